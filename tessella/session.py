"""Sessions with settings that suit these operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def session(master: str | None = None, app: str = "tessella", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; every other setting is the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a local session (tests) has a temporary folder of its own; on a cluster that is an error, since
    executors can't read each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="tessella-")
    return _OWN[key]
