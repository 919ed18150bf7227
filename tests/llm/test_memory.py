"""What is held at once: bytes of Arrow batches, sums that tasks pass on, plans of the driver."""

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import staging, sums_by_block

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batches(spark):
    """Rows and bytes of each batch of 600 texts of 50,000 characters in one partition."""
    texts = spark.range(0, 600, 1, 1).selectExpr("id", "repeat('word ', 10000) text")

    def measure(rows):
        for b in rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    yield lambda: texts.mapInArrow(measure, "rows long, bytes long").collect()
    spark.conf.unset(KEY)


def test_a_batch_of_long_texts_holds_a_few_mb(spark, batches):
    spark.conf.unset(KEY)
    staging.ship(spark)
    got = batches()
    assert sum(r.rows for r in got) == 600
    assert max(r.bytes for r in got) < 6 << 20


def test_a_limit_of_the_sessions_own_stays(spark, batches):
    spark.conf.set(KEY, "1m")
    staging.ship(spark)
    assert max(r.bytes for r in batches()) < 2 << 20


def test_sums_are_passed_on_a_few_blocks_at_a_time():
    sums = np.arange(300 * sums_by_block.BLOCK + 5, dtype=float)
    sums[: 130 * sums_by_block.BLOCK] = 0
    out, size = np.zeros(301 * sums_by_block.BLOCK), []
    for batch in sums_by_block.sent(sums):
        size.append(len(batch))
        for k, x in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            out[k * sums_by_block.BLOCK : (k + 1) * sums_by_block.BLOCK] += np.frombuffer(x.as_buffer(), np.int64)
    assert (out[: len(sums)] == sums).all() and not out[len(sums) :].any()
    assert max(size) <= sums_by_block.SENT and sum(size) == 171


def test_a_step_of_components_is_planned_from_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_NODE", 0)
    plans, written = [], staging.written
    monkeypatch.setattr(staging, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation")), written(df, name))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long")
    assert {(r.id, r.component) for r in staging.components(links).collect()} == {(i, i // 10 * 10) for i in range(40) if i % 10}
    assert max(plans) <= 16
