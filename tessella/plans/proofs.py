"""Further registered queries, each with its SQL twin: functions of the expression language, all cell operators of a
pivot, files written and read again, order made visible, and properties that samples must have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import append, filter_rows, join_rows, sample, select, wider
from ..sinks import split_by_key, split_lines, split_random, to_csv, to_tsv
from ..sources import from_html, read_csv, read_tsv
from ..session import shared_folder
from .expr import select_expr
from .registry import query, rounded

#: expression, SQL with the type of its result
TEXTS = {
    "has": ("contains(@c_name, '12')", "contains(c_name, '12')"),
    "bare": ("is_empty(@c_mktsegment)", "c_mktsegment = ''"),
    "head": ("take(@c_name, 3)", "substr(c_name, 1, 3)"),
    "tail": ("drop(@c_name, 9)", "substr(c_name, 10)"),
    "glued": ("concat(@c_name, '-', @c_custkey)", "c_name || '-' || c_custkey"),
    "tidy": ("trim('  ' ++ @c_mktsegment ++ ' ')", "c_mktsegment"),
    "seven": ("ends_with(@c_name, '7')", "ends_with(c_name, '7')"),
    "words": ("wordcount(replace(@c_mktsegment, 'I', ' '))", "CAST(len(list_filter(string_split(replace(c_mktsegment, 'I', ' '), ' '), lambda x: x <> '')) AS BIGINT)"),
    "cut": ("truncate(@c_name, 11)", "substr(c_name, 1, 8) || '...'"),
    "turned": ("reverse(@c_name)", "reverse(c_name)"),
    "fits": ("regex_match(@c_name, '[0-9]*7$')", "regexp_matches(c_name, '[0-9]*7$')"),
    "zeros": ("regex_replace(@c_name, '0+', '_')", "regexp_replace(c_name, '0+', '_', 'g')"),
    "shown": ("string(@c_custkey)", "CAST(c_custkey AS VARCHAR)"),
    "same": ("@c_custkey == 7", "c_custkey = 7"),
    "other": ("@c_mktsegment != 'BUILDING'", "c_mktsegment <> 'BUILDING'"),
    "minus": ("-@c_custkey", "CAST(-c_custkey AS BIGINT)"),
    "late": ("not (@c_custkey > 5)", "NOT c_custkey > 5"),
    "is_n": ("is_null(null)", "TRUE"),
    "is_i": ("is_int(@c_custkey)", "TRUE"),
    "is_f": ("is_float(@c_custkey / 2)", "TRUE"),
    "is_d": ("is_numeric(@c_custkey)", "TRUE"),
    "is_s": ("is_string(@c_name)", "TRUE"),
    "is_b": ("is_bool(@c_custkey > 1)", "TRUE"),
    "is_l": ("is_list(split(@c_name, '#'))", "TRUE"),
    "kind": ("type(@c_name)", "'string'"),
    "said": ("print(@c_name)", "c_name"),
    "hint": ("eprint(@c_name)", "c_name"),
}
NUMBERS = {
    "whole": ("int(@c_custkey ++ '')", "CAST(c_custkey AS BIGINT)"),
    "real": ("float(@c_custkey)", "CAST(c_custkey AS DOUBLE)"),
    "up": ("ceil(@c_custkey / 7)", "CAST(ceil(c_custkey / 7.0) AS BIGINT)"),
    "power": ("pow(@c_custkey, 2)", "CAST(c_custkey AS DOUBLE) ** 2"),
    "s": ("sin(@c_custkey)", "sin(c_custkey)"),
    "c": ("cos(@c_custkey)", "cos(c_custkey)"),
    "t": ("tan(@c_custkey)", "tan(c_custkey)"),
    "digits": ("log10(@c_custkey + 1)", "log10(c_custkey + 1)"),
    "grown": ("exp(@c_custkey / 1000)", "exp(c_custkey / 1000.0)"),
}
_W = "string_split(p_type, ' ')"
LISTS = {
    "final": ("last(@w)", f"{_W}[-1]"),
    "back": ("join(reverse(@w), ' ')", f"array_to_string(list_reverse({_W}), ' ')"),
    "second": ("nth(@w, 1)", f"{_W}[2]"),
    "patched": ("join(replace_nth(@w, 0, 'x'), ' ')", f"array_to_string(list_prepend('x', {_W}[2:]), ' ')"),
    "sorted": ("join(sort(@w), ' ')", f"array_to_string(list_sort({_W}), ' ')"),
    "shortest": ("char_len(first(sort_by(@w, x => char_len(x))))", f"CAST(list_min(list_transform({_W}, lambda x: length(x))) AS BIGINT)"),
    "distinct_words": ("len(unique(concat(@w, @w)))", f"CAST(len(list_distinct({_W})) AS BIGINT)"),
    "middle": ("join(slice(@w, 1, 3), ' ')", f"array_to_string({_W}[2:3], ' ')"),
    "letters": ("reduce(@w, 0, (a, x) => a + char_len(x))", f"CAST(list_sum(list_transform({_W}, lambda x: length(x))) AS BIGINT)"),
    "till": ("len(take_while(@w, x => x != 'BRASS'))", f"CAST(coalesce(nullif(list_position({_W}, 'BRASS'), 0) - 1, len({_W})) AS BIGINT)"),
    "steps": ("join(range(1, 4), ',')", "'1,2,3'"),
    "flat": ("join(flatten([@w, @w]), ' ')", "p_type || ' ' || p_type"),
    "pairs": ("len(zip(@w, @w))", f"CAST(len({_W}) AS BIGINT)"),
    "sides": ("len(partition(@w, x => char_len(x) > 5))", "CAST(2 AS BIGINT)"),
    "doubled": ("join(flat_map(@w, x => [x, x]), ' ')", f"array_to_string(flatten(list_transform({_W}, lambda x: [x, x])), ' ')"),
    "groups": ("len(grouped(@w, 2))", f"CAST(ceil(len({_W}) / 2.0) AS BIGINT)"),
    "places": ("join(filter_index(@w, x => char_len(x) > 5), ',')", f"array_to_string(list_filter(list_transform({_W}, lambda x, i: CASE WHEN length(x) > 5 THEN CAST(i - 1 AS VARCHAR) END), lambda y: y IS NOT NULL), ',')"),
    "holds": ("contains(@w, 'BRASS')", f"list_contains({_W}, 'BRASS')"),
    "few": ("join(take(@w, 2), ' ')", f"array_to_string({_W}[1:2], ' ')"),
    "rest": ("join(drop(@w, 2), ' ')", f"array_to_string({_W}[3:], ' ')"),
}


def _expr(rows: dict[str, tuple[str, str]], key: str, before: str = "") -> str:
    return f"{before}[@{key}, " + ", ".join(f"{e} as @{n}" for n, (e, _) in rows.items()) + "]"


def _sql(rows: dict[str, tuple[str, str]], key: str, table: str, places: int | None = None) -> str:
    shown = lambda s: f"round({s}, {places})" if places is not None and "BIGINT" not in s else s
    return f"SELECT {key}, " + ", ".join(f"{shown(s)} AS {n}" for n, (_, s) in rows.items()) + f" FROM {table}"


@query(_sql(TEXTS, "c_custkey", "customer"))
def functions_of_text(t):
    return select_expr(t("customer"), _expr(TEXTS, "c_custkey"))


@query(_sql(NUMBERS, "c_custkey", "customer", 5))
def functions_of_numbers(t):
    return rounded(select_expr(t("customer"), _expr(NUMBERS, "c_custkey")), 5)


@query(_sql(LISTS, "p_partkey", "part"))
def functions_of_lists(t):
    return select_expr(t("part"), _expr(LISTS, "p_partkey", "split(@p_type, ' ') as @w; "))


@query("SELECT count(*) AS n, TRUE AS later, TRUE AS versioned, TRUE AS placed, TRUE AS named, NULL::VARCHAR AS unset FROM region")
def functions_of_the_system(t):
    out = select_expr(t("region"), "[now() as @now, version() as @version, platform() as @platform, cwd() as @cwd, env('TESSELLA_NO_SUCH_NAME') as @unset]")
    full = lambda c: F.bool_and(F.length(c) > 0)
    return out.agg(F.count("*").alias("n"), F.bool_and(F.col("now") > F.lit("2024-01-01").cast("timestamp")).alias("later"), full("version").alias("versioned"), full("cwd").alias("placed"), full("platform").alias("named"), F.max("unset").cast("string").alias("unset"))


# pivots: every cell operator, side by side
_CELLS = {
    "first": "arg_min(o_totalprice, o_orderkey)", "last": "arg_max(o_totalprice, o_orderkey)", "sum": "sum(o_totalprice)", "min": "min(o_totalprice)",
    "max": "max(o_totalprice)", "mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)", "variance": "var_samp(o_totalprice) / 1e6",
    "stdev": "stddev_samp(o_totalprice)", "q1": "quantile_cont(o_totalprice, 0.25)", "q3": "quantile_cont(o_totalprice, 0.75)",
    "iqr": "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)", "range": "max(o_totalprice) - min(o_totalprice)",
}
_WORDS = {
    "count": "CAST(count(*) AS BIGINT)", "nunique": "CAST(count(DISTINCT o_custkey % 5) AS BIGINT)",
    "values": "string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey)", "unique_values": "string_agg(DISTINCT (o_custkey % 5)::VARCHAR, '|' ORDER BY (o_custkey % 5)::VARCHAR)",
}


def _filtered(sql: str, status: str) -> str:
    """Each aggregate of an SQL expression, over one status only."""
    out, depth, start = "", 0, True
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        out += ch
        if ch == ")" and depth == 0 and not sql.startswith("CAST"):
            out += f" FILTER (o_orderstatus = '{status}')"
    return out.replace(") AS BIGINT)", f") FILTER (o_orderstatus = '{status}') AS BIGINT)") if sql.startswith("CAST") else out


def _pivots(t, ops, value: str) -> DataFrame:
    orders = t("orders").where("o_orderkey % 3 > 0 or o_orderstatus != 'P'").withColumn("k", F.col("o_custkey") % 5)
    out = orders.select("o_orderpriority").distinct()
    for op in ops:
        of = "o_orderkey" if op == "values" else value
        made = wider(orders, "o_orderstatus", of, "o_orderpriority", op=op, names=["F", "O"], order_by=["o_orderkey"])
        made = made.select("o_orderpriority", *(F.col(s).alias(f"{op}_{s}") for s in ("F", "O")))
        out = out.join(made, "o_orderpriority")
    return out


_FROM = "FROM (SELECT * FROM orders WHERE o_orderkey % 3 > 0 OR o_orderstatus <> 'P') GROUP BY 1"


@query("SELECT o_orderpriority, " + ", ".join(f"round({_filtered(sql, s)}, 4) AS {op}_{s}" for op, sql in _CELLS.items() for s in "FO") + f" {_FROM}")
def pivot_numbers(t):
    out = _pivots(t, _CELLS, "o_totalprice")
    return rounded(out.withColumns({f"variance_{s}": F.col(f"variance_{s}") / 1e6 for s in "FO"}), 4)


@query("SELECT o_orderpriority, " + ", ".join(f"{_filtered(sql, s)} AS {op}_{s}" for op, sql in _WORDS.items() for s in "FO") + f" {_FROM}")
def pivot_words(t):
    return _pivots(t, _WORDS, "k")


@query("""
    WITH c AS (SELECT c_nationkey, c_mktsegment, c_nationkey % 2 AS half, count(*) AS n FROM customer GROUP BY ALL),
         b AS (SELECT c_nationkey, half, arg_min(c_mktsegment, (-n, c_mktsegment)) AS m FROM c GROUP BY ALL)
    SELECT c_nationkey, max(m) FILTER (half = 0) AS even, max(m) FILTER (half = 1) AS odd FROM b GROUP BY 1""")
def pivot_mode(t):
    halves = t("customer").withColumn("half", F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd"))
    return wider(halves, "half", "c_mktsegment", "c_nationkey", op="mode", names=["even", "odd"])


# files ----------------------------------------------------------------------------------------------------------------


def _folder(df: DataFrame, name: str) -> str:
    """A path of this run's own below the shared folder; what is written there goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


_DOCS = """SELECT doc_id::VARCHAR AS doc_id, replace(replace(replace(text, chr(9), ' '), chr(10), '{0}'), chr(13), '{0}') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           n_chars::VARCHAR AS n_chars FROM documents"""


@query(_DOCS.format(" "))
def csv_round_trip(t):
    docs = t("documents")
    path = _folder(docs, "csv")
    to_csv(docs, path)
    return read_csv(docs.sparkSession, path)


@query(_DOCS.format("/"))
def tsv_round_trip(t):
    docs = t("documents").withColumn("text", F.regexp_replace(F.regexp_replace("text", "\\t", " "), "[\\r\\n]", "/"))
    path = _folder(docs, "tsv")
    to_tsv(docs, path)
    return read_tsv(docs.sparkSession, path)


# samples: what must hold of any of them ---------------------------------------------------------------------------------


def _facts(**facts) -> DataFrame:
    frames = [df.select(F.lit(name).alias("fact"), F.col("x").cast("boolean").alias("holds")) for name, df in ((n, d.toDF("x")) for n, d in facts.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _true(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS fact, TRUE AS holds" for n in names)


@query(_true("subset", "near_its_share", "nested", "key_whole", "key_share"))
def sample_by_chance(t):
    events = t("events")
    some = sample(events, prob=0.1, seed=7)
    small, large = (sample(events, prob=p, order_by=["event_id"], stable=True) for p in (0.1, 0.3))
    keyed = sample(events, prob=0.2, key="user_id", seed=7)
    n = events.agg(F.count("*").alias("n"))
    split = events.join(keyed.select("event_id").withColumn("kept", F.lit(1)), "event_id", "left").groupBy("user_id").agg(F.min(F.coalesce("kept", F.lit(0))).alias("a"), F.max(F.coalesce("kept", F.lit(0))).alias("b"))
    return _facts(
        subset=some.exceptAll(events).agg(F.count("*") == 0),
        near_its_share=some.agg(F.count("*").alias("k")).crossJoin(n).selectExpr("abs(k - 0.1 * n) < 6 * sqrt(0.09 * n)"),
        nested=small.join(large, "event_id", "left_anti").agg(F.count("*") == 0),
        key_whole=split.agg(F.bool_and(F.col("a") == F.col("b"))),
        key_share=split.agg(F.avg("a").between(0.05, 0.45)),
    )


@query(_true("of_size", "distinct", "smaller_in_larger", "in_order", "no_weightless", "heavy_first", "replaced_size", "replaced_from_all"))
def sample_by_number(t):
    events, orders = t("events"), t("orders")
    small, large = (sample(events, n=k, order_by=["event_id"], stable=True, in_order=True) for k in (200, 500))
    seen = large.withColumn("at", F.monotonically_increasing_id()).select("event_id", F.lag("event_id").over(Window.orderBy("at")).alias("before"))
    line = t("lineitem").withColumn("w", F.when(F.col("l_quantity") < 10, 0.0).otherwise(F.col("l_quantity")))
    heavy = sample(line, n=1000, weight="w", seed=7)
    drawn = sample(orders, n=300, replace=True, order_by=["o_orderkey"])
    apart = sample(orders, n=300, replace=True)
    return _facts(
        of_size=large.agg(F.count("*") == 500),
        distinct=large.agg(F.count_distinct("event_id") == 500),
        smaller_in_larger=small.join(large, "event_id", "left_anti").agg(F.count("*") == 0),
        in_order=seen.agg(F.bool_and(F.coalesce(F.col("before") < F.col("event_id"), F.lit(True)))),
        no_weightless=heavy.agg(F.min("l_quantity") >= 10),
        heavy_first=heavy.agg(F.avg("l_quantity").alias("a")).crossJoin(line.where("w > 0").agg(F.avg("l_quantity").alias("b"))).selectExpr("a > b"),
        replaced_size=drawn.agg(F.count("*") == 300),
        replaced_from_all=apart.join(orders, "o_orderkey").agg(F.count("*") == 300),
    )


# lists of several items, shown item by item
_M = "string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')"
ITEMS = {
    "pairs": ("join(flatten(zip(@m, reverse(@m))), ' ')", f"array_to_string(flatten(list_transform(list_zip({_M}, list_reverse({_M})), lambda p: [p[1], p[2]])), ' ')"),
    "groups": ("join(map(grouped(@m, 2), g => join(g, '+')), ' ')", f"concat_ws(' ', array_to_string({_M}[1:2], '+'), array_to_string({_M}[3:4], '+'))"),
    "sides": ("join(flatten(partition(@m, x => char_len(x) > 5)), ' ')", f"array_to_string(list_concat(list_filter({_M}, lambda x: length(x) > 5), list_filter({_M}, lambda x: length(x) <= 5)), ' ')"),
    "once": ("join(unique(concat(@m, @m)), ' ')", f"array_to_string({_M}, ' ')"),
    "by_end": ("join(sort_by(@m, x => reverse(x)), ' ')", f"array_to_string(list_transform(list_sort(list_transform({_M}, lambda x: reverse(x))), lambda x: reverse(x)), ' ')"),
    "head": ("join(take_while(@m, x => char_len(x) < 6), ' ')", f"array_to_string({_M}[1:coalesce(list_position(list_transform({_M}, lambda x: length(x) >= 6), TRUE), 5) - 1], ' ')"),
    "counted": ("join(map(range(0, len(@m)), i => i * 2), ',')", f"array_to_string(list_transform(range(0, len({_M})), lambda i: i * 2), ',')"),
}


@query(_sql(ITEMS, "p_partkey", "part"))
def functions_of_items(t):
    return select_expr(t("part"), _expr(ITEMS, "p_partkey", "split(@p_name ++ ' ' ++ @p_type ++ ' ' ++ @p_brand, ' ') as @m; "))


# types that differ by row
KINDS = {
    "none": ("is_null(regex_extract(@p_brand, '[13]'))", "NOT regexp_matches(p_brand, '[13]')"),
    "whole": ("is_numeric(@p_size) and is_int(@p_size)", "TRUE"),
    "kinds": ("type(@p_size) ++ ' ' ++ type(@p_retailprice) ++ ' ' ++ type(@p_name)", "'int float string'"),
    "unless": ("default(regex_extract(@p_brand, '[13]'), 'other')", "CASE WHEN regexp_matches(p_brand, '[13]') THEN regexp_extract(p_brand, '[13]') ELSE 'other' END"),
}


@query(_sql(KINDS, "p_partkey", "part"))
def functions_of_types(t):
    return select_expr(t("part"), _expr(KINDS, "p_partkey"))


# filters and joins whose results hold rows
@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 9 AND strlen(p_type) <= 6")
def filter_lengths(t):
    return select(filter_rows(t("part"), char_len_gt="p_name:9", byte_len_le="p_type:6"), "p_partkey,p_name")


@query("""
    SELECT p_partkey, p_name || repeat(chr(769), p_size % 3) AS marked FROM part
    WHERE length_grapheme(p_name || repeat(chr(769), p_size % 3)) <= 9 AND strlen(p_name || repeat(chr(769), p_size % 3)) > 9""")
def filter_graphemes(t):
    """A letter with its combining marks is one character, of several bytes."""
    marked = t("part").withColumn("marked", F.concat("p_name", F.repeat(F.lit("́"), F.col("p_size") % 3)))
    return select(filter_rows(marked, char_len_le="marked:9", byte_len_gt="marked:9"), "p_partkey,marked")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def join_anti_rows(t):
    dear = filter_rows(t("orders"), gt="o_totalprice:150000")
    return select(join_rows(t("customer"), dear, "o_custkey", "c_custkey", exclude=True), "c_custkey,c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_mktsegment) <> 'machinery'")
def filter_istr_any(t):
    return select(filter_rows(t("customer"), any_of=True, istr_eq="c_mktsegment:Building", istr_ne="c_mktsegment:Machinery"), "c_custkey,c_name")


# files ----------------------------------------------------------------------------------------------------------------


def _place(t, name):
    return f"{shared_folder(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, 'c' AS origin FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, 's' FROM supplier")
def tsv_two_files(t):
    """Two files one after the other, each with its header, in the order of their lines."""
    spark, folder = t("region").sparkSession, _place(t, "two")
    for name, key, origin in (("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s")):
        side = t(name)
        to_tsv(side.select(F.col(key).alias("key"), F.col(f"{name[0]}_name").alias("name"), F.lit(origin).alias("origin")), f"{folder}/{name}", single=True)
    return read_tsv(spark, [f"{folder}/customer", f"{folder}/supplier"])


@query("""
    SELECT o_orderkey::VARCHAR AS o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT o_orderkey::VARCHAR, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_reordered_files(t):
    """Keys go by name in every file: the two data files have their columns in different orders."""
    spark, folder, out = t("region").sparkSession, _place(t, "reordered"), []
    to_tsv(t("customer").select("c_name", "c_custkey"), f"{folder}/lookup", single=True)
    lookup = read_tsv(spark, f"{folder}/lookup").withColumnRenamed("c_custkey", "o_custkey")
    for k, columns in enumerate((["o_orderkey", "o_custkey"], ["o_custkey", "o_orderkey"])):
        to_tsv(t("orders").select(*columns), f"{folder}/data{k}", single=True)
        out.append(select(join_rows(read_tsv(spark, f"{folder}/data{k}"), lookup, "o_custkey", append="c_name"), "o_orderkey,c_name"))
    return append(out)


@query("""
    WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)
    SELECT 'lines' AS way, o_orderkey::VARCHAR AS o_orderkey, (n // 1000)::INTEGER AS part FROM n
    UNION ALL SELECT 'random', o_orderkey::VARCHAR, 0 FROM n UNION ALL SELECT 'key', o_orderkey::VARCHAR, 0 FROM n""")
def split_files(t):
    """Orders split by number of rows, at random and by key, read back; of the latter two every row once, of a key one part."""
    spark, folder = t("region").sparkSession, _place(t, "split")
    orders = select(t("orders"), "o_orderkey,o_custkey")
    split_lines(orders, f"{folder}/lines", 1000, ["o_orderkey"])
    split_random(orders, f"{folder}/random", 7)
    split_by_key(orders, f"{folder}/key", 7, "o_custkey")
    back = {w: spark.read.csv(f"{folder}/{w}", sep="\t", header=True) for w in ("lines", "random", "key")}
    parts = back["key"].groupBy("o_custkey").agg((F.count_distinct("part") - 1).cast("int").alias("part"))
    keyed = back["key"].drop("part").join(parts, "o_custkey")
    within = F.when(F.col("part").between(0, 6), 0).otherwise(1).alias("part")
    return (
        back["lines"].select(F.lit("lines").alias("way"), "o_orderkey", F.col("part").cast("int").alias("part"))
        .union(back["random"].select(F.lit("random"), "o_orderkey", within)).union(keyed.select(F.lit("key"), "o_orderkey", "part"))
    )


@query("""
    SELECT p_partkey AS page, 1 AS n, 'part' AS a, 'name' AS b, 'dear' AS c FROM part
    UNION ALL SELECT p_partkey, 2, p_partkey::VARCHAR, p_name, (p_retailprice > 1000)::VARCHAR FROM part""")
def html_tables(t):
    """A page a part, whose second table is read: a header and a row of three cells."""
    cells = F.concat(F.lit("<table><tr><th>part<th>name<th>dear</tr><tr><td>"), "p_partkey", F.lit("</td><td><b>"), "p_name", F.lit("</b></td><td>"), (F.col("p_retailprice") > 1000).cast("string"), F.lit("</table>"))
    pages = t("part").select(F.col("p_partkey").alias("page"), F.concat(F.lit("<html><body><table><tr><td>no</table><p>then</p>"), cells).alias("html"))
    return from_html(pages, id_col="page", table=True, index=2).select("page", "n", *(F.col("cells")[i].alias(c) for i, c in enumerate("abc")))
