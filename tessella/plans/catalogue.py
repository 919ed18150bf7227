"""Registered queries over the driver's tables, each with its SQL twin where SQL can say the same.

Floating results are rounded on both sides; ordered operators show their rank as a column, since results are compared
without order. Every query runs over whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import (
    append,
    bin2d,
    bin_values,
    blank,
    box_stats,
    except_left,
    fill,
    filter_rows,
    intersect_left,
    join_rows,
    longer,
    nl,
    regression,
    reverse,
    running_sum,
    select,
    slice_rows,
    sort_rows,
    stats,
    transpose,
    union_distinct,
    uniq,
    wider,
)
from ..operators.aggregates import aggregate_rows
from ..operators.sketches import merge_sketches, quantile_sketches, sketch_quantiles
from ..session import shared_folder
from ..sinks.transposed import read_transposed, write_transposed
from ..sources import from_html
from ..streaming import stream
from ..streaming.ordered import OrderedSteps, released_rows, run_ordered
from .expr import extend, mutate, select_expr, skip_null
from .expr.api import running
from .registry import ORACLE_SQL, QUERIES, query, rounded

LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount"
_LINE = LINE.replace(" ", "")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity) AS l_quantity_sum,
           round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(quantile_cont(l_discount, 0.5), 4) AS l_discount_median,
           count(DISTINCT l_suppkey) AS l_suppkey_nunique
    FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R' GROUP BY 1, 2""")
def flagship(t):
    rows = filter_rows(t("lineitem"), gt="l_quantity:10", str_eq="l_returnflag:R")
    out = stats(rows, "l_returnflag,l_linestatus", count=True, sum="l_quantity", mean="l_extendedprice", median="l_discount", nunique="l_suppkey")
    return rounded(out, 4, "l_extendedprice_mean", "l_discount_median")


# filters --------------------------------------------------------------------------------------------------------------


@query(f"SELECT {LINE} FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.05")
def filter_numeric_and(t):
    return select(filter_rows(t("lineitem"), gt=["l_quantity:10", "l_discount:0.05"]), _LINE)


@query(f"SELECT {LINE} FROM lineitem WHERE NOT (l_quantity < 25 OR l_returnflag = 'N')")
def filter_or_invert(t):
    return select(filter_rows(t("lineitem"), any_of=True, invert=True, lt="l_quantity:25", str_eq="l_returnflag:N"), _LINE)


@query("SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN l_tax >= 0.04 THEN 'high' ELSE 'low' END AS level FROM lineitem")
def filter_label(t):
    return select(filter_rows(t("lineitem"), ge="l_tax:0.04", label="level", label_values=("high", "low")), "l_orderkey,l_linenumber,l_tax,level")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_extendedprice <= 50000")
def filter_count(t):
    return filter_rows(t("lineitem"), count=True, gt="l_quantity:10", le="l_extendedprice:50000")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '[A-Z]+ED|^STANDARD') AND NOT regexp_matches(lower(p_brand), '#1')")
def filter_regex(t):
    return select(filter_rows(t("part"), regex="p_type:[A-Z]+ED|^STANDARD", not_iregex="p_brand:#1"), "p_partkey,p_type")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_mktsegment) <> 'machinery' AND c_custkey < 50")
def filter_istr(t):
    customer = t("customer")
    both = filter_rows(customer, istr_ne="c_mktsegment:Machinery", lt="c_custkey:50")
    return select(filter_rows(customer, istr_eq="c_mktsegment:Building").union(both).distinct(), "c_custkey,c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '7') AND NOT contains(lower(c_mktsegment), 'auto') AND c_name >= 'Customer#000000100'")
def filter_substr(t):
    return select(filter_rows(t("customer"), str_in_fld="c_name:7", istr_not_in_fld="c_mktsegment:AUTO", str_ge="c_name:Customer#000000100"), "c_custkey,c_name")


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 12 AND strlen(p_type) <= 20")
def filter_len(t):
    return select(filter_rows(t("part"), char_len_gt="p_name:12", byte_len_le="p_type:20"), "p_partkey,p_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE coalesce(o_orderpriority, '') <> '' AND o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)")
def filter_present(t):
    return select(filter_rows(t("orders"), not_empty="o_orderpriority", not_blank="o_orderpriority", is_numeric="o_totalprice", is_finite="o_totalprice"), "o_orderkey,o_orderpriority")


@query(f"SELECT {LINE} FROM lineitem WHERE l_orderkey > l_partkey AND l_discount <> l_tax")
def filter_ff_numeric(t):
    return select(filter_rows(t("lineitem"), ff_gt="l_orderkey:l_partkey", ff_ne="l_discount:l_tax"), _LINE)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = o_orderpriority OR o_orderstatus <> o_orderpriority")
def filter_ff_text(t):
    return select(filter_rows(t("orders"), any_of=True, ff_str_eq="o_orderstatus:o_orderpriority", ff_istr_ne="o_orderstatus:o_orderpriority"), "o_orderkey,o_custkey")


@query(f"SELECT {LINE} FROM lineitem WHERE abs(l_partkey - l_suppkey) <= 100")
def filter_absdiff(t):
    return select(filter_rows(t("lineitem"), ff_absdiff_le="l_partkey:l_suppkey:100"), _LINE)


@query(f"""
    SELECT {LINE} FROM lineitem
    WHERE CASE WHEN l_orderkey = l_partkey THEN 0 WHEN least(abs(l_orderkey), abs(l_partkey)) = 0 THEN 'inf'::DOUBLE
          ELSE abs(l_orderkey::DOUBLE - l_partkey) / least(abs(l_orderkey::DOUBLE), abs(l_partkey)) END > 2.5""")
def filter_reldiff(t):
    return select(filter_rows(t("lineitem"), ff_reldiff_gt="l_orderkey:l_partkey:2.5"), _LINE)


@query(f"SELECT {LINE} FROM lineitem WHERE l_quantity * l_extendedprice > 1000000 AND l_returnflag IN ('A', 'R')")
def filter_expr(t):
    return select(filter_rows(t("lineitem"), expr="@l_quantity * @l_extendedprice > 1000000 and (@l_returnflag eq 'A' or @l_returnflag eq 'R')"), _LINE)


# projections ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_size, p_retailprice, p_name FROM part")
def select_rest(t):
    return select(t("part"), "p_name", exclude="p_type", rest="first")


@query("SELECT l_orderkey, l_shipdate, l_returnflag, l_linestatus FROM lineitem")
def select_ranges(t):
    return select(t("lineitem"), "1,11,9-10")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, floor((l_extendedprice - 900) / 500) * 500 + 900 AS bin FROM lineitem")
def bin_price(t):
    return select(bin_values(t("lineitem"), "l_extendedprice", 500, 900, "bin"), "l_orderkey,l_linenumber,l_extendedprice,bin")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem")
def extend_revenue(t):
    out = extend(t("lineitem"), net="@l_extendedprice * (1 - @l_discount)", gross="@l_extendedprice * (1 - @l_discount) as @n; @n * (1 + @l_tax)")
    return rounded(select(out, "l_orderkey,l_linenumber,net,gross"), 6)


@query("SELECT p_partkey, upper(p_brand) AS p_brand, round(p_retailprice * 1.1, 4) AS p_retailprice FROM part")
def mutate_price(t):
    return rounded(select(mutate(mutate(t("part"), "upper(@p_brand) as @p_brand"), "@p_retailprice * 1.1 as @p_retailprice"), "p_partkey,p_brand,p_retailprice"), 4)


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'small' END AS class,
           o_orderkey % 7 AS week, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands
    FROM orders""")
def expr_case(t):
    return select_expr(t("orders"), "[@o_orderkey, if(@o_totalprice > 200000, 'big', if(@o_orderstatus eq 'F', 'done', 'small')) as @class, @o_orderkey % 7 as @week, floor(@o_totalprice / 1000) as @thousands]")


@query("""
    SELECT c_custkey, lower(c_name) AS low, substr(c_name, 10, 4) AS piece, replace(c_name, '0', 'o') AS swapped,
           c_mktsegment || '/' || c_custkey AS tag, length(c_name) AS size, starts_with(c_mktsegment, 'B') AS b
    FROM customer""")
def expr_string(t):
    return select_expr(t("customer"), "[@c_custkey, @c_name.lower() as @low, @c_name | substr(_, 9, 4) as @piece, replace(@c_name, '0', 'o') as @swapped, @c_mktsegment ++ '/' ++ @c_custkey as @tag, char_len(@c_name) as @size, starts_with(@c_mktsegment, 'B') as @b]")


@query("""
    SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: lower(x)), '-') AS joined,
           len(list_filter(string_split(p_type, ' '), lambda x: length(x) > 5)) AS long_words, string_split(p_type, ' ')[1] AS first
    FROM part""")
def expr_list_hof(t):
    return select_expr(t("part"), "split(@p_type, ' ') as @w; [@p_partkey, join(map(@w, x => lower(x)), '-') as @joined, len(filter(@w, x => char_len(x) > 5)) as @long_words, first(@w) as @first]")


@query("""
    SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS root, round(ln(o_totalprice), 4) AS log, round(o_totalprice ** 2 / 1000, 2) AS sq,
           CAST(round(o_totalprice) AS BIGINT) AS whole, least(o_custkey, 500) AS low, greatest(o_custkey, 500) AS high, abs(o_custkey - 700) AS off
    FROM orders""")
def expr_numeric(t):
    out = select_expr(t("orders"), "[@o_orderkey, sqrt(@o_totalprice) as @root, ln(@o_totalprice) as @log, @o_totalprice ** 2 / 1000 as @sq, round(@o_totalprice) as @whole, min(@o_custkey, 500) as @low, max(@o_custkey, 500) as @high, abs(@o_custkey - 700) as @off]")
    return rounded(rounded(out, 4, "root", "log"), 2, "sq")


@query("SELECT regexp_extract(props, '[0-9]+') AS k FROM events WHERE regexp_matches(props, '[0-9]+')")
def expr_skip_null(t):
    return skip_null(t("events"), "regex_extract(@props, '[0-9]+') as @k")


@query("""
    SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, base64(c_name::BLOB) AS b, c_name AS back FROM customer""")
def hash_md5_sha(t):
    return select_expr(t("customer"), "[@c_custkey, md5(@c_name) as @m, sha256(@c_name) as @s, base64(@c_name) as @b, unbase64(base64(@c_name)) as @back]")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day, strftime(o_orderdate, '%d.%m.%y %H:%M') AS short FROM orders")
def strptime_strftime(t):
    return select_expr(t("orders"), "strptime(strftime(@o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as @d; [@o_orderkey, strftime(@d, '%Y/%m/%d') as @day, strftime(@d, '%d.%m.%y %H:%M') as @short]")


@query("SELECT p_partkey, printf('%s [%6d] %.2f', p_brand, p_size, p_retailprice) AS line FROM part")
def expr_fmt(t):
    return select_expr(t("part"), "[@p_partkey, fmt('%() [%(:6)] %(:.2)', @p_brand, @p_size, @p_retailprice) as @line]")


# statistics -----------------------------------------------------------------------------------------------------------


@query("""
    SELECT l_returnflag, count(*) AS count, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
           round(max(l_extendedprice) - min(l_extendedprice), 2) AS l_extendedprice_range, round(avg(l_discount), 6) AS l_discount_mean
    FROM lineitem GROUP BY 1""")
def stats_basic(t):
    out = stats(t("lineitem"), "l_returnflag", count=True, sum="l_extendedprice", min="l_quantity", max="l_quantity", range="l_extendedprice", mean="l_discount")
    return rounded(rounded(out, 2, "l_extendedprice_sum", "l_extendedprice_range"), 6, "l_discount_mean")


@query("""
    SELECT l_linestatus, round(var_samp(l_quantity), 4) AS l_quantity_variance, round(stddev_samp(l_extendedprice), 2) AS l_extendedprice_stdev,
           round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS l_quantity_cv
    FROM lineitem GROUP BY 1""")
def stats_moments(t):
    out = stats(t("lineitem"), "l_linestatus", variance="l_quantity", stdev="l_extendedprice", cv="l_quantity")
    return rounded(rounded(rounded(out, 4, "l_quantity_variance"), 2, "l_extendedprice_stdev"), 6, "l_quantity_cv")


@query("""
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice_median, round(quantile_cont(l_extendedprice, 0.25), 4) AS l_extendedprice_q1,
           round(quantile_cont(l_extendedprice, 0.75), 4) AS l_extendedprice_q3, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 4) AS l_quantity_iqr,
           round(quantile_cont(l_extendedprice, 0.1), 4) AS "l_extendedprice_quantile_0.1", round(quantile_cont(l_extendedprice, 0.9), 4) AS "l_extendedprice_quantile_0.9"
    FROM lineitem GROUP BY 1""")
def stats_quantiles(t):
    out = stats(t("lineitem"), "l_returnflag", median="l_extendedprice", q1="l_extendedprice", q3="l_extendedprice", iqr="l_quantity", quantile="l_extendedprice:0.1,0.9")
    return out.select("l_returnflag", *(F.round(F.col(f"`{c}`"), 4).alias(c) for c in out.columns[1:]))


@query("""
    WITH m AS (SELECT o_orderstatus AS k, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1)
    SELECT o_orderstatus, round(quantile_cont(abs(o_totalprice - m), 0.5) * 1.4826, 4) AS o_totalprice_mad FROM orders JOIN m ON o_orderstatus = k GROUP BY 1""")
def stats_mad(t):
    return rounded(stats(t("orders"), "o_orderstatus", mad="o_totalprice"), 4)


@query("""
    SELECT l_linestatus, round(exp(avg(ln(l_quantity))), 6) AS l_quantity_geomean, round(count(*) / sum(1 / l_quantity), 6) AS l_quantity_harmmean
    FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def stats_geo_harm(t):
    return rounded(stats(t("lineitem"), "l_linestatus", geomean="l_quantity", harmmean="l_quantity"), 6)


@query("""
    WITH c AS (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, p) AS k FROM c)
    SELECT o_orderstatus, p AS o_orderpriority_mode, n AS o_orderpriority_mode_count FROM r WHERE k = 1""")
def stats_mode(t):
    return stats(t("orders"), "o_orderstatus", mode="o_orderpriority", mode_count="o_orderpriority")


@query("""
    SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name_values, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS n_name_unique_values,
           count(*) FILTER (coalesce(n_name, '') = '') AS n_name_missing_count, count(*) FILTER (coalesce(n_name, '') <> '') AS n_name_not_missing_count
    FROM nation GROUP BY 1""")
def stats_values(t):
    return stats(t("nation"), "n_regionkey", order_by=["n_nationkey"], values_delimiter=",", values="n_name", unique_values="n_name", missing_count="n_name", not_missing_count="n_name")


@query("""
    SELECT user_id, arg_min(event_type, event_id) AS event_type_first, arg_max(event_type, event_id) AS event_type_last FROM events GROUP BY 1""")
def stats_first_last(t):
    return stats(t("events"), "user_id", order_by=["event_id"], first="event_type", last="event_type")


@query("SELECT count(*) AS count, count(DISTINCT l_orderkey) AS l_orderkey_nunique, round(sum(l_quantity), 2) AS total FROM lineitem")
def stats_global(t):
    out = stats(t("lineitem"), count=True, nunique="l_orderkey", sum="l_quantity:total")
    return rounded(out, 2)


@query("""
    SELECT event_type, round(avg(CASE WHEN event_id % 7 = 0 THEN 100 ELSE value END), 4) AS value_mean
    FROM events GROUP BY 1""")
def stats_replace_missing(t):
    holes = t("events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return rounded(stats(holes, "event_type", mean="value", replace_missing=100), 4)


# reshaping ------------------------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O",
           round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P"
    FROM orders GROUP BY 1""")
def pivot_sum(t):
    out = wider(t("orders"), "o_orderstatus", "o_totalprice", "o_orderpriority", op="sum", names_sort=True)
    return rounded(out, 2)


@query("""
    SELECT n_regionkey, coalesce(count(*) FILTER (n_name < 'F'), 0) AS early, coalesce(count(*) FILTER (n_name >= 'F'), 0) AS late FROM nation GROUP BY 1""")
def pivot_count_fill(t):
    halves = t("nation").withColumn("half", F.when(F.col("n_name") < "F", "early").otherwise("late"))
    return wider(halves, "half", id_cols="n_regionkey", op="count", fill=0, names=["early", "late"])


@query("""
    SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def pivot_last(t):
    return wider(t("events"), "event_type", "value", "user_id", order_by=["event_id"], names=["click", "purchase"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS name, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_extendedprice', l_extendedprice FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem""")
def unpivot_prices(t):
    return longer(select(t("lineitem"), "l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount"), "l_quantity-l_discount")


@query("""
    SELECT p_partkey, 'retail' AS what, 'price' AS kind, CAST(p_retailprice AS DOUBLE) AS v FROM part
    UNION ALL SELECT p_partkey, 'pack', 'size', CAST(p_size AS DOUBLE) FROM part""")
def unpivot_names_sep(t):
    part = t("part").select("p_partkey", F.col("p_retailprice").alias("x_retail_price"), F.col("p_size").cast("double").alias("x_pack_size"))
    return longer(part, "x_*", names_to=["what", "kind"], values_to="v", names_sep="_", names_prefix="x_")


@query("""
    SELECT f AS field, r1, r2, r3, r4, r5 FROM (
      SELECT 'r_regionkey' AS f, max(r_regionkey::VARCHAR) FILTER (n = 1) AS r1, max(r_regionkey::VARCHAR) FILTER (n = 2) AS r2, max(r_regionkey::VARCHAR) FILTER (n = 3) AS r3, max(r_regionkey::VARCHAR) FILTER (n = 4) AS r4, max(r_regionkey::VARCHAR) FILTER (n = 5) AS r5
      FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS n FROM region)
      UNION ALL SELECT 'r_name', max(r_name) FILTER (n = 1), max(r_name) FILTER (n = 2), max(r_name) FILTER (n = 3), max(r_name) FILTER (n = 4), max(r_name) FILTER (n = 5)
      FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS n FROM region))""")
def transpose_region(t):
    return transpose(t("region"), ["r_regionkey"])


# joins and sets -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi(t):
    return select(join_rows(t("orders"), filter_rows(t("customer"), str_eq="c_mktsegment:BUILDING"), "c_custkey", "o_custkey"), "o_orderkey,o_custkey")


@query("SELECT o_orderkey, o_custkey, c_name AS cust_c_name, c_mktsegment AS cust_c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_append(t):
    return select(join_rows(t("orders"), t("customer"), "c_custkey", "o_custkey", append="c_name,c_mktsegment", prefix="cust_"), "o_orderkey,o_custkey,cust_*")


@query("SELECT s_suppkey, s_nationkey, coalesce(n_name, 'elsewhere') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def join_left_fill(t):
    return select(join_rows(t("supplier"), filter_rows(t("nation"), lt="n_regionkey:3"), "n_nationkey", "s_nationkey", append="n_name", fill="elsewhere"), "s_suppkey,s_nationkey,n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(t):
    return select(join_rows(t("customer"), t("orders"), "o_custkey", "c_custkey", exclude=True), "c_custkey,c_name")


@query("""
    SELECT c_custkey, o.o_orderkey AS last_o_orderkey FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def join_last_wins(t):
    return select(join_rows(t("customer"), t("orders"), "o_custkey", "c_custkey", append="o_orderkey", last_wins=True, prefix="last_", order_by=["o_orderkey"]), "c_custkey,last_*")


@query("SELECT l_orderkey, l_linenumber, o_orderdate, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_orders_lineitem(t):
    return select(join_rows(t("lineitem"), t("orders"), "o_orderkey", "l_orderkey", append="o_orderdate,o_orderstatus", mode="all"), "l_orderkey,l_linenumber,o_orderdate,o_orderstatus")


@query("SELECT 'customer' AS origin, c_nationkey AS key, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def append_source(t):
    return append({"customer": t("customer").selectExpr("c_nationkey as key", "c_acctbal as bal"), "supplier": t("supplier").selectExpr("s_nationkey as key", "s_acctbal as bal")}, source="origin")


@query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct_keys(t):
    return union_distinct(t("customer").selectExpr("c_nationkey as key"), t("supplier").selectExpr("s_nationkey as key"))


@query("SELECT c_nationkey AS key FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def intersect_left_keys(t):
    return intersect_left(t("customer").selectExpr("c_nationkey as key"), filter_rows(t("supplier"), gt="s_acctbal:0").selectExpr("s_nationkey as key"))


@query("SELECT c_nationkey AS key FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def except_left_keys(t):
    return except_left(t("customer").selectExpr("c_nationkey as key"), filter_rows(t("supplier"), gt="s_acctbal:5000").selectExpr("s_nationkey as key"))


# order ----------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def uniq_first(t):
    return select(uniq(t("events"), "user_id", ["event_id"]), "user_id,event_id,event_type")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 2")
def uniq_repeated(t):
    return select(uniq(t("events"), "user_id,event_type", ["event_id"], repeated=True), "user_id,event_type,event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k BETWEEN 2 AND 4")
def uniq_max(t):
    return select(uniq(t("events"), "user_id", ["event_id"], at_least=2, maximum=4), "user_id,event_id")


@query("""
    WITH f AS (SELECT user_id AS u, row_number() OVER (ORDER BY min(event_id)) AS k FROM events GROUP BY user_id)
    SELECT event_id, user_id, k AS equiv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS equiv_line FROM events JOIN f ON u = user_id""")
def uniq_equiv(t):
    return select(uniq(t("events"), "user_id", ["event_id"], equiv="equiv_id", number="equiv_line"), "event_id,user_id,equiv_id,equiv_line")


@query("""
    SELECT o_orderkey, o_orderpriority, o_custkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) AS line FROM orders""")
def sort_multi(t):
    return nl(select(t("orders"), "o_orderkey,o_orderpriority,o_custkey"), ["o_orderpriority", "o_custkey", "o_orderkey"])


def placed(df: DataFrame) -> DataFrame:
    """Rows with their place in the order in which they come."""
    return df.withColumn("__at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("__at")).cast("long")).drop("__at")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_numeric_desc(t):
    return placed(sort_rows(select(t("orders"), "o_orderkey,o_totalprice"), "o_totalprice", numeric=True, descending=True, order_by=["o_orderkey"]))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def sort_text(t):
    return placed(sort_rows(select(t("customer"), "c_custkey,c_mktsegment"), "c_mktsegment", order_by=["c_custkey"]))


@query("SELECT n, event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n BETWEEN 101 AND 300 OR n = 5 OR n >= 9900")
def slice_ranges(t):
    return select(slice_rows(t("events"), "101-300,5,9900-", ["event_id"], number="n"), "n,event_id,event_type")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders")
def reverse_orders(t):
    return placed(reverse(select(t("orders"), "o_orderkey,o_orderdate"), ["o_orderkey"]))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, event_id FROM events")
def nl_events(t):
    return nl(select(t("events"), "event_id"), ["event_id"], start=0)


@query("""
    SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), v) AS event_type
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS v FROM events)""")
def fill_down(t):
    holes = t("events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("event_type"))
    return fill(holes, "event_type", ["event_id"])


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, -1) AS value FROM events")
def fill_const(t):
    return fill(t("events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value")), "value", value=-1)


@query("SELECT event_id, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN '-' ELSE event_type END AS event_type FROM events")
def blank_repeats(t):
    return blank(select(t("events"), "event_id,event_type"), "event_type", ["event_id"], replacement="-")


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) AS total FROM events")
def running_sum_events(t):
    return rounded(select(running_sum(t("events"), "value", ["event_id"], "total"), "event_id,total"), 2)


@query("SELECT event_id, sum(user_id) OVER (ORDER BY event_id) AS total FROM events")
def expr_global_sum(t):
    return select(running(t("events"), "default(@__total, 0) + @user_id as @__total", ["event_id"]), "event_id,total")


# bins and plots' statistics -------------------------------------------------------------------------------------------


@query("""
    WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
    SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 10)), 9) AS INTEGER) AS x_bin, CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 8)), 7) AS INTEGER) AS y_bin, count(*) AS count
    FROM lineitem, b GROUP BY 1, 2""")
def bin2d_hist(t):
    return bin2d(t("lineitem"), "l_quantity", "l_extendedprice", (10, 8))


@query("""
    WITH q AS (SELECT p_brand AS k, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1)
    SELECT p_brand, any_value(n) AS n, any_value(lo) AS min, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, any_value(hi) AS max,
           min(p_retailprice) FILTER (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
           max(p_retailprice) FILTER (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
           count(*) FILTER (NOT (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
    FROM part JOIN q ON p_brand = k GROUP BY 1""")
def box_stats_price(t):
    return rounded(box_stats(t("part"), "p_retailprice", "p_brand", outliers=False), 4, "q1", "median", "q3")


@query("""
    SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem GROUP BY 1""")
def regression_price(t):
    return rounded(rounded(rounded(regression(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 4, "slope"), 2, "intercept"), 6, "r2")


# sources, samples -----------------------------------------------------------------------------------------------------


@query("""
    WITH found AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages)
    SELECT page_id, unnest(range(1, len(hrefs) + 1)) AS n, unnest(hrefs) AS value FROM found""")
def html_links(t):
    return from_html(t("pages"), id_col="page_id", css="nav a attr{href}")


def _unescaped(sql: str) -> str:
    return f"trim(replace(replace(replace({sql}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"


@query(f"""
    SELECT page_id, 1 AS n, {_unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
           {_unescaped("regexp_extract(html, '(?s)<nav><ul><li><a [^>]*href=.([^>]*).>', 1)")} AS first_place,
           {_unescaped("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")} AS heading,
           {_unescaped("regexp_extract(html, '(?s)<nav><ul><li><a [^>]*>(.*?)</a>', 1)")} AS first_link
    FROM pages""")
def html_struct(t):
    cols = {"title": "title text{}", "first_place": "nav li:first-child a attr{href}", "heading": "article h1 text{}", "first_link": "nav li:first-child a text{}"}
    return from_html(t("pages"), id_col="page_id", row="html", cols=cols)


from . import proofs  # noqa: E402, F401  (registers its queries)


# globals that last over rows -------------------------------------------------------------------------------------------

_EVENTS = "OVER (ORDER BY event_id)"


@query(f"SELECT event_id, round(greatest(0, max(value) {_EVENTS}), 6) AS top FROM events")
def expr_global_max(t):
    return rounded(select(running(t("events"), "max(default(@__top, 0), @value) as @__top", ["event_id"]), "event_id,top"), 6)


@query(f"SELECT event_id, round(least(1000000000, min(value + 1) {_EVENTS}), 6) AS low FROM events")
def expr_global_min(t):
    return rounded(select(running(t("events"), "min(default(@__low, 1000000000), @value + 1) as @__low", ["event_id"]), "event_id,low"), 6)


@query(f"SELECT event_id, count(CASE WHEN event_type = 'click' THEN 1 END) {_EVENTS} AS clicks FROM events")
def expr_global_count(t):
    return select(running(t("events"), "if(@event_type eq 'click', default(@__clicks, 0) + 1, default(@__clicks, 0)) as @__clicks", ["event_id"]), "event_id,clicks")


@query(f"SELECT event_id, (count(*) FILTER (user_id % 2 = 1) {_EVENTS}) % 2 * -2 + 1 AS sign FROM events")
def expr_global_product(t):
    out = running(t("events"), "default(@__sign, 1) * if(@user_id % 2 == 1, -1, 1) as @__sign", ["event_id"])
    return select(out.withColumn("sign", F.col("sign").cast("long")), "event_id,sign")


@query(f"""
    WITH g AS (SELECT event_id, user_id, event_type, count(*) FILTER (event_type = 'error') {_EVENTS} AS g FROM events)
    SELECT event_id, coalesce(sum(CASE WHEN event_type <> 'error' THEN user_id END) OVER (PARTITION BY g ORDER BY event_id), 0)::BIGINT AS since FROM g""")
def expr_global_reset(t):
    return select(running(t("events"), "if(@event_type eq 'error', 0, default(@__since, 0) + @user_id) as @__since", ["event_id"]), "event_id,since")


@query(f"""
    WITH s AS (SELECT event_id, sum(user_id % 11 - 5) {_EVENTS} AS s FROM events)
    SELECT event_id, (s - least(0, min(s) {_EVENTS}))::BIGINT AS excess FROM s""")
def expr_global_excess(t):
    return select(running(t("events"), "max(0, default(@__excess, 0) + @user_id % 11 - 5) as @__excess", ["event_id"]), "event_id,excess")


@query(f"""
    WITH RECURSIVE n AS (SELECT event_id, value, row_number() {_EVENTS} AS k FROM events),
         s AS (SELECT k, event_id, value * 0.25 AS x FROM n WHERE k = 1 UNION ALL SELECT n.k, n.event_id, s.x * 0.75 + n.value * 0.25 FROM s JOIN n ON n.k = s.k + 1)
    SELECT event_id, round(x, 4) AS smooth FROM s""")
def expr_global_smoothing(t):
    return rounded(select(running(t("events"), "default(@__smooth, 0) * 0.75 + @value * 0.25 as @__smooth", ["event_id"]), "event_id,smooth"), 4)


@query(f"""
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) {_EVENTS} AS buyer,
           user_id - coalesce(lag(user_id) {_EVENTS}, 0) AS step FROM events""")
def expr_global_previous(t):
    kept = running(t("events"), "if(@event_type eq 'purchase', @user_id, @__buyer) as @__buyer", ["event_id"])
    return select(running(kept, "default(@__p, 0) as @old; @user_id as @__p; @user_id - @old", ["event_id"], name="step"), "event_id,buyer,step")


# ordered operators on streams ------------------------------------------------------------------------------------------


@query("""
    WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS event_type FROM events)
    SELECT event_id, row_number() OVER w AS line, last_value(event_type IGNORE NULLS) OVER w AS event_type, sum(user_id) OVER w AS total,
           CASE WHEN user_id % 4 = lag(user_id % 4) OVER w THEN '=' ELSE (user_id % 4)::VARCHAR END AS part
    FROM e WINDOW w AS (ORDER BY ts, event_id)""")
def stream_ordered(t):
    """Events that arrive in four files, each up to an hour out of order, one a micro-batch."""
    spark, root = t("events").sparkSession, f"{shared_folder(t('events').sparkSession)}/stream-{uuid.uuid4().hex}"
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("event_type"), (F.col("user_id") % 4).cast("string").alias("part"))
    arrives = F.col("ts").cast("long") + F.pmod(F.xxhash64("event_id"), F.lit(3600))
    cuts = e.select(F.percentile_approx(arrives, [0.25, 0.5, 0.75])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = e.where((F.lit(True) if low is None else arrives >= low) & (F.lit(True) if high is None else arrives < high))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    steps = OrderedSteps("ts", ("event_id",), "1 hour", number="line", fill="event_type", blank="part", replacement="=", globals={"total": "default(@__t, 0) + @user_id as @__t"})
    run_ordered(stream(spark, f"{root}/in", 1), steps, f"{root}/out", f"{root}/checkpoint", close=True)
    return released_rows(spark, f"{root}/out").select("event_id", "line", "event_type", "total", "part")


# hot keys --------------------------------------------------------------------------------------------------------------


@query("""
    SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_orderkey END AS k FROM lineitem) JOIN orders ON k = o_orderkey""")
def join_hot_key(t):
    """A third of all rows have one key, which meets a broadcast; the others are shuffled."""
    lines = t("lineitem").withColumn("k", F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(F.col("l_orderkey")))
    out = join_rows(select(lines, "l_orderkey,l_linenumber,k"), t("orders"), "o_orderkey", data_key="k", append="o_custkey,o_orderstatus", skew=True)
    return select(out, "l_orderkey,l_linenumber,o_custkey,o_orderstatus")


@query("""
    WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)
    SELECT event_id, event_type, place, dense_rank() OVER (ORDER BY f) AS kind FROM e""")
def uniq_hot_key(t):
    """Places within five keys, each of which fills several tasks, and the keys' identifiers."""
    return uniq(select(t("events"), "event_id,event_type"), "event_type", ["event_id"], number="place", equiv="kind", small=0)


# aggregates of a user's own, sketches, transposed files ----------------------------------------------------------------


class SecondLargest:
    """The second largest of the values that differ."""

    state, result = "first double, second double", "double"

    def start(self):
        return None, None

    def update(self, state, values):
        return self.merge(state, tuple(sorted(set(values[0].drop_null().to_pylist()), reverse=True)[:2]))

    def merge(self, a, b):
        best = sorted({x for x in (*a, *b) if x is not None}, reverse=True)[:2]
        return tuple(best + [None] * (2 - len(best)))

    def finish(self, state):
        return state[1]


@query("""
    WITH v AS (SELECT DISTINCT event_type, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS k FROM v)
    SELECT event_type, value AS second FROM r WHERE k = 2""")
def aggregate_second_largest(t):
    return aggregate_rows(t("events"), "event_type", "value", "second", SecondLargest())


@query("""
    SELECT event_type, count(*) AS n, TRUE AS near FROM events GROUP BY 1""")
def sketch_quantiles_by_day(t):
    """Sketches a day, merged by type: the values whose place is within a hundredth of the asked one."""
    events = t("events").withColumn("day", F.to_date("ts"))
    whole = merge_sketches(quantile_sketches(events, "event_type,day", "value", "s"), "event_type", "s")
    found = sketch_quantiles(whole, "s", [0.1, 0.5, 0.9])
    below = {p: F.avg((F.col("value") <= F.col(f"`s_{p}`")).cast("double")) for p in (0.1, 0.5, 0.9)}
    near = [F.abs(b - p) <= 0.011 for p, b in below.items()]
    return events.join(found, "event_type").groupBy("event_type").agg(F.count("*").alias("n"), (near[0] & near[1] & near[2]).alias("near"))


@query("""
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority FROM orders""")
def transpose_file(t):
    """All orders as a file of one line a field, read back."""
    orders = select(t("orders"), "o_orderkey,o_custkey,o_orderstatus,o_orderpriority")
    path = f"{shared_folder(orders.sparkSession)}/transposed-{uuid.uuid4().hex}"
    write_transposed(orders, path, ["o_orderkey"], small=0)
    return read_transposed(orders.sparkSession, path, small=0)
