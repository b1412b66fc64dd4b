"""Comparison of runs: events are runs of a user's document, lineitems and orders the evidence of two methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate as E
from ..sources import files
from . import scoring
from .registry import F, Tables, dec, long, query

_MOMENTS_SQL = "count({0}) AS n, CAST(avg({0}) AS DECIMAL(18,6))::DOUBLE AS mean, CAST(stddev_samp({0}) AS DECIMAL(18,6))::DOUBLE AS std, CAST(min({0}) AS DECIMAL(18,6))::DOUBLE AS low, CAST(max({0}) AS DECIMAL(18,6))::DOUBLE AS high, CAST(quantile_cont({0}, 0.5) AS DECIMAL(18,6))::DOUBLE AS median"


@query(f"SELECT event_type, {_MOMENTS_SQL.format('value')} FROM events GROUP BY event_type")
def group_moments(t: Tables) -> DataFrame:
    o = E.group_summary(t.events, "event_type", ["value"])
    return o.select("event_type", F.col("value_count").alias("n"), *[dec(F.col(f"value_{k}")).alias(n) for k, n in (("mean", "mean"), ("std", "std"), ("min", "low"), ("max", "high"), ("median", "median"))])


@query("""
SELECT metric, CAST(avg(v) AS DECIMAL(18,4))::DOUBLE AS mean, max(v) AS high
FROM (SELECT 'quantity_score_100' AS metric, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'tax_score_100', l_tax::DOUBLE FROM lineitem) GROUP BY metric
""")
def score_summary(t: Tables) -> DataFrame:
    """The columns of a wide table that are scores, picked by their names, and summed up."""
    wide = t.lineitem.select(F.col("l_quantity").alias("quantity_score_100"), "l_orderkey", F.col("l_tax").alias("tax_score_100"), F.col("l_discount").alias("score_100_discount"))
    return E.column_summary(wide, E.score_columns(wide)).select("metric", F.col("mean").cast("decimal(18,4)").cast("double").alias("mean"), F.col("max").alias("high"))


@query("""
SELECT l_returnflag, CAST(quantile_cont(l_extendedprice, 0.5) AS DECIMAL(18,6))::DOUBLE AS price, CAST(quantile_cont(l_quantity, 0.5) AS DECIMAL(18,6))::DOUBLE AS quantity, count(l_tax) AS n FROM lineitem GROUP BY 1
""")
def group_medians(t: Tables) -> DataFrame:
    """Medians by ranges: no task holds more than a hundred values of a group."""
    o = E.group_summary(t.lineitem, "l_returnflag", ["l_extendedprice", "l_quantity", "l_tax"], held=100)
    return o.select("l_returnflag", dec(F.col("l_extendedprice_median")).alias("price"), dec(F.col("l_quantity_median")).alias("quantity"), F.col("l_tax_count").alias("n"))


@query("""
SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '#run' ELSE ' ' END || p_size AS pdf_name, CAST(p_size AS INTEGER) AS run_idx FROM part
""")
def run_names(t: Tables) -> DataFrame:
    """Ids of runs taken apart again, of names that look like ids of runs."""
    name = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit("#run")).otherwise(F.lit(" ")), F.col("p_size").cast("string"))
    rows = t.part.select("p_partkey", scoring.run_id(name, F.col("p_size")).alias("doc_id"))
    back, run = scoring.run_parts(F.col("doc_id"))
    return rows.select("p_partkey", back.alias("pdf_name"), run.alias("run_idx"))


@query("""
SELECT metric, CAST(avg(v) AS DECIMAL(18,4))::DOUBLE AS mean, CAST(min(v) AS DECIMAL(18,4))::DOUBLE AS low, CAST(max(v) AS DECIMAL(18,4))::DOUBLE AS high, CAST(quantile_cont(v, 0.5) AS DECIMAL(18,4))::DOUBLE AS median
FROM (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY metric
""")
def column_summary(t: Tables) -> DataFrame:
    o = E.column_summary(t.lineitem, ["l_quantity", "l_discount", "l_tax"])
    return o.select("metric", *[F.col(k).cast("decimal(18,4)").cast("double").alias(n) for k, n in (("mean", "mean"), ("min", "low"), ("max", "high"), ("median", "median"))])


@query("""
WITH m AS (SELECT count(*) FILTER (event_type = 'click') AS na, avg(value) FILTER (event_type = 'click') AS ma, var_samp(value) FILTER (event_type = 'click') AS va, count(*) FILTER (event_type = 'view') AS nb, avg(value) FILTER (event_type = 'view') AS mb, var_samp(value) FILTER (event_type = 'view') AS vb FROM events)
SELECT CAST((ma - mb) / sqrt(va / na + vb / nb) AS DECIMAL(18,6))::DOUBLE AS t, CAST((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)) AS DECIMAL(18,4))::DOUBLE AS dof FROM m
""")
def welch_t(t: Tables) -> DataFrame:
    o = E.welch(t.events, "event_type", "value", "click", "view")
    return o.select(dec(F.col("statistic")).alias("t"), F.col("dof").cast("decimal(18,4)").cast("double").alias("dof"))


@query("""
WITH p AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY value),
c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM p WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT CAST(max(abs(ca * 1.0 / na - cb * 1.0 / nb)) AS DECIMAL(18,6))::DOUBLE AS d FROM c
""")
def ks_statistic(t: Tables) -> DataFrame:
    return E.ks(t.events, "event_type", "value", "click", "view").select(dec(F.col("statistic")).alias("d"))


@query("""
WITH o AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(max(q) FILTER (l_returnflag = 'A') AS DECIMAL(18,6))::DOUBLE AS a_q, CAST(max(q) FILTER (l_returnflag = 'N') AS DECIMAL(18,6))::DOUBLE AS n_q, CAST(max(q) FILTER (l_returnflag = 'R') AS DECIMAL(18,6))::DOUBLE AS r_q,
  CAST(max(q) FILTER (l_returnflag = 'A') - max(q) FILTER (l_returnflag = 'R') AS DECIMAL(18,6))::DOUBLE AS a_diff, CAST(max(q) FILTER (l_returnflag = 'N') - max(q) FILTER (l_returnflag = 'R') AS DECIMAL(18,6))::DOUBLE AS n_diff FROM o GROUP BY l_orderkey
""")
def three_way_diff(t: Tables) -> DataFrame:
    runs = {k.lower(): t.lineitem.where(F.col("l_returnflag") == k) for k in "ANR"}
    o = E.compare(runs, "l_orderkey", ["l_quantity"], "r")
    return o.select("l_orderkey", *[dec(F.col(f"{k}_l_quantity")).alias(f"{k}_q") for k in "anr"], *[dec(F.col(f"{k}_vs_r_l_quantity")).alias(f"{k}_diff") for k in "an"])


@query("""
WITH o AS (SELECT l_orderkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS n, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL), c AS (SELECT * FROM o WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL)
SELECT 'a' AS method, CAST(avg(abs(a - r)) AS DECIMAL(18,6))::DOUBLE AS mae, CAST(avg(a - r) AS DECIMAL(18,6))::DOUBLE AS bias, count(*) AS n FROM c UNION ALL SELECT 'n', CAST(avg(abs(n - r)) AS DECIMAL(18,6))::DOUBLE, CAST(avg(n - r) AS DECIMAL(18,6))::DOUBLE, count(*) FROM c
""")
def errors_against_reference(t: Tables) -> DataFrame:
    runs = {k.lower(): t.lineitem.where(F.col("l_returnflag") == k) for k in "ANR"}
    o = E.errors(E.compare(runs, "l_orderkey", ["l_quantity"], "r"), ["l_quantity"], ["a", "n"], "r")
    return o.select("method", dec(F.col("mae")).alias("mae"), dec(F.col("bias")).alias("bias"), "n")


@query("""
WITH a AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s, max(value) - min(value) AS r FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s, max(value) - min(value) AS r FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, round(a.s, 3) AS pipeline_std, round(b.s, 3) AS baseline_std, CASE WHEN round(a.s, 3) < round(b.s, 3) THEN 'pipeline' WHEN round(a.s, 3) > round(b.s, 3) THEN 'baseline' ELSE 'tie' END AS more_stable FROM a LEFT JOIN b USING (user_id)
""")
def stability(t: Tables) -> DataFrame:
    a, b = (t.events.where(F.col("event_id") % 2 == i) for i in (0, 1))
    return E.stability(a, b, "user_id", "value").select("user_id", "pipeline_std", "baseline_std", "more_stable")


@query("SELECT l_returnflag, CAST(least(10, 1 + floor(l_discount * 1000 / 10)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL".replace("l_discount * 1000", "(l_quantity * 2)"))
def histogram10(t: Tables) -> DataFrame:
    return E.histogram(t.lineitem.withColumn("x", F.col("l_quantity") * 2), "x", 0.0, 100.0, 10, "l_returnflag")


_SETS_SQL = "SELECT o_custkey AS case_id, list_distinct(list(l_partkey % 20) FILTER (l_linestatus = 'F')) AS b, list_distinct(list(l_partkey % 20) FILTER (l_returnflag <> 'N')) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


@query(f"""
WITH s AS (SELECT case_id, coalesce(b, []) AS b, coalesce(p, []) AS p FROM ({_SETS_SQL})), c AS (SELECT case_id, len(list_intersect(b, p)) AS tp, len(p) - len(list_intersect(b, p)) AS fp, len(b) - len(list_intersect(b, p)) AS fn FROM s),
f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) END AS pr, CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) END AS re FROM c)
SELECT case_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END AS DECIMAL(18,6))::DOUBLE AS f1 FROM f
""")
def set_scores(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_partkey") % 20
    s = rows.groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_set(F.when(F.col("l_linestatus") == "F", k)).alias("b"), F.collect_set(F.when(F.col("l_returnflag") != "N", k)).alias("p"))
    x = E.set_scores(F.col("b"), F.col("p"))
    return s.select("case_id", *[long(x[k]).alias(k) for k in ("tp", "fp", "fn")], dec(x["f1"]).alias("f1"))


@query("""
WITH b AS (SELECT o_custkey AS case_id, o_orderkey % 3 AS section, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT o_custkey AS case_id, o_orderkey % 3 AS section, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS i FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT b.case_id, b.section, CAST(b.i AS INTEGER) AS pair_index, b.k AS base_criterion, p.k AS pred_criterion, CAST(CASE WHEN b.k % 7 = p.k % 7 THEN 1 ELSE 0 END AS INTEGER) AS tp FROM b JOIN p USING (case_id, section, i)
""")
def positional_pairs(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 3).alias("section"), F.col("o_orderkey").alias("criterion"), F.array(F.col("o_orderkey") % 7).alias("chunks"), "o_orderstatus", "o_orderpriority")
    o = E.pair_by_position(rows.where("o_orderstatus <> 'P'"), rows.where("o_orderpriority <> '5-LOW'"), ["case_id", "section"], ["criterion"])
    return o.select("case_id", "section", "pair_index", "base_criterion", "pred_criterion", "tp")


def _pairs(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") % 10).alias("case_id"), F.col("l_returnflag").alias("variant"), (F.col("l_partkey") % 3).cast("int").alias("tp"), (F.col("l_suppkey") % 2).cast("int").alias("fp"), (F.col("l_linenumber") % 2).cast("int").alias("fn")).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


_PAIRS_SQL = "SELECT l_orderkey % 10 AS case_id, l_returnflag AS variant, l_partkey % 3 AS tp, l_suppkey % 2 AS fp, l_linenumber % 2 AS fn FROM lineitem"


@query(f"""
WITH s AS (SELECT variant, case_id, count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END) AS macro FROM ({_PAIRS_SQL}) GROUP BY ALL)
SELECT variant, case_id, CAST(n AS BIGINT) AS criteria_n, CAST(2.0 * tp / (2 * tp + fp + fn) AS DECIMAL(18,6))::DOUBLE AS micro_f1, CAST(macro AS DECIMAL(18,6))::DOUBLE AS macro_f1 FROM s
""")
def micro_f1(t: Tables) -> DataFrame:
    o = E.f1_summary(_pairs(t), "variant", "case_id")
    return o.select("variant", "case_id", "criteria_n", dec(F.col("micro_f1")).alias("micro_f1"), dec(F.col("macro_f1")).alias("macro_f1"))


@query(f"""
WITH s AS (SELECT variant, case_id, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f FROM ({_PAIRS_SQL}) GROUP BY ALL)
SELECT case_id, CAST(max(f) FILTER (variant = 'A') AS DECIMAL(18,6))::DOUBLE AS a, CAST(max(f) FILTER (variant = 'N') AS DECIMAL(18,6))::DOUBLE AS n, CAST(max(f) FILTER (variant = 'R') AS DECIMAL(18,6))::DOUBLE AS r FROM s GROUP BY case_id
""")
def variant_pivot(t: Tables) -> DataFrame:
    o = E.variant_pivot(E.f1_summary(_pairs(t), "variant", "case_id"), "case_id", ["A", "N", "R"])
    return o.select("case_id", *[dec(F.col(k)).alias(k.lower()) for k in "ANR"])


@query("""
WITH d AS (SELECT o_orderkey, abs(o_orderkey % 11 - o_orderkey % 5) AS a, abs(o_orderkey % 7 - o_orderkey % 5) AS b FROM orders)
SELECT o_orderkey, CAST(a AS BIGINT) AS a_dist, CAST(b AS BIGINT) AS b_dist, CASE WHEN a < b THEN 'a' WHEN b < a THEN 'b' ELSE 'tie' END AS closer FROM d
""")
def winner_argmin(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", *[(F.col("o_orderkey") % n).alias(c) for c, n in (("a", 11), ("b", 7), ("ref", 5))])
    return E.closest(rows, "ref", ["a", "b"], "o_orderkey")


@query("""
SELECT coalesce(c_mktsegment, 'overall') AS "group", count(*) AS total_files, count(*) FILTER (c_nationkey IN (3, 7)) AS excluded_files, round(count(*) FILTER (c_nationkey IN (3, 7)) * 100.0 / count(*), 1) AS excluded_rate FROM customer GROUP BY ROLLUP (c_mktsegment)
""")
def group_rollup(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_mktsegment").alias("group"), F.col("c_nationkey").cast("string").alias("pdf_name"))
    return E.excluded_table(rows, "pdf_name", ["3", "7"]).select("group", "total_files", "excluded_files", "excluded_rate")


@query("""
WITH l AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'o' END AS g, 'pipeline' AS method, 'size' AS section, l_quantity AS v FROM lineitem UNION ALL SELECT CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'o' END, 'baseline', 'size', l_tax * 100 FROM lineitem)
SELECT method, section, CAST(avg(v) FILTER (g = 'f') AS DECIMAL(18,1))::DOUBLE AS f_mean, CAST(avg(v) FILTER (g = 'o') AS DECIMAL(18,1))::DOUBLE AS o_mean FROM l GROUP BY ALL
""")
def group_deltas(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.when(F.col("l_linestatus") == "F", "f").otherwise("o").alias("group"), F.col("l_quantity").alias("pipeline_size_score_100"), (F.col("l_tax") * 100).alias("baseline_size_score_100"))
    return E.group_deltas(rows, ["pipeline", "baseline"], ["size"], ("f", "o")).select("method", "section", "f_mean", "o_mean")


@query("""
WITH p AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS b, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS a FROM orders GROUP BY 1)
SELECT o_custkey, CAST(a - b AS DECIMAL(18,4))::DOUBLE AS diff FROM p WHERE a IS NOT NULL AND b IS NOT NULL
""")
def paired_diff(t: Tables) -> DataFrame:
    means = t.orders.groupBy("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "before").otherwise("after").alias("phase")).agg(F.avg("o_totalprice").alias("price"))
    both = means.groupBy("o_custkey").count().where("count = 2").select("o_custkey")
    o = E.paired_diff(means.join(both, "o_custkey", "left_semi"), "o_custkey", "phase", ["price"])
    return o.select("o_custkey", F.col("price").cast("decimal(18,4)").cast("double").alias("diff"))


@query("""
SELECT o_custkey AS doc_id, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f_items, CAST(coalesce(max(o_orderkey) FILTER (o_orderstatus = 'O'), -1) AS BIGINT) AS o_last, CAST(count(*) AS BIGINT) AS overall_items FROM orders GROUP BY o_custkey
""")
def flattened_results(t: Tables) -> DataFrame:
    sections = t.orders.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("section_key")).agg(F.count("*").alias("items"), F.max("o_orderkey").alias("last"))
    overall = t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("items"))
    o = E.flatten_results(overall, sections, ["items", "last"], ["F", "O", "P"])
    return o.select("doc_id", F.coalesce("F_items", F.lit(0)).cast("bigint").alias("f_items"), F.coalesce("O_last", F.lit(-1)).cast("bigint").alias("o_last"), "overall_items")


@query("""SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_type <> 'view'""")
def conflict_repair(t: Tables) -> DataFrame:
    """JSON with merge conflicts, read as its first side."""
    raw = F.expr("CASE WHEN event_type = 'click' THEN '<<<<<<< HEAD\\n' || props || '\\n=======\\n{\"k\": 0}\\n>>>>>>> other\\n' ELSE props END")
    return files.repaired(t.events.where("event_type <> 'view'").select("event_id", raw.alias("raw"))).select("event_id", F.get_json_object("raw", "$.k").cast("bigint").alias("k"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE length(o_orderpriority) >= 6)")
def resume_after_stop(t: Tables) -> DataFrame:
    """What a log of done names doesn't hold yet."""
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("raw"))
    return files.cached(t.customer.select("c_custkey", "c_mktsegment"), done, "c_custkey", 6)


@query(None)
def distribution_tests(t: Tables) -> DataFrame:
    """Welch and Kolmogorov-Smirnov with p-values, from sums that Spark makes."""
    return E.tests(t.events, "event_type", "value", "click", "view")
