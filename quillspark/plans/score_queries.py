"""Beliefs, repair of scores, the weighted roll-up, careers, teams and budgets.

Customers stand for sections and persons, orders for sub-criteria and works, lineitems for signals and citations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window

from ..functions import text as T
from ..operators import belief, citations, features, repair, rollup
from .registry import F, Tables, dec, long, query


def _findings(t: Tables) -> DataFrame:
    one = lambda c: F.array(F.concat(F.lit("c"), c.cast("string")))
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("section_pos"), F.concat(F.lit("s"), F.col("l_linenumber") % 4).alias("section_name"), F.col("l_partkey").cast("int").alias("finding_pos"), F.concat(F.lit("g."), F.col("l_partkey") % 5).alias("sub_id"), one(F.col("l_suppkey") % 6).alias("good"), F.when(F.col("l_returnflag") == "R", one(F.col("l_suppkey") % 3)).otherwise(F.array().cast("array<string>")).alias("bad"), F.concat(F.lit("i"), F.col("l_quantity").cast("int") % 3).alias("implication"))


@query("""
WITH f AS (SELECT l_orderkey AS doc_id, 'g.' || l_partkey % 5 AS sub_id, l_linenumber AS pos, l_partkey AS at2, 'c' || l_suppkey % 6 AS good, CASE WHEN l_returnflag = 'R' THEN 'c' || l_suppkey % 3 END AS bad, 'i' || CAST(l_quantity AS INTEGER) % 3 AS said FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, at2, sub_id, good, bad, said) AS rn FROM f),
g AS (SELECT doc_id, sub_id, string_agg(good, ',' ORDER BY rn) AS x FROM (SELECT doc_id, sub_id, good, min(rn) AS rn FROM r GROUP BY ALL) GROUP BY ALL),
b AS (SELECT doc_id, sub_id, string_agg(bad, ',' ORDER BY rn) AS x FROM (SELECT doc_id, sub_id, bad, min(rn) AS rn FROM r WHERE bad IS NOT NULL GROUP BY ALL) GROUP BY ALL),
s AS (SELECT doc_id, sub_id, string_agg(said, ',' ORDER BY rn) AS x FROM (SELECT doc_id, sub_id, said, min(rn) AS rn FROM r GROUP BY ALL) GROUP BY ALL),
p AS (SELECT doc_id, sub_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(rn)) AS belief_pos FROM r GROUP BY doc_id, sub_id)
SELECT p.doc_id, p.sub_id, CAST(belief_pos AS BIGINT) AS belief_pos, g.x AS good, coalesce(b.x, '') AS bad, s.x AS said FROM p JOIN g USING (doc_id, sub_id) JOIN s USING (doc_id, sub_id) LEFT JOIN b USING (doc_id, sub_id)
""")
def belief_merge(t: Tables) -> DataFrame:
    out = belief.beliefs(_findings(t))
    return out.select("doc_id", "sub_id", long(F.col("belief_pos")).alias("belief_pos"), F.array_join("good", ",").alias("good"), F.array_join("bad", ",").alias("bad"), F.array_join("implications", ",").alias("said"))


_SUBS = [("general", 0, f"g.{i}", i) for i in range(5)] + [("application_form", 1, "af.1", 0)]


@query("""
WITH n AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS section_pos FROM lineitem),
s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey % 5 AS k FROM lineitem),
f AS (SELECT doc_id, k, min(pos) AS first FROM s GROUP BY ALL)
SELECT n.doc_id, CAST(n.section_pos AS INTEGER) AS section_pos, coalesce(string_agg('g.' || x.k, ',' ORDER BY x.k) FILTER (f.first IS NULL OR f.first > n.section_pos), '') AS missing
FROM n CROSS JOIN range(0, 5) x(k) LEFT JOIN f ON f.doc_id = n.doc_id AND f.k = x.k GROUP BY n.doc_id, n.section_pos
""")
def missing_after(t: Tables) -> DataFrame:
    subs = t.spark.createDataFrame(_SUBS, "section_key string, section_pos int, sub_id string, sub_pos int")
    found = _findings(t)
    return belief.missing_after(found, found, subs).select("doc_id", "section_pos", F.array_join("missing", ",").alias("missing"))


@query("""
WITH e AS (SELECT user_id, event_type || '-' || regexp_extract(props, '[0-9]+') AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
d AS (SELECT user_id, name, min(rn) AS rn FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d)
SELECT user_id AS doc_id, CAST(max(n) AS BIGINT) AS n, string_agg(name, ',' ORDER BY k) FILTER (k > n - 10) AS last_ten FROM o GROUP BY user_id
""")
def state_last_ten(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("section_pos"), F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("section_name"))
    none = F.lit(None).cast("map<string,struct<good_evidence_ids:array<string>,bad_evidence_ids:array<string>,implications:array<string>>>")
    view = belief.state_view(belief.processed(rows).withColumn("subcriteria_beliefs", none).withColumn("missing_signals", F.array()))
    return view.select("doc_id", long(F.col("processed_section_count")).alias("n"), F.array_join("processed_sections", ",").alias("last_ten"))


_VALUES = "CASE l_linenumber % 8 WHEN 0 THEN '3' WHEN 1 THEN '2.5' WHEN 2 THEN 'true' WHEN 3 THEN '\"4\"' WHEN 4 THEN '9' WHEN 5 THEN '5.0' WHEN 6 THEN 'null' ELSE '-1' END"


@query("SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 8 WHEN 0 THEN 3 WHEN 5 THEN 5 ELSE 0 END AS INTEGER) AS score FROM lineitem")
def score_coercion(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", repair.coerce_score(F.try_parse_json(F.expr(_VALUES))).alias("score"))


@query("""
WITH s AS (SELECT l_orderkey, 'g.1.' || chr(97 + l_linenumber % 4) AS sid, max(CAST(l_quantity AS INTEGER) % 6) AS score FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS doc_id, sid, CAST(CASE WHEN score < 5 THEN score WHEN l_orderkey % 3 = 0 THEN 5 WHEN l_orderkey % 3 = 1 THEN 4
  WHEN NOT bool_or(sid IN ('g.1.a', 'g.1.b')) OVER (PARTITION BY l_orderkey) THEN 4 WHEN sid = 'g.1.a' THEN 4 ELSE 5 END AS INTEGER) AS score FROM s
""")
def perfect_score_cap(t: Tables) -> DataFrame:
    sid = F.concat(F.lit("g.1."), F.char(97 + F.col("l_linenumber") % 4))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), sid.alias("sid")).agg(F.max(F.col("l_quantity").cast("int") % 6).alias("score"))
    note = F.expr("CASE doc_id % 3 WHEN 0 THEN 'No gaps.' WHEN 1 THEN 'Costs are unclear.' ELSE 'g.1.a lacks detail. g.1.b is strong.' END")
    out = repair.cap_perfect(rows.withColumn("section_key", F.lit("general")).withColumn("sub_id", F.lit("g.1")).withColumn("drawbacks", note))
    return out.select("doc_id", "sid", F.col("score").cast("int").alias("score"))


@query("""
WITH r AS (SELECT s.l_orderkey, k.k FROM (SELECT DISTINCT l_orderkey FROM lineitem) s CROSS JOIN range(0, 6) k(k)),
m AS (SELECT l_orderkey, l_partkey % 6 AS k, max(CAST(l_quantity AS INTEGER) % 6) AS score FROM lineitem GROUP BY ALL)
SELECT r.l_orderkey AS doc_id, 'g.1.' || chr(CAST(97 + r.k AS INTEGER)) AS sid, CAST(coalesce(m.score, 0) AS INTEGER) AS score FROM r LEFT JOIN m USING (l_orderkey, k)
""")
def scores_of_answers(t: Tables) -> DataFrame:
    """Answers in JSON, keyed by signal and by sub-criterion, repaired to a score for every signal of the rubric."""
    sid = F.concat(F.lit("g.1."), F.char(97 + F.col("l_partkey") % 6))
    name = F.concat(F.lit("g.1.x"), F.concat_ws("_", *[F.col(c).cast("int").cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]))
    part = F.concat(F.lit('"'), name, F.lit('":{"signals":{"'), sid, F.lit('":'), (F.col("l_quantity").cast("int") % 6).cast("string"), F.lit('},"used_chunk_ids":["c1"]}'))
    parts = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), part.alias("part"))  # in a step of its own they are built by generated code
    raw = parts.groupBy("doc_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("part"), ","), F.lit("}")).alias("raw")).withColumn("section_key", F.lit("general"))
    rub = t.spark.createDataFrame([("general", "g.1", f"g.1.{chr(97 + i)}", i) for i in range(6)], "section_key string, sub_id string, sid string, signal_pos int")
    signals, _ = repair.normalize(raw, rub, raw.select("doc_id", F.array(F.lit("c1")).alias("chunk_ids")))
    return signals.select("doc_id", "sid", F.col("score").cast("int").alias("score"))


def _signals(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("sub_id"), (F.col("l_quantity").cast("int") % 6).alias("score"), F.col("l_linenumber").cast("double").alias("signal_weight"))


_SUB_SQL = "SELECT l_orderkey AS sub_id, count(*) AS n_signals, sum((CAST(l_quantity AS INTEGER) % 6) * CAST(l_linenumber AS DOUBLE)) / (5 * sum(CAST(l_linenumber AS DOUBLE))) * 10 AS score_10 FROM lineitem GROUP BY l_orderkey"
_QUALITY_SQL = "CASE WHEN score_10 >= 7.5 THEN 'good' WHEN score_10 >= 4 THEN 'mixed' ELSE 'weak' END"


@query(f"SELECT sub_id, CAST(n_signals AS BIGINT) AS n_signals, CAST(score_10 AS DECIMAL(18,6))::DOUBLE AS score_10, {_QUALITY_SQL} AS quality FROM ({_SUB_SQL})")
def signal_to_sub(t: Tables) -> DataFrame:
    out = rollup.sub_scores(_signals(t), ("sub_id",), (), rounded=False)
    return out.select("sub_id", "n_signals", dec(F.col("score_10")).alias("score_10"), "quality")


def _subs(t: Tables) -> DataFrame:
    sub = rollup.sub_scores(_signals(t), ("sub_id",), (), rounded=False)
    rows = t.orders.join(sub, F.col("o_orderkey") == F.col("sub_id"))
    return rows.select(F.col("o_custkey").alias("section"), "sub_id", (F.col("o_orderkey") % 3 + 1).cast("double").alias("sub_weight"), (F.col("o_orderstatus") != "P").alias("counts"), "score_10", "n_signals", (F.col("o_orderkey") % 6).alias("evidence_count"), F.lit("high_confidence").alias("confidence_label"))


_SUBS_SQL = f"SELECT o_custkey AS section, sub_id, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS w, o_orderstatus <> 'P' AS c, score_10, n_signals, o_orderkey % 6 AS e FROM orders JOIN ({_SUB_SQL}) ON sub_id = o_orderkey"
_SECTION_SQL = f"""SELECT section, count(*) AS total, CASE WHEN count(*) FILTER (c) > 0 THEN count(*) FILTER (c) ELSE count(*) END AS scored, sum(n_signals) AS signals, sum(e) AS evidence,
  CASE WHEN count(*) FILTER (c) > 0 THEN sum(score_10 * w) FILTER (c) / sum(w) FILTER (c) ELSE sum(score_10 * w) / sum(w) END AS score_10,
  CASE WHEN count(*) FILTER (c) > 0 THEN count(*) FILTER (c AND score_10 >= 7.5) ELSE count(*) FILTER (score_10 >= 7.5) END AS good,
  CASE WHEN count(*) FILTER (c) > 0 THEN count(*) FILTER (c AND score_10 > 0) ELSE count(*) FILTER (score_10 > 0) END AS positive FROM ({_SUBS_SQL}) GROUP BY section"""


@query(f"""SELECT section, CAST(total AS BIGINT) AS total_items, CAST(scored AS BIGINT) AS scored_items, CAST(signals AS BIGINT) AS signal_count, CAST(evidence AS BIGINT) AS evidence_count, CAST(good AS BIGINT) AS good_items, CAST(positive AS BIGINT) AS positive_items,
  CAST(score_10 AS DECIMAL(18,6))::DOUBLE AS score_10, CAST(positive * 100.0 / greatest(1, scored) AS DECIMAL(18,6))::DOUBLE AS coverage FROM ({_SECTION_SQL})""")
def sub_to_section(t: Tables) -> DataFrame:
    """Sections without a sub-criterion that counts fall back on all of theirs."""
    out = rollup.section_scores(_subs(t), ("section",), (), rounded=False)
    return out.select("section", "total_items", "scored_items", "signal_count", "evidence_count", "good_items", "positive_items", dec(F.col("score_10")).alias("score_10"), dec(F.col("coverage_score_0to100")).alias("coverage"))


_EXCLUDED = [("a", "MACHINERY"), ("b", "BUILDING"), ("b", "MACHINERY"), ("b", "HOUSEHOLD"), ("b", "AUTOMOBILE"), ("b", "FURNITURE")]


@query(f"""
WITH s AS (SELECT c_nationkey AS doc_id, CASE WHEN c_nationkey % 5 = 0 THEN 'b' WHEN c_nationkey % 2 = 0 THEN 'a' ELSE 'c' END AS doc_type, c_mktsegment, x.* FROM customer JOIN ({_SECTION_SQL}) x ON section = c_custkey),
o AS (SELECT *, NOT ((doc_type = 'a' AND c_mktsegment = 'MACHINERY') OR (doc_type = 'b' AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE', 'FURNITURE'))) AS scoring FROM s)
SELECT doc_id, CAST(sum(total) AS BIGINT) AS total_items, CAST(sum(scored) AS BIGINT) AS scored_items,
  CAST(CASE WHEN count(*) FILTER (scoring) > 0 THEN sum(positive) FILTER (scoring) ELSE sum(positive) END AS BIGINT) AS positive_items,
  CAST(CASE WHEN count(*) FILTER (scoring) > 0 THEN avg(score_10) FILTER (scoring) ELSE avg(score_10) END AS DECIMAL(18,6))::DOUBLE AS score_10,
  CAST(CASE WHEN count(*) FILTER (scoring) > 0 THEN sum(positive) FILTER (scoring) ELSE sum(positive) END * 100.0 / greatest(1, sum(scored)) AS DECIMAL(18,6))::DOUBLE AS coverage FROM o GROUP BY doc_id
""")
def section_to_overall(t: Tables) -> DataFrame:
    """Excluded sections leave the score and the positive count, not the count that coverage divides by."""
    sec = rollup.section_scores(_subs(t), ("section",), (), rounded=False)
    kind = F.when(F.col("c_nationkey") % 5 == 0, "b").when(F.col("c_nationkey") % 2 == 0, "a").otherwise("c")
    rows = t.customer.join(sec, F.col("c_custkey") == F.col("section")).select(F.col("c_nationkey").alias("doc_id"), kind.alias("doc_type"), F.col("c_mktsegment").alias("section_key"), F.lit(1.0).alias("section_weight"), *[c for c in sec.columns if c != "section"])
    out = rollup.overall_scores(rows, t.spark.createDataFrame(_EXCLUDED, "doc_type string, section_key string"), rounded=False)
    return out.select("doc_id", "total_items", "scored_items", "positive_items", dec(F.col("score_10")).alias("score_10"), dec(F.col("coverage_score_0to100")).alias("coverage"))


@query(f"SELECT sub_id, CAST(CASE WHEN o_orderstatus = 'F' THEN least(score_10, 6.0) ELSE score_10 END AS DECIMAL(18,6))::DOUBLE AS score_10, o_orderstatus = 'F' AND score_10 > 6 AS capped FROM ({_SUB_SQL}) JOIN orders ON o_orderkey = sub_id")
def score_caps(t: Tables) -> DataFrame:
    sub = rollup.sub_scores(_signals(t), ("sub_id",), (), rounded=False)
    rows = sub.join(t.orders.select(F.col("o_orderkey").alias("sub_id"), F.col("o_orderstatus").alias("doc_type")), "sub_id").withColumnRenamed("sub_id", "key").withColumn("sub_id", F.lit("af.1"))
    out = rollup.cap(rows, t.spark.createDataFrame([("F", "af.1", 6.0)], "doc_type string, sub_id string, cap double"))
    return out.select(F.col("key").alias("sub_id"), dec(F.col("score_10")).alias("score_10"), "capped")


@query("""
WITH s AS (SELECT o_custkey, o_custkey % 12 + o_orderkey % 3 - 2 AS v FROM orders), c AS (SELECT o_custkey, v >= 0 AS counts, CASE WHEN v < 0 THEN 0.0 ELSE least(10.0, greatest(0.0, v)) END AS x FROM s)
SELECT o_custkey AS doc_id, CAST(count(*) AS BIGINT) AS total_items, CAST(CASE WHEN count(*) FILTER (counts) > 0 THEN avg(x) FILTER (counts) ELSE avg(x) END AS DECIMAL(18,6))::DOUBLE AS score_10 FROM c GROUP BY o_custkey
""")
def flat_scores(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("doc_id"), F.lit("g.1").alias("sub_id"), (F.col("o_custkey") % 12 + F.col("o_orderkey") % 3 - 2).alias("score"))
    subs = t.spark.createDataFrame([("g.1", "general", 1.0, 4)], "sub_id string, section_key string, sub_weight double, n_signals long")
    out = rollup.section_scores(rollup.flat_scores(rows, subs, rounded=False), ("doc_id",), (), rounded=False)
    return out.select("doc_id", "total_items", dec(F.col("score_10")).alias("score_10"))


@query("SELECT l_orderkey AS doc_id, CAST(printf('%.4f', avg(CAST(l_quantity AS INTEGER) % 6)) AS DOUBLE) AS mean FROM lineitem GROUP BY l_orderkey")
def mean_signal_score(t: Tables) -> DataFrame:
    signals = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("int") % 6).alias("score"))
    return rollup.mean_signal(signals).select("doc_id", F.col("avg_signal_score_0to5").alias("mean"))


def _works(t: Tables) -> DataFrame:
    doi = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("10.1/"), "o_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, ("journal-article", "report", "dataset", "Lecture-Speech", "patent"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    title = F.concat(F.lit("Study of "), F.element_at(F.array(*map(F.lit, ("health policy", "Dementia", "bridges", "NHS trial"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return t.orders.select(F.col("o_custkey").alias("orcid"), F.col("o_orderkey").alias("put_code"), title.alias("title"), F.year("o_orderdate").alias("year"), kind.alias("type"), doi.alias("doi"))


def _cited(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey % 7 <> 0").groupBy(F.concat(F.lit("10.1/"), "l_orderkey").alias("doi")).agg(F.count("*").alias("cited_by"))


_CITED_SQL = "SELECT o_custkey AS orcid, year(o_orderdate) AS y, n AS c FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0"


@query(f"""
WITH c AS ({_CITED_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY orcid ORDER BY c DESC) AS down, row_number() OVER (PARTITION BY orcid ORDER BY c) AS up, count(*) OVER (PARTITION BY orcid) AS n FROM c),
h AS (SELECT orcid, max(CASE WHEN c >= down THEN down ELSE 0 END) AS h, sum(c) AS total, sum(CASE WHEN y >= 1997 THEN c ELSE 0 END) AS recent, max(c) AS top1, sum(CASE WHEN down <= 3 THEN c ELSE 0 END) AS top3, max(CASE WHEN up = n // 2 + 1 THEN c END) AS mid, max(n) AS n FROM r GROUP BY orcid),
w AS (SELECT o_custkey AS orcid, count(*) FILTER (o_orderkey % 3 <> 0) AS d, greatest(1, 2001 - min(year(o_orderdate)) + 1) AS career FROM orders GROUP BY 1)
SELECT w.orcid, CAST(coalesce(h, 0) AS BIGINT) AS h_index, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(recent, 0) AS BIGINT) AS recent, CAST(coalesce(top1, 0) AS BIGINT) AS top1, CAST(coalesce(top3, 0) AS BIGINT) AS top3, CAST(coalesce(mid, 0) AS BIGINT) AS median,
  CAST(CASE WHEN d > 0 THEN coalesce(n, 0) * 1.0 / d ELSE 0 END AS DECIMAL(18,6))::DOUBLE AS coverage, CAST(coalesce(total, 0) * 1.0 / career AS DECIMAL(18,6))::DOUBLE AS per_year FROM w LEFT JOIN h USING (orcid)
""")
def citation_features(t: Tables) -> DataFrame:
    out = citations.citation_features(_works(t), _cited(t), 2001)
    return out.select("orcid", long(F.col("h_index")).alias("h_index"), F.col("citations_total").alias("total"), F.col("citations_recent_5y").alias("recent"), F.col("citations_top1").alias("top1"), F.col("citations_top3_sum").alias("top3"), F.col("citations_median_per_paper").alias("median"), dec(F.col("citation_coverage_ratio")).alias("coverage"), dec(F.col("citations_per_year")).alias("per_year"))


@query("""
SELECT o_custkey AS orcid, CAST(count(*) AS BIGINT) AS works_total, CAST(count(*) FILTER (o_orderkey % 3 <> 0) AS BIGINT) AS works_with_doi, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year,
  CAST(count(*) FILTER (year(o_orderdate) >= 1999) AS BIGINT) AS recent_3y, CAST(count(*) FILTER (year(o_orderdate) >= 1997) AS BIGINT) AS recent_5y, CAST(count(*) FILTER (o_orderkey % 5 = 0) AS BIGINT) AS journal, CAST(count(*) FILTER (o_orderkey % 5 = 3) AS BIGINT) AS presentations,
  CAST(count(DISTINCT o_orderkey % 5) AS BIGINT) AS diversity, CAST(count(*) FILTER (o_orderkey % 4 IN (0, 3)) AS BIGINT) AS policy_hits, CAST(count(*) FILTER (o_orderkey % 4 IN (1, 3)) AS BIGINT) AS clinical_hits,
  CAST(sum(CASE WHEN 2001 - year(o_orderdate) <= 1 THEN 1.0 WHEN 2001 - year(o_orderdate) <= 3 THEN 0.7 WHEN 2001 - year(o_orderdate) <= 5 THEN 0.4 ELSE 0.2 END) AS DECIMAL(18,6))::DOUBLE AS recency FROM orders GROUP BY o_custkey
""")
def output_features(t: Tables) -> DataFrame:
    o = citations.output_features(_works(t), 2001)
    return o.select("orcid", "works_total", "works_with_doi", F.col("first_pub_year").alias("first_year"), F.col("last_pub_year").alias("last_year"), F.col("works_recent_3y").alias("recent_3y"), F.col("works_recent_5y").alias("recent_5y"), F.col("journal_article_total").alias("journal"), F.col("presentations_total").alias("presentations"), F.col("output_diversity").alias("diversity"), F.col("policy_title_hits").alias("policy_hits"), F.col("clinical_title_hits").alias("clinical_hits"), dec(F.col("pub_score_recency")).alias("recency"))


@query("""
WITH k AS (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'report' WHEN 2 THEN 'dataset' WHEN 3 THEN 'lecture-speech' ELSE 'patent' END AS kind, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey AS orcid, string_agg(kind || '=' || n, ';' ORDER BY kind) AS counts FROM k GROUP BY o_custkey
""")
def type_histogram(t: Tables) -> DataFrame:
    out = citations.type_counts(_works(t))
    return out.select("orcid", F.array_join(F.transform(F.map_entries("type_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("counts"))


_FUNDER = "CASE s_suppkey % 5 WHEN 0 THEN 'National Institute for Health and Care Research' WHEN 1 THEN 'The Wellcome Trust' WHEN 2 THEN ' NSF ' WHEN 3 THEN 'Acme' ELSE 'UK Research and Innovation (UKRI)' END"


@query("""
SELECT s_nationkey AS orcid, CAST(count(*) AS BIGINT) AS funding_total, CAST(sum(CASE s_suppkey % 5 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 3 END) AS BIGINT) AS score_sum, CAST(max(CASE s_suppkey % 5 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 3 END) AS INTEGER) AS score_max,
  CAST(bool_or(s_suppkey % 5 = 0) AS INTEGER) AS nihr, CAST(bool_or(s_suppkey % 5 = 4) AS INTEGER) AS ukri, CAST(count(*) FILTER (s_suppkey % 2 = 0) * 1.0 / count(*) AS DECIMAL(18,6))::DOUBLE AS with_year FROM supplier GROUP BY s_nationkey
""")
def funding_features(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_nationkey").alias("orcid"), F.expr(_FUNDER).alias("org"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 2000 END").alias("start_year"))
    o = citations.funding_features(rows)
    return o.select("orcid", "funding_total", F.col("funder_score_sum").alias("score_sum"), F.col("funder_score_max").alias("score_max"), F.col("funder_nihr_flag").alias("nihr"), F.col("funder_ukri_flag").alias("ukri"), dec(F.col("funding_has_start_year_ratio")).alias("with_year"))


def _team(t: Tables) -> DataFrame:
    """The lineitems of an order as a team, the first one leading."""
    org = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'City NHS Trust' WHEN 1 THEN 'Old University' WHEN 2 THEN 'Hope Charity' WHEN 3 THEN 'Acme' ELSE '' END")
    role = F.expr("CASE l_partkey % 4 WHEN 0 THEN 'Consultant nurse leading PhD student training' WHEN 1 THEN 'Published 3 papers, 1,200 citations' WHEN 2 THEN '' ELSE 'Grant funding from MRC' END")
    name = F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'Professor A' ELSE 'Ms B' END")
    m = F.struct(name.alias("full_name"), org.alias("organisation"), role.alias("proposed_role"), F.expr("CASE WHEN l_suppkey % 3 = 0 THEN '0000' ELSE ' ' END").alias("orcid"), F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit("%")).alias("fte"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", m.alias("m")))), lambda x: x["m"]).alias("members"), F.max("l_quantity").alias("lead_fte"), (F.count("*") > 3).alias("has_joint_lead"))


@query("""
SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS team_size, CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS total_fte, CAST(count(*) FILTER (l_suppkey % 3 = 0) AS BIGINT) AS orcid_count, count(*) > 3 AS has_joint_lead FROM lineitem GROUP BY l_orderkey
""")
def team_composition(t: Tables) -> DataFrame:
    return features.team_composition(_team(t)).select("doc_id", "team_size", F.col("total_fte_commitment").alias("total_fte"), "orcid_count", "has_joint_lead")


@query("""
SELECT l_orderkey AS doc_id, CAST(count(DISTINCT CASE WHEN l_suppkey % 5 < 4 THEN l_suppkey % 5 END) AS BIGINT) AS unique_organisations, CAST(count(*) FILTER (l_suppkey % 5 = 0) AS BIGINT) AS nhs, CAST(count(*) FILTER (l_suppkey % 5 = 1) AS BIGINT) AS university, CAST(count(*) FILTER (l_suppkey % 5 = 2) AS BIGINT) AS charity FROM lineitem GROUP BY l_orderkey
""")
def org_type_counts(t: Tables) -> DataFrame:
    return features.organisations(_team(t)).select("doc_id", "unique_organisations", F.col("nhs_members").alias("nhs"), F.col("university_members").alias("university"), F.col("charity_members").alias("charity"))


@query("""
SELECT l_orderkey AS doc_id, CAST(3 * count(*) FILTER (l_partkey % 4 = 1) AS BIGINT) AS publications, CAST(3 * count(*) FILTER (l_partkey % 4 = 3) AS BIGINT) AS grants, CAST(count(*) FILTER (l_partkey % 4 = 0) AS BIGINT) AS leadership, CAST(2 * count(*) FILTER (l_partkey % 4 = 0) AS BIGINT) AS mentorship,
  CAST(2 * count(*) FILTER (l_partkey % 4 = 0) AS BIGINT) AS clinical, CAST(count(*) FILTER (l_partkey % 4 = 0) AS BIGINT) AS clinical_members, CAST(count(*) FILTER (l_linenumber % 2 = 0) AS BIGINT) AS senior, CAST(coalesce(max(1200) FILTER (l_partkey % 4 = 1), 0) AS BIGINT) AS citations FROM lineitem GROUP BY l_orderkey
""")
def team_experience(t: Tables) -> DataFrame:
    return features.experience(_team(t)).select("doc_id", F.col("publication_mention_count").alias("publications"), F.col("grant_mention_count").alias("grants"), F.col("leadership_mention_count").alias("leadership"), F.col("mentorship_mention_count").alias("mentorship"), F.col("clinical_mention_count").alias("clinical"), F.col("clinical_team_members").alias("clinical_members"), F.col("senior_title_count").alias("senior"), long(F.col("max_citations_mentioned")).alias("citations"))


@query("""
SELECT c_custkey AS doc_id, CAST(c_custkey * 1000 AS DOUBLE) AS cost, CAST(c_custkey % 13 AS INTEGER) AS months, CAST(CASE WHEN c_custkey % 13 > 0 THEN c_custkey * 1000.0 / (c_custkey % 13) ELSE 0 END AS DECIMAL(18,2))::DOUBLE AS per_month, CAST(3 * (c_custkey % 100) AS DOUBLE) AS nhs, c_custkey % 2 = 0 AS again FROM customer
""")
def project_metrics(t: Tables) -> DataFrame:
    raw = F.format_string('{"SUMMARY INFORMATION":{"Total Cost to NIHR":"£%dk","Duration (months)":"%d","NHS Support Costs":"£%d","NHS Excess Treatment Costs":"£%d.00","%s":"%s"}}', "c_custkey", F.col("c_custkey") % 13, F.col("c_custkey") % 100, F.col("c_custkey") % 100 * 2, F.lit(features.RESUBMITTED), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("No"))
    out = features.project_metrics(t.customer.select(F.col("c_custkey").alias("doc_id"), raw.alias("raw")))
    return out.select("doc_id", F.col("total_cost_to_nihr").alias("cost"), F.col("duration_months").alias("months"), F.col("cost_per_month").cast("decimal(18,2)").cast("double").alias("per_month"), F.col("total_nhs_costs").alias("nhs"), F.col("is_resubmission").alias("again"))


@query("""
SELECT p_partkey AS doc_id, p_partkey % 4 = 0 AS ppi, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size * 1000 ELSE 0 END AS DOUBLE) AS amount, p_partkey % 4 = 1 AS capacity, p_partkey % 4 = 2 AS equipment, p_partkey % 4 = 3 AS staff FROM part
""")
def budget_allocation(t: Tables) -> DataFrame:
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Public involvement costs £' || p_size || 'k a year' WHEN 1 THEN 'a PhD for £5' WHEN 2 THEN 'one laptop' ELSE 'Salaries' END")
    out = features.allocation(t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("budget")))
    return out.select("doc_id", F.col("has_ppi_budget").alias("ppi"), F.col("ppi_budget_amount").alias("amount"), F.col("has_capacity_building").alias("capacity"), F.col("has_equipment_costs").alias("equipment"), F.col("has_staff_costs").alias("staff"))


@query("""
WITH v AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label AS doc_id, vec_id AS line_pos, CAST(round(list_sum(list_transform(list_zip(e, b), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x))), 5) AS DECIMAL(18,5))::DOUBLE AS score FROM v WHERE b IS NOT NULL
""")
def adjacent_cosine(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").alias("doc_id"), F.lit("all").alias("section"), F.col("vec_id").alias("line_pos"), "embedding")
    return features.adjacent_cosine(rows).select("doc_id", "line_pos", F.round("score", 5).cast("decimal(18,5)").cast("double").alias("score"))


@query("""
WITH s AS (SELECT label AS doc_id, 's' || vec_id % 3 AS section, value AS score FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings)),
b AS (SELECT doc_id, section, sum(score) AS s, count(*) AS n, count(*) FILTER (score < 0.1) AS low FROM s GROUP BY ALL)
SELECT doc_id, CAST(sum(s) / sum(n) AS DECIMAL(18,6))::DOUBLE AS coherence, CAST(sum(low) AS BIGINT) AS low_count, arg_min(section, s / n) AS worst_section FROM b GROUP BY doc_id
""")
def section_coherence(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").alias("doc_id"), F.concat(F.lit("s"), F.col("vec_id") % 3).alias("section"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return features.coherence(rows).select("doc_id", dec(F.col("coherence")).alias("coherence"), "low_count", "worst_section")


@query("""
SELECT l_orderkey AS doc_id, CAST(count(*) - 1 AS INTEGER) AS max_depth, CAST(round((count(*) - 1) / 2.0, 2) AS DOUBLE) AS avg_depth FROM lineitem GROUP BY l_orderkey
""")
def dependency_depth(t: Tables) -> DataFrame:
    """An order's lines as a chain of tokens, each hanging on the one before."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = t.lineitem.select("l_orderkey", (F.row_number().over(w) - 1).alias("i"))
    sent = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list("i")), lambda i: F.greatest(i - 1, F.lit(0)).cast("int")).alias("heads"))
    out = features.dependency_depth(sent.withColumn("is_punct", F.transform("heads", lambda h: F.lit(False))))
    return out.select("doc_id", F.col("max_dependency_depth").alias("max_depth"), F.col("avg_dependency_depth").alias("avg_depth"))


# single letters and abbreviations that may end a sentence keep their full stops: as there are no lookarounds, in two passes
_MAY_END = rf"'(^|[^\p{{L}}\p{{N}}.])({features.abbreviations()[1]})\.( [\p{{Ll}}\p{{N}}])', '\1\2' || chr(2) || '\3', 'g'"
_ONE_LETTER = r"'(^|[^\p{L}\p{N}.])(\p{L})\.([^.]|$)', '\1\2' || chr(2) || '\3', 'g'"


@query(rf"""
WITH t AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(^|[^\p{{L}}\p{{N}}.])({features.abbreviations()[0]})\.', '\1\2' || chr(2), 'g') AS x FROM conversations),
u AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, {_MAY_END}), {_MAY_END}) AS x FROM t),
v AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, {_ONE_LETTER}), {_ONE_LETTER}) AS x FROM u),
s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(x, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS x FROM v),
n AS (SELECT conv_id, turn, list_transform(x, lambda y: len(string_split(y, ' '))) AS n FROM s)
SELECT conv_id * 1000 + turn AS doc_id, CAST(len(n) AS BIGINT) AS total_sentences, CAST(printf('%.2f', CASE WHEN len(n) > 0 THEN list_sum(n) / CAST(len(n) AS DOUBLE) ELSE 0.0 END) AS DOUBLE) AS avg_sentence_length,
  CAST(printf('%.4f', CASE WHEN len(n) > 0 THEN len(list_filter(n, lambda x: x >= 30)) / CAST(len(n) AS DOUBLE) ELSE 0.0 END) AS DOUBLE) AS long_sentence_ratio FROM n
""")
def sentence_metrics(t: Tables) -> DataFrame:
    return features.sentence_metrics(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), T.text_or_empty("text").alias("text")))
