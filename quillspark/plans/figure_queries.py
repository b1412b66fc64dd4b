"""Figures of sections, derived chunks, repaired findings, scoped evidence, teams and confidence.

Rounded values are compared as printf writes them: half to even on the exact binary value, as the operators round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..operators import belief, chunks, citations, evaluate, features, lines, repair, retrieval, rollup
from .registry import F, Tables, dec, long, query
from .text_queries import READ_WORDS, SENTENCES, SYLLABLES, _turns

_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: x <> '' AND len(string_split(x, ' ')) >= 4)"
_TOKENS = f"list_filter(list_transform({SENTENCES}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9 ]+', '', 'g'))), lambda x: x <> '' AND len(string_split(regexp_replace(x, ' +', ' ', 'g'), ' ')) >= 5)"
_OVERLAP = r"list_distinct(regexp_extract_all(regexp_replace(lower(text), '[a-z]*[\p{N}_\x{80}-\x{10FFFF}][\p{L}\p{N}_]*', ' ', 'g'), '[a-z]{3,}'))"
_COMMON = "('because','between','different','important','research','summary','treatment','patients','people','project','condition','currently')"


def _fmt(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _rate(items: str) -> str:
    return _fmt(f"CASE WHEN len({items}) = 0 THEN 0.0 ELSE 1 - len(list_distinct({items})) / CAST(len({items}) AS DOUBLE) END", 3)


@query(f"SELECT doc_id, {_rate('s')} AS sentence_duplication, {_rate('l')} AS line_duplication FROM (SELECT doc_id, {_TOKENS} AS s, {_LINES} AS l FROM documents)")
def duplication_rates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.duplication_rate(T.sentence_tokens("text")).alias("sentence_duplication"), T.duplication_rate(T.normalized_lines("text")).alias("line_duplication"))


_JACCARD = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END"


@query(f"""
WITH w AS (SELECT conv_id, turn, {_OVERLAP} AS x FROM conversations)
SELECT a.conv_id, a.turn, {_fmt(_JACCARD.format(a="a.x", b="b.x"), 3)} AS similarity FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""")
def turn_similarity(t: Tables) -> DataFrame:
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.jaccard_similarity("a", "b").alias("similarity"))


@query(f"""
WITH w AS (SELECT conv_id, turn, {_OVERLAP} AS x FROM conversations),
p AS (SELECT a.conv_id, a.turn AS ta, b.turn AS tb, {_fmt(_JACCARD.format(a="a.x", b="b.x"), 3)} AS score FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, ta, tb) AS rank FROM p WHERE score >= 0.05)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, 't' || ta AS section_a, 't' || tb AS section_b, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
""")
def turn_overlaps(t: Tables) -> DataFrame:
    """The overlap of the sections of a document, turns being sections."""
    sections = t.conversations.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("section_pos"), F.concat(F.lit("t"), "turn").alias("parser_section"), "text")
    return chunks.overlaps(sections, 0.05)


@query(f"""
WITH w AS (SELECT conv_id // 25 AS doc, conv_id * 1000 + turn AS pos, {_OVERLAP} AS x FROM conversations),
p AS (SELECT a.doc, a.pos AS pa, b.pos AS pb, {_fmt(_JACCARD.format(a="a.x", b="b.x"), 3)} AS score FROM w a JOIN w b ON a.doc = b.doc AND a.pos < b.pos),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, pa, pb) AS rank FROM p WHERE score >= 0.1)
SELECT CAST(doc AS VARCHAR) AS doc_id, 't' || pa AS section_a, 't' || pb AS section_b, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
""")
def thread_overlaps(t: Tables) -> DataFrame:
    """Documents of many sections: the turns of 25 conversations each, found through the index of words."""
    pos = F.col("conv_id") * 1000 + F.col("turn")
    sections = t.conversations.select(F.floor(F.col("conv_id") / 25).cast("string").alias("doc_id"), pos.cast("int").alias("section_pos"), F.concat(F.lit("t"), pos).alias("parser_section"), "text")
    return chunks.overlaps(sections, 0.1)


def _talks(t: Tables) -> DataFrame:
    """Sections of a conversation: what users say is its plain summary, what assistants say its plan."""
    name = F.when(F.col("role") == "user", chunks.PLAIN_SECTIONS[0]).when(F.col("role") == "assistant", chunks.PLAN_SECTION).otherwise(F.col("role"))
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_pos"), F.concat(F.lit("c"), "turn").alias("chunk_id"), name.alias("parser_section"), name.alias("source_path"), "text")
    return chunks.section_texts(rows)


@query(rf"""
WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user') AS text, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant') AS plan FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, text, plan, {READ_WORDS} AS words, list_filter({SENTENCES}, lambda x: regexp_matches(x, '\S')) AS sents, {_OVERLAP} AS ow FROM t WHERE regexp_matches(text, '\S')),
p AS (SELECT conv_id, {_OVERLAP} AS pw FROM (SELECT conv_id, coalesce(plan, '') AS text FROM t)),
n AS (SELECT conv_id, words, ow, CAST(len(sents) AS DOUBLE) AS s, CAST(len(words) AS DOUBLE) AS w, CAST(coalesce({SYLLABLES}, 0) AS DOUBLE) AS y,
  list_transform(list_transform(sents, lambda text: {READ_WORDS}), lambda x: len(x)) AS lengths,
  list_distinct(list_filter(list_transform(words, lambda w: trim(lower(w), '''')), lambda w: length(w) >= 11 AND w NOT IN {_COMMON})) AS terms FROM c)
SELECT n.conv_id AS doc_id, CAST(w AS INTEGER) AS word_count, CAST(s AS INTEGER) AS sentence_count, {_fmt("CASE WHEN s > 0 THEN list_sum(lengths) / s ELSE 0 END", 2)} AS avg_sentence_length,
  {_fmt("CASE WHEN s > 0 THEN len(list_filter(lengths, lambda x: x >= 30)) / s ELSE 0 END", 3)} AS long_sentence_ratio,
  {_fmt("CASE WHEN s > 0 AND w > 0 THEN 0.39 * (w / s) + 11.8 * (y / w) - 15.59 ELSE 0 END", 2)} AS fk_grade, {_fmt("CASE WHEN s > 0 AND w > 0 THEN 206.835 - 1.015 * (w / s) - 84.6 * (y / w) ELSE 0 END", 2)} AS reading_ease,
  {_fmt("CASE WHEN w > 0 THEN len(terms) / w * 100 ELSE 0 END", 2)} AS jargon_density, {_fmt(_JACCARD.format(a="ow", b="pw"), 3)} AS alignment
FROM n JOIN p USING (conv_id)
""")
def plain_figures(t: Tables) -> DataFrame:
    out = chunks.plain_metrics(_talks(t))
    return out.select("doc_id", "word_count", "sentence_count", "avg_sentence_length", "long_sentence_ratio", "fk_grade", "reading_ease", "jargon_density", "alignment")


@query(rf"""
WITH r AS (SELECT conv_id, role, min(turn) AS pos, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL),
d AS (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM r WHERE regexp_matches(text, '\S') GROUP BY conv_id),
f AS (SELECT conv_id, n, {_TOKENS} AS s, {_LINES} AS l, text FROM d)
SELECT conv_id AS doc_id, CAST(n AS INTEGER) AS n_sections, CAST(len(regexp_extract_all(text, '(?m)^\s*(?:[-*•]|\d+[.)])\s+')) AS BIGINT) AS bullets, {_rate('s')} AS sentence_duplication, {_rate('l')} AS line_duplication FROM f
""")
def form_figures(t: Tables) -> DataFrame:
    out = chunks.form_metrics(_talks(t))
    return out.select("doc_id", F.size("sections").alias("n_sections"), long(F.col("bullets")).alias("bullets"), "sentence_duplication", "line_duplication")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
n AS (SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN length(t) <= 1200 THEN 1 ELSE CAST(ceil(length(t) / 1200.0) AS BIGINT) END AS pieces FROM d)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pieces + CASE WHEN pieces > 0 THEN 3 ELSE 2 END AS BIGINT) AS n_chunks,
  CASE WHEN pieces = 0 THEN 'secn__001' WHEN pieces = 1 THEN 'secpes__001' ELSE 'secpes__001_a' END AS first_id,
  CASE WHEN pieces > 0 THEN 'secpena__001' ELSE 'secn__001' END AS before_last, 'secafa__001' AS last_id FROM n
""")
def chunk_pool(t: Tables) -> DataFrame:
    """Documents as applications with a summary and a note, through the whole pool: leaves, pieces, ids, derived chunks last."""
    details = F.struct(F.struct(F.col("text").alias("Plain English Summary"), F.concat(F.lit("n"), "doc_id").alias("Notes")).alias("APPLICATION DETAILS"))
    pool = chunks.pool(t.documents.select("doc_id", F.to_json(details).alias("raw")))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("chunk_pos", "chunk_id"))), lambda x: x["chunk_id"])
    out = pool.groupBy("doc_id").agg(ids.alias("ids"), F.count_distinct("chunk_pos").alias("n_chunks"))
    return out.select("doc_id", "n_chunks", F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -2).alias("before_last"), F.element_at("ids", -1).alias("last_id"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS a, l_suppkey % 3 AS b, CAST(l_quantity AS INTEGER) % 2 AS x FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
f AS (
  SELECT *, a AS k, 1 AS pos, 'c1' AS good, CASE WHEN a = b THEN 'c2' ELSE '' END AS bad, 's' || l_linenumber || ': ' || CASE WHEN a = b AND x = 1 THEN 'again' ELSE 'first' END AS said FROM l WHERE a < 2
  UNION ALL SELECT *, b, CASE WHEN a < 2 THEN 2 ELSE 1 END, '', 'c2', 's' || l_linenumber || ': ' || CASE WHEN x = 1 THEN 'again' ELSE 'first' END FROM l WHERE b < 2 AND a <> b)
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS section_pos, CAST(pos AS INTEGER) AS finding_pos, 'g.' || k AS sub_id, good, bad, said FROM f
""")
def belief_findings(t: Tables) -> DataFrame:
    """Answers with unknown sub-criteria and chunks, and sub-criteria named twice, repaired to findings."""
    w = "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity)"
    rows = t.lineitem.withColumn("rn", F.expr(w)).where("rn = 1")
    raw = F.format_string(
        '{"findings":[{"sub_id":"g.%d","evidence":{"good_evidence_ids":["c1","zz","c1"]},"implication":"first"},{"sub_id":"g.%d","evidence":{"good_evidence_ids":["yy"],"bad_evidence_ids":["c2"]},"implication":"%s"},{"sub_id":"g.0","evidence":{"good_evidence_ids":["zz"]},"implication":"none"}]}',
        F.col("l_partkey") % 3,
        F.col("l_suppkey") % 3,
        F.when(F.col("l_quantity").cast("int") % 2 == 1, "again").otherwise("first"),
    )
    name = F.concat(F.lit("s"), "l_linenumber")
    answers = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("section_pos"), name.alias("section_name"), raw.alias("raw"))
    valid = answers.select("doc_id", "section_name", F.array(F.lit("c1"), F.lit("c2")).alias("chunk_ids"))
    subs = t.spark.createDataFrame([("g.0",), ("g.1",)], "sub_id string")
    out = belief.normalize(answers, valid, subs)
    return out.select("doc_id", "section_pos", "finding_pos", "sub_id", F.array_join("good", ",").alias("good"), F.array_join("bad", ",").alias("bad"), F.col("implication").alias("said"))


@query("""
WITH m(section_key, role) AS (VALUES ('talk', 'assistant'), ('rules', 'nobody')),
s AS (
  SELECT c.conv_id, m.section_key, c.turn FROM conversations c JOIN m USING (role)
  UNION SELECT c.conv_id, 'rules', c.turn FROM conversations c WHERE role = (SELECT role FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 0) AND c.conv_id % 2 = 0
  UNION SELECT c.conv_id, k.section_key, c.turn FROM conversations c, (VALUES ('talk'), ('rules')) k(section_key)
    WHERE (k.section_key = 'talk' AND NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'assistant'))
       OR (k.section_key = 'rules' AND (c.conv_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 0))))
SELECT conv_id AS doc_id, section_key, count(*) AS n, string_agg('t_' || turn, ',' ORDER BY turn) AS ids FROM s GROUP BY ALL
""")
def scoped_chunks(t: Tables) -> DataFrame:
    """Sections that a rubric's section reads, those that its beliefs lie in, or all chunks where that is nothing."""
    table = t.spark.createDataFrame([("talk", "assistant", 0), ("rules", "nobody", 0)], "section_key string, parser_section string, map_pos int")
    subs = t.spark.createDataFrame([("r.1", "rules")], "sub_id string, section_key string")
    rows = _turns(t)
    docs = rows.where("doc_id % 2 = 0").select("doc_id").distinct()
    none = F.array().cast("array<string>")
    held = docs.select("doc_id", F.lit("r.1").alias("sub_id"), F.array(F.lit("t_0"), F.lit("zz")).alias("good"), none.alias("bad"))
    out = retrieval.scoped(rows, table, held, subs)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("chunk_pos", "chunk_id"))), lambda x: x["chunk_id"])
    return out.groupBy("doc_id", "section_key").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"))


@query(r"""
WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations)
SELECT conv_id AS doc_id, md5('Score every signal from 0 to 5. Answer with JSON only.' || chr(10) || chr(10) || 'Rubric:' || chr(10) || '{}' || chr(10) || chr(10) || 'Chunks:' || chr(10)
  || string_agg('<t_' || turn || '> ' || CASE WHEN length(x) <= 900 THEN x ELSE substr(x, 1, 900) || '...' END, chr(10) ORDER BY turn)) AS digest FROM p GROUP BY conv_id
""")
def baseline_requests(t: Tables) -> DataFrame:
    return retrieval.baseline_messages(_turns(t), "{}").select("doc_id", F.md5(F.element_at("messages", 2)["content"]).alias("digest"))


@query("""
WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'o' || l_suppkey % 50 END AS orcid, l_suppkey % 50 AS k FROM lineitem),
s AS (SELECT *, l_linenumber <= 2 AND orcid <> '' AND k < 40 AS ok FROM m)
SELECT doc_id, count(*) AS team_size, count(*) FILTER (orcid <> '') AS orcid_count, CAST(printf('%.2f', count(*) FILTER (orcid <> '') / CAST(count(*) AS DOUBLE)) AS DOUBLE) AS coverage, count(*) FILTER (ok) AS resolved,
  CAST(printf('%.2f', coalesce(avg(k % 7) FILTER (ok), 0.0)) AS DOUBLE) AS avg_h, CAST(printf('%.2f', coalesce(avg(k * 3) FILTER (ok), 0.0)) AS DOUBLE) AS avg_citations, count(*) FILTER (l_linenumber > 2) AS skipped, count(*) FILTER (l_linenumber <= 2 AND orcid = '') AS without_id
FROM s GROUP BY doc_id
""")
def team_profiles(t: Tables) -> DataFrame:
    group = F.when(F.col("l_linenumber") == 1, "Lead Applicant").when(F.col("l_linenumber") == 2, "Joint Lead Applicant").otherwise("Co-Applicant")
    orcid = F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("o"), F.col("l_suppkey") % 50))
    members = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("member_pos"), group.alias("role_group"), orcid.alias("orcid"))
    k = F.col("s_suppkey") % 50
    known = t.supplier.select(k.alias("k")).unionAll(t.lineitem.select((F.col("l_suppkey") % 50).alias("k"))).distinct().where("k < 40")
    known = known.select(F.concat(F.lit("o"), "k").alias("orcid"), F.col("k").alias("works_total"), F.col("k").alias("works_recent_5y"), (F.col("k") % 7).alias("h_index"), (F.col("k") * 3).alias("citations_total"))
    rows, team = citations.enrich_team(members, known)
    told = rows.groupBy("doc_id").agg(F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "missing_orcid").alias("without_id"))
    return team.join(told, "doc_id").select("doc_id", "team_size", "orcid_count", F.col("orcid_coverage_ratio").alias("coverage"), F.col("resolved_profiles").alias("resolved"), F.col("avg_h_index").alias("avg_h"), "avg_citations", "skipped", "without_id")


@query("""
SELECT l_orderkey AS doc_id, 'g.' || l_partkey % 3 AS sub_id, l_linenumber AS pos, l_partkey % 3 <> 1 AND NOT (l_orderkey % 2 = 0 AND l_partkey % 3 = 2) AS counts, l_orderkey % 2 = 0 AND l_partkey % 3 = 2 AS doc_type_excluded, CAST(l_partkey % 3 + 1 AS DOUBLE) AS sub_weight FROM lineitem
""")
def scored_rows(t: Tables) -> DataFrame:
    """Signals with the weights of their sub-criteria, and which of these count."""
    sub = F.concat(F.lit("g."), F.col("l_partkey") % 3)
    signals = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit("general").alias("section_key"), sub.alias("sub_id"), F.concat(sub, F.lit(".a")).alias("sid"), F.col("l_linenumber").alias("pos"))
    state = signals.select("doc_id", "section_key", "sub_id").distinct()
    rubric = t.spark.createDataFrame([("general", f"g.{i}", f"g.{i}.a", 0, "Name" + " (If applicable)" * (i == 1), "", float(i + 1)) for i in range(3)], "section_key string, sub_id string, sid string, signal_pos int, name string, definition string, sub_weight double")
    types = signals.select("doc_id").distinct().withColumn("doc_type", F.when(F.col("doc_id") % 2 == 0, "short").otherwise("long"))
    excluded = t.spark.createDataFrame([("short", "g.2")], "doc_type string, sub_id string")
    return repair.scored_subs(signals, state, rubric, types, excluded).select("doc_id", "sub_id", "pos", "counts", "doc_type_excluded", "sub_weight")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN g < 0.5 THEN 'high_confidence' WHEN g < 1.5 THEN 'medium_confidence' ELSE 'low_confidence' END AS label,
  CASE WHEN g < 0.5 THEN 5.0 WHEN g < 1.5 THEN 2.5 ELSE 0.0 END::DOUBLE AS plausibility, CASE WHEN g < 0.5 THEN 100.0 WHEN g < 1.5 THEN 50.0 ELSE 0.0 END::DOUBLE AS evidence
FROM (SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS INTEGER) % 20) / 10.0 AS g FROM lineitem)
""")
def confidence_figures(t: Tables) -> DataFrame:
    label = rollup.confidence_label((F.col("l_quantity").cast("int") % 20) / 10.0)
    score = rollup.confidence_score(F.col("label"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", label.alias("label"))
    return rows.select("l_orderkey", "l_linenumber", "label", rollup.plausibility(score).alias("plausibility"), rollup.evidence_score(score).alias("evidence"))



@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY page)) AS digest, CAST(sum(length(line)) / any_value(n) AS DECIMAL(18,6))::DOUBLE AS avg_chars FROM p JOIN n USING (doc_id) WHERE page < 5 GROUP BY doc_id
""")
def page_texts(t: Tables) -> DataFrame:
    """Lines as pages: the text of the first five, characters a page over all."""
    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    return lines.page_budget(pages, 5).select("doc_id", F.md5("text").alias("digest"), dec(F.col("avg_chars")).alias("avg_chars"))


@query("SELECT o_orderkey, o_orderkey % 7 IN (0, 1, 2, 3, 4) AS is_empty FROM orders")
def empty_parses(t: Tables) -> DataFrame:
    """JSON with nothing beside its type, in several ways, and with something."""
    raw = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN '{"doc_type":"x"}' WHEN 1 THEN '{"doc_type":"x","A":"","B":[],"C":{}}' WHEN 2 THEN '{}' WHEN 3 THEN NULL WHEN 4 THEN '{"A":null,"B":0,"C":false}'
      WHEN 5 THEN '{"doc_type":"x","A":"' || o_orderkey || '"}' ELSE '{"A":{"b":""}}' END""")
    return t.orders.select("o_orderkey", lines.is_empty(raw).alias("is_empty"))


@query("SELECT p_partkey, p_size % 3 = 1 AS is_form FROM part")
def form_pages(t: Tables) -> DataFrame:
    """The form's name counts in the first two lines of a page only."""
    page = F.expr("CASE p_size % 3 WHEN 0 THEN p_name || '\n' || p_type || '\nRfPB' WHEN 1 THEN p_name || '\nRfPB ' || p_type || '\n' ELSE NULL END")
    return t.part.select("p_partkey", lines.is_rfpb(page).alias("is_form"))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def leaf_lengths(t: Tables) -> DataFrame:
    return lines.text_length(t.conversations.select(F.col("conv_id").cast("string").alias("doc_id"), "text")).select("doc_id", long(F.col("n_chars")).alias("n_chars"))


@query("""
SELECT 'small' AS "group", p_partkey AS name, CAST(p_size AS DOUBLE) AS a_score, CAST(p_size * 2 AS DOUBLE) AS b_score FROM part WHERE p_size < 25 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0
UNION ALL SELECT 'large', p_partkey, CAST(p_size AS DOUBLE), CAST(p_size * 2 AS DOUBLE) FROM part WHERE p_size >= 25 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
""")
def stacked_groups(t: Tables) -> DataFrame:
    """Rows of both methods by group, without those that lack a score or are named as left out."""

    def sides(where: str) -> tuple[DataFrame, DataFrame]:
        rows = t.part.where(where)
        a = rows.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("double").alias("a_score"))
        return a, rows.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"), (F.col("p_size") * 2).cast("double").alias("b_score"))

    out = evaluate.stack_groups({"small": sides("p_size < 25"), "large": sides("p_size >= 25 and p_partkey % 7 <> 0")}, "name", ["a_score", "b_score"])
    return out.select("group", "name", "a_score", "b_score")


@query(rf"""
WITH c AS (SELECT doc_id, text, {READ_WORDS} AS words, CAST(len(list_filter({SENTENCES}, lambda x: regexp_matches(x, '\S'))) AS DOUBLE) AS s FROM documents),
n AS (SELECT doc_id, s, CAST(len(words) AS DOUBLE) AS w, CAST(coalesce({SYLLABLES}, 0) AS DOUBLE) AS y, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS k,
  len(list_distinct(list_filter(list_transform(words, lambda w: lower(w)), lambda w: greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '[^a-z]', '', 'g'), 'e$', ''), '[aeiouy]+'))) >= 3))) AS hard FROM c),
g AS (SELECT *, {_fmt("CASE WHEN s > 0 AND w > 0 THEN 0.39 * (w / s) + 11.8 * (y / w) - 15.59 ELSE 0 END", 2)} AS grade FROM n)
SELECT doc_id, grade AS flesch_kincaid_grade, CAST(hard AS INTEGER) AS jargon_count, {_fmt("CASE WHEN k > 0 THEN hard / CAST(k AS DOUBLE) * 100 ELSE 0 END", 2)} AS jargon_density, grade BETWEEN 9 AND 12 AS is_grade_level_ok FROM g
""")
def plain_english(t: Tables) -> DataFrame:
    return features.plain_english(t.documents.select("doc_id", "text"))


@query("""
WITH w AS (SELECT o_custkey AS k, count(*) AS works, count(*) FILTER (o_orderkey % 3 <> 0) AS with_doi, min(year(o_orderdate)) AS first FROM orders GROUP BY 1)
SELECT 'p' || c_custkey AS orcid, coalesce(works, 0) AS works_total, coalesce(with_doi, 0) AS works_with_doi, CAST(coalesce(greatest(1, 2001 - first + 1), 1) AS INTEGER) AS career_years, CAST(0 AS BIGINT) AS funding_total, CAST(2001 AS INTEGER) AS now_year FROM customer LEFT JOIN w ON k = c_custkey
""")
def profile_features(t: Tables) -> DataFrame:
    """The wide row of every person, with or without works; nobody has fundings here."""
    person = F.concat(F.lit("p"), F.col("c_custkey"))
    doi = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("10.1/"), "o_orderkey"))
    works = t.orders.select(F.concat(F.lit("p"), F.col("o_custkey")).alias("orcid"), F.col("o_orderkey").alias("put_code"), F.lit("T").alias("title"), F.year("o_orderdate").alias("year"), F.lit("report").alias("type"), doi.alias("doi"))
    none = works.limit(0).select("orcid", F.lit("t").alias("title"), F.lit("grant").alias("type"), F.lit("o").alias("org"), F.lit("c").alias("org_city"), F.lit("c").alias("org_country"), F.col("year").alias("start_year"))
    out = citations.features(t.customer.select(person.alias("orcid")), works, none, None, 2001)
    return out.select("orcid", long(F.col("works_total")).alias("works_total"), long(F.col("works_with_doi")).alias("works_with_doi"), F.col("career_years").cast("int").alias("career_years"), long(F.col("funding_total")).alias("funding_total"), F.col("now_year").cast("int").alias("now_year"))
