"""Chunks, text figures, retrieval and parsing over documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions.columns import py_round
from ..operators import chunks, lines, retrieval
from ..sources.ledger import request_id
from .registry import F, Tables, dec, long, query

# SQL for the words of readability: runs of letters A-Z joined by ' or -, no part of another word.
READ_WORDS = r"regexp_extract_all(regexp_replace(text, '[A-Za-z]*[\p{N}_\x{80}-\x{10FFFF}][\p{L}\p{N}_]*', ' ', 'g'), '[A-Za-z][A-Za-z''-]*[A-Za-z]|[A-Za-z]')"
SENTENCES = r"string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+')"
SYLLABLES = r"list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'e$', ''), '[aeiouy]+')))))"


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count("text").alias("n_words"))


@query(r"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> '' AND len(string_split(x, ' ')) >= 4) AS l FROM documents)
""")
def repeated_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", T.normalized_lines("text").alias("l"))
    return rows.select("doc_id", long(F.size("l")).alias("n_lines"), long(F.size(F.array_distinct("l"))).alias("n_distinct"))


@query(rf"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(list_distinct(s)) AS BIGINT) AS n_distinct FROM (
  SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9 ]+', '', 'g'))), lambda x: x <> '' AND len(string_split(regexp_replace(x, ' +', ' ', 'g'), ' ')) >= 5) AS s FROM documents)
""")
def repeated_sentences(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", T.sentence_tokens("text").alias("s"))
    return rows.select("doc_id", long(F.size("s")).alias("n_sentences"), long(F.size(F.array_distinct("s"))).alias("n_distinct"))


@query(rf"""
WITH c AS (SELECT doc_id, {READ_WORDS} AS words, CAST(len(list_filter({SENTENCES}, lambda x: regexp_matches(x, '\S'))) AS DOUBLE) AS s FROM documents),
n AS (SELECT doc_id, s, CAST(len(words) AS DOUBLE) AS w, CAST(coalesce({SYLLABLES}, 0) AS DOUBLE) AS y FROM c)
SELECT doc_id, CAST(s AS BIGINT) AS n_sentences, CAST(w AS BIGINT) AS n_words, CAST(y AS BIGINT) AS n_syllables,
  CAST(CASE WHEN s > 0 AND w > 0 THEN 0.39 * (w / s) + 11.8 * (y / w) - 15.59 ELSE 0 END AS DECIMAL(18,6))::DOUBLE AS fk_grade,
  CAST(CASE WHEN s > 0 AND w > 0 THEN 206.835 - 1.015 * (w / s) - 84.6 * (y / w) ELSE 0 END AS DECIMAL(18,6))::DOUBLE AS reading_ease
FROM n
""")
def readability(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", T.read_words("text").alias("words"), F.size(T.read_sentences("text")).cast("double").alias("s"))
    rows = rows.select("doc_id", "s", F.size("words").cast("double").alias("w"), T.syllable_sum(F.col("words")).cast("double").alias("y"))
    s, w, y = F.col("s"), F.col("w"), F.col("y")
    return rows.select("doc_id", long(s).alias("n_sentences"), long(w).alias("n_words"), long(y).alias("n_syllables"), dec(T.flesch_kincaid(s, w, y)).alias("fk_grade"), dec(T.reading_ease(s, w, y)).alias("reading_ease"))


@query(rf"""
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_terms, array_to_string(list_sort(x), ' ') AS terms FROM (
  SELECT doc_id, list_distinct(list_filter(list_transform({READ_WORDS}, lambda w: trim(lower(w), '''')), lambda w: length(w) >= 11 AND w NOT IN ('because','between','different','important','research','summary','treatment','patients','people','project','condition','currently'))) AS x FROM documents)
""")
def technical_terms(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", T.technical_terms("text").alias("x"))
    return rows.select("doc_id", long(F.size("x")).alias("n_terms"), F.array_join(F.sort_array("x"), " ").alias("terms"))


def _hit(words: str) -> str:
    return rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)')"


_COVERS = " || ".join(f"CASE WHEN {_hit(p[3:-3])} THEN '{k};' ELSE '' END" for k, p in T.COVERAGE.items())


@query(f"SELECT conv_id, turn, {_COVERS} AS hits FROM (SELECT conv_id, turn, text || ' people need data to improve ' || role || ' support' AS text FROM conversations)")
def coverage_hits(t: Tables) -> DataFrame:
    text = F.concat("text", F.lit(" people need data to improve "), "role", F.lit(" support"))
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(T.coverage_hits(text), lambda x: F.concat(x, F.lit(";"))), "").alias("hits"))


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^\s*(?:[-*•]|\d+[.)])\s+')) AS BIGINT) AS bullets,
  CAST(len(regexp_extract_all(text, '(?m)^\s*\d+(?:\.\d+)*[.)]?\s+[A-Z][^\n]{3,120}$')) AS BIGINT) AS numbered_headings FROM documents
""")
def structure_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *[T.structure_count("text", k).alias(k) for k in ("bullets", "numbered_headings")])


_MONEY_SQL = "CASE c_custkey % 5 WHEN 0 THEN '£' || c_custkey || 'k' WHEN 1 THEN '£1,' || (100 + c_custkey % 900) || '.50' WHEN 2 THEN ' £' || c_custkey || 'M ' WHEN 3 THEN 'about ' || c_custkey ELSE NULL END"


@query(f"""
SELECT c_custkey, CAST(CASE c_custkey % 5 WHEN 0 THEN c_custkey * 1000 WHEN 1 THEN 1000 + 100 + c_custkey % 900 + 0.5 WHEN 2 THEN c_custkey * 1000000 ELSE 0 END AS DECIMAL(18,2))::DOUBLE AS amount,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 0 END AS DECIMAL(18,2))::DOUBLE AS percent FROM customer
""")
def money_and_percent(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.expr(_MONEY_SQL).alias("m"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '%' ELSE 'none' END").alias("p"))
    return rows.select("c_custkey", T.parse_currency("m").cast("decimal(18,2)").cast("double").alias("amount"), T.parse_percent("p").cast("decimal(18,2)").cast("double").alias("percent"))


@query("""
SELECT p_partkey, CAST(len(regexp_extract_all(lower(p_name), '\\bred\\b')) + len(regexp_extract_all(lower(p_name), '\\bring\\b')) + len(regexp_extract_all(lower(p_name), '\\bred ring\\b')) AS BIGINT) AS hits,
  p_name LIKE '%ring%' OR p_name LIKE '%bolt%' AS holds_any FROM part
""")
def keyword_hits(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.keyword_count("p_name", ["red", "ring", "red ring"]).alias("hits"), T.contains_any("p_name", ["ring", "bolt"]).alias("holds_any"))


@query("SELECT p_partkey, CAST(CASE WHEN p_name LIKE '%ring%' THEN p_size * 1000 WHEN p_name LIKE '%red%' THEN p_size * 1000 ELSE 0 END AS DECIMAL(18,2))::DOUBLE AS amount FROM part")
def category_amounts(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(" at £"), "p_size", F.lit("k and £7 more"))
    return t.part.select("p_partkey", T.category_amount(text, ["ring", "red"]).cast("decimal(18,2)").cast("double").alias("amount"))


@query(r"SELECT doc_id, CASE WHEN length(x) <= 500 THEN x ELSE substr(x, 1, 500) || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)")
def previews(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.preview("text").alias("preview"))


_NOTES = "CASE o_orderkey % 6 WHEN 0 THEN 'No significant gaps or limitations.' WHEN 1 THEN 'However, costs are unclear.' WHEN 2 THEN 'Strong and complete.' WHEN 3 THEN 'There are no weaknesses. The plan is limited.' WHEN 4 THEN 'g.1.a lacks detail. g.1.b is strong.' ELSE NULL END"


@query("SELECT o_orderkey, o_orderkey % 6 IN (1, 3, 4) AS caveat, o_orderkey % 6 = 4 AS about_a, false AS about_b FROM orders")
def caveats(t: Tables) -> DataFrame:
    note = F.expr(_NOTES)
    return t.orders.select("o_orderkey", T.has_caveat(note).alias("caveat"), T.caveat_about(note, F.lit("g.1.a")).alias("about_a"), T.caveat_about(note, F.lit("g.1.b")).alias("about_b"))


@query("""
SELECT o_orderkey, lower('10.' || (1000 + o_custkey % 9000) || '/Ab.' || o_orderkey) AS normal,
  CASE o_orderkey % 3 WHEN 0 THEN 'X/' || o_orderkey WHEN 1 THEN '10.' || (1000 + o_custkey % 9000) || '/Ab.' || o_orderkey ELSE NULL END AS found FROM orders
""")
def dois(t: Tables) -> DataFrame:
    doi = F.expr("'10.' || (1000 + o_custkey % 9000) || '/Ab.' || o_orderkey")
    shown = F.expr("CASE o_orderkey % 2 WHEN 0 THEN ' https://doi.org/' ELSE 'doi:' END")
    one = F.struct(F.lit("isbn").alias("type"), F.lit("none").alias("value"))
    two = F.struct(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'DOI' ELSE 'url' END").alias("type"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' X/' || o_orderkey WHEN 1 THEN 'see 10.' || (1000 + o_custkey % 9000) || '/Ab.' || o_orderkey ELSE 'nothing' END").alias("value"))
    return t.orders.select("o_orderkey", T.normalize_doi(F.concat(shown, doi)).alias("normal"), T.extract_doi(F.array(one, two)).alias("found"))


@query("SELECT conv_id, turn, substr(CASE WHEN starts_with(trim(text), role || ':') THEN trim(text) ELSE role || ': ' || trim(text) END, 1, 220) AS implication FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN role || ': ' || trim(text) ELSE text END AS text FROM conversations)")
def implications(t: Tables) -> DataFrame:
    text = F.expr("CASE WHEN turn % 2 = 0 THEN role || ': ' || trim(text) ELSE text END")
    return t.conversations.select("conv_id", "turn", T.with_prefix(F.col("role"), text).alias("implication"))


@query("""
WITH f AS (SELECT l_orderkey, l_partkey % 7 AS k, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY place, k) AS kept, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CASE WHEN k < 4 THEN 3 - k ELSE 1000 END, place, k) AS by_position FROM f GROUP BY l_orderkey
""")
def ordered_distinct(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 7).cast("string").alias("k")))).alias("x"))
    ids = ids.select("l_orderkey", F.array_distinct(F.transform("x", lambda s: s["k"])).alias("k"))
    places = F.map_from_entries(F.array(*[F.struct(F.lit(str(i)), F.lit(3 - i)) for i in range(4)]))
    return ids.select("l_orderkey", F.array_join("k", ",").alias("kept"), F.array_join(T.by_position(F.col("k"), places), ",").alias("by_position"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 < 2 THEN 'c_' || l_orderkey END AS sample, CASE l_linenumber % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' END AS phase, CAST(-l_linenumber - 0.25 AS DECIMAL(18,6))::DOUBLE AS number FROM lineitem")
def case_phases(t: Tables) -> DataFrame:
    name = F.expr("'c_' || l_orderkey || CASE l_linenumber % 3 WHEN 0 THEN '_before' WHEN 1 THEN '_after' ELSE '_later' END")
    sample, phase = T.case_and_phase(name)
    return t.lineitem.select("l_orderkey", "l_linenumber", sample.alias("sample"), phase.alias("phase"), dec(T.first_number(F.expr("'avg ' || (-l_linenumber - 0.25) || ' of 5'"))).alias("number"))


@query("""SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type = 'error' AS repaired FROM events""")
def json_answers(t: Tables) -> DataFrame:
    """Objects in answers with thoughts, fences or nothing around them."""
    raw = F.expr("CASE event_type WHEN 'error' THEN '<think>{no}</think>\n```json\n' || props || '\n```' WHEN 'click' THEN 'Answer: ' || props || ' .' ELSE props END")
    return t.events.select("event_id", F.get_json_object(T.json_object(raw), "$.k").cast("bigint").alias("k"), (F.col("event_type") == "error").alias("repaired"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, i, CASE WHEN length(t) <= 1200 THEN t ELSE substr(t, CAST(i * 1200 + 1 AS BIGINT), 1200) END AS piece, length(t) AS n FROM d, unnest(range(0, greatest(1, CAST(ceil(length(t) / 1200.0) AS BIGINT)))) x(i) WHERE t <> '')
SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(length(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS BIGINT) AS n_chars, md5(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS digest FROM p
""")
def chunk_fixed(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(chunks.split_text(F.col("text"))).alias("pos", "piece"))
    return rows.select("doc_id", "pos", long(F.length("piece")).alias("n_chars"), F.md5("piece").alias("digest"))


@query("""
WITH s AS (SELECT p_size AS doc, p_name || ' ' || p_type AS section, min(p_partkey) AS pos FROM part GROUP BY ALL),
b AS (SELECT *, 'sec' || array_to_string(list_transform(regexp_extract_all(lower(section), '[a-z0-9]+'), lambda x: x[1]), '') AS base FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY pos) AS nth FROM b)
SELECT CAST(doc AS VARCHAR) AS doc_id, section AS parser_section, CASE WHEN nth = 1 THEN base ELSE base || nth END AS slug FROM n
""")
def section_slugs(t: Tables) -> DataFrame:
    s = t.part.groupBy(F.col("p_size").cast("string").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("parser_section")).agg(F.min("p_partkey").alias("pos"))
    return chunks.slugs(s).drop("pos")


@query(r"""
WITH RECURSIVE s AS (SELECT p_brand AS doc, concat_ws(' ', p_name, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END) AS section, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
b AS (SELECT *, 'sec' || array_to_string(list_transform(regexp_extract_all(lower(section), '[a-z0-9]+'), lambda x: x[1]), '') AS base, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM s),
f AS (
  SELECT doc, section, base AS slug, i, [base] AS used FROM b WHERE i = 1 UNION ALL
  SELECT doc, section, slug, i, list_append(used, slug) FROM (
    SELECT b.doc, b.section, b.i, used, CASE WHEN list_contains(used, base) THEN base || list_filter(range(2, len(used) + 3), lambda k: NOT list_contains(used, base || k))[1] ELSE base END AS slug
    FROM f JOIN b ON b.doc = f.doc AND b.i = f.i + 1))
SELECT doc AS doc_id, section AS parser_section, slug FROM f
""")
def colliding_slugs(t: Tables) -> DataFrame:
    """Sections whose initials may end in a digit, so that numbered names meet other initials."""
    number = F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 5).cast("string"))
    s = t.part.groupBy(F.col("p_brand").alias("doc_id"), F.concat_ws(" ", "p_name", number).alias("parser_section")).agg(F.min("p_partkey").alias("pos"))
    return chunks.slugs(s).drop("pos")


def _turns(t: Tables) -> DataFrame:
    """Conversations as chunks: roles are sections, turns positions."""
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_pos"), F.concat_ws("_", F.lit("t"), "turn").alias("chunk_id"), F.col("role").alias("parser_section"), F.col("role").alias("source_path"), "text")


@query(r"""
WITH e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
p AS (SELECT conv_id, turn, role, nth, i, CASE WHEN length(t) <= 300 THEN 1 ELSE CAST(ceil(length(t) / 300.0) AS BIGINT) END AS n, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, CAST(i * 300 + 1 AS BIGINT), 300) END AS piece FROM e, unnest(range(0, greatest(1, CAST(ceil(length(t) / 300.0) AS BIGINT)))) x(i) WHERE t <> '')
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INTEGER) AS chunk_pos,
  'sec' || role[1] || '__' || lpad(CAST(nth AS VARCHAR), 3, '0') || CASE WHEN n > 1 THEN '_' || chr(CAST(97 + i AS INTEGER)) ELSE '' END AS chunk_id, role AS parser_section, md5(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS digest FROM p
""")
def chunk_ids(t: Tables) -> DataFrame:
    e = t.conversations.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("leaf_pos"), F.col("role").alias("parser_section"), F.col("role").alias("source_path"), "text", F.lit(False).alias("whole"))
    return chunks.identify(e, 300).select("doc_id", "chunk_pos", "chunk_id", "parser_section", F.md5("text").alias("digest"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, role AS parser_section, string_agg('t_' || turn, ' ' ORDER BY turn) AS chunk_ids FROM conversations GROUP BY 1, 2
""")
def section_chunk_ids(t: Tables) -> DataFrame:
    """The index of a document's sections, chunks in order."""
    return chunks.section_ids(_turns(t)).select(F.col("doc_id").cast("string").alias("doc_id"), "parser_section", F.array_join("chunk_ids", " ").alias("chunk_ids"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type ELSE NULL END AS value FROM events
""")
def unwrapped_values(t: Tables) -> DataFrame:
    """Values that stand alone, are wrapped in an object, or are missing from it."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("value")))).otherwise(F.col("props"))
    return t.events.select("event_id", T.json_value(raw).alias("value"))


@query("""
SELECT conv_id, turn, sha256('m' || chr(1) || coalesce(text, '') || chr(1) || '{}' || chr(1) || turn) AS request_id FROM conversations
""")
def request_ids(t: Tables) -> DataFrame:
    """The hash under which the ledger keeps a model's answer."""
    return t.conversations.select("conv_id", "turn", request_id(T.text_or_empty("text"), F.lit("{}"), F.col("turn"), "m").alias("request_id"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, md5(string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id
""")
def context_entries(t: Tables) -> DataFrame:
    leaf = t.conversations.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("leaf_pos"), F.lit(chunks.CONTEXT).alias("parser_section"), F.col("role").alias("source_path"), "text")
    return chunks.entries(leaf).select("doc_id", F.md5("text").alias("digest"))


@query("""
SELECT conv_id AS doc_id, role AS parser_section, CAST(min(turn) AS INTEGER) AS section_pos, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY ALL
""")
def section_texts(t: Tables) -> DataFrame:
    return chunks.section_texts(_turns(t)).select("doc_id", "parser_section", "section_pos", F.md5("text").alias("digest"))


@query("SELECT conv_id AS doc_id, md5(string_agg('t_' || turn || ': ' || to_json(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY ALL")
def pool_index(t: Tables) -> DataFrame:
    return chunks.index_text(_turns(t)).select("doc_id", F.md5("index_text").alias("digest"))


_MAP = [("talk", "assistant", 0), ("talk", "user", 1), ("all", None, 0), ("rules", "system", 0)]


@query("""
WITH m(section_key, role, map_pos) AS (VALUES ('talk', 'assistant', 0), ('talk', 'user', 1), ('all', NULL, 0), ('rules', 'system', 0)),
j AS (SELECT c.conv_id, m.section_key, m.map_pos, c.turn FROM conversations c JOIN m ON m.role IS NULL OR m.role = c.role)
SELECT conv_id AS doc_id, section_key, CAST(row_number() OVER (PARTITION BY conv_id, section_key ORDER BY map_pos, turn) AS INTEGER) AS nth, 't_' || turn AS chunk_id FROM j
""")
def rule_retrieval(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(_MAP, "section_key string, parser_section string, map_pos int")
    return retrieval.by_rule(_turns(t), table)


@query("""
WITH c AS (SELECT conv_id, turn, role, text, lag(turn) OVER w AS before, lag(role) OVER w AS role_before FROM conversations WHERE role <> 'system' AND turn <> 2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, CASE WHEN role_before IS NOT DISTINCT FROM role THEN '' ELSE CASE WHEN before IS NULL THEN '' ELSE chr(10) END || '===== ' || role || ' =====' || chr(10) || chr(10) END
  || CASE WHEN turn - before > 1 THEN chr(10) || '...' || chr(10) || chr(10) ELSE '' END || '<t_' || turn || '>' || chr(10) || text || chr(10) || '<t_' || turn || '>' || chr(10) || chr(10) AS s FROM c)
SELECT conv_id AS doc_id, md5(rtrim(string_agg(s, '' ORDER BY turn), chr(10) || ' ')) AS digest FROM p GROUP BY conv_id
""")
def evidence_texts(t: Tables) -> DataFrame:
    rows = _turns(t)
    picked = rows.where("parser_section <> 'system' and chunk_pos <> 2").select("doc_id", "chunk_id")
    return retrieval.evidence_text(picked, rows, ("doc_id",)).select("doc_id", F.md5("text").alias("digest"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey) AS f FROM lineitem)
SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS names FROM i JOIN part ON p_partkey = l_partkey AND p_size < 30 GROUP BY l_orderkey
""")
def evidence_expansion(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("used_chunk_ids"))
    pool = t.part.where("p_size < 30").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"), F.col("p_type").alias("parser_section"), F.col("p_brand").alias("source_path"))
    chunk = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("chunk_id")).distinct().join(pool, "chunk_id")
    out = retrieval.expand(ids, chunk, ("doc_id",))
    return out.select("doc_id", long(F.size("evidence")).alias("n"), F.array_join(F.transform("evidence", lambda x: x["text"]), "|").alias("names"))


@query("SELECT conv_id AS doc_id, role AS section_name, CAST(min(turn) AS INTEGER) AS section_pos, CAST(count(*) AS BIGINT) AS n, string_agg('t_' || turn, ',' ORDER BY turn) AS ids FROM conversations GROUP BY ALL")
def section_inputs(t: Tables) -> DataFrame:
    out = retrieval.section_inputs(_turns(t))
    keys = F.json_object_keys("content")
    return out.select("doc_id", "section_name", "section_pos", long(F.size(keys)).alias("n"), F.array_join(keys, ",").alias("ids"))


def _lines(t: Tables) -> DataFrame:
    """Lines of documents on pages of ten; short ones lie in the heading band."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    top = F.when(F.length("text") < 30, 70.0).otherwise(100.0 + F.col("pos") % 10)
    return rows.select("doc_id", F.expr("pos div 10").alias("page"), "text", (F.col("pos") % 10).cast("double").alias("x0"), top.alias("top"), F.lit(500.0).alias("x1"), (top + 10).alias("bottom"), F.lit(842.0).alias("page_height"), F.lit(True).alias("is_section_page"))


@query("""
WITH l AS (SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
o AS (SELECT *, pos // 10 AS page, CASE WHEN length(line) < 30 THEN 70 ELSE 100 + pos % 10 END AS top, pos % 10 AS x0, length(line) < 30 AS is_heading FROM l),
r AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, top, x0 ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT doc_id, CAST(no AS BIGINT) AS heading_no, CAST(count(*) FILTER (NOT is_heading) AS BIGINT) AS n_lines, CAST(coalesce(sum(length(line)) FILTER (NOT is_heading), 0) AS BIGINT) AS n_chars FROM r GROUP BY ALL
""")
def slice_sections(t: Tables) -> DataFrame:
    rows = lines.sectioned(_lines(t), "fellowship")
    body = F.when(~F.col("is_heading"), F.length("text"))
    return rows.groupBy("doc_id", long(F.col("heading_no")).alias("heading_no")).agg(F.count(body).alias("n_lines"), long(F.coalesce(F.sum(body), F.lit(0))).alias("n_chars"))


@query("""
WITH l AS (SELECT l_orderkey % 50 AS doc_id, l_linenumber AS page, l_orderkey, l_quantity * 10 AS top, l_quantity * 10 + 8 AS bottom FROM lineitem),
b AS (SELECT p_partkey % 50 AS doc_id, p_size % 7 AS page, p_retailprice / 3 AS top, p_retailprice / 3 + 5 AS bottom FROM part WHERE p_size >= 20 AND p_partkey % 2 = 0)
SELECT doc_id, page, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.doc_id = l.doc_id AND b.page = l.page AND l.top <= b.bottom AND l.bottom >= b.top)) AS BIGINT) AS n_in_box FROM l GROUP BY ALL
""")
def box_overlap_join(t: Tables) -> DataFrame:
    row = t.lineitem.select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 10).alias("top"), (F.col("l_quantity") * 10 + 8).alias("bottom"))
    box = t.part.select((F.col("p_partkey") % 50).alias("doc_id"), (F.col("p_size") % 7).alias("page"), (F.col("p_retailprice") / 3).alias("top"), (F.col("p_retailprice") / 3 + 5).alias("bottom"), F.when(F.col("p_size") >= 20, 60.0).otherwise(50.0).alias("width"), F.lit(100.0).alias("page_width"), (F.col("p_partkey") % 2 == 0).alias("fill"))
    out = lines.mark_in_box(row, box)
    return out.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if("in_box").alias("n_in_box"))


@query("""
WITH w AS (SELECT l_orderkey AS doc_id, CAST(round_even(l_linenumber * 1.7 / 3.0, 0) AS BIGINT) AS bucket, l_partkey AS x0, l_linenumber AS ln, l_linenumber * 1.7 AS top FROM lineitem)
SELECT doc_id, string_agg('w' || ln, ' ' ORDER BY x0, ln) AS text, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(top) AS DECIMAL(18,6))::DOUBLE AS top, CAST(max(x0) + 5 AS DOUBLE) AS x1 FROM w GROUP BY doc_id, bucket
""")
def words_to_lines(t: Tables) -> DataFrame:
    top = F.col("l_linenumber") * 1.7
    words = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.concat(F.lit("w"), "l_linenumber").alias("text"), F.col("l_partkey").cast("double").alias("x0"), top.cast("double").alias("top"), (F.col("l_partkey") + 5).cast("double").alias("x1"), top.alias("bottom"), F.lit(842.0).alias("page_height"))
    return lines.lines_of(words).select("doc_id", "text", "x0", dec(F.col("top")).alias("top"), "x1")


@query("SELECT s_suppkey FROM supplier WHERE NOT (abs(r - g) < 0.05 AND abs(g - b) < 0.05 AND r > 0.7)".replace("FROM supplier", "FROM (SELECT s_suppkey, s_suppkey % 100 / 100.0 AS r, s_suppkey % 90 / 100.0 AS g, s_suppkey % 80 / 100.0 AS b FROM supplier)"))
def watermark_filter(t: Tables) -> DataFrame:
    chars = t.supplier.select("s_suppkey", *[(F.col("s_suppkey") % n / 100.0).alias(c) for c, n in (("r", 100), ("g", 90), ("b", 80))])
    return lines.without_watermark(chars).select("s_suppkey")


@query("SELECT DISTINCT p_type || ' / ' || p_name AS title, regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '', 'g') AS heading_key, p_type || ' / ' || p_name AS normal FROM part")
def heading_keys(t: Tables) -> DataFrame:
    title = F.concat_ws(" / ", "p_type", "p_name")
    return t.part.select(title.alias("title")).distinct().select("title", lines.heading_key(F.concat(F.lit("12. "), "title")).alias("heading_key"), lines.normal_heading(F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit("   ")), F.lit(" : "))).alias("normal"))


@query(None)
def rounded_like_python(t: Tables) -> DataFrame:
    """Prices rounded half to even on the exact binary value; no SQL does that."""
    return t.part.select("p_partkey", *[py_round(F.col("p_retailprice") / 7, d).alias(f"d{d}") for d in (0, 1, 2, 4)])


