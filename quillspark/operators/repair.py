"""Stage 2: scores in a model's answers, checked and repaired."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.columns import strip


def coerce_score(value: Column) -> Column:
    """A VARIANT as a score: whole numbers from 0 to 5; anything else, booleans and texts too, is 0."""
    number = F.to_json(value).try_cast("double")  # in JSON a text keeps its quotes, so only numbers can be cast
    place = F.array_position(F.array(*[F.lit(float(n)) for n in range(6)]), number)  # names number once; 0 if it is none of them
    return F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("int")


_KEYS = ["doc_id", "section_key", "sub_id"]
_PRO, _CON = ("pros", "strengths", "advantages"), ("drawbacks", "rationale")


def _present(*names: str) -> Column:
    """The trimmed text under the first of names that a part's fields have; null if that is no text or blank."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        at = F.try_element_at("fields", F.lit(n))
        out = F.when(F.map_contains_key("fields", n), F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))).otherwise(out)
    return F.nullif(strip(out), F.lit(""))


def _parts(responses: DataFrame, fields: str, lead: bool = False) -> DataFrame:
    """(doc_id, section_key, key, fields, answer, order): parts of answers by their keys, with fields of the type given.

    lead: every answer has a row without a key too.

    An answer is parsed once, into a map, which forgets the order. Parts that are texts are taken from a second parsing,
    done only for answers that have any. What is of the answer is computed before parts become rows, not for each of
    them; a map is exploded by its entries, as else the planner parses twice, first to drop those without any.
    """
    rows = responses.select("doc_id", "section_key", T.outer_text("raw").alias("answer"))
    rows = rows.select("*", F.when(F.startswith("answer", F.lit("{")), F.try_variant_get(F.try_parse_json("answer"), "$", f"map<string,{fields}>")).alias("parts"))
    texts = F.when(F.exists(F.map_values("parts"), lambda p: p.isNull()), F.from_json("answer", "map<string,string>"))
    rows = rows.select("*", texts.alias("texts"), F.json_object_keys("answer").alias("order"))
    entries = F.map_entries("parts")
    if lead:
        none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast(fields).alias("value")))
        entries = F.coalesce(F.concat(none, entries), none)
    rows = rows.select("doc_id", "section_key", "answer", "texts", "order", F.explode(entries).alias("e"))
    text = F.try_element_at("texts", F.col("e.key"))
    kept = F.col("e.value").isNotNull() | F.startswith(F.btrim(text), F.lit("{"))
    rows = rows.where(F.col("e.key").isNull() | kept if lead else kept)
    return rows.select("doc_id", "section_key", "answer", "order", F.col("e.key").alias("key"), F.coalesce("e.value", F.try_variant_get(F.try_parse_json(text), "$", fields)).alias("fields"))


def sources(responses: DataFrame, subs: DataFrame, only: Column | None = None) -> DataFrame:
    """(doc_id, section_key, sub_id, key, fields, answer, order): parts of answers that belong to a sub-criterion, by its id or one below it.

    responses: (doc_id, section_key, raw). fields: a part's map of VARIANT, null if it is a text that begins like an
    object and is none. order: the answer's keys in their order. only: which responses to parse.
    """
    rows = _parts(responses if only is None else responses.where(only), "map<string,variant>")
    rows = rows.select("*", F.explode(F.array_distinct(F.array("key", F.regexp_replace("key", r"\.[^.]*$", "")))).alias("sub_id"))
    return rows.join(F.broadcast(subs.select("section_key", "sub_id")), ["section_key", "sub_id"], "left_semi")


#: Signals of a block; of each, five bits of a long tell which scores from 1 to 5 were found.
_BLOCK = 12


def _cells(rubric: DataFrame) -> DataFrame:
    """(section_key, block, unit, sub_id, sid, signal_pos): the signals of the rubric, each once. unit: the lowest of the signal's bits in its block."""
    rows = rubric.groupBy("section_key").agg(F.sort_array(F.collect_set(F.struct("sub_id", "sid", "signal_pos"))).alias("signals"))
    rows = rows.select("section_key", F.posexplode("signals").alias("n", "s"))
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n") % _BLOCK * 5)
    return rows.select("section_key", F.floor(F.col("n") / _BLOCK).cast("int").alias("block"), unit.alias("unit"), "s.*")


def _bit(score: Column) -> Column:
    """The bit of a score from 0 to 5 in its signal's five; 0 has none."""
    return F.get(F.array(*[F.lit(n).cast("bigint") for n in (0, 1, 2, 4, 8, 16)]), score)


def _top(bits: Column, unit: Column) -> Column:
    """The largest score of a signal that bits of its block tell."""
    own = lambda n: bits.bitwiseAND(unit * (1 << n)) != 0
    return F.when(own(4), 5).when(own(3), 4).when(own(2), 3).when(own(1), 2).when(own(0), 1).otherwise(0)


def _scores(responses: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, section_key, block, bits): for every answer no bits by block of its section, and every score that a part tells of a signal of its sub-criterion."""
    rows = _parts(responses, "struct<signals:map<string,variant>>", lead=True).select("doc_id", "section_key", "key", F.explode_outer("fields.signals").alias("sid", "value"))
    rows = rows.where(F.col("key").isNull() | F.col("sid").isNotNull())
    # a row without a key meets all blocks, those of parts meet signals of their name
    to = cells.where(F.col("sid").isNotNull()).select("section_key", "block", "unit", "sub_id", F.col("sid").alias("at"))
    none = F.lit(None).cast("string")
    to = to.unionByName(cells.select("section_key", "block", F.lit(0).cast("bigint").alias("unit"), none.alias("sub_id"), none.alias("at")).distinct())
    to = to.withColumnRenamed("section_key", "of")
    below = F.concat("sub_id", F.lit("."), F.substring_index("key", ".", -1))
    mine = F.col("key").isNull() | (F.col("key") == F.col("sub_id")) | (F.col("key") == below)
    rows = rows.join(F.broadcast(to), (F.col("section_key") == F.col("of")) & F.col("sid").eqNullSafe(F.col("at")) & mine)
    return rows.select("doc_id", "section_key", "block", (F.col("unit") * _bit(coerce_score(F.col("value")))).alias("bits"))


def _merged(parts: DataFrame) -> DataFrame:
    """(doc_id, section_key, sub_id, all): what the parts of a sub-criterion tell, in the answer's order."""
    listed = F.try_element_at("fields", F.lit("used_chunk_ids"))
    text = F.try_element_at(F.from_json("answer", "map<string,string>"), "key")  # as it stands, if it is no list of texts
    ids = F.when(F.col("fields").isNotNull() & listed.isNull(), F.array().cast("array<string>")).when(F.schema_of_variant(listed).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(listed, "$", "array<string>")).otherwise(F.from_json(F.get_json_object(text, "$.used_chunk_ids"), "array<string>"))
    told = F.struct(F.array_position("order", F.col("key")).alias("pos"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), _present(*_PRO).alias("pro"), _present(*_CON).alias("con"))
    return parts.select(*_KEYS, told.alias("part")).groupBy(*_KEYS).agg(F.sort_array(F.collect_list("part")).alias("all"))


def normalize(responses: DataFrame, rubric: DataFrame, valid_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, subs) of every document and sub-criterion of the sections answered.

    signals: doc_id, section_key, sub_id, sid, score; subs: used_chunk_ids, evidence_status,
    pros, drawbacks, missing_evidence. valid_ids: (doc_id, chunk_ids).

    One pass of small rows by blocks of signals: scores found and caveats are bits that are put together, so a block of
    the rubric is one group, however many of its signals were told. Texts meet by sub-criterion only where parts tell any.
    """
    cells = _cells(rubric)  # a rubric's few hundred rows
    sub_rows = cells.groupBy("section_key", "sub_id").agg(F.collect_list(F.struct("sid", "block", "unit")).alias("sids"))
    told = lambda n: F.array_join(F.array_distinct(F.filter(F.transform("all", lambda x: x[n]), lambda x: x.isNotNull())), " ").alias(n)
    # a key that is written without a backslash stands in the answer as it is
    with_con = reduce(or_, [F.contains("raw", F.lit(n)) for n in (*_CON, "\\")])
    doubts = _merged(sources(responses, sub_rows, with_con).where(_present(*_CON).isNotNull())).select(*_KEYS, told("con")).join(F.broadcast(sub_rows), ["section_key", "sub_id"])
    doubts = doubts.select(*_KEYS, "con", F.exists("sids", lambda s: T.mentions(F.col("con"), s["sid"])).alias("some"), F.inline("sids"))
    doubted = _doubted(F.col("con"), F.col("sid"), F.col("some"), T.mentions(F.col("con"), F.col("sid")))
    no = F.lit(0).cast("bigint")
    doubts = doubts.select("doc_id", "section_key", "block", no.alias("bits"), F.when(doubted, F.col("unit")).otherwise(no).alias("cuts"))
    rows = _scores(responses, cells).withColumn("cuts", no).unionByName(doubts)
    rows = rows.groupBy("doc_id", "section_key", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("cuts").alias("cuts")).join(F.broadcast(cells), ["section_key", "block"])
    rows = rows.select(*_KEYS, "sid", "signal_pos", _top(F.col("bits"), F.col("unit")).alias("score"), (F.col("cuts").bitwiseAND(F.col("unit")) != 0).alias("cut"))
    signals = rows.select(*_KEYS, "sid", "signal_pos", F.when((F.col("score") == 5) & F.col("cut"), 4).otherwise(F.col("score")).alias("score"))
    every = rows.groupBy(*_KEYS).agg(F.max("score").alias("top")).join(_merged(sources(responses, sub_rows)), _KEYS, "left").join(valid_ids, "doc_id", "left")
    valid = F.coalesce("chunk_ids", F.array().cast("array<string>"))
    used = F.array_distinct(F.filter(F.flatten(F.transform("all", lambda x: x["ids"])), lambda i: F.array_contains(valid, i)))
    subs = every.select(*_KEYS, "top", F.coalesce(used, F.array().cast("array<string>")).alias("used_chunk_ids"), *[F.coalesce(told(n), F.lit("")).alias(to) for n, to in (("pro", "pros"), ("con", "drawbacks"))])
    subs = subs.withColumn("missing_evidence", (F.col("top") > 0) & (F.size("used_chunk_ids") == 0))
    status = F.when(F.col("missing_evidence"), "invalid_evidence").when(F.size("used_chunk_ids") == 1, "sparse_evidence").otherwise("ok")
    return signals, subs.select(*_KEYS, "used_chunk_ids", "pros", "drawbacks", "missing_evidence", status.alias("evidence_status"))


def _doubted(drawbacks: Column, sid: Column, some_named: Column, named: Column) -> Column:
    """Whether drawbacks hold a caveat to a signal: any if they name no signal, else one in a sentence with its name."""
    return (F.coalesce(drawbacks, F.lit("")) != "") & T.has_caveat(drawbacks) & F.when(some_named, named & T.caveat_about(drawbacks, sid)).otherwise(F.lit(True))


def cap_perfect(signals: DataFrame, keys: tuple[str, ...] = ("doc_id", "section_key", "sub_id")) -> DataFrame:
    """signals (keys, sid, score, drawbacks) with 5 cut to 4 where the drawbacks hold a caveat.

    If they name signals, only for those that a sentence with a caveat names.
    """
    named = signals.withColumn("named", T.mentions(F.col("drawbacks"), F.col("sid")))
    some = named.groupBy(*keys).agg(F.bool_or("named").alias("some_named"))
    rows = named.join(some, list(keys))
    cut = (F.col("score") == 5) & _doubted(F.col("drawbacks"), F.col("sid"), F.col("some_named"), F.col("named"))
    return rows.withColumn("uncapped", F.col("score")).withColumn("score", F.when(cut, 4).otherwise(F.col("score"))).drop("named", "some_named")


def scored_subs(signals: DataFrame, sub_state: DataFrame, rubric: DataFrame, doc_types: DataFrame, excluded: DataFrame) -> DataFrame:
    """Signals joined with weights and sub-criteria, and whether a sub-criterion counts towards its section's mean."""
    named = F.lower(F.concat_ws(" ", "name", "definition"))
    rows = signals.join(F.broadcast(rubric.drop("signal_pos")), ["section_key", "sub_id", "sid"]).join(sub_state, ["doc_id", "section_key", "sub_id"]).join(doc_types, "doc_id", "left")
    rows = rows.join(F.broadcast(excluded.withColumn("doc_type_excluded", F.lit(True))), ["doc_type", "sub_id"], "left").withColumn("doc_type_excluded", F.coalesce("doc_type_excluded", F.lit(False)))
    return rows.withColumn("counts", ~F.contains(named, F.lit("if applicable")) & ~F.col("doc_type_excluded")).withColumn("if_applicable", ~F.col("counts"))
