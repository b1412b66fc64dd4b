"""Chunks for rubric sections, evidence text, and expansion of evidence ids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

NOTHING = "(no retrieved chunks)"


def by_rule(chunk: DataFrame, section_map: DataFrame) -> DataFrame:
    """(doc_id, section_key, nth, chunk_id): in the order of the mapping, then of the chunks; all chunks where it names none."""
    named = section_map.where("parser_section is not null")
    hits = chunk.join(F.broadcast(named), "parser_section")
    every = section_map.where("parser_section is null").select("section_key", "map_pos")
    # a row or two stand for "all chunks"
    free = chunk.join(F.broadcast(every), F.lit(True))
    rows = hits.select("doc_id", "section_key", "map_pos", "chunk_pos", "chunk_id").unionByName(free.select("doc_id", "section_key", "map_pos", "chunk_pos", "chunk_id"))
    rows = rows.groupBy("doc_id", "section_key", "chunk_pos", "chunk_id").agg(F.min("map_pos").alias("map_pos"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "section_key").orderBy("map_pos", "chunk_pos"))
    return rows.select("doc_id", "section_key", nth.alias("nth"), "chunk_id")


def belief_sections(beliefs: DataFrame, chunk: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, section_key, parser_section) that the evidence of beliefs lies in."""
    ids = beliefs.select("doc_id", "sub_id", F.explode(F.array_distinct(F.concat("good", "bad"))).alias("chunk_id"))
    return ids.join(F.broadcast(subs.select("sub_id", "section_key")), "sub_id").join(chunk.select("doc_id", "chunk_id", "parser_section"), ["doc_id", "chunk_id"]).select("doc_id", "section_key", "parser_section").distinct()


def scoped(chunk: DataFrame, section_map: DataFrame, beliefs: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, section_key, chunk_pos, chunk_id): mapped sections and those of beliefs, in document order; all chunks where that is nothing."""
    fixed = section_map.where("parser_section is not null").select("section_key", "parser_section")
    docs = chunk.select("doc_id").distinct()
    wanted = docs.join(F.broadcast(fixed), F.lit(True)).unionByName(belief_sections(beliefs, chunk, subs).join(F.broadcast(fixed.select("section_key").distinct()), "section_key", "left_semi").select("doc_id", "section_key", "parser_section")).distinct()
    some = chunk.join(wanted, ["doc_id", "parser_section"]).select("doc_id", "section_key", "chunk_pos", "chunk_id")
    keys = docs.join(F.broadcast(section_map.select("section_key").distinct()), F.lit(True))
    empty = keys.join(some.select("doc_id", "section_key").distinct(), ["doc_id", "section_key"], "left_anti")
    return some.unionByName(chunk.join(empty, "doc_id").select("doc_id", "section_key", "chunk_pos", "chunk_id"))


def evidence_text(picked: DataFrame, chunk: DataFrame, keys: tuple[str, ...] = ("doc_id", "section_key")) -> DataFrame:
    """keys and text: chunks tagged by id, a heading at each change of section, an ellipsis where positions are left out."""
    rows = picked.select(*keys, "chunk_id").distinct().join(chunk, ["doc_id", "chunk_id"])
    w = Window.partitionBy(*keys).orderBy("chunk_pos")
    before, section = F.lag("chunk_pos").over(w), F.lag("parser_section").over(w)
    head = F.concat(F.when(before.isNull(), F.lit("")).otherwise(F.lit("\n")), F.lit("===== "), "parser_section", F.lit(" =====\n\n"))
    text = F.concat(F.when(section.eqNullSafe(F.col("parser_section")), F.lit("")).otherwise(head), F.when(F.col("chunk_pos") - before > 1, F.lit("\n...\n\n")).otherwise(F.lit("")), F.lit("<"), "chunk_id", F.lit(">\n"), "text", F.lit("\n<"), "chunk_id", F.lit(">\n\n"))
    rows = rows.select(*keys, "chunk_pos", text.alias("t"))
    out = rows.groupBy(*keys).agg(F.rtrim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_pos", "t"))), lambda x: x["t"]), "")).alias("text"))
    return out.withColumn("text", F.regexp_replace("text", r"\s+$", ""))


def or_nothing(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NOTHING))


def full_text(chunk: DataFrame) -> DataFrame:
    return evidence_text(chunk.select("doc_id", "chunk_id"), chunk, ("doc_id",))


def expand(ids: DataFrame, chunk: DataFrame, keys: tuple[str, ...] = ("doc_id", "sub_id")) -> DataFrame:
    """keys and evidence: an array of chunk structs in the order of the ids; unknown ids are dropped."""
    rows = ids.select(*keys, F.posexplode("used_chunk_ids").alias("i", "chunk_id")).join(chunk, ["doc_id", "chunk_id"])
    item = F.struct("i", F.struct(F.col("chunk_id").alias("id"), F.col("chunk_id").alias("section_id"), "text", F.col("parser_section").alias("section"), "source_path").alias("e"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["e"]).alias("evidence"))


def section_inputs(chunk: DataFrame) -> DataFrame:
    """(doc_id, section_pos, section_name, content): a section's chunks as an ordered JSON object."""
    pair = F.struct("chunk_pos", F.struct("chunk_id", "text").alias("e"))
    ordered = F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["e"])
    return chunk.groupBy("doc_id", F.col("parser_section").alias("section_name")).agg(F.min("chunk_pos").alias("section_pos"), F.to_json(F.map_from_entries(ordered)).alias("content"))


def previews(chunk: DataFrame, limit: int = 900) -> DataFrame:
    return chunk.select("doc_id", "chunk_pos", "chunk_id", "parser_section", T.preview("text", limit).alias("preview"))


def baseline_messages(chunk: DataFrame, rubric_json: str) -> DataFrame:
    """(doc_id, messages) of a one-shot scoring of all chunks."""
    line = F.struct("chunk_pos", F.concat(F.lit("<"), "chunk_id", F.lit("> "), "preview").alias("t"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n")
    user = F.concat(F.lit("Score every signal from 0 to 5. Answer with JSON only.\n\nRubric:\n" + rubric_json + "\n\nChunks:\n"), body)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return previews(chunk).groupBy("doc_id").agg(F.array(message("system", F.lit("You score applications by a rubric.")), message("user", user)).alias("messages"))


STAGE1 = "You review one section of an application at a time. Answer with JSON only: one finding per sub-criterion that the section clearly supports or challenges, with ids of its chunks and a short implication."


def stage1_request(section: str, content: str, criteria_json: str, state_json: str = "{}") -> str:
    """Messages of a section, the criteria and the state so far, as JSON: for the loop over a document's sections."""
    user = f"Section: {section}\nContent:\n{content}\nCriteria:\n{criteria_json}\nState:\n{state_json}"
    return json.dumps([{"role": "system", "content": STAGE1}, {"role": "user", "content": user}], ensure_ascii=False, separators=(",", ":"))


def stage1_messages(inputs: DataFrame, criteria_json: str, state: Column | None = None) -> DataFrame:
    """(doc_id, section_pos, section_name, messages): the same of all sections at once, with a column of states."""
    state = F.lit("{}") if state is None else state
    user = F.concat(F.lit("Section: "), "section_name", F.lit("\nContent:\n"), "content", F.lit("\nCriteria:\n" + criteria_json + "\nState:\n"), state)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return inputs.select("doc_id", "section_pos", "section_name", F.array(message("system", F.lit(STAGE1)), message("user", user)).alias("messages"))


def stage2_messages(texts: DataFrame, views: DataFrame, beliefs_json: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, section_key, messages) and columns of texts to carry: full text, a section of the rubric, and the beliefs on it.

    A document's beliefs are joined as one map; its text is copied for the sections after the last exchange.
    """
    held = beliefs_json.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_key", "beliefs"))).alias("held"))  # an entry a section
    rows = texts.join(held, "doc_id", "left").join(F.broadcast(views.select("section_key", "human_name", "sub_criteria")), F.lit(True))
    rows = rows.withColumn("beliefs", F.try_element_at("held", F.col("section_key")))
    system = F.lit("You score one section of a rubric. Answer with JSON only: for each sub-criterion signal scores from 0 to 5, the ids of the chunks used, pros and drawbacks.")
    user = F.concat(F.lit("Section: "), "human_name", F.lit("\nRubric:\n"), "sub_criteria", F.lit("\nBeliefs:\n"), F.coalesce("beliefs", F.lit("{}")), F.lit("\nApplication:\n"), "text")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select("doc_id", "section_key", *carry, F.array(message("system", system), message("user", user)).alias("messages"))
