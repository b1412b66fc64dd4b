"""The scoring rubric as one small table, and the views and schemas made from it."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

# Section names, keys and id prefixes, in order.
SECTIONS = {
    "General": ("general", "g"),
    "Proposed research": ("proposed_research", "pr"),
    "Training and development": ("training_development", "td"),
    "Sites and support": ("sites_support", "ss"),
    "Working with people and communities": ("wpcc", "wp"),
    "Application Form": ("application_form", "af"),
}
# Signals of each sub-criterion, by section prefix.
SIGNAL_COUNTS = {"g": (4, 4, 3, 4, 4, 4), "pr": (6, 4, 3, 4, 3, 3, 3, 3, 3), "td": (4, 4, 4), "ss": (4, 4, 4, 4), "wp": (3, 3, 3, 3, 3, 3), "af": (4, 3, 4)}
IF_APPLICABLE = ("g.6", "pr.8")
# What doesn't count, and what is capped, by type of document.
EXCLUDED_SECTIONS = (("rfpb", "training_development"),)
EXCLUDED_SUBS = (("rfpb", "g.1"), ("rfpb", "g.2"))
SCORE_CAPS = (("llm_fallback", "af.1", 6.0),)
# Parser sections that a rubric section reads, in order; none given: all of them.
PARSER_SECTIONS = {
    "general": None,
    "proposed_research": (
        "Application Context", "Plain English NLP Analysis", "Plain English Summary of Research", "Plain English Summary",
        "Scientific Abstract", "Detailed Research Plan", "Changes from Previous Stage", "Patient & Public Involvement",
        "Working with People and Communities Summary", "SUMMARY BUDGET",
    ),
    "training_development": ("Application Context", "Training & Development and Research Support", "SUPPORT AND MENTORSHIP"),
    "sites_support": ("Application Context", "Training & Development and Research Support", "SUPPORT AND MENTORSHIP"),
    "wpcc": ("Application Context", "Patient & Public Involvement", "Working with People and Communities Summary", "Detailed Research Plan", "SUMMARY BUDGET"),
    "application_form": ("Application Form Analysis",),
}

SCHEMA = "section_key string, section_pos int, human_name string, section_weight double, sub_id string, sub_pos int, name string, definition string, group_name string, sub_weight double, sid string, signal_pos int, signal_text string, signal_weight double"


def skeleton() -> dict:
    """Criteria with neutral wording: ids, weights and which sub-criteria are conditional."""
    out = {}
    for human, (_, prefix) in SECTIONS.items():
        subs = []
        for i, n in enumerate(SIGNAL_COUNTS[prefix], 1):
            sub = f"{prefix}.{i}"
            name = f"Criterion {sub}" + " (if applicable)" * (sub in IF_APPLICABLE)
            subs.append({"sub_id": sub, "name": name, "definition": "", "signals": [{"sid": f"{sub}.{chr(97 + k)}", "text": f"Signal {k + 1} of criterion {sub}"} for k in range(n)]})
        out[human] = {"sub_criteria": subs}
    return out


def _sub(sub_id: str, item: dict, group: str | None = None) -> dict:
    """A sub-criterion whose signals are plain texts: ids go by letter."""
    signals = [{"sid": f"{sub_id}.{chr(97 + i)}", "text": t} for i, t in enumerate(item.get("signals", []))]
    return {"sub_id": sub_id, "name": item["name"], "definition": item.get("definition", ""), "group_name": group, "signals": signals}


def _subs(human: str, prefix: str, payload: object) -> list[dict] | None:
    """Sub-criteria of a section in any of the three layouts; None if it has none of them."""
    if isinstance(payload, dict) and isinstance(payload.get("sub_criteria"), list):
        return payload["sub_criteria"]
    if isinstance(payload, list):
        return [_sub(f"{prefix}.{i}", x) for i, x in enumerate(payload, 1)]
    if human == "General" and isinstance(payload, dict):
        named = [payload[k] for k in ("common_characteristics_of_good_applications", "tell_us_why_you_need_this_award") if isinstance(payload.get(k), dict)]
        items = [(x, x["name"]) for x in named] + [(x, "Applicant") for x in payload.get("Applicant", [])]
        return [_sub(f"{prefix}.{i}", x, g) for i, (x, g) in enumerate(items, 1)]
    return None


def rows(criteria: dict) -> list[tuple]:
    """Rows of SCHEMA from criteria; sections of unknown names are left out, weights default to 1."""
    out = []
    for human, payload in criteria.items():
        if human not in SECTIONS:
            continue
        key, prefix = SECTIONS[human]
        subs = _subs(human, prefix, payload)
        for i, s in enumerate(subs or []):
            for k, g in enumerate(s.get("signals", [])):
                weight = float(payload.get("weight", 1.0)) if isinstance(payload, dict) else 1.0
                out.append((key, list(SECTIONS).index(human), human, weight, s["sub_id"], i, s["name"], s.get("definition", ""), s.get("group_name") or None, float(s.get("weight", 1.0)), g["sid"], k, g["text"], float(g.get("weight", 1.0))))
    return out


def load(spark: SparkSession, criteria: dict | str | None = None) -> DataFrame:
    """The rubric table of criteria: a dict, JSON text, or none for the skeleton. A few hundred rows."""
    if isinstance(criteria, str):
        criteria = json.loads(criteria)
    return spark.createDataFrame(rows(criteria or skeleton()), SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rubric table of a criteria file in any store that Spark reads."""
    return load(spark, spark.read.text(path, wholetext=True).first()[0])


def subs(rubric: DataFrame) -> DataFrame:
    """One row a sub-criterion, with if_applicable and how many signals it has."""
    named = F.lower(F.concat_ws(" ", "name", "definition"))
    keys = ["section_key", "section_pos", "human_name", "section_weight", "sub_id", "sub_pos", "name", "definition", "group_name", "sub_weight"]
    return rubric.groupBy(*keys).agg(F.count("*").alias("n_signals")).withColumn("if_applicable_text", F.contains(named, F.lit("if applicable")))


def small(spark: SparkSession, values: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def excluded_sections(spark: SparkSession) -> DataFrame:
    return small(spark, EXCLUDED_SECTIONS, "doc_type string, section_key string")


def excluded_subs(spark: SparkSession) -> DataFrame:
    return small(spark, EXCLUDED_SUBS, "doc_type string, sub_id string")


def score_caps(spark: SparkSession) -> DataFrame:
    return small(spark, SCORE_CAPS, "doc_type string, sub_id string, cap double")


def section_map(spark: SparkSession) -> DataFrame:
    """(section_key, parser_section, map_pos); a null parser section stands for all."""
    return small(spark, [(k, p, i) for k, ps in PARSER_SECTIONS.items() for i, p in enumerate(ps or (None,))], "section_key string, parser_section string, map_pos int")


def prompt_view(rubric: DataFrame) -> DataFrame:
    """(human_name, sub_criteria): what a prompt shows of a section, as JSON, without weights."""
    signals = F.transform(F.sort_array(F.collect_list(F.struct("signal_pos", F.struct("sid", F.col("signal_text").alias("text")).alias("s")))), lambda x: x["s"])
    keys = ["section_key", "section_pos", "human_name", "sub_id", "sub_pos", "name", "definition", "group_name"]
    sub = rubric.groupBy(*keys).agg(signals.alias("signals"))
    item = F.struct("sub_id", "name", "definition", "group_name", "signals")
    return sub.groupBy("section_key", "section_pos", "human_name").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("sub_pos", F.to_json(item).alias("j")))), lambda x: x["j"])).alias("quoted"), F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub_pos", F.to_json(item).alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("sub_criteria")).select("section_key", "section_pos", "human_name", "sub_criteria")


def stage1_view(rubric: DataFrame) -> DataFrame:
    """Signals that stage 1 sees: all but those of the application form."""
    return rubric.where(F.col("section_key") != "application_form").select("section_pos", "sub_pos", "signal_pos", "sid", "sub_id", F.col("name").alias("sub_name"), F.col("human_name").alias("section_name"), F.col("signal_text").alias("text"))


def _object(properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def evidence_schema(sub_ids: list[str], chunk_ids: list[str], most: int = 3) -> dict:
    """JSON Schema of a stage-1 answer on one section."""
    ids = {"type": "array", "items": {"type": "string", "enum": chunk_ids}, "maxItems": most}
    finding = _object({"sub_id": {"type": "string", "enum": sub_ids}, "evidence": _object({"good_evidence_ids": ids, "bad_evidence_ids": ids}), "implication": {"type": "string"}})
    return _object({"section_name": {"type": "string"}, "findings": {"type": "array", "items": finding}, "resolved_signals": {"type": "array", "items": {"type": "string", "enum": sub_ids}}})


def scoring_schema(section: list[tuple[str, list[str]]], chunk_ids: list[str], most: int | None = None) -> dict:
    """JSON Schema of a stage-2 answer; section: (sub id, signal ids)."""
    used = {"type": "array", "items": {"type": "string", "enum": chunk_ids}} | ({"maxItems": most} if most else {})
    one = lambda sids: _object({"signals": _object({s: {"type": "integer", "enum": list(range(6))} for s in sids}), "used_chunk_ids": used, "pros": {"type": "string"}, "drawbacks": {"type": "string"}})
    return _object({sub: one(sids) for sub, sids in section})
