"""Stage 1: findings of sections, repaired and folded into an ordered state of beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import strip

MOST, CUT = 3, 220
RESPONSE = "section_name string, findings array<struct<sub_id string, evidence struct<good_evidence_ids array<string>, bad_evidence_ids array<string>>, implication string>>, resolved_signals array<string>"


def _union(a: Column, b: Column, most: int | None = None) -> Column:
    both = F.array_distinct(F.concat(a, b))
    return F.slice(both, 1, most) if most else both


def _empty() -> Column:
    return F.array().cast("array<string>")


def normalize(responses: DataFrame, valid_ids: DataFrame, valid_subs: DataFrame) -> DataFrame:
    """Findings (doc_id, section_pos, section_name, finding_pos, sub_id, good, bad, implication).

    responses: (doc_id, section_pos, section_name, raw); valid_ids: (doc_id, section_name,
    chunk_ids); valid_subs: sub_id. Findings without known evidence go; a sub-criterion
    named again adds its ids, MOST of a kind at most, and its implication replaces the
    former unless that ends with it.
    """
    known = lambda c: F.slice(F.array_distinct(F.filter(F.coalesce(c, _empty()), lambda x: F.array_contains(F.coalesce("chunk_ids", _empty()), x))), 1, MOST)

    def finding(f: Column, i: Column) -> Column:
        good, bad = f["evidence"]["good_evidence_ids"], f["evidence"]["bad_evidence_ids"]
        return F.struct(i.alias("i"), f["sub_id"].alias("sub_id"), known(good).alias("good"), known(bad).alias("bad"), F.coalesce(f["implication"], F.lit("")).alias("implication"))

    # an answer is parsed once: of a column of it, the planner would ask first whether it is null or empty, by parsing again
    found = F.transform(F.from_json(T.json_object("raw"), RESPONSE)["findings"], finding)
    some = F.filter(found, lambda x: (F.size(x["good"]) > 0) | (F.size(x["bad"]) > 0))
    rows = responses.join(valid_ids, ["doc_id", "section_name"], "left").select("doc_id", "section_pos", "section_name", F.explode(some).alias("f"))
    rows = rows.select("doc_id", "section_pos", "section_name", "f.*").join(F.broadcast(valid_subs.select("sub_id")), "sub_id", "left_semi")
    rows = rows.repartition("doc_id", "section_pos")  # groups and their numbers both lie in it
    one = F.struct("i", "good", "bad", "implication")
    grouped = rows.groupBy("doc_id", "section_pos", "section_name", "sub_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    name = F.col("section_name")

    def fold(a: Column, x: Column) -> Column:
        said = strip(x["implication"])
        keep = (said == "") | F.endswith(a["implication"], said)
        return F.struct(_union(a["good"], x["good"], MOST).alias("good"), _union(a["bad"], x["bad"], MOST).alias("bad"), F.when(keep, a["implication"]).otherwise(T.with_prefix(name, x["implication"], CUT)).alias("implication"))

    first = F.get("all", F.lit(0))
    start = F.struct(first["good"].alias("good"), first["bad"].alias("bad"), T.with_prefix(name, first["implication"], CUT).alias("implication"))
    out = grouped.select("doc_id", "section_pos", "section_name", "sub_id", first["i"].alias("i"), F.aggregate(F.slice("all", F.lit(2), F.size("all")), start, fold).alias("m"))
    pos = F.row_number().over(Window.partitionBy("doc_id", "section_pos").orderBy("i"))
    return out.select("doc_id", "section_pos", "section_name", pos.alias("finding_pos"), "sub_id", "m.good", "m.bad", "m.implication")


def beliefs(findings: DataFrame) -> DataFrame:
    """(doc_id, sub_id, belief_pos, good, bad, implications): unions in order of first appearance."""
    one = F.struct("section_pos", "finding_pos", "good", "bad", "implication")
    rows = findings.groupBy("doc_id", "sub_id").agg(F.sort_array(F.collect_list(one)).alias("all"), F.min(F.struct("section_pos", "finding_pos")).alias("first"))
    said = F.array_distinct(F.filter(F.transform("all", lambda x: strip(F.coalesce(x["implication"], F.lit("")))), lambda x: x != ""))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return rows.select("doc_id", "sub_id", pos.alias("belief_pos"), F.array_distinct(F.flatten(F.transform("all", lambda x: x["good"]))).alias("good"), F.array_distinct(F.flatten(F.transform("all", lambda x: x["bad"]))).alias("bad"), said.alias("implications"))


def processed(sections: DataFrame) -> DataFrame:
    """(doc_id, processed_sections): names in order of first appearance, from (doc_id, section_pos, section_name)."""
    return sections.groupBy("doc_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("section_pos", "section_name"))), lambda x: x["section_name"])).alias("processed_sections"))


def missing_after(sections: DataFrame, findings: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, section_pos, missing): sub-criteria that no section up to this one resolved, in the rubric's order."""
    every = subs.where(F.col("section_key") != "application_form").agg(F.transform(F.sort_array(F.collect_list(F.struct("section_pos", "sub_pos", "sub_id"))), lambda x: x["sub_id"]).alias("every"))
    here = findings.groupBy("doc_id", "section_pos").agg(F.collect_set("sub_id").alias("resolved"))
    rows = sections.select("doc_id", "section_pos").distinct().join(here, ["doc_id", "section_pos"], "left")
    w = Window.partitionBy("doc_id").orderBy("section_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.flatten(F.collect_list(F.coalesce("resolved", _empty())).over(w))
    return rows.select("doc_id", "section_pos", seen.alias("seen")).join(F.broadcast(every), F.lit(True)).select("doc_id", "section_pos", F.array_except("every", "seen").alias("missing"))


def state(sections: DataFrame, findings: DataFrame, subs: DataFrame) -> DataFrame:
    """One row a document: processed_sections, beliefs (a map), missing_signals."""
    entry = F.struct("belief_pos", F.struct("sub_id", F.struct(F.col("good").alias("good_evidence_ids"), F.col("bad").alias("bad_evidence_ids"), "implications").alias("b")).alias("e"))
    held = beliefs(findings).groupBy("doc_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"])).alias("subcriteria_beliefs"))
    last = missing_after(sections, findings, subs).groupBy("doc_id").agg(F.max_by("missing", "section_pos").alias("missing_signals"))
    return processed(sections).join(held, "doc_id", "left").join(last, "doc_id", "left")


def state_view(s: DataFrame) -> DataFrame:
    """What a prompt shows of a state: the last ten sections, two cut implications a sub-criterion, resolved ids."""
    n = F.size("processed_sections")
    entries = F.map_entries(F.coalesce("subcriteria_beliefs", F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<good_evidence_ids:array<string>,bad_evidence_ids:array<string>,implications:array<string>>>>"))))
    resolved = F.transform(F.filter(entries, lambda e: (F.size(e["value"]["good_evidence_ids"]) > 0) | (F.size(e["value"]["bad_evidence_ids"]) > 0)), lambda e: e["key"])
    said = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("sub_id"), F.slice(F.filter(F.transform(e["value"]["implications"], lambda x: F.substring(strip(x), 1, CUT)), lambda x: x != ""), 1, 2).alias("implications"))), lambda x: F.size(x["implications"]) > 0)
    return s.select("doc_id", F.slice("processed_sections", F.greatest(F.lit(1), n - 9), F.lit(10)).alias("processed_sections"), n.alias("processed_section_count"), "missing_signals", F.array_distinct(resolved).alias("resolved_signals"), said.alias("signal_implications"))


def section_findings(answer: dict, section: str, sub_ids: list[str], chunk_ids: list[str]) -> dict[str, dict]:
    """normalize() of one answer in plain Python, for the loop over sections: sub_id -> good, bad, implication."""
    out: dict[str, dict] = {}
    subs, ok, prefix = set(sub_ids), set(chunk_ids), f"{section}:"

    def known(ids: object) -> list[str]:
        return list(dict.fromkeys(x for x in ids if isinstance(x, str) and x in ok))[:MOST] if isinstance(ids, list) else []

    def named(said: str) -> str:
        return (said if said.startswith(prefix) else f"{prefix} {said}" if said else prefix)[:CUT]

    findings = answer.get("findings")
    for f in findings if isinstance(findings, list) else []:
        sub = f.get("sub_id") if isinstance(f, dict) else None
        if not isinstance(sub, str) or sub not in subs:
            continue
        evidence = f.get("evidence") if isinstance(f.get("evidence"), dict) else {}
        good, bad = known(evidence.get("good_evidence_ids")), known(evidence.get("bad_evidence_ids"))
        if not good and not bad:
            continue
        said = f["implication"].strip() if isinstance(f.get("implication"), str) else ""
        if sub not in out:
            out[sub] = {"good": good, "bad": bad, "implication": named(said)}
            continue
        held = out[sub]
        held["good"] = list(dict.fromkeys(held["good"] + good))[:MOST]
        held["bad"] = list(dict.fromkeys(held["bad"] + bad))[:MOST]
        if said and not held["implication"].endswith(said):
            held["implication"] = named(said)
    return out


def running_view(sections: list[str], found: list[dict[str, dict]], sub_ids: list[str]) -> dict:
    """state_view() after sections with what section_findings() found in each, in order of first appearance."""
    said: dict[str, list[str]] = {}
    for one in found:
        for sub, f in one.items():
            said.setdefault(sub, []).append(f["implication"].strip())
    names = list(dict.fromkeys(sections))
    cut = {sub: [x[:CUT] for x in dict.fromkeys(xs) if x][:2] for sub, xs in said.items()}
    return {
        "processed_sections": names[-10:],
        "processed_section_count": len(names),
        "missing_signals": [s for s in sub_ids if s not in said],
        "resolved_signals": list(said),
        "signal_implications": [{"sub_id": sub, "implications": xs} for sub, xs in cut.items() if xs],
    }
