"""The belief state as a stream: sections arrive in any order, the fold goes in theirs."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship

FINDING = "struct<finding_pos:int,sub_id:string,good:array<string>,bad:array<string>,implication:string>"
#: A section's answer, with its findings; a section without any is an event too.
EVENT = f"doc_id string, section_pos int, section_name string, findings array<{FINDING}>"


def section_events(sections: DataFrame, findings: DataFrame) -> DataFrame:
    """EVENT rows of sections (doc_id, section_pos, section_name) and their findings as operators.belief has them."""
    one = F.struct(F.col("finding_pos").cast("int").alias("finding_pos"), "sub_id", "good", "bad", "implication")
    held = findings.groupBy("doc_id", "section_pos").agg(F.sort_array(F.collect_list(one)).alias("findings"))
    rows = sections.select("doc_id", "section_pos", "section_name").join(held, ["doc_id", "section_pos"], "left")
    return rows.select("doc_id", F.col("section_pos").cast("int").alias("section_pos"), "section_name", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def _folded(state: dict, name: str, findings: list[dict]) -> None:
    """Fold a section into state, in place."""
    if name not in state["processed_sections"]:
        state["processed_sections"].append(name)
    for f in findings:
        entry = state["subcriteria_beliefs"].setdefault(f["sub_id"], {"good_evidence_ids": [], "bad_evidence_ids": [], "implications": []})
        said = (f["implication"] or "").strip()
        for kind, new in (("good_evidence_ids", f["good"] or []), ("bad_evidence_ids", f["bad"] or []), ("implications", [said] if said else [])):
            entry[kind] = list(dict.fromkeys([*entry[kind], *new]))
        if f["sub_id"] in state["missing_signals"]:
            state["missing_signals"].remove(f["sub_id"])


def fold_beliefs(events: DataFrame, every_sub: list[str], patience_ms: int | None = None, first: int = 0) -> DataFrame:
    """(doc_id, next_pos, waiting, closed, state) after each batch of EVENT rows: the fold of the sections up to next_pos, in their order.

    A section that comes before its turn waits. If nothing of its document comes for patience_ms, the gap is closed:
    what waits is shown folded over it, in order, with closed set, but kept apart. So a section that comes still
    later is folded in its place, and when all have come the state is operators.belief.state() of the same sections,
    whatever the order of arrival. A section that comes again changes nothing. Kept a document: the folded state and
    the sections that wait. Without patience_ms gaps stay open, and a query that is to take what is there and stop
    must do without: with timers to look after, Spark never takes it to be done.
    """
    ship(events.sparkSession)
    begin = {"processed_sections": [], "subcriteria_beliefs": {}, "missing_signals": list(every_sub)}

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(held.get[0]) if held.exists else {"next": first, "closed": False, "state": copy.deepcopy(begin), "waiting": {}}
        waiting = kept["waiting"]
        if patience_ms is not None and held.hasTimedOut:
            kept["closed"] = bool(waiting)
        for pdf in pdfs:
            for pos, name, findings in zip(pdf["section_pos"], pdf["section_name"], pdf["findings"], strict=True):
                if pos >= kept["next"]:
                    rows = [dict(f) if isinstance(f, dict) else f.asDict() for f in findings]
                    for f in rows:
                        f["good"], f["bad"], f["finding_pos"] = list(f["good"] if f["good"] is not None else []), list(f["bad"] if f["bad"] is not None else []), int(f["finding_pos"])
                    waiting.setdefault(str(int(pos)), [name, sorted(rows, key=lambda f: f["finding_pos"])])
        while (turn := str(kept["next"])) in waiting:
            _folded(kept["state"], *waiting.pop(turn))
            kept["next"] += 1
        kept["closed"] = kept["closed"] and bool(waiting)
        held.update((json.dumps(kept, ensure_ascii=False),))
        if patience_ms is not None and waiting and not kept["closed"]:
            held.setTimeoutDuration(patience_ms)
        shown = kept["state"]
        if kept["closed"]:
            shown = copy.deepcopy(shown)
            for pos in sorted(waiting, key=int):
                _folded(shown, *waiting[pos])
        yield pd.DataFrame({"doc_id": [key[0]], "next_pos": [kept["next"]], "waiting": [len(waiting)], "closed": [kept["closed"]], "state": [json.dumps(shown, ensure_ascii=False)]})

    schema = "doc_id string, next_pos int, waiting int, closed boolean, state string"
    return events.groupBy("doc_id").applyInPandasWithState(step, schema, "kept string", "update", GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
