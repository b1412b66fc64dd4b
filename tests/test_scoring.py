import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import belief, repair, retrieval, rollup, rubric
from quillspark.plans import scoring
from quillspark.sources.ledger import Ledger
from quillspark.sources.scorers import FakeScorer, call, first_object


@pytest.fixture(scope="module")
def rub(spark):
    return rubric.load(spark).cache()


def test_rubric_shape(rub):
    assert rub.count() == 112 and rub.select("sub_id").distinct().count() == 31
    assert {r["sub_id"] for r in rubric.subs(rub).where("if_applicable_text").collect()} == {"g.6", "pr.8"}
    assert {r["sid"] for r in rub.where("sub_id = 'g.3'").collect()} == {"g.3.a", "g.3.b", "g.3.c"}


def test_rubric_layouts():
    raw = {
        "meta": {},
        "General": {"common_characteristics_of_good_applications": {"name": "Common", "signals": ["a", "b"]}, "Applicant": [{"name": "X", "signals": ["c"]}]},
        "Proposed research": [{"name": "P", "definition": "d", "signals": ["e"]}],
        "Sites and support": {"weight": 2, "sub_criteria": [{"sub_id": "ss.1", "name": "S", "signals": [{"sid": "ss.1.a", "text": "t", "weight": 3}]}]},
        "Unknown": [],
    }
    got = {(r[4], r[10], r[8], r[13], r[3]) for r in rubric.rows(raw)}
    assert got == {("g.1", "g.1.a", "Common", 1.0, 1.0), ("g.1", "g.1.b", "Common", 1.0, 1.0), ("g.2", "g.2.a", "Applicant", 1.0, 1.0), ("pr.1", "pr.1.a", None, 1.0, 1.0), ("ss.1", "ss.1.a", None, 3.0, 2.0)}


def normalized(spark, raw, ids=("c1", "c2", "c3", "c4")):
    r = spark.createDataFrame([("d", 0, "S", json.dumps(raw) if not isinstance(raw, str) else raw)], "doc_id string, section_pos int, section_name string, raw string")
    v = spark.createDataFrame([("d", "S", list(ids))], "doc_id string, section_name string, chunk_ids array<string>")
    subs = spark.createDataFrame([("g.1",), ("g.2",)], "sub_id string")
    return belief.normalize(r, v, subs).orderBy("finding_pos").collect()


def finding(sub, good=(), bad=(), said="x"):
    return {"sub_id": sub, "evidence": {"good_evidence_ids": list(good), "bad_evidence_ids": list(bad)}, "implication": said}


def test_findings_are_repaired(spark):
    got = normalized(spark, {"findings": [finding("g.2", ["c1", "c9", "c1"]), finding("zz", ["c1"]), finding("g.1", []), finding("g.1", ["c2", "c3"], ["c4"], "S: why"), finding("g.1", ["c1", "c4"], [], "later"), finding("g.1", ["c1"], [], "later")]})
    assert [(r["sub_id"], r["good"], r["bad"], r["implication"]) for r in got] == [("g.2", ["c1"], [], "S: x"), ("g.1", ["c2", "c3", "c1"], ["c4"], "S: later")]
    assert normalized(spark, "not json") == [] and normalized(spark, {"findings": "x"}) == []


def test_missing_only_shrinks(spark):
    f = spark.createDataFrame([("d", 0, "A", 0, "g.1", ["c"], [], "A: x"), ("d", 2, "C", 0, "g.1", ["e"], ["c"], "C: y"), ("d", 2, "C", 1, "g.2", [], ["c"], "")], "doc_id string, section_pos int, section_name string, finding_pos int, sub_id string, good array<string>, bad array<string>, implication string")
    s = spark.createDataFrame([("d", 0, "A"), ("d", 1, "B"), ("d", 2, "C"), ("d", 3, "A")], "doc_id string, section_pos int, section_name string")
    subs = spark.createDataFrame([("general", 0, f"g.{i}", i) for i in (1, 2, 3)] + [("application_form", 1, "af.1", 0)], "section_key string, section_pos int, sub_id string, sub_pos int")
    after = [r["missing"] for r in belief.missing_after(s, f, subs).orderBy("section_pos").collect()]
    assert after == [["g.2", "g.3"], ["g.2", "g.3"], ["g.3"], ["g.3"]]
    st = belief.state(s, f, subs).first()
    assert st["processed_sections"] == ["A", "B", "C"] and st["missing_signals"] == ["g.3"] and sorted(st["subcriteria_beliefs"]) == ["g.1", "g.2"]
    b = st["subcriteria_beliefs"]["g.1"]
    assert (b["good_evidence_ids"], b["bad_evidence_ids"], b["implications"]) == (["c", "e"], ["c"], ["A: x", "C: y"])
    v = belief.state_view(belief.state(s, f, subs)).first()
    assert v["processed_section_count"] == 3 and sorted(v["resolved_signals"]) == ["g.1", "g.2"] and [x["sub_id"] for x in v["signal_implications"]] == ["g.1"]


RUB3 = [("general", f"g.1.{c}", i) for i, c in enumerate("abc")]


def repaired(spark, raw):
    r = spark.createDataFrame([("d", "general", json.dumps(raw))], "doc_id string, section_key string, raw string")
    rb = spark.createDataFrame([(k, "g.1", s, i) for k, s, i in RUB3], "section_key string, sub_id string, sid string, signal_pos int")
    ids = spark.createDataFrame([("d", ["c1", "c2"])], "doc_id string, chunk_ids array<string>")
    signals, subs = repair.normalize(r, rb, ids)
    return [x["score"] for x in signals.orderBy("signal_pos").collect()], subs.first()


def test_scores_are_repaired(spark):
    s, sub = repaired(spark, {"g.1": {"signals": {"g.1.a": 5, "g.1.b": 2.5, "g.1.c": "4"}, "used_chunk_ids": ["c2", "c9", "c2", "c1"], "pros": " good ", "drawbacks": ""}})
    assert s == [5, 0, 0] and sub["used_chunk_ids"] == ["c2", "c1"] and sub["pros"] == "good" and sub["evidence_status"] == "ok"
    s, sub = repaired(spark, {"g.1.a": {"signals": {"g.1.a": 3}}, "g.1.x": {"signals": {"g.1.a": 4.0, "g.1.c": True}, "strengths": "s", "rationale": "r"}, "g.2": {"signals": {"g.1.b": 5}}})
    assert s == [4, 0, 0] and sub["missing_evidence"] and sub["evidence_status"] == "invalid_evidence" and (sub["pros"], sub["drawbacks"]) == ("s", "r")
    s, sub = repaired(spark, {"g.1": {"signals": {"g.1.a": 9, "g.1.b": -1}, "used_chunk_ids": ["c1"], "pros": None, "strengths": "unused"}})
    assert s == [0, 0, 0] and sub["evidence_status"] == "sparse_evidence" and sub["pros"] == ""
    assert repaired(spark, {})[0] == [0, 0, 0]


def test_parts_as_texts_and_odd_ids(spark):
    inner = json.dumps({"signals": {"g.1.a": 3}, "used_chunk_ids": ["c2"], "rationale": "later"})
    s, sub = repaired(spark, {"g.1.z": " " + inner, "g.1": {"signals": {"g.1.b": 2}, "used_chunk_ids": [7, "c1"], "drawbacks": "first"}, "g.1.q": "{no", "g.1.a": [inner]})
    assert s == [3, 2, 0] and sub["used_chunk_ids"] == ["c2", "c1"] and sub["drawbacks"] == "later first"


def test_scores_read_no_more_than_they_need(spark):
    r = spark.createDataFrame([("d", "general", "{}")], "doc_id string, section_key string, raw string")
    rb = spark.createDataFrame([(k, "g.1", s, i) for k, s, i in RUB3], "section_key string, sub_id string, sid string, signal_pos int")
    signals, _ = repair.normalize(r, rb, r.select("doc_id", F.array(F.lit("c1")).alias("chunk_ids")))
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    # scores go by rows; keys in their order, for texts that meet, are read only from answers that may have drawbacks
    assert plan.count("jsonObjectKeys") == 1 and "Contains(raw" in plan


def test_scores_meet_zeros_without_a_shuffle_and_answers_are_read_once(spark):
    r = spark.createDataFrame([("d", "general", "{}")] * 2, "doc_id string, section_key string, raw string").groupBy("doc_id", "section_key").agg(F.max("raw").alias("raw"))
    rb = spark.createDataFrame([(k, "g.1", s, i) for k, s, i in RUB3], "section_key string, sub_id string, sid string, signal_pos int")
    plan_of = lambda d: d._jdf.queryExecution().executedPlan().toString()
    signals, _ = repair.normalize(r, rb, r.select("doc_id", F.array(F.lit("c1")).alias("chunk_ids")))
    assert "Exchange" not in plan_of(signals).split("Union")[0]
    # what is of the answer is computed under the step that makes rows of parts, not over it for each of them
    over, under = plan_of(repair.sources(r, rb)).split("Generate explode(map_entries(parts")
    assert "answer" in over and not any(x in over for x in ("jsonObjectKeys", "map_values(parts"))
    assert under.count("parseJson(answer") == under.count("jsonObjectKeys") == 1


def test_scores_belong_to_the_sub_criterion_of_their_part(spark):
    rb = spark.createDataFrame([("k", s, "x", 0) for s in ("g.1", "g.1.x", "g")], "section_key string, sub_id string, sid string, signal_pos int")
    x = lambda v: {"signals": {"x": v, "g.9": 5}}
    for answer, want in [
        ({"g.1": x(1), "g.1.x": x(2), "g.2": x(3), "g.1.x.y.z": x(4), "g.1.": x(0)}, {"g.1": 2, "g.1.x": 2, "g": 3}),
        ({"g.1.x.y": x(4), ".g.1": x(5), "g,1": x(5), "g.1.x\n": x(3)}, {"g.1": 3, "g.1.x": 4, "g": 0}),
        ({"g": x(5), "g.1.a": json.dumps(x(4)), "g.1.b": x("5"), "g.1.x": [x(5)]}, {"g.1": 4, "g.1.x": 0, "g": 5}),
    ]:
        r = spark.createDataFrame([("d", "k", json.dumps(answer)), ("d", "k", "{}")], "doc_id string, section_key string, raw string")
        signals, _ = repair.normalize(r, rb, r.select("doc_id", F.array(F.lit("c1")).alias("chunk_ids")))
        assert {s.sub_id: s.score for s in signals.collect()} == want


def test_scores_and_zeros_come_from_one_reading_by_blocks_of_signals(spark):
    sids = [f"g.1.s{n:02d}" for n in range(30)]
    rb = spark.createDataFrame([("k", "g.1", s, n) for n, s in enumerate(sids)] * 2 + [("l", "g.1", "g.1.s00", 0), ("l", "g.2", None, 1)], "section_key string, sub_id string, sid string, signal_pos int")
    told = {"g.1": {"signals": {s: n % 8 for n, s in enumerate(sids)}, "drawbacks": "G.1.S13 is weak. g.1.s29 is superb."}, "g.1.s00": {"signals": {s: 2 for s in sids[20:]}}}
    rows = [("d", "k", json.dumps(told)), ("e", "k", None), ("e", "l", "no"), ("f", "l", f"<think>{{}}</think>```json\n{json.dumps(told)}\n```"), ("f", "l", "{}<think>}"), ("g", "m", json.dumps(told)), ("h", None, "{}")]
    r = spark.createDataFrame(rows, "doc_id string, section_key string, raw string")
    signals, subs = repair.normalize(r, rb, r.select("doc_id", F.array(F.lit("c1")).alias("chunk_ids")).distinct())
    got = {(s.doc_id, s.section_key, s.sub_id, s.sid): s.score for s in signals.collect()}
    want = {("d", "k", "g.1", s): max(n % 8 if n % 8 < 6 else 0, 2 if n >= 20 else 0) - (n == 13) for n, s in enumerate(sids)} | {("e", "k", "g.1", s): 0 for s in sids}
    assert got == want | {("e", "l", "g.1", "g.1.s00"): 0, ("e", "l", "g.2", None): 0, ("f", "l", "g.1", "g.1.s00"): 0, ("f", "l", "g.2", None): 0}
    assert signals.count() == 64 and dict(signals.dtypes)["score"] == "int"
    assert {(s.doc_id, s.section_key, s.sub_id): s.missing_evidence for s in subs.collect()} == {("d", "k", "g.1"): True} | {k[:3]: False for k in got if k[0] != "d"}
    # one reading for zeros and scores, one for answers that may have drawbacks
    assert signals._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [doc_id#") == 2


def test_perfect_scores_are_capped(spark):
    five = {"g.1.a": 5, "g.1.b": 5, "g.1.c": 3}
    score = lambda text: repaired(spark, {"g.1": {"signals": five, "used_chunk_ids": ["c1"], "pros": "", "drawbacks": text}})[0]
    assert score("No significant gaps.") == [5, 5, 3] and score("") == [5, 5, 3]
    assert score("Costs are unclear.") == [4, 4, 3]
    assert score("g.1.a lacks detail. g.1.b is superb.") == [4, 5, 3]


def sub_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, doc_type string, section_key string, section_weight double, sub_id string, sub_weight double, counts boolean, score_10 double, n_signals long, evidence_count long, confidence_label string")


def test_roll_up_by_hand(spark):
    h = "high_confidence"
    subs = sub_rows(spark, [("d", "rfpb", "general", 1.0, "g.1", 1.0, False, 10.0, 4, 5, h), ("d", "rfpb", "general", 1.0, "g.2", 2.0, True, 7.5, 4, 2, h), ("d", "rfpb", "general", 1.0, "g.3", 1.0, True, 0.0, 4, 0, h), ("d", "rfpb", "training_development", 1.0, "td.1", 1.0, True, 9.0, 4, 1, h)])
    sec = rollup.section_scores(subs, carry=("section_weight", "doc_type"))
    g = sec.where("section_key = 'general'").first()
    assert (g["score_10"], g["coverage_score_0to100"], g["scored_items"], g["total_items"], g["good_items"]) == (5.0, 50.0, 2, 3, 1)
    o = rollup.overall_scores(sec, rubric.excluded_sections(spark)).first()
    assert (o["score_10"], o["scored_items"], o["positive_items"], o["coverage_score_0to100"]) == (5.0, 3, 1, 33.33)
    assert (o["avg_confidence_0to2"], o["avg_plausibility_0to5"], o["evidence_score_0to100"]) == (2.0, 5.0, 100.0)


def test_fallbacks(spark):
    h = "high_confidence"
    subs = sub_rows(spark, [("d", "", "general", 1.0, "g.6", 1.0, False, 4.0, 4, 0, h), ("e", "", "general", 1.0, "g.1", 0.0, True, 4.0, 4, 0, h)])
    got = {r["doc_id"]: r for r in rollup.section_scores(subs).collect()}
    assert got["d"]["score_10"] == 4.0 and got["d"]["scored_items"] == 1  # none counts: all do
    assert got["e"]["score_10"] == 0.0  # no weight
    empty = rollup.with_empty(rollup.overall_scores(rollup.section_scores(subs, carry=("section_weight", "doc_type")), rubric.excluded_sections(spark)), spark.createDataFrame([("z",)], "doc_id string")).first()
    assert empty["score_10"] == 0 and empty["good_items"] is None and empty["target_evidence_per_item"] == 5


def test_sums_are_exact_before_a_tie(spark):
    """Added up in any order as doubles, these may come to 46.589999999999996 and 7.76."""
    # Section scores of a recorded run and the overall score that it gave
    keys = [k for k, _ in rubric.SECTIONS.values()]
    rows = [("d", "", k, 1.0, f"{k}.1", 1.0, True, x, 1, 0, "high_confidence") for k, x in zip(keys, [7.67, 6.77, 8.83, 8.38, 7.11, 7.83], strict=True)]
    sec = rollup.section_scores(sub_rows(spark, rows), carry=("section_weight", "doc_type"))
    assert rollup.overall_scores(sec, rubric.excluded_sections(spark)).first()["score_10"] == 7.77


def test_caps(spark):
    subs = sub_rows(spark, [("d", "llm_fallback", "application_form", 1.0, "af.1", 1.0, True, 9.0, 4, 0, "high_confidence"), ("e", "fellowship", "application_form", 1.0, "af.1", 1.0, True, 9.0, 4, 0, "high_confidence")])
    got = {r["doc_id"]: r for r in rollup.cap(subs, rubric.score_caps(spark)).collect()}
    assert (got["d"]["score_10"], got["d"]["quality"], got["e"]["score_10"]) == (6.0, "mixed", 9.0)


CHUNKS = [("d", 0, "a__1", "A", "A", "first"), ("d", 1, "b__1", "B", "B", "second"), ("d", 3, "b__2", "B", "B", "third")]
SCHEMA = "doc_id string, chunk_pos int, chunk_id string, parser_section string, source_path string, text string"


def test_evidence_text(spark):
    c = spark.createDataFrame(CHUNKS, SCHEMA)
    want = "===== A =====\n\n<a__1>\nfirst\n<a__1>\n\n\n===== B =====\n\n<b__1>\nsecond\n<b__1>\n\n\n...\n\n<b__2>\nthird\n<b__2>"
    assert retrieval.full_text(c).first()["text"] == want


def test_retrieval_and_expansion(spark):
    c = spark.createDataFrame(CHUNKS, SCHEMA)
    m = spark.createDataFrame([("x", "B", 0), ("x", "A", 1), ("y", None, 0)], "section_key string, parser_section string, map_pos int")
    got = {}
    for r in retrieval.by_rule(c, m).orderBy("nth").collect():
        got.setdefault(r["section_key"], []).append(r["chunk_id"])
    assert got == {"x": ["b__1", "b__2", "a__1"], "y": ["a__1", "b__1", "b__2"]}
    ids = spark.createDataFrame([("d", "g.1", ["b__2", "zz", "a__1"])], "doc_id string, sub_id string, used_chunk_ids array<string>")
    assert [e["id"] for e in retrieval.expand(ids, c).first()["evidence"]] == ["b__2", "a__1"]
    b = spark.createDataFrame([("d", "s.1", ["a__1"], [])], "doc_id string, sub_id string, good array<string>, bad array<string>")
    subs = spark.createDataFrame([("s.1", "x")], "sub_id string, section_key string")
    only_b = spark.createDataFrame([("x", "B", 0), ("z", "Nothing", 0)], "section_key string, parser_section string, map_pos int")
    got = {(r["section_key"], r["chunk_id"]) for r in retrieval.scoped(c, only_b, b, subs).collect()}
    assert got == {("x", "a__1"), ("x", "b__1"), ("x", "b__2"), ("z", "a__1"), ("z", "b__1"), ("z", "b__2")}


def test_retry_and_failures(spark):
    class Flaky:
        def __init__(self):
            self.n = 0

        def __call__(self, m, s, t):
            if "boom" in m:
                raise OSError("down")
            self.n += 1
            return "oops" if self.n == 1 or "bad" in m else '{"ok": 1}'

    r = spark.createDataFrame([("a", "[1]"), ("b", '["boom"]'), ("c", '["bad"]')], "doc_id string, messages string").coalesce(1)
    got = {x["doc_id"]: x for x in call(r, Flaky(), ("doc_id",)).collect()}
    assert got["a"]["ok"] and got["a"]["attempts"] == 2
    assert not got["b"]["ok"] and got["b"]["attempts"] == 1 and "down" in got["b"]["error"]
    assert not got["c"]["ok"] and got["c"]["attempts"] == 2 and got["c"]["raw"] == "oops"
    assert first_object("<think>x</think>{\"a\": 1}") == {"a": 1}


def test_whole_run(spark, rub, tmp_path):
    app = {"doc_type": "rfpb", "APPLICATION DETAILS": {"Detailed Research Plan": "We plan a trial with clear aims."}}
    apps = spark.createDataFrame([("d", json.dumps(app)), ("f", json.dumps({"doc_type": "x", "note": "FAILHERE"}))], "doc_id string, raw string")
    stage1 = json.dumps({"section_name": "Detailed Research Plan", "findings": [finding("pr.1", ["secdrp__001"])], "resolved_signals": ["pr.1"]})
    stage2 = json.dumps({"pr.1": {"signals": {f"pr.1.{c}": 4 for c in "abcdef"}, "used_chunk_ids": ["secdrp__001"], "pros": "clear", "drawbacks": ""}})
    fake = FakeScorer((("FAILHERE", "broken"), ("Section: Proposed research", stage2), ("Section: Detailed Research Plan", stage1)))
    done = scoring.score(apps, rub, fake, scoring.store_in(str(tmp_path / "run")))
    o = {r["doc_id"]: r for r in done.overall.collect()}
    assert set(o) == {"d"}
    pr = done.sections.where("doc_id = 'd' and section_key = 'proposed_research'").first()
    assert pr["score_10"] == 1.0 and pr["scored_items"] == 8 and o["d"]["score_10"] == 0.2  # td is out for this type
    assert done.state.where("doc_id = 'd'").first()["subcriteria_beliefs"]["pr.1"]["good_evidence_ids"] == ["secdrp__001"]
    assert {r["doc_id"] for r in done.failures.collect()} == {"f"}
    assert json.loads(done.results.first()["result"])["overall"]["score_10"] == 0.2
    again = scoring.score(apps, rub, FakeScorer(()), scoring.store_in(str(tmp_path / "run")))  # resumes: no model is asked
    assert again.overall.first()["score_10"] == 0.2
    assert F.col is not None


def test_requests_hold_the_state_and_the_schema(spark, rub, tmp_path):
    """The second section sees the repaired state of the first; stage 2 is bound to the section's signals and the document's chunks."""
    first = {"findings": [finding("g.1", ["zz__9"], [], "no such chunk"), finding("pr.1", ["a__1", "zz__9"], [], "clear"), finding("pr.1", [], ["a__1"], "dear")], "resolved_signals": ["g.1", "pr.1"]}
    asked = tmp_path / "asked"
    asked.mkdir()

    def generate(messages, schema, tokens):
        user = json.loads(messages)[1]["content"]
        (asked / user.split("\n")[0].removeprefix("Section: ")).write_text(user)
        return json.dumps(first if user.startswith("Section: A") else {"findings": []})

    inputs = spark.createDataFrame([("d", 0, "A", '{"a__1": "x"}'), ("d", 1, "B", '{"b__1": "y"}')], "doc_id string, section_pos int, section_name string, content string")
    raw = scoring.stage1(inputs, "{}", ["g.1", "pr.1"], generate, Ledger(str(tmp_path / "ledger")))
    assert raw.count() == 2
    state = json.loads((asked / "B").read_text().split("State:\n")[1])
    assert state == {"processed_sections": ["A"], "processed_section_count": 1, "missing_signals": ["g.1"], "resolved_signals": ["pr.1"], "signal_implications": [{"sub_id": "pr.1", "implications": ["A: dear"]}]}
    valid = spark.createDataFrame([("d", "A", ["a__1"]), ("d", "B", ["b__1"])], "doc_id string, section_name string, chunk_ids array<string>")
    found = belief.normalize(raw, valid, rubric.subs(rub).where("section_key <> 'application_form'"))
    subs = rubric.subs(rub).where("sub_id in ('g.1', 'pr.1')")
    view = belief.state_view(belief.state(raw.where("section_name = 'A'"), found, subs)).drop("doc_id").first().asDict(True)
    assert view == state

    chunk = spark.createDataFrame(CHUNKS, SCHEMA)
    asks = {r["section_key"]: json.loads(r["schema"]) for r in scoring.stage2_requests(chunk, belief.beliefs(found), rub).where("doc_id = 'd'").collect()}
    want = {}
    for r in rub.orderBy("section_pos", "sub_pos", "signal_pos").collect():
        want.setdefault(r["section_key"], {}).setdefault(r["sub_id"], []).append(r["sid"])
    ids = [r["chunk_id"] for r in chunk.where("doc_id = 'd'").orderBy("chunk_pos").collect()]
    assert asks == {k: rubric.scoring_schema(list(x.items()), ids) for k, x in want.items()}


class Counting:
    """Answers, and leaves a file a call; stops for good after some calls."""

    def __init__(self, folder, most=None):
        self.folder, self.most = str(folder), most

    def __call__(self, messages, schema, tokens):
        import hashlib
        import uuid

        if self.most is not None and len(os.listdir(self.folder)) >= self.most:
            raise SystemExit("killed")
        open(f"{self.folder}/{hashlib.sha256(messages.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}", "w").close()
        return json.dumps({"findings": [finding("g.1", ["a__1"])]}) if "Section: S1" in messages else '{"findings": []}'


def test_a_stopped_run_asks_only_for_what_it_lacks(spark, tmp_path):
    """Killed in its second step, a run doesn't repeat the first; equal requests are asked once."""
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(f"d{d}", i, f"S{i}", json.dumps({"a__1": f"text {d}"})) for d in range(6) for i in range(3)]
    rows += [("twin", i, f"S{i}", json.dumps({"a__1": "text 0"})) for i in range(3)]
    inputs = spark.createDataFrame(rows, "doc_id string, section_pos int, section_name string, content string")
    ledger = Ledger(str(tmp_path / "ledger"), batch=3)
    with pytest.raises(Exception):  # noqa: B017
        scoring.stage1(inputs, "{}", ["g.1"], Counting(calls, 9), ledger).collect()
    first = Counter(n[:16] for n in os.listdir(calls))
    done = {r.request_id for r in spark.read.parquet(str(tmp_path / "ledger" / "step=stage1-0001")).collect()}
    assert len(done) == 6  # of seven documents two are alike
    got = scoring.stage1(inputs, "{}", ["g.1"], Counting(calls), ledger).collect()
    assert len(got) == len(rows) and all(r.ok for r in got)
    every = Counter(n[:16] for n in os.listdir(calls))
    assert len(every) == 18 and sum(every.values()) <= 18 + ledger.batch  # one batch may be asked again
    assert sum((every - first).values()) <= 18 - len(done)
    before = sum(every.values())
    again = scoring.stage1(inputs, "{}", ["g.1"], Counting(calls), ledger).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) and len(os.listdir(calls)) == before


def test_failed_answers_are_asked_again(spark, tmp_path):
    asked = spark.createDataFrame([("a", "[1]"), ("b", "[2]")], "doc_id string, messages string")
    ledger = Ledger(str(tmp_path))
    bad = {r.doc_id: r for r in ledger.ask("s", asked, FakeScorer((("2", "broken"),), '{"x": 1}'), ("doc_id",)).collect()}
    assert bad["a"].ok and not bad["b"].ok and bad["b"].attempts == 2
    good = {r.doc_id: r for r in ledger.ask("s", asked, FakeScorer((), '{"y": 2}'), ("doc_id",)).collect()}
    assert (good["a"].raw, good["b"].raw) == ('{"x": 1}', '{"y": 2}') and all(r.ok for r in good.values())
    other = Ledger(str(tmp_path), model="other").ask("s", asked, FakeScorer((), '{"z": 3}'), ("doc_id",)).collect()
    assert {r.raw for r in other} == {'{"z": 3}'}


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, 1, "s", '{"findings":[{"sub_id":"g.1","evidence":{"good_evidence_ids":["a","z"]},"implication":"x"},null,{"sub_id":"g.1"}]}')], "doc_id int, section_pos int, section_name string, raw string")
    valid = spark.createDataFrame([(1, "s", ["a"])], "doc_id int, section_name string, chunk_ids array<string>")
    out = belief.normalize(rows, valid, spark.createDataFrame([("g.1",)], "sub_id string"))
    assert [(r.finding_pos, r.good, r.bad, r.implication) for r in out.collect()] == [(1, ["a"], [], "s: x")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
