import hashlib
import random
import shutil
from pathlib import Path

import pytest

from quillspark.llm import bpe
from quillspark.llm.queries import tokenizer


@pytest.fixture(scope="module")
def m():
    return bpe.merges(Path(tokenizer()[0]).read_bytes(), tokenizer()[1])


@pytest.fixture(scope="module")
def both(m):
    tiktoken = pytest.importorskip("tiktoken")
    return m, tiktoken.Encoding("own", pat_str=tokenizer()[1], mergeable_ranks=m.ranks, special_tokens={})


def slow(m, piece):
    """The leftmost pair of lowest rank, by looking at all pairs each time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((m.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in m.ranks), default=None)
        if best is None:
            return [m.ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_replay_equals_one_merge_at_a_time(m):
    rng = random.Random(6)
    pieces = [bytes(rng.choice(b"aabbcein st") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    pieces += [b"a" * k for k in range(70)] + [b"ab" * k for k in range(40)] + [bytes([c]) * 3 for c in range(256)]
    want = [[m.ranks[p]] if p in m.ranks else slow(m, p) if p else [] for p in pieces]
    assert m.replay(pieces) == want
    assert [m.one_by_one(p) for p in pieces] == [slow(m, p) for p in pieces]
    assert m.one_by_one(b"abcd" * 100_000) == m.replay([b"abcd" * 100_000])[0]


def test_equals_the_library(both, spark):
    m, enc = both
    rng = random.Random(7)
    alphabet = "abc thé 12\n\t ñß漢字😀'slx  !?"
    texts = ["", None, " ", "<|endoftext|>", "a" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, *tokenizer()).collect()}
    assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, *tokenizer()), *tokenizer()).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_digests_are_of_the_ids(both, spark):
    _, enc = both
    texts = ["Hello there", "été", None, "x" * 100, "so it goes " * 200_000]
    df = spark.createDataFrame([(i, t, 0, "n") for i, t in enumerate(texts)], "doc_id long, text string, id int, n_tokens string")
    for r in bpe.digests(df, *tokenizer()).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_what_a_task_keeps_changes_no_result(m, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc thé 12\n") for _ in range(rng.randint(0, 80))).encode() for _ in range(400)]
    flat = lambda made: [i for ids in made[0] for i in ids]
    want = [flat(next(bpe.Pieces(m).add([t]))) for t in texts]
    for memo in (0, 50, 10**6):
        monkeypatch.setattr(bpe, "MEMO", memo)
        pieces, got = bpe.Pieces(m), []
        for a in range(0, len(texts), 7):
            got += map(flat, pieces.add(texts[a : a + 7]))
        assert got == want


def test_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.digests(df, *tokenizer()).collect()), key=str)
    assert got == sorted([(None, 2), (1, 2), (1, 2), (1, 1)], key=str)
    assert bpe.digests(df.limit(0), *tokenizer()).count() == 0


def test_tasks_don_t_open_the_rank_file(spark, tmp_path, monkeypatch):
    own = tmp_path / "own.tiktoken"
    shutil.copy(tokenizer()[0], own)
    out = bpe.digests(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), str(own), tokenizer()[1])
    own.unlink()
    assert out.first()["n_tokens"] == 3
    shutil.copy(tokenizer()[0], own)
    monkeypatch.setattr(bpe, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(own), tokenizer()[1])
