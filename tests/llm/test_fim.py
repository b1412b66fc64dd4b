"""Fill-in-middle against plain regular expressions, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, seed=42, rates=fim.Rates(), marks=fim.SENTINELS):
    """(n, form, output, prefix_chars, middle_chars), by regular expressions."""
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= rates.transformed:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h4 % 100 < rates.suffix_first:
        return n, "spm", s + suffix + p + prefix + m + middle, len(prefix), len(middle)
    return n, "psm", p + prefix + s + suffix + m + middle, len(prefix), len(middle)


def texts():
    rng = random.Random(11)
    out = ["", None, " ", "\n\t ", "a", " a", "a ", "é", "日本 語　x", "<P>", "a <S> b", "<<M>", "< P>", "<P", "<P<S", "<<P <S< M>", "x\x0by\x1fz\x85 q", "😀 😀\r\n😀 "]
    out += ["".join(rng.choice(["a", "é", "日", "😀", " ", "\n", "<", "P", "S", "M", ">", "\t", "word"]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    out.append(" ".join(rng.choice(["lorem", "日本", "x<", ">P"]) for _ in range(60_000)))  # several pieces and steps
    out.append("n" * 100_000)
    out.append(" " * 5000 + "<M" + "\n" * 5000)
    return out


def test_equals_regular_expressions(spark):
    rows = list(enumerate(texts())) + [(3, "the same id again here"), (3, "the same id again here"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.digests(docs).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        n, form, output, p, m = plainly(doc_id, text)
        want.append((doc_id, n, form, p, m, sha(output), sha(text or "")))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_transform_keeps_rows_and_restores(spark):
    docs = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(texts())], "doc_id long, text string, fim string, c1 int")
    docs = docs.withColumnRenamed("fim", "c0")
    out = fim.transform(docs, rates=fim.Rates(100, 50))
    assert out.columns == [*docs.columns, "fim"]
    for r in out.collect():
        n, form, output, p, m = plainly(r.doc_id, r.text, rates=fim.Rates(100, 50))
        assert (r.c0, r.c1, *r.fim) == ("kept", 7, n, form, output, p, m)
        assert fim.restored(r.fim.text.encode(), form).decode() == (r.text or "")


def test_other_sentinels_with_shared_beginnings(spark):
    marks = ("<fim pre>", "<fim pos>", "<fim>")
    rows = [(i, t) for i, t in enumerate(["a <fim pre> b", "a <fim pr e> b", "<fim<fim>", "<fim pos", "x <fim p <fim pos> y", "<fim pre<fim po> s"] * 5)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=marks, rates=fim.Rates(100, 50), seed=5).collect()
    for r in got:
        assert tuple(r.fim) == plainly(r.doc_id, r.text, 5, fim.Rates(100, 50), marks)
        assert fim.restored(r.fim.text.encode(), r.fim.form, marks).decode() == r.text


def test_sentinels_that_cannot_be_told_apart():
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "cc", "dd"), ("ab", "bc", "dd"), ("", "b", "c")):
        with pytest.raises(ValueError, match="sentinel"):
            fim._checked(bad)


def test_pieces_equal_one_walk():
    """Pieces that are warmed up on the bytes before them give what a walk byte by byte gives."""
    automaton = fim.table(fim.SENTINELS)
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"a <PSM>\xff\xc3\xa9\n", np.uint8), 5 * fim.PIECE + 17)
    state, want = 0, []
    for byte in data.tolist():
        want.append(automaton.emitted[state + byte])
        state = int(automaton.following[state + byte])
    assert fim.emissions(data, automaton).tolist() == want


def test_no_rows_and_broken_bytes(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    broken = spark.sql("select 1L doc_id, cast(x'61ff62c3' as string) text")
    (r,) = fim.digests(broken).collect()
    assert r.restored_sha256 == hashlib.sha256("a�b�".encode()).hexdigest()
    assert broken.select(F.length("text")).first()
