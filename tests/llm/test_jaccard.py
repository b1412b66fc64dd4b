import random
import re

import pytest

from quillspark.llm import jaccard as J
from quillspark.llm.shingles import shingle_sets

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{id: (n, component)} by comparing all pairs that share a shingle."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = {}
    for i, a in enumerate(s):
        shared = {}
        for h in a:
            for j in held.get(h, ()):
                shared[j] = shared.get(j, 0) + 1
            held.setdefault(h, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(a) + len(s[j]) - n):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {rows[i][0]: (len(s[i]), least[find(i)]) for i in range(len(rows))}


def joined(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_bounds():
    for n in range(1, 3000):
        for level in J.bands(n):
            assert J.parts(level) > J.reach(n, level) and (level > J.FINE or n > J.reach(n, level))
        for m in range(n, n * 5 // 4 + 1):
            assert J.band(m) in J.bands(n)


def test_shingles_are_the_texts_own():
    rng = random.Random(1)
    texts = ["", " \t\n", "one", "One two THREE", "a b c d e", "é b c d e f"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    got = list(shingle_sets([t.encode() for t in texts]))
    assert [len(g) for g in got] == [len(sets(t)) for t in texts]
    for i in range(0, 200, 7):
        for j in range(1, 200, 11):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(sets(texts[i]) & sets(texts[j]))


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(2)
    for _ in range(200):
        a = list(shingle_sets([" ".join(str(rng.randint(0, 50)) for _ in range(rng.randint(5, 300))).encode()]))[0]
        b = list(shingle_sets([" ".join(str(rng.randint(0, 50)) for _ in range(rng.randint(5, 300))).encode()]))[0]
        assert J.distance(J.sketch(a), J.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def corpus(seed=5):
    """Copies, near copies in chains, a passage that many share, documents that are mostly that passage, and junk."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = ["", "  ", None, "one", "One", "a b c d", "a b c d e", "A B C D E f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 250))]
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(base))
            if rng.random() < 0.6:
                base = list(base)
                for _ in range(max(1, len(base) // rng.randint(8, 60))):
                    base[rng.randrange(len(base))] = word()
    for _ in range(60):
        texts.append(" ".join([*[word() for _ in range(rng.randint(3, 60))], *passage, *[word() for _ in range(rng.randint(0, 20))]]))
    for _ in range(30):
        texts.append(" ".join([*passage, *[word() for _ in range(rng.randint(1, 16))]]))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("pairs", "hot", "held"), [(24, 128, 1 << 18), (2, 128, 1 << 18), (2, 3, 200), (4, 6, 1 << 18)])
def test_equals_brute_force(spark, monkeypatch, pairs, hot, held):
    """With small limits too, which send keys through lists of their first documents and documents to the last step."""
    for name, value in (("PAIRS", pairs), ("HOT", hot), ("HELD", held)):
        monkeypatch.setattr(J, name, value)
    rows = corpus()
    assert joined(spark, rows) == brute(rows)


def passages(seed):
    """Documents that are mostly shared passages, alone and together, some alike in the rest, some only in passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [[word() for _ in range(rng.choice([20, 45, 90]))] for _ in range(5)]
    texts = []
    for _ in range(160):
        body = [w for p in rng.sample(shared, rng.randint(1, 3)) for w in p]
        own = [word() for _ in range(int(len(body) * rng.uniform(0.02, 0.3)))]
        cut = rng.randint(0, len(own))
        texts.append(" ".join([*own[:cut], *body, *own[cut:]]))
        if rng.random() < 0.3:  # the same but for a part of its own words
            other = [word() if rng.random() < 0.5 else w for w in own]
            texts.append(" ".join([*other[:cut], *body, *other[cut:]]))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_made_of_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "PAIRS", 3)
    monkeypatch.setattr(J, "BLOCK", 16)
    seen = []
    last = J._left_over
    monkeypatch.setattr(J, "_left_over", lambda *a: seen.append(a[0].count()) or last(*a))
    rows = passages(seed)
    assert joined(spark, rows) == brute(rows)
    assert seen and seen[0] > 50


def test_form_letters_are_not_compared_with_each_other(spark, monkeypatch):
    """A passage and words of their own, too many for two to be similar: one group, so the last step has a centre and the others only."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(104)]  # 100 shingles
    rows = [(i, " ".join([*passage, *(f"w{rng.random()}" for _ in range(rng.randint(15, 19)))])) for i in range(300)]
    seen = []
    last = J._in_blocks
    monkeypatch.setattr(J, "_in_blocks", lambda a, b: seen.append((a.select("node").distinct().count(), b.count())) or last(a, b))
    assert {c for _, c in joined(spark, rows).values()} == {i for i, _ in rows}
    assert len(seen) == 1 and seen[0][0] == 1


def test_short_texts_need_no_last_step(spark, monkeypatch):
    """Random short texts: no part holds all their shingles by chance."""

    def none(*_):
        raise AssertionError("a short text was left over")

    monkeypatch.setattr(J, "_left_over", none)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(8))) for i in range(20_000)]
    rows += [(20_000 + i, rows[i][1] + (" x" if i % 2 else "")) for i in range(100)]
    got = joined(spark, rows)
    assert all(got[20_000 + i][1] == (i if i % 2 == 0 else i if 100 * 4 >= 80 * 5 else 20_000 + i) for i in range(100))
    assert sum(c == i for i, (_, c) in got.items()) == 20_000


def test_rows_of_one_id_join_what_they_link_with(spark):
    rows = [(3, "a b c d e f g"), (5, "A b c d e f g"), (5, "n o p q r s t"), (9, "n o p q r s t"), (11, "x y z u v w o")]
    got = [(r["doc_id"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]


def test_edges(spark):
    assert joined(spark, []) == {}
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (9, "A B C D E F G"), (None, "a b c d e f g"), (7, None)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 3, 5), (5, 3, 5), (9, 3, 5), (None, 3, None), (7, 0, 7)], key=str)


def test_extra_columns_do_not_clash(spark):
    rows = [(1, "x y z", 0, "k", 2, "n"), (2, "x y z", 0, "k", 2, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, t string, node int, component_id string")
    assert {r["component_id"] for r in J.join(df).collect()} == {1}
