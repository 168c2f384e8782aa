"""N-gram Jaccard join against comparing all pairs."""

import random
from math import comb

import pytest

from voxelframe.llm import jaccard, queries
from voxelframe.llm.common import LOWER

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows of (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return sorted(out, key=str)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Chains of near copies, short texts, a line in a third of all texts, copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 160))]
        for _ in range(12):
            texts.append(edited(rng, base, rng.randrange(0, 7)))
        for _ in range(6):  # drift
            base = edited(rng, base, 2)
            texts.append(base)
    for _ in range(60):
        short = [rng.choice("abc") for _ in range(rng.randrange(0, 24))]
        texts += [short, short[:-1]] if rng.random() < 0.5 else [short]
    for n in range(5, 24):
        base = [f"s{n}_{i}" for i in range(n)]
        texts += [base, base[1:], base[:-1], [*base, "x"], [*base, "x", "y"], base[2:]]
    line = [f"hot{i}" for i in range(30)]
    texts = [t + line if rng.random() < 0.33 else t for t in texts]
    texts += [texts[0]] * 20
    rng.shuffle(texts)
    return [(10 * i + 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed)
    got = sorted((tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op10_jaccard_components(spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_odd(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (None, text), (9, text), (9, text), (8, text + " z"),
            (None, "lonely words here"), (7, "v " * 3000), (9, "another text under id nine")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, component_id string")
    got = sorted((tuple(r) for r in jaccard.components(docs).collect()), key=str)
    assert got == brute(rows)
    assert jaccard.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("x", [0, 5, 9, 12])
def test_any_boundary(spark, x, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda counts, by: x)
    rows = corpus(3)
    got = sorted((tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_boundary_by_cost():
    by = jaccard.Settings()
    assert jaccard.boundary({}, by) == 0
    assert 5 <= jaccard.boundary({s: 100 for s in range(1, 17)}, by) < 16
    assert by.overlap(10, 10) == 9 and list(by.partners(10)) == [8, 9, 10, 11, 12] and comb(10, 9) == 10
