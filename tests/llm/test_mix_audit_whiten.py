"""Mixing, filter interactions and whitening against brute force."""

import itertools
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import interactions, mixing, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- mixing -------------------------------------------------------------------------------------

def brute_targets(sizes):
    """Reshares the excess of sources at their limit, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    out = {s: total * w[s] / sum(w.values()) for s in names}
    full = set()
    while any(out[s] > 2 * sizes[s] + 1e-9 for s in names if s not in full):
        full |= {s for s in names if out[s] > 2 * sizes[s]}
        rest = total - sum(2 * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        out = {s: 2 * sizes[s] if s in full else rest * w[s] / free for s in names}
    return out


def check_mix(spark, rows, schema="doc_id long, text string, source string"):
    got = mixing.taken(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    sizes, of = {}, {}
    for d, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
        of.setdefault(d, set()).add(s)
    want, took = brute_targets(sizes), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        (s,) = of[r.doc_id] if len(of[r.doc_id]) == 1 else (None,)
        if len(of[r.doc_id]) == 1:
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            took[s] = took.get(s, 0) + r.taken
    if all(len(v) == 1 for v in of.values()):
        for s in sizes:
            assert abs(took[s] - want[s]) <= 0.5 + 1e-6
    return got


def some_docs(seed, n=300, hot="b"):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(string.ascii_lowercase, k=rng.choice((0, 1, 3, 40, 700)))), hot if rng.random() < 0.4 else rng.choice("acdefé"))
            for i in range(n)]


def test_mix_targets_and_limits(spark):
    rows = some_docs(1)
    got = check_mix(spark, rows)
    again = mixing.taken(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_mix_odd_rows(spark):
    rows = [(0, None, "a", 1), (1, "", None, 2), (2, "x y z", None, 3), (3, "w " * 9000, "a", 4), (4, "same words", "", 5), (5, "same words", "", 5), (6, "t", "z", 0)]
    check_mix(spark, rows, "doc_id long, text string, source string, size long")
    repeated = [(7, "a b c", "s")] * 5 + [(None, "d e", None)] * 4
    assert abs(sum(r.taken for r in check_mix(spark, repeated)) - 34.5) <= 1
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(empty).collect() == []
    assert [r.taken for r in mixing.taken(spark.createDataFrame([(1, None, None), (2, " ", "a")], empty.schema)).collect()] == [0, 0]


def test_mix_pieces_and_order(spark):
    docs = spark.createDataFrame(some_docs(2), "doc_id long, text string, source string")
    parts, sized, sources = mixing.mix(docs)
    parts = parts.cache()
    blocks = parts.groupBy("slot").agg(F.sum("length").alias("n"), F.count_distinct("row").alias("d")).collect()
    assert len(blocks) == sources.agg(F.sum("blocks")).first()[0] and max(b.n for b in blocks) == mixing.BLOCK
    assert sum(b.n < mixing.BLOCK for b in blocks) <= sources.count()
    # any early stretch of the mix holds the sources near their shares
    by = {r["row"]: r["source"] for r in sized.collect()}
    first = sorted({(p.slot, by[p.row]) for p in parts.collect()})
    share = {r.source: r.blocks for r in sources.collect()}
    for upto in (len(first) // 4, len(first) // 2):
        for s, b in share.items():
            assert abs(sum(x == s for _, x in first[:upto]) - upto * b / len(first)) < 4
    words = {r.doc_id: (r.text or "").split(" ") for r in docs.collect()}
    for r in mixing.texts(docs, parts).join(parts.select("slot", "at", "start", "length"), ["slot", "at"]).collect():
        assert r.text.split(" ") == words[r.doc_id][r.start:r.start + r.length]


def test_schedule_without_points_for_a_source(spark):
    """A source whose share is below the points' resolution still gets its block."""
    sources = spark.createDataFrame([("a", 0, 5000, 0), ("b", 1, 1, 5000), ("c", 2, 3, 5001)], "source string, no long, blocks long, before_blocks long")
    got = mixing.schedule(sources).collect()
    assert len(got) == len({r.slot for r in got}) == 5004
    for no, n in ((0, 5000), (1, 1), (2, 3)):
        assert sorted(r["rank"] for r in got if r.no == no) == list(range(n))


# ---- filter interactions ------------------------------------------------------------------------

def brute_audit(docs, labels):
    fails, part, good, toxic = [], [], [], []
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                      "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]})
        part.append(s or "")
        good.append(any(x == d and q == 1 for x, q, _ in labels) and d is not None)
        toxic.append(any(x == d and y == 1 for x, _, y in labels) and d is not None)
    out = {}
    for p in set(part):
        own = [i for i in range(len(docs)) if part[i] == p]
        shap = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = set(own)
            for k, f in enumerate(order, 1):
                gone = {i for i in alive if fails[i][f]}
                late = [i for i in own if fails[i][f] and i not in alive]
                alive -= gone
                shap[f] += len(gone)
                out[p, "".join(order), k] = [len(alive), len(gone), len(late), sum(fails[i][f] and sum(fails[i].values()) == 1 for i in own),
                                             sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
        for (q, order, k), v in out.items():
            if q == p:
                v.append(shap[order[k - 1]])
    return out


def test_audit_brute(spark):
    rng = random.Random(3)
    words = [rng.choice(("Tree", "leaf", "NODE", "a", "b$", "é")) + str(rng.randrange(30)) for _ in range(500)]
    plain = [f"w{i}" for i in range(400)]
    texts = [None, "", "short", " ".join(words), " ".join(plain), "x " * 300, " ".join(plain) + " #", " ".join(plain).upper()]
    docs = [(i if i % 19 else None, rng.choice(texts) if i % 4 else " ".join(rng.sample(plain, 250)), rng.choice(["a", "a", "b", None, ""])) for i in range(120)]
    docs += docs[:6] + [(3, docs[3][1], "b")]
    labels = [(i, rng.randrange(2), rng.choice((0, 1, None))) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, kept long")
    got = interactions.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert list(r)[3:] == want[r.part, r.filter_order, r.step]


def test_audit_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(docs, labels).collect() == []
    one = interactions.audit(spark.createDataFrame([(None, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


# ---- whitening ----------------------------------------------------------------------------------

SPECTRA = {"random": lambda r, d: r.gamma(1.0, 1.0, d), "geometric": lambda r, d: 2.0 ** -np.arange(d), "equal": lambda r, d: np.ones(d),
           "pairs": lambda r, d: np.repeat(np.arange(1, d // 2 + 2), 2)[:d].astype(float), "low rank": lambda r, d: np.r_[np.ones(2), np.zeros(d)][:d],
           "tight": lambda r, d: 1 + 1e-9 * np.arange(d), "zero": lambda r, d: np.zeros(d)}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("d", [1, 2, 5, 24])
def test_spectral_division(name, d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * SPECTRA[name](rng, d)) @ q.T if d > 1 else SPECTRA[name](rng, 1).reshape(1, 1)
    a = (a + a.T) / 2
    values, vectors = whitening.components(a)
    size = np.linalg.norm(a) or 1.0
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size


def test_polar_factor():
    rng = np.random.default_rng(0)
    for d in (1, 3, 40):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        signs = rng.choice((-1.0, 1.0), d)
        a = (q * signs * np.exp(rng.uniform(-20, 0, d))) @ q.T
        assert np.abs(whitening.polar_sign((a + a.T) / 2) - (q * signs) @ q.T).max() < 1e-6


def brute_whiten(rows):
    rows = [(i, [float(e) for e in v]) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))))
    n, s = len(fit), [sum(c) for c in zip(*map(list, fit.tolist()))]
    y = (fit * n - np.array(s)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:16]
    out = []
    for (i, _), v in zip(rows, x):
        dev = sum((n * e - t) ** 2 for e, t in zip(v, s))
        for k, c in enumerate(order, 1):
            out.append((i, k, n, dev, float((np.array(v) - np.array(s) / n) @ vectors[:, c] / np.sqrt(values[c])), float(values[c] / values.sum())))
    return out


def test_whiten_brute(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(e)) for e in rng.standard_normal(20) * np.arange(1, 21)]) for i in range(200)]
    rows += [(200, None), (201, [None] * 20), (202, [float("nan")] + [0.0] * 19), (203, [float("inf")] * 20), (204, rows[0][1]), (None, rows[0][1]), (205, [1.0, 2.0])]
    rows += [(300, rows[5][1])] * 3
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, component int").repartition(5)
    got = sorted(whitening.whiten(frame).collect(), key=lambda r: (str(r.vec_id), r.component))
    want = sorted(brute_whiten([r for r in rows if r[0] != 205]), key=lambda r: (str(r[0]), r[1]))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    sign = {}
    for g, w in zip(got, want):
        assert g.explained == pytest.approx(w[5], rel=1e-9) and g.identity_error < 1e-9
        sign.setdefault(g.component, math.copysign(1, g.whitened * w[4]))
        assert g.whitened == pytest.approx(sign[g.component] * w[4], abs=1e-7)


def test_whiten_odd(spark):
    schema = "vec_id long, embedding array<float>"
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [1.0, 2.0])] * 3) == []  # one distinct vector has no variance
    line = run([(i, [float(i), 2.0 * i]) for i in range(4)])
    assert len(line) == 4 and {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    with pytest.raises(Exception, match="too large"):
        run([(1, [3e38, 1.0]), (2, [1.0, 2.0])])
