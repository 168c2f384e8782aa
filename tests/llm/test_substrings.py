"""Substring dedup against looking up every window."""

import hashlib
import random

import numpy as np
import pytest

from voxelframe.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows of (doc_id, text), ids unique -> sorted (doc_id, n_words, n_removed, digest of the kept words)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)


def corpus(seed):
    """Passages of 15 to 200 words shared at any place, copies, runs, periods, a passage in a third of the texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(rng.randrange(15, 200)) for _ in range(25)] + [["a"] * 50, ["a", "b"] * 40, ["a", "b", "c", "a"] * 30, fresh(19), fresh(20), fresh(21)]
    hot, texts = fresh(60), []
    for _ in range(150):
        text = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a:] if rng.random() < 0.3 else p
            text += fresh(rng.randrange(0, 30))
        texts.append(text + hot if rng.random() < 0.33 else text)
    texts += texts[:10]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, map(" ".join, texts), strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in queries.op1_substring_dedup(spark, SF).collect())
    assert got == brute(rows)


def test_odd(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "short"), (5, text), (6, f"x {text}\ny"), (6, f"x {text}\ny"), (None, text + " z"), (None, text),
            (7, "v " * 9000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, kept string")
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.kept[:5]) for r in substrings.dedup(docs).collect())
    assert got == [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 0, "short"), (5, 50, 0, "w0 w1"), (6, 52, 50, "x y"), (6, 52, 50, "x y"),
                   (7, 9000, 8999, "v"), (99, 50, 50, ""), (99, 51, 50, "z")]
    assert substrings.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_symbols_depend_on_their_words_alone(seed):
    """Put between other words, a stretch gives the same symbols wherever naming depends on it alone; bounds never fall."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6)]
    middle = [rng.choice(words) for _ in range(60)]
    found = []
    for _ in range(2):
        before, after = ([rng.choice(words) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        w = substrings.Words([" ".join(words), " ".join(before + middle + after)])
        s = substrings.Symbols.of(w)
        for k in range(substrings.LOW):
            s = s.round(w, k)
        assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
        at = len(words) + len(before)
        found.append({(a - at, b - at, n) for a, b, n, lo, hi in zip(s.start, s.end, s.name, s.low, s.high, strict=True) if lo >= at and hi <= at + 60})
    assert found[0] == found[1] and len(found[0]) > 10
