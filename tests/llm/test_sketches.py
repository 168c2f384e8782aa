"""Invertible Bloom lookup fingerprints against plain sets."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from voxelframe.llm import queries, sketches

SF = "/root/testdata/sf0.001"


def paragraphs(text):
    return set(Counter(re.findall(r"[^\n]{1,256}", text)).items())


def like(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """rows of (doc_id, text), ids unique -> {doc_id: (n_chars, digest of the edited text, near_edited, near_next)}"""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + following[:q]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, following), 9))
    return out


def values(rows):
    return {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_iblt_fingerprints(spark, SF).collect()
    assert values(got) == brute(rows) and len(got) == len(rows)
    text, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)


def test_odd(spark):
    long = "\n".join(f"line {i} {'é𝄞' * (i % 7)}" for i in range(3000))
    rows = [(5, None), (1, ""), (9, long), (2, "one line"), (7, long + "\nmore"), (3, "a\nb\na\na\nc"), (4, "a\nb\na\nc"), (30, "x" * 2000), (31, "\n\n")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, head string")
    got = sketches.edited_versions(docs).collect()
    assert values(got) == brute(rows)
    assert sketches.edited_versions(docs.limit(0)).count() == 0
    one = sketches.edited_versions(docs.where("doc_id = 2")).collect()
    assert values(one) == brute([(2, "one line")])
    again = docs.unionByName(docs).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    got = sketches.edited_versions(again).collect()
    assert len(got) == 20 and all(0 <= r.near_edited <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 9}) == 1


def test_differences(spark):
    """What peeling recovers, with retries from a table far too small."""
    rows = [(i, list(range(1, 1 + 10 * i)), list(range(1 + 3 * i, 1 + 12 * i))) for i in range(12)] + [(99, [5, 6], [5, 6])]
    pairs = spark.createDataFrame(rows, "row long, plus array<long>, minus array<long>")
    got = {r.row: (set(r.only_plus), set(r.only_minus)) for r in sketches.differences(pairs, ["row"], cells=6).collect()}
    assert got == {i: (set(a) - set(b), set(b) - set(a)) for i, a, b in rows if a != b}
    assert sketches.differences(pairs.limit(0), ["row"]).count() == 0
