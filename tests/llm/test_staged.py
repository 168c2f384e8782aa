"""Operators that stage or join: packing, language model, archives."""

import base64
import hashlib
import zlib
from array import array
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelframe.llm import packing, ppm, queries, warc
from voxelframe.session import scratch_path

SF = "/root/testdata/sf0.001"
TOOL = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
TOOL.encode_special_tokens = True


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def greedy(lengths, capacity):
    """The method item by item."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), None)
        if b is not None:
            large.remove(b)
        gaps.append(capacity - a - (b or 0))
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


@given(st.lists(st.integers(1, 24), min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_plan(lengths):
    counts, rows = Counter(lengths), []
    for s in packing.plan(counts, 24):
        rows += [{"length": s.length, "sequence_id": s.first + (r - s.low) // s.per_bin,
                  "offset": s.base + (r - s.low) % s.per_bin * s.length} for r in range(s.low, s.high)]
    assert Counter(r["length"] for r in rows) == counts
    assert check_packing(rows, 24) == greedy(lengths, 24)


@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["The", " ", "\n", "\t", "é", "é", "İ", "ΣΑΣ", "'s", "a.", "É,", ".", "...", "it's.", "\u0301.", "\u0958.", "İ,", "<|END", "x;;", "12", "<|endoftext|>", "!", "\x1c", "\xa0"]), max_size=30).map("".join)))
@settings(max_examples=500, deadline=None)
def test_tokens(text):
    words = packing.WORDS.setdefault("test", packing.Words(public_tokenizers.path(packing.VOCABULARY)))
    assert list(array("I", words.encode(text))) == TOOL.encode(text, add_special_tokens=False).ids


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [r.asDict() for r in queries.op2_best_fit_packing(spark, SF).collect()]
    want = {}
    for d in docs:
        ids = [*TOOL.encode(d.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = array("I", ids[k:k + 2048])
            want[d.doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    n = check_packing(rows, 2048)
    assert n == greedy([r["length"] for r in rows], 2048) <= 1.05 * sum(r["length"] for r in rows) / 2048 + 1


def test_packing_odd(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "w " * 9000, 5), (4, "a b", 5), (4, "a b", 5), (None, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = [r.asDict() for r in packing.pack_documents(docs).collect()]
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 3: 5, 4: 2, None: 1}
    check_packing(got, 2048)
    assert packing.pack_documents(docs.limit(0)).collect() == []


def brute_ppm(train, texts):
    """Counts and exclusion sets as plain dictionaries; every node kept."""
    low = lambda t: (t or "").encode().translate(ppm.LOWER)
    tables = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in train:
        data = bytes([ppm.END] * ppm.ORDER) + low(t) + bytes([ppm.END])
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                tables[k][data[i - k:i]][data[i]] += 1
    out = []
    for t in texts:
        data, total = bytes([ppm.END] * ppm.ORDER) + low(t) + bytes([ppm.END]), 0.0
        for i in range(ppm.ORDER, len(data)):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {b: n for b, n in tables[k].get(data[i - k:i], {}).items() if b not in excluded}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    total += log10(seen[data[i]] / whole)
                    break
                total += log10(len(seen) / whole)
                excluded |= set(seen)
            else:
                total -= log10(256 - len(excluded))
        out.append(total)
    return out


def brute_base(train, texts):
    tokens = lambda t: [*(t or "").encode().translate(ppm.LOWER).split(), b"\n"]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(w in c for w in tokens(t)), sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in texts]


def test_ppm_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = [zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs]
    train = [d.text for d, h in zip(docs, held, strict=True) if not h]
    got = {r.doc_id: r for r in queries.op3_ppm_score(spark, SF).collect()}
    n, base = brute_base(train, [d.text for d in docs])
    score = brute_ppm(train, [d.text for d in docs[:60]])
    for k, (d, h) in enumerate(zip(docs, held, strict=True)):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *base[k][:2], n)
        assert abs(r.base_score - base[k][2]) < 1e-6 * abs(base[k][2])
        if k < len(score):
            assert abs(r.score - score[k]) < 1e-6 * abs(score[k])
    bits = [-r.score / log10(2) / (len(d.text.encode()) + 1) for d in docs if (r := got[d.doc_id]).held_out]
    assert np.mean(bits) < 4


def test_ppm_odd(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "abc " * 700_000, 1), (4, "Abc abc", 1), (4, "Abc abc", 1), (None, "zz", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in ppm.score(docs, F.col("doc_id") == 4).collect())
    assert got == [(0, 2, 1, 6), (1, 1, 1, 6), (2, 1, 1, 6), (3, 700_001, 700_001, 6), (4, 3, 3, 6), (4, 3, 3, 6)]
    assert ppm.score(docs.limit(0), F.lit(True)).collect() == []
    none = {r.doc_id: r for r in ppm.score(docs, F.lit(None).cast("boolean")).collect()}
    assert abs(none[2].score + log10(256)) < 1e-9 and none[2].base_score == 0


def test_ppm_keeps_rare_contexts(spark):
    """More than 2^20 training bytes: contexts seen once count as in the plain form."""
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), rng.integers(2, 9))) for _ in range(400)) for _ in range(700)]
    train, held = texts[:-40], texts[-40:]
    assert sum(len(t.encode()) for t in train) > 1 << 20
    docs = spark.createDataFrame([*enumerate(train), *((10_000 + i, t) for i, t in enumerate(held))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") < 10_000).collect()}
    assert len(got) == len(texts)
    for i, want in zip([*range(20), *range(10_000, 10_040)], brute_ppm(train, train[:20] + held), strict=True):
        assert abs(got[i] - want) < 1e-6 * abs(want)


def test_thresholds_keep_probabilities():
    rng = np.random.default_rng(1)
    data = [rng.choice(list(b"abcde "), 3000, p=[.4, .2, .1, .1, .1, .1]).astype(np.uint8).tobytes() for _ in range(5)]
    keys, n = np.unique(np.concatenate([p for p, _ in ppm.grams(data)]), return_counts=True)
    nodes = []
    for k in range(ppm.ORDER + 1):
        u, back = np.unique(keys & ppm.Model.mask(k), return_inverse=True)
        c = np.bincount(back, n).astype(np.int64)
        keep = c >= 6 * (k > 0)
        nodes.append((u[keep], c[keep]))
    model = ppm.Model(nodes)
    for context in (b"abca", b"zzzz", b"eab ", b"zabc"):
        all_next = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** model.log10(all_next)).sum() - 1) < 1e-9


def test_warc_sql(spark):
    got = [tuple(r) for r in queries.op9_warc_archives(spark, SF).orderBy("page_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == con.execute(queries.ORACLES["op9_warc_archives"] + " ORDER BY page_id").fetchall()


def test_warc_files(spark):
    """Every frame after the dictionary is one whole record; payloads come back."""
    rows = [(i, f"http://x/{i % 3} \r\né", f"<p>page number {i // 2} " + "lorem ipsum dolor " * 50 + "</p>") for i in range(400)]
    rows += [(1000, None, None), (1001, "u", ""), (None, "u", "only"), (2005, "u", "same"), (2005, "u", "same"), (2007, "v", "only"), (1002, "big", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x"))
    manifest = warc.write(pages, scratch_path(spark, "warc"), settings=warc.Settings(sample_bytes=50_000))
    records = [warc.parse(x) for m in manifest.collect() for x in warc.read_archive(m.path)]
    assert len(records) == len(rows) == sum(m.records for m in manifest.collect())
    assert all(m.bytes for m in manifest.collect())
    by_id = {r["page_id"]: r for r in records}
    for page_id, _, html in rows:
        r = by_id[page_id]
        data = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["payload"] == data if r["record_type"] == "response" else r["refers_to"] < page_id if page_id is not None else True
    assert by_id[1001]["refers_to"] == 1000 and by_id[None]["refers_to"] == 2007 and by_id[2007]["record_type"] == "response"
    assert [r["record_type"] for r in records if r["page_id"] == 2005].count("response") == 2
    assert sorted(map(str, warc.read(manifest).toPandas()["page_id"].dropna())) == sorted(str(float(r[0])) for r in rows if r[0] is not None)
    import struct
    dictionaries = 0
    for m in manifest.collect():
        data = open(m.path.removeprefix("file:"), "rb").read()
        dictionaries += struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE and data[8:12] == b"\x37\xa4\x30\xec"
    assert dictionaries
    assert warc.read(warc.write(pages.limit(0), scratch_path(spark, "warc"))).count() == 0


def test_warc_damage(spark):
    data = warc.record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"payloaf"))
    assert zstandard
