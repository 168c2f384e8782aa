"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline
from tests.llm import test_jaccard, test_rows, test_staged, test_substrings
from voxelframe.llm import langid, pii

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = langid.fit(docs, corpus_pipeline.F.lit(True))
    st = langid.Settings()
    encoders = [langid.Encoder(model[n], st) for n in sorted(model)]
    want = [r for r in rows(docs) if not langid.judge(r["text"], encoders, sorted(model), st.margin)[2]]
    stages = dict(corpus_pipeline.STAGES)
    assert [r["doc_id"] for r in rows(docs) if r not in want and len(r["text"]) > 100] == []

    docs = corpus_pipeline.staged(stages["language ID"](spark, docs, SF), "t")
    assert docs.columns == columns and rows(docs) == want

    firsts = {c for _, _, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in want])}
    want = [r for r in want if r["doc_id"] in firsts]
    docs = corpus_pipeline.staged(stages["n-gram Jaccard join"](spark, docs, SF), "t")
    assert docs.columns == columns and rows(docs) == want

    removed = {i: (n, sha) for i, _, n, sha in test_substrings.brute([(r["doc_id"], r["text"]) for r in want])}
    docs = corpus_pipeline.staged(stages["substring dedup"](spark, docs, SF), "t")
    got = rows(docs)
    assert docs.columns == columns and [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    for a, b in zip(want, got, strict=True):
        n, sha = removed[a["doc_id"]]
        assert b == a if not n else test_substrings.hashlib.sha256(b["text"].encode()).hexdigest() == sha and b["n_chars"] == len(b["text"])

    want = [{**r, "text": (t := pii.mask(r["text"], pii.find(r["text"]))), "n_chars": len(t)} for r in got]
    docs = corpus_pipeline.staged(stages["PII"](spark, docs, SF), "t")
    assert docs.columns == columns and rows(docs) == want
    for r in want:
        assert not [s for s in test_rows.brute_spans(r["text"]) if s[1] in ("email", "ip")]

    last = [r.asDict() for r in stages["best-fit packing"](spark, docs, SF).collect()]
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in want}
    test_staged.check_packing(last, 2048)
    again = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    key = lambda rs: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(again) == key(last)


def test_odd(spark):
    rows_ = [(1, None, "en", "x", 0, 1), (2, "", "en", "x", 0, 1), (3, "The same words again and again here", "en", "y", None, 1), (None, "null id text of words", None, "y", 5, 1),
             (3, "The same words again and again here", "en", "y", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` int"
    for docs in (spark.createDataFrame(rows_, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = corpus_pipeline.staged(stage(spark, docs, SF), "t")
            assert name == "best-fit packing" or docs.columns == before
    final = corpus_pipeline.STAGES
    assert len(final) == 5
