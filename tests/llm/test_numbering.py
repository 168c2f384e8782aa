"""Rows keep their numbers when Spark packs the input's files otherwise between two scans."""

import random

import pytest

from voxelframe.llm import common, jaccard, sketches, substrings

RUNS = {"dedup": lambda d: substrings.dedup(d).drop("row"), "shortened": substrings.shortened,
        "edited_versions": sketches.edited_versions, "representatives": jaccard.representatives, "components": jaccard.components}


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    rng, out = random.Random(5), str(tmp_path_factory.mktemp("packed") / "documents")
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=rng.randrange(30, 300))) + (f" {passage}" if i % 3 else "") for i in range(60)]
    rows = [(i, texts[i] if i % 7 else texts[0] + f" {i}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(out)
    return out


@pytest.mark.parametrize("name", RUNS)
def test_packing_changes(spark, path, monkeypatch, name):
    setting = "spark.sql.files.minPartitionNum"
    collect = lambda: sorted(map(str, RUNS[name](spark.read.parquet(path)).collect()))
    spark.conf.set(setting, "1")
    try:
        want = collect()
        assert spark.read.parquet(path).rdd.getNumPartitions() < 4

        def packed_otherwise(df, of, write=common.staged):
            out = write(df, of)
            spark.conf.set(setting, "100")
            return out

        for module in (common, substrings, sketches, jaccard):
            monkeypatch.setattr(module, "staged", packed_otherwise)
        assert collect() == want
    finally:
        spark.conf.unset(setting)
