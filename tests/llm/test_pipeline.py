"""The pipeline's stages, each against what its operator says of its input."""

from pyspark.sql import functions as F

import corpus_pipeline
from groupwise.llm import jaccard, pii

from ..conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, DATA).cache()
    assert good.columns == columns and 0 < good.count() < docs.count()
    bad = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").select("doc_id")
    assert good.join(bad, "doc_id").count() <= 2
    alone = stages["n-gram Jaccard join"](spark, good, DATA).cache()
    assert alone.columns == columns
    groups = jaccard.near_duplicates(good).select("component_id").distinct().count()
    assert alone.count() == groups
    clean = stages["PII"](spark, alone, DATA).cache()
    assert clean.columns == columns and not [r for r in clean.collect() if pii.base_spans(r["text"])]
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    mixed = stages["mixing sources to target weights"](spark, clean, DATA)
    assert mixed.columns == columns and mixed.select("doc_id").distinct().join(clean, "doc_id", "left_anti").count() == 0
    assert stages["BPE encoding and decoding"](spark, mixed, DATA).where("n_tokens <> size(ids)").count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = lambda name: text(name) + f" {name}"
    docs = [(1, text("a")), (2, near("a")), (1, text("b")), (3, near("b")), (1, near("b")), (2, text("c")), (4, text("d")), (5, ""), (5, text("e")), (None, text("f")), (None, near("a")), (None, None)]
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, spark.createDataFrame(docs, "doc_id long, text string"), DATA)
    assert got.columns == ["doc_id", "text"]
    found = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    of_b = [r for r in found if r[1] and r[1].startswith("b0")]
    assert len(of_b) == 1 and of_b[0] in [(1, text("b")), (1, near("b"))]
    want = [(1, text("a")), (2, text("c")), (4, text("d")), (5, ""), (5, text("e")), (None, text("f")), (None, None)]
    assert [r for r in found if r not in of_b] == sorted(want, key=str)


def test_encoding_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "Some text, with 漢字 and  spaces\n"), (2, ""), (3, None), (4, "x" * 500)], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["BPE encoding and decoding"](spark, docs, DATA)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "decoded_sha256"]
    assert got.where("decoded_sha256 <=> sha2(coalesce(text, ''), 256)").count() == 4
