"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprint, jaccard, language, mixing, pii, quality, sharding, tokenfile
from .common import checkpoint, crc_mod, scratch, stored, table

try:
    import public_tokenizers
except ImportError:  # the files may be anywhere: the operators take a path
    BPE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
else:
    BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")

#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpoint(quality.text_statistics(table(spark, sf_dir, "documents")))
    model = quality.fit(quality.training_rows(stats, table(spark, sf_dir, "labels")))
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    scored = stats.select("doc_id", held_out.alias("held_out"), quality.scorer(model)("stats").alias("score"))
    return scored.withColumn("predicted", quality.passing(F.col("score")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_PATH)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), pii.default_field())
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark, "token-ids") as out:
        tokenfile.write(table(spark, sf_dir, "documents"), out, BPE_PATH)
        return stored(tokenfile.digests(spark, out), "digests")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": f"""
            WITH d AS (
                SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
                FROM documents),
            l AS (SELECT d.*, k AS depth, h >> (60 - k) AS bucket FROM d, range(0, 41) t(k)),
            s AS (SELECT depth, bucket FROM l GROUP BY depth, bucket HAVING sum(bytes) <= {SHARD_BYTES} OR count(*) = 1),
            p AS (SELECT doc_id, bytes, h, min(l.depth) AS depth FROM l JOIN s USING (depth, bucket) GROUP BY doc_id, bytes, h)
            SELECT doc_id, bytes, CAST(depth AS INTEGER) AS depth, h >> (60 - depth) AS bucket, CAST(0 AS BIGINT) AS part,
                   depth || ':' || (h >> (60 - depth)) || ':0' AS shard
            FROM p""",
    }
