"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its words, weighted by how often they occur. For each of SAMPLES
hash functions, every term draws r and c from Gamma(2, 1) and b uniform, all from a hash of
the term; with t = floor(ln w / r + b) its rank is ln c - r (t - b + 1), and the least rank
gives the sample (term, t). Two documents share a sample with the probability of their
generalised Jaccard similarity, sum of minima over sum of maxima of weights.

Rank and sample are packed into one bigint, so a document's samples are plain minima that
hash aggregation combines without sorting. Texts move once, dealt by blocks of BLOCK ids;
words, counts and minima stay in that partitioning. The document after the last of a block
is the first of the next block that has any, found from block numbers alone.

Defined results: null text counts as empty; a document without words has samples 0, alike
those of others without words (likeness 1) and unlike all else; null ids come first; rows
with one id are in order of a hash of their text; a lone document follows itself; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SAMPLES = 32
BLOCK = 64
#: Keys that one task puts in order while looking for successors.
FAN = 4096


def successors(keys: DataFrame) -> DataFrame:
    """(key, next_key) of a table of distinct bigints ``key``; after the last comes the first."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    linked = _linked(keys, low, high) if low is not None else keys.withColumn("next_key", F.col("key"))
    return linked.select("key", F.coalesce("next_key", F.lit(low).cast("long")).alias("next_key"))


def _linked(keys: DataFrame, low: int, high: int) -> DataFrame:
    if high - low < FAN:
        return keys.select("key", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy("key")).alias("next_key"))
    up = F.floor(F.col("key") / F.lit(FAN)).cast("long")
    inner = keys.withColumn("up", up).withColumn("lead", F.lead("key").over(Window.partitionBy("up").orderBy("key")))
    firsts = keys.groupBy(up.alias("key")).agg(F.min("key").alias("first"))
    above = _linked(firsts.select("key"), low // FAN, high // FAN).select(F.col("key").alias("up"), F.col("next_key").alias("up_next"))
    across = above.join(firsts.select(F.col("key").alias("up_next"), "first"), "up_next").select("up", "first")
    return inner.join(across, "up", "left").select("key", F.coalesce("lead", "first").alias("next_key"))


def _samples(weight: str, alias: str) -> list[Column]:
    out = []
    for k in range(SAMPLES):
        h, g = f"xxhash64(term, {k})", f"xxhash64(term, {k + 1_000})"
        part = lambda x, shift: f"(((shiftrightunsigned({x}, {shift}) & 2097151) + 0.5D) / 2097152D)"
        r = f"(-ln({part(h, 0)} * {part(h, 21)}))"
        b = part(h, 42)
        c = f"ln(-ln({part(g, 0)} * {part(g, 21)}))"
        t = f"floor({weight} / {r} + {b})"
        rank = f"cast(({c} - {r} * ({t} - {b} + 1D) + 64D) * 16777216D as bigint)"
        out.append(F.expr(f"min(shiftleft({rank}, 32) | ((term ^ ({t} * 2654435761)) & 4294967295))").alias(f"{alias}{k}"))
    return out


def _written(alias: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(F.col(f"{alias}{k}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for k in range(SAMPLES)])


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that two fingerprints have in common."""
    same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(SAMPLES)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(SAMPLES))


def fingerprints(texts: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Fingerprints of the text columns ``names`` of each row, as columns of these names.

    ``key`` identifies a row; if ``texts`` is partitioned by columns among ``key``, nothing is shuffled.
    """
    versions = F.explode(F.array(*[F.struct(F.lit(i).alias("version"), F.col(n).alias("text")) for i, n in enumerate(names)])).alias("v")
    words = texts.select(*key, versions).select(*key, F.col("v.version").alias("version"), F.explode(F.split("v.text", r"[\x20\x09-\x0D]+")).alias("word"))
    counted = [F.sum((F.col("version") == i).cast("int")).alias(f"n{i}") for i in range(len(names))]
    # empty words mark documents without any; they have weight 0 and so no rank
    terms = words.withColumn("term", F.when(F.col("word") != "", F.xxhash64("word"))).groupBy(*key, "term").agg(*counted)
    weights = terms.select(*key, "term", *[F.ln(F.col(f"n{i}").cast("double")).alias(f"w{i}") for i in range(len(names))])
    drawn = weights.groupBy(*key).agg(*[s for i in range(len(names)) for s in _samples(f"w{i}", f"s{i}_")])
    return drawn.select(*key, *[_written(f"s{i}_").alias(n) for i, n in enumerate(names)])


NULL_ID = -(1 << 63)


def with_next(docs: DataFrame) -> DataFrame:
    """(id, g, i, next_g, next_i, text, next_text), partitioned by g: each document and the one after it.

    Both uses of the dealt texts read the same columns of them, so they share one exchange.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    block = F.floor(key / F.lit(BLOCK)).cast("long")
    rows = docs.select(block.alias("g"), key.alias("id"), F.coalesce("text", F.lit("")).alias("text")).repartition("g")
    order = Window.partitionBy("g").orderBy("id", F.xxhash64("text"))
    inner = rows.select("g", "id", "text", F.row_number().over(order).alias("i"), F.lead("text").over(order).alias("lead"))
    blocks = checkpoint(docs.select(block.alias("key")).distinct())
    firsts = rows.groupBy("g").agg(F.min_by("text", F.struct("id", F.xxhash64("text"))).alias("first_text"))
    links = successors(blocks).select(F.col("key").alias("block"), "next_key")
    across = links.join(firsts, links["next_key"] == firsts["g"]).select(F.col("block").alias("g"), "next_key", "first_text")
    both = inner.join(across, "g")
    last = F.col("lead").isNull()
    return both.select(
        "id", "g", "i", F.when(last, F.col("next_key")).otherwise(F.col("g")).alias("next_g"), F.when(last, F.lit(1)).otherwise(F.col("i") + 1).alias("next_i"),
        "text", F.coalesce("lead", "first_text").alias("next_text"),
    )


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to each other and the next document's.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next document.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # words are grouped by place alone, so that their table stays narrow; the rest meets the samples by place
    drawn = fingerprints(rows, ["g", "i"], ["text", "edited"])
    about = rows.select(F.col("g").alias("ag"), F.col("i").alias("ai"), F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "next_g", "next_i", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    found = checkpoint(drawn.join(about.hint("merge"), (F.col("g") == F.col("ag")) & (F.col("i") == F.col("ai"))).drop("ag", "ai"))
    after = found.select(F.col("g").alias("next_g"), F.col("i").alias("next_i"), F.col("text").alias("next_fingerprint"))
    out = found.join(after, ["next_g", "next_i"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next_fingerprint")).alias("near_next"),
    )
