"""Approximate nearest neighbours by multi-index hashing, largest cosine first.

Codes: each 64 bits are signs after a rotation learned on a bounded sample (SAMPLE vectors
of least hash): principal directions, turned by iterative quantisation from a start of
their own, WORDS such words together. Index: candidates are dealt by hash into blocks of
about BLOCK rows, every row in exactly one; in a block each SUB-bit substring of the codes
has its own bucket table. Search: a query's codes within Hamming RADIUS agree with it in
some substring within RADIUS // substrings bits (pigeonhole), so probing all such buckets
of each substring retrieves every code within the radius; where that would probe more
buckets than the block has rows, the block's codes are scanned instead, which retrieves the
same. Retrieved rows are reranked by cosine in double precision.

The radius is learned: RECALL of the true neighbours of the sample's own queries lie
within it. Neighbours in the whole table are nearer than those in the sample, so it errs
to the wide side.

Queries meet blocks by key, both cut into parts of bounded size; each pair of parts returns
its best k for each query, and a window keeps the best k of these.
A query with fewer than k rows within the radius over all blocks searches again with the
widest radius, which every code is within, so that all candidates are reranked for it.

Defined results: vectors null, zero, of another length than most, or holding null or
non-finite components take no part, components of any finite size do; ties go to the smaller
id; one id in several rows is one candidate for each row; fewer than k candidates give fewer
rows; an empty table, none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 6000
WORDS = 4
SUB = 16
BLOCK = 16_384
QUERIES = 2048
RECALL = 0.98


def rotations(sample: np.ndarray, seed: int = 0, turns: int = 15) -> list[np.ndarray]:
    """WORDS matrices of (dimensions, up to 64 bits), by principal directions and iterative quantisation."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    bits = min(64, d)
    _, vectors = np.linalg.eigh(sample.T @ sample)
    main = vectors[:, ::-1][:, :bits]
    low = sample @ main
    out = []
    for _ in range(WORDS):
        r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(turns):
            u, _, v = np.linalg.svd(low.T @ np.where(low @ r >= 0, 1.0, -1.0))
            r = u @ v
        out.append(main @ r)
    return out


class Coder:
    def __init__(self, turned: list[np.ndarray]):
        self.turned = turned

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of uint64 words."""
        out = np.zeros((len(unit), len(self.turned)), np.uint64)
        for k, r in enumerate(self.turned):
            bits = np.zeros((len(unit), 64), np.uint8)
            bits[:, : r.shape[1]] = unit @ r >= 0
            out[:, k] = np.packbits(bits, axis=1).view(">u8").ravel()
        return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` from every row of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def _masks(bits: int, within: int) -> list[int]:
    """All differences of up to ``within`` of ``bits`` bits."""
    masks = [0]
    ring = {0}
    for _ in range(within):
        ring = {m | 1 << b for m in ring for b in range(bits) if not m >> b & 1}
        masks += sorted(ring)
    return masks


class Index:
    """Bucket tables over every substring of a block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.subs = np.ascontiguousarray(codes).view("<u2")
        self.order = np.argsort(self.subs, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.subs, self.order, 0)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """Rows within the radius, for each query."""
        m = self.subs.shape[1]
        each = min(SUB, radius // m)
        probes = m * sum(math.comb(SUB, i) for i in range(each + 1))
        if probes >= len(self.codes):
            for at in range(0, len(queries), 256):
                yield from map(np.flatnonzero, hamming(queries[at : at + 256], self.codes) <= radius)
            return
        masks = np.array(_masks(SUB, each), np.uint16)
        for q, sub in zip(queries, np.ascontiguousarray(queries).view("<u2")):
            hits = [np.empty(0, np.int64)]
            for j in range(m):
                keys = sub[j] ^ masks
                first, last = np.searchsorted(self.sorted[:, j], keys), np.searchsorted(self.sorted[:, j], keys, "right")
                hits += [self.order[a:b, j] for a, b in zip(first.tolist(), last.tolist()) if a < b]
            rows = np.unique(np.concatenate(hits))
            yield rows[hamming(q[None], self.codes[rows])[0] <= radius]


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, each scaled by a power of two so that no square over- or underflows, and their lengths.

    Such a factor changes no digit, and a cosine of scaled vectors is that of the originals.
    """
    x = np.vstack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 1))
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    size = np.sqrt((x * x).sum(1))
    return x, size


def learn(sample: np.ndarray, k: int) -> tuple[Coder, int]:
    """Coder and radius from unit vectors."""
    coder = Coder(rotations(sample))
    codes = coder(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 400))
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    distance = np.take_along_axis(hamming(codes[asked], codes), best, 1)
    return coder, int(np.quantile(distance, RECALL, method="higher")) if len(sample) > 1 else 64 * WORDS


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding)."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id is not null").where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == lengths["d"])
    n = lengths["n"]
    share = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(share < SAMPLE / n).orderBy("vec_id").limit(2 * SAMPLE).toPandas()
    if sample.empty:
        sample = rows.limit(1).toPandas()
    x, size = _unit(sample["embedding"])
    coder, radius = learn(x / size[:, None], k)

    blocks = max(1, math.ceil(n / BLOCK))
    asked = rows.where(F.expr("vec_id is not null") & is_query)
    salt = F.xxhash64(F.lit("block"), "vec_id", F.xxhash64("embedding"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(asked: DataFrame, n_asked: int, radius: int) -> DataFrame:
        groups = max(1, math.ceil(n_asked / QUERIES))
        part = asked.withColumn("qb", F.pmod(salt, F.lit(groups)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        block = rows.withColumn("cb", F.pmod(salt, F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(queries) and len(candidates):
                q, q_size = _unit(queries["embedding"])
                c, c_size = _unit(candidates["embedding"])
                ids = candidates["vec_id"].to_numpy()
                if radius >= 64 * WORDS:
                    found = (np.arange(len(c)) for _ in q)
                else:
                    found = Index(coder(c / c_size[:, None])).within(coder(q / q_size[:, None]), radius)
                for i, (own, hit) in enumerate(zip(queries["vec_id"].tolist(), found)):
                    hit = hit[ids[hit] != own]
                    score = (c[hit] * q[i]).sum(1) / (c_size[hit] * q_size[i])
                    top = np.lexsort((ids[hit], -score))[:k]
                    out += [(own, int(ids[hit[b]]), float(score[b])) for b in top]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        met = part.groupBy("cb", "qb").cogroup(block.groupBy("cb", "qb")).applyInPandas(search, "query_id long, vec_id long, score double")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = best(asked, asked.count(), radius)
    if radius >= 64 * WORDS:
        return near
    near = stored(near, "nearest")
    full = near.where(F.col("rank") == k).select(F.col("query_id").alias("full_id"))
    short = stored(asked.join(full, asked["vec_id"] == full["full_id"], "left_anti"), "short")
    n_short = short.count()
    if not n_short:
        return near
    wide = best(short, n_short, 64 * WORDS)
    return near.join(full, near["query_id"] == full["full_id"], "left_semi").unionByName(wide)
