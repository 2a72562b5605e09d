"""Mixing sources to target weights by balanced (cube-method) sampling.

Every source gets a target number of words. A document's expected number of copies is
target / source size; the whole part is taken outright, the fraction is an inclusion
probability. The cube method moves these probabilities through the null space of two
constraints per source (number of documents, number of words) until they are 0 or 1:

* flight: within a block of one source, three undecided documents at a time move along the
  one direction that keeps both totals, until one of them is decided. At most two documents
  of a block stay undecided; they meet those of other blocks at the next level, so a source
  of n documents needs about log(n) / log(BLOCK / 2) levels and no task sees more than one
  block;
* landing: the last two documents of a source or fewer are drawn jointly, with their own
  probabilities, by the one-parameter linear programme that keeps the expected miss in
  words least.

Defined results: null text has size 0; a null source is a source of its own, last in order;
repeated rows are units of their own; an empty table gives an empty result; columns that
clash with the working names are not read. Draws come from a seeded counter generator keyed
by source, level and block, and blocks are ordered by id and size, so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, word_count

#: Undecided documents that one task balances at a time.
BLOCK = 4096
EPS = 1e-9


def source_targets(units: DataFrame, weights: Sequence[float], ratio: float, cap: float) -> DataFrame:
    """Per source: n, source_size, target.

    Sources take the weights in turn, by code point, null last. The targets share ``ratio``
    times all sizes by weight; none passes ``cap`` times its source's size, the excess going
    to the others by weight. Water-filling in closed form: with sources in order of
    cap / weight, the level is the first at which the next source stays under its cap.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    s = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", turn[F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))])
    s = s.withColumn("cap", cap * F.col("source_size"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (ratio * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    s = s.withColumn("level", F.coalesce(F.max(free).over(total), F.lit(float("inf"))))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "n", target.alias("target"))


def _uniform(key: str, n: int) -> Iterator[float]:
    return iter(np.random.Generator(np.random.Philox(key=zlib.crc32(key.encode()))).random(n).tolist())


def flight(pi: list[float], size: list[float], draw: Iterator[float]) -> list[float]:
    """Probabilities after the flight: all 0 or 1 but for two at most; sums of pi and of pi * size kept."""
    pi = list(pi)
    waiting = iter([i for i, p in enumerate(pi) if EPS < p < 1 - EPS])
    active: list[int] = []
    while True:
        while len(active) < 3:
            i = next(waiting, None)
            if i is None:
                return [round(p) if p <= EPS or p >= 1 - EPS else p for p in pi]
            active.append(i)
        a, b, c = (size[i] for i in active)
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, x in zip(active, u):
            if x > 0:
                up, down = min(up, (1 - pi[i]) / x), min(down, pi[i] / x)
            elif x < 0:
                up, down = min(up, pi[i] / -x), min(down, (1 - pi[i]) / -x)
        step = up if next(draw) * (up + down) < down else -down
        for i, x in zip(active, u):
            pi[i] += step * x
        active = [i for i in active if EPS < pi[i] < 1 - EPS]


def landing(pi: list[float], size: list[float], draw: Iterator[float]) -> list[float]:
    """Decide the last two or fewer documents, each with its own probability."""
    pi = [round(p) if p <= EPS or p >= 1 - EPS else p for p in pi]
    left = [i for i, p in enumerate(pi) if 0 < p < 1]
    if len(left) == 1:
        pi[left[0]] = float(next(draw) < pi[left[0]])
    elif left:
        i, j = left
        mean = pi[i] * size[i] + pi[j] * size[j]
        miss = lambda x, y: abs(x * size[i] + y * size[j] - mean)
        # P(both) = t fixes the other three; the expected miss is linear in t
        slope = miss(1, 1) + miss(0, 0) - miss(1, 0) - miss(0, 1)
        t = max(0.0, pi[i] + pi[j] - 1) if slope >= 0 else min(pi[i], pi[j])
        x = next(draw)
        for (a, b), p in (((1, 1), t), ((1, 0), pi[i] - t), ((0, 1), pi[j] - t), ((0, 0), 2.0)):
            if x < p:
                pi[i], pi[j] = float(a), float(b)
                break
            x -= p
    return pi


def cube_sample(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Turn column ``pi`` of (source, doc_id, size, n, pi, ...) into 0 or 1, balanced per source."""
    most = units.agg(F.max("n")).first()[0] or 0
    fan = block // 2
    level, cells = 0, max(1, math.ceil(most / block))
    columns = units.columns
    work = units.withColumn("blk", F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1), F.ceil(F.col("n") / block))).cast("long"))
    done: list[DataFrame] = []
    while True:
        last, at = cells == 1, level

        def move(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "size"], kind="stable", na_position="first").reset_index(drop=True)
            draw = _uniform(f"{seed}|{at}|{pdf['source'][0]}|{pdf['blk'][0]}", len(pdf) + 4)
            pi = flight(pdf["pi"].tolist(), pdf["size"].astype(float).tolist(), draw)
            if last:
                pi = landing(pi, pdf["size"].astype(float).tolist(), draw)
            return pdf.assign(pi=pi)

        moved = checkpoint(work.groupBy("source", "blk").applyInPandas(move, work.schema))
        if last:
            done.append(moved)
            break
        undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(moved.where(~undecided))
        work = moved.where(undecided).withColumn("blk", F.floor(F.col("blk") / fan).cast("long"))
        level, cells = level + 1, math.ceil(cells / fan)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``."""
    units = checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(units, weights, ratio, cap).withColumnRenamed("source", "target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    units = checkpoint(units.withColumn("whole", F.floor(rate + EPS).cast("long")).withColumn("pi", F.greatest(F.lit(0.0), rate - F.col("whole"))))
    drawn = cube_sample(units, seed)
    return drawn.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("pi").cast("long")).alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns unchanged.

    Rows alike in id, source and size share what the mix takes of them: each gets the whole
    part of the mean, the first ones in order of text one more.
    """
    key = ("doc_id", "source", "size")
    took = mix(docs, **options).groupBy(*key).agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    took = took.select(*[F.col(c).alias(f"mix_{c}") for c in took.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col("text")).alias("size"))
    same: Column = F.lit(True)
    for c in key:
        mine = F.col("size") if c == "size" else F.col(f"row.{c}")
        same = same & mine.eqNullSafe(F.col(f"mix_{c}"))
    both = rows.join(took.where("mix_all > 0"), same)
    alone = both.where("mix_rows = 1").withColumn("copies", F.col("mix_all"))
    turn = Window.partitionBy("mix_doc_id", "mix_source", "mix_size").orderBy(F.col("row.text"))
    shared = both.where("mix_rows > 1").withColumn("copies", F.floor(F.col("mix_all") / F.col("mix_rows")) + (F.row_number().over(turn) <= F.col("mix_all") % F.col("mix_rows")).cast("long"))
    out = alone.unionByName(shared).where("copies > 0")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
