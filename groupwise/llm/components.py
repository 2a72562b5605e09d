"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, stored


#: Steps of pointer jumping in one plan; they cover chains of 2 ** JUMPS ids.
JUMPS = 3
#: Links that one task labels at once; where there are more, joins contract them until there aren't.
AT_ONCE = 1 << 18
#: Types whose values Arrow orders as Spark does; ids of these, or structs of these, can be labelled in one task.
ORDERED = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(), T.DateType())


def _jumped(hook: DataFrame, steps: int = JUMPS) -> DataFrame:
    """Each x with the end of its chain x -> y -> .., as far as 2 ** steps steps go."""
    for _ in range(steps):
        on = hook.select(F.col("x").alias("y"), F.col("y").alias("beyond"))
        hook = hook.join(on.hint("merge"), "y", "left").select("x", F.coalesce("beyond", "y").alias("y"))
    return hook


def hooks(links: DataFrame) -> DataFrame:
    """(x, y): every id of links (a, b) that has a smaller neighbour, with its smallest. Combined before it is shuffled, so a hub is no hot key."""
    return links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).groupBy("x").agg(F.min("y").alias("y"))


def _ranks(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each id's rank among the different ones, from 0, and where an id of each rank stands."""
    fields = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    table = pa.table({str(k): x for k, x in enumerate(fields)})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start")
    new = np.arange(len(ids)) == 0
    for column in table.take(order).columns:
        x = column.combine_chunks()
        other = pc.fill_null(pc.not_equal(x[1:], x[:-1]), False)
        new[1:] |= pc.or_(other, pc.xor(x[1:].is_null(), x[:-1].is_null())).to_numpy(zero_copy_only=False)
    at = order.to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[at] = np.cumsum(new) - 1
    return rank, at[new]


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of 0 .. n - 1, the least that links (a, b) reach from it."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := label[label]) != label).any():
            label = up


def _at_once(links: DataFrame) -> DataFrame:
    """(x, y): every id of at most AT_ONCE links but each component's least, with that least id; one task, one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held])
        rank, at = _ranks(ids)
        least = least_reachable(*np.split(rank, 2), len(at))
        x = np.flatnonzero(least != np.arange(len(at)))
        found = pa.RecordBatch.from_arrays([ids.take(pa.array(at[x])), ids.take(pa.array(at[least[x]]))], names=["x", "y"])
        yield from (found.slice(k, 10_000) for k in range(0, len(x), 10_000))

    kind = links.schema["a"].dataType
    return links.select("a", "b").coalesce(1).mapInArrow(run, T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in links (a, b) but each component's least, that least id.

    Each round hooks every id with a smaller neighbour onto its smallest, contracts, and
    keeps the links between different contracted ids; rounds grow with the logarithm of a
    component's size. Once AT_ONCE links or fewer are left, one task does the rest: some
    sixteen exchanges a round would cost the driver more memory (plans, a thread for each
    exchange) than so few links do. Joins are sort-merge by hint: a broadcast side would stay
    in the driver's memory for each of the many small jobs. Ids may be of any type with an order.
    """
    with scratch(links.sparkSession, "components") as folder:
        return stored(_components(links, folder), "components")


def _components(links: DataFrame, folder: str) -> DataFrame:
    keep = lambda df: stored(df, within=folder)
    links = keep(links.select("a", "b").where("a <> b").distinct())
    kinds = [links.schema[x].dataType for x in "ab"]
    parts = [f.dataType for f in kinds[0].fields] if isinstance(kinds[0], T.StructType) else kinds[:1]
    orderly = kinds[0] == kinds[1] and parts and all(p in ORDERED for p in parts)
    label: DataFrame | None = None
    left = links.count()
    while label is None or left:
        few = orderly and left <= AT_ONCE
        hook = keep(_at_once(links) if few else hooks(links))
        while not few:
            hook = keep(_jumped(hook))
            on = hook.select(F.col("x").alias("y"))
            if hook.join(on.hint("merge"), "y", "left_semi").isEmpty():
                break
        fresh = hook.select(F.col("x").alias("id"), F.col("y").alias("component"))
        if few:
            left = 0
        else:
            for end in ("a", "b"):
                to = fresh.select(F.col("id").alias(end), F.col("component").alias("to"))
                links = links.join(to.hint("merge"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            links = keep(links.where("a <> b").distinct())
            left = links.count()
        if label is None:
            label = fresh
        else:
            # an id that is hooked now was the least of its component, so no label had it
            at = hook.select(F.col("x").alias("component"), F.col("y").alias("next"))
            moved = label.join(at.hint("merge"), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
            label = moved.unionByName(fresh)
    return label
