"""Diff and merge of versions of a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import matched_rows


def diff_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str], typed: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(key, kind, cells): added, removed and changed rows, with the cells that changed.

    Rows pair by key, repeated keys in order; without keys by their whole content. A cell
    has changed if its text differs, unless both sides parse to one value.
    """
    common = [c for c in a.columns if c in b.columns]
    keys = list(keys) or common
    pairs = matched_rows(a, b, keys, order)
    cells = []
    for c in common:
        if c in keys:
            continue
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        differs = ~x.eqNullSafe(y)
        if typed and c in typed:
            differs = differs & ~F.coalesce(typed[c](x) == typed[c](y), F.lit(False))
        cells.append(F.when(differs, F.struct(F.lit(c).alias("heading"), x.cast("string").alias("a"), y.cast("string").alias("b"))))
    found = F.filter(F.array(*cells), lambda s: s.isNotNull()) if cells else F.array().cast("array<struct<heading:string,a:string,b:string>>")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    key = F.array(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).cast("string") for k in keys])
    out = pairs.select(key.alias("key"), kind.alias("kind"), found.alias("cells"))
    return out.where((F.col("kind") != "changed") | (F.size("cells") > 0)).withColumn("cells", F.when(F.col("kind") == "changed", F.col("cells")))


def diff_cells(rows: DataFrame) -> DataFrame:
    """(key, heading, a, b) of every changed cell."""
    return rows.where("kind = 'changed'").select("key", F.explode("cells").alias("c")).select("key", "c.heading", "c.a", "c.b")


def stacked(versions: Sequence[DataFrame], order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """All versions with ``file_idx`` and ``row``, and the union of their headings in order of first sight."""
    headings: list[str] = []
    for v in versions:
        headings += [c for c in v.columns if c not in headings]
    out = None
    for i, v in enumerate(versions):
        part = v.select(F.lit(i).alias("file_idx"), F.struct(*order).alias("row"), *[F.col(c) if c in v.columns else F.lit(None).cast(next(w.schema[c].dataType for w in versions if c in w.columns)).alias(c) for c in headings])
        out = part if out is None else out.unionByName(part)
    return out, headings


def merge(versions: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: every cell from the last version that carries its heading.

    A blank in a later version overwrites; a heading it lacks does not. Aggregated by key
    with partial combination; rows keep no order (see ``first_seen`` for that of first sight).
    """
    rows, headings = stacked(versions, order)
    carries = {c: [i for i, v in enumerate(versions) if c in v.columns] for c in headings}
    at = F.struct("file_idx", "row")
    cells = [F.max(F.when(F.col("file_idx").isin(carries[c]), F.struct(at.alias("at"), F.col(c).alias("value"))))["value"].alias(c) for c in headings if c not in keys]
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), *cells).select(*headings, "first_seen")


def revisions(versions: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(key columns, file_idx, heading, was, now): cells that a later version changed, null-safe."""
    rows, headings = stacked(versions, order)
    carries = {c: [i for i, v in enumerate(versions) if c in v.columns] for c in headings}
    w = Window.partitionBy(*keys).orderBy("file_idx", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    notes = []
    for c in headings:
        if c in keys:
            continue
        held = F.when(F.col("file_idx").isin(carries[c]), F.struct(F.col(c).alias("value")))
        out = out.withColumn(f"_was_{c}", F.last(held, ignorenulls=True).over(w))
        was = F.col(f"_was_{c}")
        notes.append(F.when(F.col("file_idx").isin(carries[c]) & was.isNotNull() & ~was["value"].eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("heading"), was["value"].cast("string").alias("was"), F.col(c).cast("string").alias("now"))))
    return out.select(*keys, "file_idx", F.explode(F.filter(F.array(*notes), lambda n: n.isNotNull())).alias("n")).select(*keys, "file_idx", "n.*")


def identity_dedup(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row of each id or value hash, the first in ``order``."""
    keep = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.col(column).alias("_id_of")).agg(keep.alias("r")).select("r.*")
