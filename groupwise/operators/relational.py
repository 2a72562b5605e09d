"""Joins, dedup, windows and set operations over keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an ``at`` filter beyond which a semi-join takes the place of IN.
IN_LIMIT = 1000


def null_safe_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "left") -> DataFrame:
    """Join in which blank keys, held as null, equal each other."""
    on: Column = F.lit(True)
    for a, b in pairs:
        on = on & left[a].eqNullSafe(right[b])
    return left.join(right, on, how)


def band_join(points: DataFrame, bands: DataFrame, keys: Sequence[tuple[str, str]], at: str, top: str, base: str, how: str = "inner", width: float | None = None) -> DataFrame:
    """Rows whose keys are equal and whose ``at`` lies in [top, base).

    The equality hashes rows to one key's bands. Where one key holds very many bands, ``width``
    cuts depth into cells, so that the join hashes on (key, cell) too and each point meets only
    the bands over its own cell.
    """
    on: Column = F.lit(True)
    for a, b in keys:
        on = on & (points[a] == bands[b])
    inside = (points[at] >= bands[top]) & (points[at] < bands[base])
    if width is None:
        return points.join(bands, on & inside, how)
    cells = F.sequence(F.floor(bands[top] / width), F.floor(bands[base] / width))
    dealt = bands.where(bands[top] <= bands[base]).withColumn("_cell_b", F.explode(cells))
    here = points.withColumn("_cell_p", F.floor(points[at] / width))
    on = here["_cell_p"] == dealt["_cell_b"]
    for a, b in keys:
        on = on & (here[a] == dealt[b])
    return here.join(dealt, on & (here[at] >= dealt[top]) & (here[at] < dealt[base]), how).drop("_cell_p", "_cell_b")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows with keys, all present, that no parent row has."""
    on: Column = F.lit(True)
    full: Column = F.lit(True)
    for c, p in keys:
        on = on & (child[c] == parent[p])
        full = full & child[c].isNotNull()
    return child.where(full).join(parent.select(*[p for _, p in keys]), on, "left_anti")


def at(tables: Mapping[str, DataFrame], column: str, values: Sequence | DataFrame) -> dict[str, DataFrame]:
    """Each table's rows whose ``column`` is among the values; tables without it pass whole.

    An error if no table has the column. A table of values, or a long list, is a semi-join.
    """
    if not any(column in t.columns for t in tables.values()):
        raise ValueError(f"no group has column {column}")
    if not isinstance(values, DataFrame) and len(values) > IN_LIMIT:
        spark = next(iter(tables.values())).sparkSession
        values = spark.createDataFrame([(v,) for v in values], [column])
    out = {}
    for name, t in tables.items():
        if column not in t.columns:
            out[name] = t
        elif isinstance(values, DataFrame):
            out[name] = t.join(values.select(F.col(values.columns[0]).alias("_at")), F.col(column) == F.col("_at"), "left_semi")
        else:
            out[name] = t.where(F.col(column).isin(list(values))) if len(values) else t.where(F.lit(False))
    return out


def matched_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of two versions paired by key, repeated keys in order: struct columns ``a`` and ``b``, null where unpaired."""
    pair = Window.partitionBy(*keys).orderBy(*order)

    def turn(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("_turn", F.row_number().over(pair)).select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("_turn").alias(f"_{name}_turn"), F.struct(*df.columns).alias(name))

    left, right = turn(a, "a"), turn(b, "b")
    on = left["_a_turn"] == right["_b_turn"]
    for k in keys:
        on = on & left[f"_a_{k}"].eqNullSafe(right[f"_b_{k}"])
    return left.join(right, on, "full_outer").select("a", "b")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key another row has too. Counted before it meets the rows, so a hot key is no hot task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("key_rows"))
    on: Column = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(counts[f"_{k}"])
    return df.join(counts, on).drop(*[f"_{k}" for k in keys])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name, missing ones null, in order of first sight."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def except_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not the other, with multiplicity; column ``side`` says which."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def regressions(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is below the greatest of the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.max(value).over(w)).where(F.col(value) < F.col("before"))


def natural_key(c: Column) -> Column:
    """A sort key that orders digit runs by number: each gets its length, without leading zeros, in front of it."""

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), piece), "")


def key_sorted(df: DataFrame, numeric: Sequence[str], natural: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rows by exact decimal value, then natural order, blanks last, ties by ``tie``."""
    by = [F.col(c).cast("decimal(38,18)").asc_nulls_last() for c in numeric] + [natural_key(F.col(c)).asc_nulls_last() for c in natural]
    return df.orderBy(*by, *tie)


def point_segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment, as in a distance join with an alignment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / size))).otherwise(0.0)
    return F.sqrt(F.pow(x - x1 - t * dx, 2) + F.pow(y - y1 - t * dy, 2))


def resolved_links(rows: DataFrame, link: str, delimiter: str, targets: Mapping[str, tuple[DataFrame, Sequence[str]]], row_id: str) -> DataFrame:
    """(row id, link, n): how many rows each record link ``GROUP|k1|k2..`` finds among the first columns of its group."""
    parts = F.split(F.col(link), f"\\Q{delimiter}\\E")
    links = rows.where(F.col(link).isNotNull() & (F.col(link) != "")).select(F.col(row_id).alias("row_id"), F.col(link).alias("link"), parts[0].alias("target"), F.slice(parts, 2, 1_000).alias("wanted"))
    out = None
    for name, (df, columns) in targets.items():
        mine = links.where(F.col("target") == name)
        most = len(columns)
        prefix = F.array(*[F.col(c).cast("string") for c in columns])
        # one entry for each length that links use
        keys = df.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), prefix.alias("all")).select(F.slice("all", F.lit(1), F.col("k")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        found = mine.join(keys, mine["wanted"] == keys["key"], "left").select("row_id", "link", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        out = found if out is None else out.unionByName(found)
    other = links.where(~F.col("target").isin(list(targets))).select("row_id", "link", F.lit(0).cast("long").alias("n"))
    return other if out is None else out.unionByName(other)
