"""Integrity and chart analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_at_greatest(value: Column, order: Column) -> Column:
    """The value at the greatest ``order`` among rows that have one (max_by alone would give null)."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def chart(df: DataFrame, x: str, measure: str, y: str | None = None, colour: Column | None = None) -> DataFrame:
    """count, sum, avg, min or max of y by x, and by colour; rows without y count only for count."""
    if measure != "count":
        df = df.where(F.col(y).isNotNull())
    made = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(y), "avg": lambda: F.avg(y), "min": lambda: F.min(y), "max": lambda: F.max(y)}[measure]()
    by = [F.col(x).alias("x"), *([colour.alias("colour")] if colour is not None else [])]
    return df.groupBy(*by).agg(made.alias("value"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").asc()).limit(k)


def folded(df: DataFrame, column: str, k: int, label: str = "Other") -> DataFrame:
    """``df`` with column ``folded``: values outside the k most frequent become one label that no value has.

    The k values are a table of at most k rows, broadcast.
    """
    top = top_values(df.where(F.col(column).isNotNull()), column, k).select(F.col("value").alias("_kept"))
    taken = {r["_kept"] for r in top.collect()}
    name, turn = label, 2
    while name in taken:
        name, turn = f"{label} ({turn})", turn + 1
    return df.join(F.broadcast(top), df[column] == top["_kept"], "left").withColumn("folded", F.when(F.col(column).isNotNull(), F.coalesce("_kept", F.lit(name)))).drop("_kept")


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, filled, total, pct) in one pass."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)])).alias("r")
    pct = F.when(F.col("total") > 0, F.round(F.col("r.filled") * 100.0 / F.col("total"), 2)).otherwise(0.0)
    return one.select(rows, "total").select("r.column_name", "r.filled", "total", pct.alias("pct"))


def coverage(tables: Mapping[str, DataFrame], column: str) -> DataFrame:
    """(value, one count column for each table): rows of each value in each table that has the column."""
    stacked = None
    for name, t in tables.items():
        if column in t.columns:
            part = t.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.lit(name).alias("table"))
            stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("value").pivot("table", list(tables)).count().fillna(0)


def capped(findings: DataFrame, per_rule: int, order: Sequence[str]) -> DataFrame:
    """At most ``per_rule`` findings of each rule, each with its rule's true total."""
    totals = findings.groupBy(F.col("rule").alias("_rule")).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("rule").orderBy(*order)
    kept = findings.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_rule)
    return kept.join(F.broadcast(totals), kept["rule"] == totals["_rule"]).drop("_rule")


def verdict(findings: DataFrame) -> DataFrame:
    """Errors, warnings and notes in all."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("fyi", "notes"))])
