"""Anonymising keyed tables: stable pseudonyms, blanks, tokens, bracket stripping, keyword redaction."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TOKEN = "REDACTED"


def _literal(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _ranked(firsts: DataFrame, order: Sequence[str], buckets: int = 64) -> DataFrame:
    """``firsts`` with ``rank`` from 1 in ``order``, without one task sorting everything: ranges are counted, then offset."""
    # ranges rest on a sample, so both uses must read one and the same deal
    dealt = cut(firsts.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()))
    inner = dealt.withColumn("_turn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = inner.groupBy(F.col("_part").alias("_of")).agg(F.max("_turn").alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return inner.join(offsets, inner["_part"] == offsets["_of"]).withColumn("rank", F.col("_turn") + F.col("_offset")).drop("_part", "_turn", "_of", "_n", "_offset")


def pseudonyms(df: DataFrame, column: str, order: str, prefix: str, width: int = 4) -> DataFrame:
    """(value, first, pseudonym): numbered by first sight in ``order``, ties by value."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first"))
    ranked = _ranked(firsts, ["first", column])
    text = F.col("rank").cast("string")
    return ranked.select(column, "first", F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)).alias("pseudonym"))


def strip_brackets(c: Column, token: str = TOKEN) -> Column:
    """What stands in square brackets replaced by the token; blank and unclosed ones stay as they are."""
    return F.regexp_replace(c, r"(?U)\[(?=[^\]]*[^\]\s])[^\]]*\]", _literal(f"[{token}]"))


def redact_keywords(c: Column, keywords: Sequence[str], token: str = f"[{TOKEN}]") -> Column:
    """Keywords replaced, case of A to Z aside; longer ones first."""
    for k in sorted(keywords, key=len, reverse=True):
        c = F.regexp_replace(c, f"(?i)\\Q{k}\\E", _literal(token))
    return c


def censor(df: DataFrame, policy: Mapping[str, str], order: str, file_id: str = "", keywords: Sequence[str] = ()) -> DataFrame:
    """``df`` under a policy of column -> filehash, pseudonym, blank, token, brackets or skip."""
    out = df
    for column, action in policy.items():
        if column not in df.columns or action == "skip":
            continue
        c = F.col(column)
        full = c.isNotNull() & (c != "")
        if action == "filehash":
            out = out.withColumn(column, F.when(full, F.lit(hashlib.sha256(file_id.encode()).hexdigest()[:8])).otherwise(c))
        elif action == "pseudonym":
            names = pseudonyms(df.where(full), column, order, "ID").select(F.col(column).alias("_was"), "pseudonym")
            out = out.join(names, out[column] == names["_was"], "left").withColumn(column, F.coalesce("pseudonym", column)).drop("_was", "pseudonym")
        elif action == "blank":
            out = out.withColumn(column, F.lit(""))
        elif action == "token":
            out = out.withColumn(column, F.when(full, F.lit(f"[{TOKEN}]")).otherwise(c))
        elif action == "brackets":
            out = out.withColumn(column, strip_brackets(c))
        else:
            raise ValueError(f"unknown action {action}")
    if keywords:
        texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"} - set(policy)
        out = out.withColumns({c: redact_keywords(F.col(c), keywords) for c in sorted(texts)})
    return out.select(*df.columns)
