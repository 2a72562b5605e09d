"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a hash of the document's id. A bucket that
holds more bytes than a shard may have splits on its next bit; others stay. As a bucket's
bytes are the sum of the bytes of the two it would split into, one aggregation at the
finest depth gives every coarser one, so the directory is found in one pass and not in one
pass per split.

Defined results: null text has 0 bytes, a null id hashes as the empty text. A bucket that
one document fills beyond the limit alone has that document only, or, where documents share
an id or all BITS bits, is cut by running total in order of id and text hash (``part``).
An empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Bits of the hash; the directory is never deeper.
BITS = 60
#: Depths beyond that of evenly filled shards that the first aggregation looks at, and each later one.
SPARE = 6


def id_hash(doc_id: Column) -> Column:
    """The first BITS bits of the MD5 of the id written as text, as a bigint."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, bytes, depth, bucket, part, shard): ``bucket`` holds the leading ``depth`` bits."""
    rows = checkpoint(docs.select("doc_id", id_hash(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.xxhash64("text").alias("tie")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total) / limit))) + SPARE
    done: list[DataFrame] = []
    start = 0
    left = rows
    while start < BITS:
        end = min(BITS, depth)
        cut = F.expr(f"shiftright(h, {BITS - end})")
        cells = left.groupBy(cut.alias("cell")).agg(F.sum("bytes").alias("cell_bytes"), F.count(F.lit(1)).alias("cell_rows"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("bucket", F.expr(f"shiftright(cell, {end} - depth)"))
        sums = checkpoint(levels.groupBy("depth", "bucket").agg(F.sum("cell_bytes").alias("bucket_bytes"), F.sum("cell_rows").alias("bucket_rows")))
        fit = sums.where((F.col("bucket_bytes") <= limit) | (F.col("bucket_rows") == 1))
        # depths at which no bucket fits are left out of the join: all cells share their few buckets
        low = fit.agg(F.min("depth")).first()[0]
        levels = levels.where(F.col("depth") >= (end + 1 if low is None else low))
        # the shallowest bucket that fits, for each cell
        place = levels.join(fit, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("at"))
        placed = checkpoint(left.withColumn("cell", cut).join(place, "cell", "left").select("doc_id", "h", "bytes", "tie", F.col("at.depth").alias("depth"), F.col("at.bucket").alias("bucket")))
        done.append(placed.where("depth is not null"))
        left = placed.where("depth is null").select("doc_id", "h", "bytes", "tie")
        start, depth = end, end + 2 * SPARE
        if left.isEmpty():
            break
    out = done[0].withColumn("part", F.lit(0).cast("long"))
    for more in done[1:]:
        out = out.unionByName(more.withColumn("part", F.lit(0).cast("long")))
    if start == BITS:
        run = Window.partitionBy("h").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
        # half the limit a part at least, so that no part passes the limit unless one row does
        rest = left.withColumn("depth", F.lit(BITS)).withColumn("bucket", F.col("h")).withColumn("part", F.floor(F.coalesce(F.sum("bytes").over(run), F.lit(0)) / max(1, limit // 2)).cast("long"))
        out = out.unionByName(rest)
    name = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("bucket").cast("string"), F.lit(":"), F.col("part").cast("string"))
    return out.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), "bucket", "part", name.alias("shard"))
