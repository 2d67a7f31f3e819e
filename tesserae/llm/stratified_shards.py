"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source. Row r of n in its source gets the rank (r + 1/2) / n, and the order
of all ranks interleaves the sources in proportion all the way. Cut into equal runs, each shard has the mixture of the whole.

Neither a source nor the whole order is ever sorted in one task: the hash and the rank are uniform, so equal stretches of
them hold about equally many rows. Stretches are numbered on their own, and a small table of their counts gives the offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import stored

SHARDS = 16
ROWS_PER_STRETCH = 100_000


def _numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """Add `out`, the place of each row in the order (key, stretch, order) from 0 within the key."""
    window = Window.partitionBy(*keys, "stretch").orderBy(*order)
    counts = df.groupBy(*keys, "stretch").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("stretch") if keys else Window.orderBy("stretch")
    before = F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "stretch", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = df.withColumn("__inside", F.row_number().over(window) - 1)
    return inside.join(offsets, [*keys, "stretch"]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside", "stretch")


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = 1, rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """`(doc_id, size, text_crc32, source, shard, slot)` for every row of `docs(doc_id, text, source)`.

    Shards differ by one row at most, `slot` counts from 0 without gaps in the order of the ranks. `size` is the bytes of the
    text plus one; a null text has size 1 and the checksum of the empty string. Rows without a source are a source of
    their own. Rows alike in id and text are interchangeable. Fewer rows than shards leave shards empty.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"),
    )
    rows = stored(rows.withColumn("hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"))), "rows")
    total = rows.count()
    stretches = max(1, math.ceil(total / rows_per_stretch))
    start = F.conv(F.substring("hash", 1, 7), 16, 10).cast("long")  # 28 bits
    ranked = _numbered(
        rows.withColumn("stretch", F.floor(start * stretches / F.lit(1 << 28))), ["stratum"], ["hash", F.col("doc_id").asc_nulls_first(), "size"], "r"
    )
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    placed = ranked.join(sizes, "stratum").withColumn("rank", (F.col("r") + 0.5) / F.col("n"))
    placed = _numbered(placed.withColumn("stretch", F.floor(F.col("rank") * stretches)), [], ["rank", "stratum"], "place")
    shard = F.floor(F.col("place") * shards / F.lit(max(total, 1)))
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards))
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - first).cast("long").alias("slot")
    )
