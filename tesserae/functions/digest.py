"""Digests of identifier sets and of ordered geometry.

A set digest hashes, in this order: the length-prefixed domain, a two-byte version, the length-prefixed region
name, the eight-byte count, and every identifier in ascending order as eight big-endian bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAIN = "tesserae/instance-set"
VERSION = 1


def u64_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("long"))), 16, "0")


def _framed_hex(text: Column) -> Column:
    raw = F.encode(text, "utf-8")
    return F.concat(u64_hex(F.octet_length(raw)), F.lower(F.hex(raw)))


def set_header_hex(region: Column, count: Column, domain: str = DOMAIN, version: int = VERSION) -> Column:
    return F.concat(_framed_hex(F.lit(domain)), F.lit(f"{version:04x}"), _framed_hex(region), u64_hex(count))


def sha256_of_hex(hex_text: Column) -> Column:
    return F.sha2(F.unhex(hex_text), 256)


def row_fingerprint(shape_type: Column, ring: Column) -> Column:
    """Digest of one shape row: its kind, vertex count and vertex values, in order."""
    text = F.concat_ws(
        "|", shape_type, F.size(ring).cast("string"),
        F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["y"].cast("string"), p["x"].cast("string"))), ";"),
    )
    return F.sha2(text, 256)


BUCKET_BITS = 16


def geometry_fingerprint(shapes: DataFrame, element: str = "element", row_pos: str = "row_pos") -> DataFrame:
    """`element, n_rows, fingerprint` of the ordered shapes `(element, row_pos, shape_type, ring)`.

    Row digests are joined in order within 65536 consecutive positions and hashed, then those hashes likewise, up to
    one per element, so that no buffer grows with the number of shapes.
    """
    level = shapes.select(
        F.col(element).alias("element"), F.col(row_pos).cast("long").alias("b"), F.lit(1).cast("long").alias("n"),
        row_fingerprint(F.col("shape_type"), F.col("ring")).alias("d"),
    )
    for _ in range(64 // BUCKET_BITS):
        in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("b").alias("k"), "d"))), lambda s: s["d"]), "")
        level = level.groupBy("element", F.shiftright("b", BUCKET_BITS).alias("b")).agg(
            F.sum("n").alias("n"), F.sha2(in_order, 256).alias("d")
        )
    return level.select("element", F.col("n").alias("n_rows"), F.col("d").alias("fingerprint"))
