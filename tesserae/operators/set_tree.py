"""Trees of set digests that are kept, so that a change costs one path and two sets are compared from their roots.

A row `(region, level, b, d)` is a node: on level 0 the digest of the ids in a bucket of 65,536 consecutive values, above it that of
65,536 consecutive nodes of the level below, up to one root per region. The digest of a region's set follows from its root and
equals that of `region_binding_digest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.digest import DOMAIN, set_header_hex, sha256_of_hex, u64_hex
from tesserae.operators.centers import BUCKET_BITS
from tesserae.scale import Sized, join_sized, settle

LEVELS = 64 // BUCKET_BITS


def _leaves(ids: DataFrame) -> DataFrame:
    """`(region, b, n, d)` of the buckets of a set `(region, id)`."""
    found = ids.groupBy("region", F.shiftright("id", BUCKET_BITS).alias("b")).agg(F.collect_set("id").alias("ids"))
    body = F.array_join(F.transform(F.sort_array("ids"), u64_hex), "")
    return found.select("region", "b", F.size("ids").cast("long").alias("n"), sha256_of_hex(body).alias("d"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes above `(region, b, n, d)`."""
    in_order = F.sort_array(F.collect_list(F.struct(F.col("b").alias("k"), "d")))
    body = F.array_join(F.transform(in_order, lambda s: F.concat(u64_hex(s["k"]), s["d"])), "")
    return nodes.groupBy("region", F.shiftright("b", BUCKET_BITS).alias("b")).agg(F.sum("n").alias("n"), sha256_of_hex(body).alias("d"))


def _above(level: int) -> Column:
    return F.lit(level).cast("int").alias("level")


def set_tree(ids: DataFrame) -> DataFrame:
    """All nodes `(region, level, b, n, d)` of the sets of ids `(region, instance_id)`; `n` counts the ids below."""
    nodes = settle(_leaves(ids.select("region", F.col("instance_id").cast("long").alias("id")))).df
    tree = nodes.select("region", _above(0), "b", "n", "d")
    for level in range(1, LEVELS):
        nodes = _parents(nodes)
        tree = tree.unionAll(nodes.select("region", _above(level), "b", "n", "d"))
    return tree


def set_digests(tree: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """`(region, n_obs, digest)` from the roots of trees."""
    header = set_header_hex(F.col("region"), F.col("n"), domain)
    digest = F.concat(F.lit("sha256-tree:"), sha256_of_hex(F.concat(header, F.col("d"))))
    return tree.where(F.col("level") == LEVELS - 1).select("region", F.col("n").alias("n_obs"), digest.alias("digest"))


def touched_nodes(changes: DataFrame) -> DataFrame:
    """`(region, level, b)`: the nodes on the paths of changed ids `(region, instance_id)`."""
    at = F.col("instance_id").cast("long")
    # in two shifts, as one by all 64 bits would be none
    steps = F.array(*[F.struct(_above(k), F.shiftright(F.shiftright(at, BUCKET_BITS * k), BUCKET_BITS).alias("b")) for k in range(LEVELS)])
    return changes.select("region", F.inline(steps)).distinct()


def updated_tree(tree: DataFrame, changes: DataFrame, ids: DataFrame) -> DataFrame:
    """The tree of `ids`, given the tree of the sets before ids of `changes(region, instance_id)` came or went.

    Only the ids in touched buckets are read and hashed (a filter on their bucket, which reaches a table that is stored by it), and
    above them only the nodes whose parent is touched.
    """
    touched = settle(touched_nodes(changes))
    typed = ids.select("region", F.col("instance_id").cast("long").alias("id")).withColumn("b", F.shiftright("id", BUCKET_BITS))
    fresh = _leaves(join_sized(typed, _level(touched, 0), ["region", "b"], "left_semi").drop("b"))
    out = []
    for level in range(LEVELS):
        own = _level(touched, level)
        fresh = settle(fresh)
        kept = join_sized(tree.where(F.col("level") == level).drop("level"), own, ["region", "b"], "left_anti").select("region", "b", "n", "d")
        nodes = kept.unionAll(fresh.df.select("region", "b", "n", "d"))
        out.append(nodes.select("region", _above(level), "b", "n", "d"))
        if level + 1 < LEVELS:
            siblings = nodes.withColumn("__b", F.shiftright("b", BUCKET_BITS))
            above = _level(touched, level + 1)
            above = Sized(above.df.withColumnRenamed("b", "__b"), above.rows, above.nbytes)
            fresh = _parents(join_sized(siblings, above, ["region", "__b"], "left_semi").drop("__b"))
    tree = out[0]
    for nodes in out[1:]:
        tree = tree.unionAll(nodes)
    return tree


def _level(touched: Sized, level: int) -> Sized:
    return Sized(touched.df.where(F.col("level") == level).select("region", "b"), touched.rows, touched.nbytes)


def changed_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """`(region, b)`: buckets whose ids differ between two trees. From the roots down, only nodes below differing ones are compared."""
    differing = None
    for level in range(LEVELS - 1, -1, -1):
        sides = [t.where(F.col("level") == level).select("region", "b", F.col("d").alias(name)) for t, name in ((left, "l"), (right, "r"))]
        if differing is not None:
            above = Sized(differing.df.withColumnRenamed("b", "__b"), differing.rows, differing.nbytes)
            sides = [join_sized(s.withColumn("__b", F.shiftright("b", BUCKET_BITS)), above, ["region", "__b"], "left_semi").drop("__b") for s in sides]
        both = sides[0].join(sides[1], ["region", "b"], "full")
        differing = settle(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("region", "b"))
    return differing.df
