"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import discard, stored


def _toward_minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """`(id, component)` for every id in `links(a, b)`; the component is the smallest id that links reach.

    Each round joins edges with the smallest neighbour of their end; no neighbourhood is gathered in one row, so a node
    with very many links is split by Spark's handling of skewed joins. Rounds grow with the logarithm of the component
    size. Every round is written to the shared folder. Loops (a = b) give a component of one; nulls are ignored.
    """
    ends = links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = stored(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.where("u != v").unionAll(edges.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_toward_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = large.join(_toward_minimum(large), "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"), F.col("u").alias("o"))
        small = small.select("u", "v").unionAll(small.select(F.col("o").alias("u"), "v")).where("u != v").distinct()
        edges_next = stored(small, "links")
        state = edges_next.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        state = (state[0], state[1])
        discard(edges)
        edges = edges_next
        if state == seen:
            break
        seen = state
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    every = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
