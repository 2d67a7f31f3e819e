"""Queries on annotation tables: customers by market segment, orders by status, suppliers as shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.bindings.registry import query, table
from tesserae.functions.geometry import box_ring
from tesserae.operators import regions as G
from tesserae.sources.tables import object_keys, scan_obs_table

CUSTOMERS = object_keys({
    "region_key": "c_mktsegment", "instance_key": "c_custkey", "region": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
})
CUSTOMER_SQL = "obs AS (SELECT c_mktsegment AS region, c_custkey AS instance_id, c_name, c_acctbal FROM customer)"


def customers(spark, folder):
    return scan_obs_table(table(spark, folder, "customer"), CUSTOMERS).select("region", "instance_id", "c_name", "c_acctbal")


def shapes(spark, folder):
    """A shape per supplier, of one or two boxes."""
    s = table(spark, folder, "supplier")
    x, y = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    one, two = F.array(box_ring(x, y, x + 10, y + 1)), F.array(box_ring(x + 20, y, x + 25, y + 2))
    parts = F.when(F.col("s_suppkey") % 2 == 1, F.array(one, two)).otherwise(F.array(one))
    return s.select(F.col("s_suppkey").alias("instance_id"), parts.alias("parts"))


def shape_rows(spark, folder):
    """Table rows for the suppliers in credit."""
    s = table(spark, folder, "supplier").where("s_acctbal >= 0")
    return s.select(F.col("s_suppkey").alias("instance_id"), "s_name", "s_acctbal")


@query("scan_obs_table", f"WITH {CUSTOMER_SQL} SELECT * FROM obs")
def scan_obs(spark, folder):
    return customers(spark, folder)


@query("region_filter", f"WITH {CUSTOMER_SQL} SELECT region, instance_id FROM obs WHERE region IN ('BUILDING', 'MACHINERY')")
def region_filter(spark, folder):
    regions = G.requested_regions(["MACHINERY", "BUILDING", "MACHINERY"], CUSTOMERS.regions)
    return G.region_filter(customers(spark, folder), regions).select("region", "instance_id")


@query("undeclared_regions", """
SELECT DISTINCT p_type AS region, 'labels' AS missing_from FROM part WHERE p_type NOT IN (SELECT event_type FROM events)
UNION ALL SELECT DISTINCT p_type, 'table' FROM part WHERE p_type NOT IN (SELECT c_mktsegment FROM customer)""")
def undeclared_regions(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_type").alias("region"))
    labels = table(spark, folder, "events").select(F.col("event_type").alias("region"))
    return G.undeclared_regions(parts, labels, customers(spark, folder))


@query("duplicate_instances", """
WITH dup AS (SELECT o_orderstatus AS region, o_custkey AS instance_id FROM orders GROUP BY ALL HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY instance_id) AS r FROM dup)
SELECT region, count(*) AS n_duplicates, string_agg(CASE WHEN r <= 5 THEN CAST(instance_id AS VARCHAR) END, ', ' ORDER BY instance_id) AS preview
FROM ranked GROUP BY region""")
def duplicate_instances(spark, folder):
    orders = table(spark, folder, "orders")
    return G.duplicate_instances(orders.select(F.col("o_orderstatus").alias("region"), F.col("o_custkey").alias("instance_id")))


@query("positive_instance_filter", """
WITH raw AS (SELECT c_mktsegment AS region, CASE WHEN c_nationkey = 3 THEN c_name WHEN c_nationkey < 10 THEN c_custkey || '.5'
                    WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS v FROM customer)
SELECT region, CAST(trunc(TRY_CAST(v AS DOUBLE)) AS BIGINT) AS instance_id FROM raw WHERE trunc(TRY_CAST(v AS DOUBLE)) > 0""")
def positive_instance_filter(spark, folder):
    raw = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("region"),
        F.when(F.col("c_nationkey") == 3, F.col("c_name"))
        .when(F.col("c_nationkey") < 10, F.concat(F.col("c_custkey").cast("string"), F.lit(".5")))
        .when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_custkey").cast("string")).alias("instance_id"),
    )
    return G.positive_instances(raw)


@query("x_var_values", """
SELECT o_orderkey AS obs_id, coalesce(v, 0) AS value FROM orders
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F'""")
def x_var_values(spark, folder):
    items = table(spark, folder, "lineitem")
    matrix = items.groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_returnflag").alias("var")).agg(F.sum("l_quantity").alias("value"))
    obs = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("obs_id"))
    return G.x_var_values(matrix, obs, "R")


@query("align_table_to_shapes", """
SELECT s.s_suppkey AS instance_id, 1 + s.s_suppkey % 2 AS n_parts, t.s_name, t.s_acctbal, t.s_suppkey IS NOT NULL AS has_table_row
FROM supplier s LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) t USING (s_suppkey)""")
def align_table_to_shapes(spark, folder):
    aligned = G.align_table_to_shapes(shapes(spark, folder), shape_rows(spark, folder))
    return aligned.withColumn("parts", F.size("parts").cast("long")).withColumnRenamed("parts", "n_parts")


@query("alignment_problems", """
SELECT count(*) AS table_rows, 0 AS missing_table_instances,
       (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS duplicate_table_instances,
       0 AS missing_shape_instances,
       (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS instances_without_shape,
       'duplicate_table_instances' AS problem FROM lineitem""")
def alignment_problems(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("instance_id"))
    return G.alignment_problems(shapes(spark, folder), rows)


@query("expand_rendered_rows", """
SELECT s_suppkey AS instance_id, CAST(part AS BIGINT) AS part, CASE part WHEN 0 THEN s_acctbal ELSE s_acctbal + 20 END AS min_x
FROM supplier, (SELECT unnest([0, 1]) AS part) WHERE part <= s_suppkey % 2""")
def expand_rendered_rows(spark, folder):
    rows = G.expand_rendered_rows(shapes(spark, folder))
    return rows.select("instance_id", F.col("part").cast("long").alias("part"), F.expr("rings[0][0].x").alias("min_x"))


@query("merge_feature_matrix", """
WITH obs AS (SELECT o_orderstatus AS region, o_orderkey AS instance_id, o_totalprice FROM orders),
new AS (SELECT l_orderkey AS instance_id, CAST(count(*) AS DOUBLE) AS f FROM lineitem GROUP BY 1)
SELECT region, instance_id, CASE WHEN region <> 'F' THEN o_totalprice WHEN f IS NULL THEN -1.0 ELSE f END AS feature
FROM obs LEFT JOIN new USING (instance_id)""")
def merge_feature_matrix(spark, folder):
    obs = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("region"), F.col("o_orderkey").alias("instance_id"), "o_totalprice"
    )
    counted = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.count(F.lit(1)).alias("n"))
    new = counted.select(F.lit("F").alias("region"), "instance_id", F.array(F.col("n").cast("double")).alias("features"))
    old = obs.select("region", "instance_id", F.array("o_totalprice").alias("features"))
    merged = G.merge_feature_matrix(obs.select("region", "instance_id"), new, old, width=1, same_schema=True, overwrite=True)
    return merged.select("region", "instance_id", F.nanvl(F.col("features")[0], F.lit(-1.0)).alias("feature"))


@query("realign_edited_shapes", """
SELECT l_suppkey * 2 AS instance_id, s_name, s_nationkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey * 2""")
def realign_edited_shapes(spark, folder):
    edited = table(spark, folder, "lineitem").select((F.col("l_suppkey") * 2).alias("instance_id")).distinct()
    source = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("instance_id"), "s_name", "s_nationkey")
    return G.realign_edited_shapes(edited, source)


@query("union_regions", """
SELECT c_mktsegment AS region, c_custkey AS instance_id FROM customer UNION ALL SELECT o_orderstatus, o_custkey FROM orders""")
def union_regions(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("region"), F.col("o_custkey").alias("instance_id"))
    return G.union_regions(customers(spark, folder).select("region", "instance_id"), orders)


@query("fixture_multi_region", f"""
WITH {CUSTOMER_SQL} SELECT region, count(*) AS n, sum(instance_id) AS total FROM
  (SELECT * FROM obs UNION ALL SELECT 'second' AS region, instance_id, c_name, c_acctbal FROM obs) GROUP BY region""")
def fixture_multi_region(spark, folder):
    both = G.duplicate_into_region(customers(spark, folder), "second")
    return both.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("instance_id").alias("total"))


@query("class_feature_rows", """
SELECT c_mktsegment AS region, c_custkey AS instance_id, CAST(1 + c_nationkey % 3 AS BIGINT) AS user_class,
       CAST(NULL AS BIGINT) AS pred_class, CAST(NULL AS DOUBLE) AS pred_confidence FROM customer WHERE c_custkey > 0""")
def class_feature_rows(spark, folder):
    obs = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("region"), F.col("c_custkey").alias("instance_id"),
        (1 + F.pmod("c_nationkey", F.lit(3))).alias("user_class"),
    )
    return G.class_feature_rows(obs)
