"""Queries on polygons: a box with a hole per nation, a small polygon per customer, element catalogs of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.bindings.registry import query, table
from tesserae.functions.geometry import box_ring, point, polygon_area
from tesserae.functions.numeric import Affine
from tesserae.operators import annotate as A
from tesserae.operators import shapes as S
from tesserae.operators import spatial as G
from tesserae.sources import catalog as K
from tesserae.sources import tables as T


def nation_boxes(spark, folder):
    n = table(spark, folder, "nation")
    x = F.col("n_nationkey") * 400.0 - 1000.0
    low, high = F.lit(0.0), F.lit(24.0)
    rings = F.array(box_ring(x, low, x + 350, high), box_ring(x + 100, low + 6, x + 250, high - 6))
    return n.select(F.col("n_nationkey").cast("long").alias("polygon_id"), rings.alias("rings"))


def customer_points(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("instance_id"), F.col("c_mktsegment").alias("region"),
        F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"),
    )


INSIDE_SQL = """
boxes AS (SELECT n_nationkey AS polygon_id, n_nationkey * 400.0::DOUBLE - 1000 AS bx FROM nation),
inside AS (SELECT DISTINCT c_custkey AS instance_id FROM customer, boxes
  WHERE c_acctbal BETWEEN bx AND bx + 350 AND c_nationkey BETWEEN 0 AND 24
    AND NOT (c_acctbal > bx + 100 AND c_acctbal < bx + 250 AND c_nationkey > 6 AND c_nationkey < 18))"""


@query("points_in_polygons", f"WITH {INSIDE_SQL} SELECT instance_id FROM inside")
def points_in_polygons(spark, folder):
    return G.points_in_polygons(customer_points(spark, folder), nation_boxes(spark, folder), ["instance_id"]).select("instance_id")


@query("points_in_transformed_polygons", """
WITH shifted AS (SELECT c_custkey AS instance_id, -(c_acctbal - 5) AS x, (c_nationkey - 1) / 0.5::DOUBLE AS y FROM customer),
boxes AS (SELECT n_nationkey * 400.0::DOUBLE - 1000 AS bx FROM nation)
SELECT DISTINCT instance_id FROM shifted, boxes WHERE x BETWEEN bx AND bx + 350 AND y BETWEEN 0 AND 24
  AND NOT (x > bx + 100 AND x < bx + 250 AND y > 6 AND y < 18)""")
def points_in_transformed_polygons(spark, folder):
    mirrored = Affine(-1.0, 0.0, 0.0, 0.5, 5.0, 1.0)
    return G.matched_ids(customer_points(spark, folder), nation_boxes(spark, folder), ["instance_id"], affine=mirrored)


@query("matched_ids_sorted", f"WITH {INSIDE_SQL} SELECT instance_id FROM inside")
def matched_ids_sorted(spark, folder):
    return G.matched_ids(customer_points(spark, folder), nation_boxes(spark, folder), ["instance_id"])


@query("polygon_union_membership", f"WITH {INSIDE_SQL} SELECT c_custkey AS instance_id, c_custkey IN (SELECT instance_id FROM inside) AS in_union FROM customer")
def polygon_union_membership(spark, folder):
    return G.union_membership(customer_points(spark, folder), nation_boxes(spark, folder), ["instance_id"]).select("instance_id", "in_union")


@query("bbox_prefilter", "SELECT c_custkey AS instance_id FROM customer WHERE c_acctbal BETWEEN 200 AND 5000.5 AND c_nationkey BETWEEN 3 AND 12")
def bbox_prefilter(spark, folder):
    return G.bbox_prefilter(customer_points(spark, folder), (200.0, 3.0, 5000.5, 12.0)).select("instance_id")


@query("annotate_by_polygon", f"""
WITH {INSIDE_SQL} SELECT c_mktsegment AS region, c_custkey AS instance_id,
  CASE WHEN c_custkey IN (SELECT instance_id FROM inside) THEN 'tumor' END AS note FROM customer""")
def annotate_by_polygon(spark, folder):
    marked = G.mark_covered(customer_points(spark, folder), nation_boxes(spark, folder), "covered").select("region", "instance_id", "covered")
    return A.annotate_flagged(marked, "covered", "note", " tumor ", "new")


@query("polygon_area_bounds", """
SELECT CAST(n_nationkey AS BIGINT) AS polygon_id, 350.0 * 24 - 150 * 12 AS area, n_nationkey * 400.0 - 1000 AS min_x, 0.0 AS min_y,
  n_nationkey * 400.0 - 650 AS max_x, 24.0 AS max_y FROM nation""")
def polygon_area_bounds(spark, folder):
    return G.polygon_area_bounds(nation_boxes(spark, folder)).drop("rings")


def customer_polygons(spark, folder):
    """A pentagon per customer; a pentagram, an open, a flat and a holed one in some segments."""
    c = table(spark, folder, "customer")
    x, y = F.col("c_acctbal").cast("double"), F.col("c_nationkey") * 100.0
    corners = [point(x + dx, y + dy) for dx, dy in ((0, 10), (10, 3), (6, -9), (-6, -9), (-10, 3))]
    pentagon, star = [0, 1, 2, 3, 4, 0], [0, 2, 4, 1, 3, 0]
    ring = lambda order: F.array(*[corners[i] for i in order])
    inner = box_ring(x - 2, y - 2, x + 2, y + 2)
    far = box_ring(x + 100, y, x + 101, y + 1)
    rings = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(ring(star)))
        .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.array(corners[0], corners[1], corners[0])))
        .when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") > 5000), F.array(ring(pentagon), far))
        .when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") < 0), F.array(ring(pentagon), inner, box_ring(x - 1, y - 1, x + 1, y + 1)))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(ring(pentagon), inner))
        .when(F.col("c_acctbal") < 0, F.array(ring(pentagon[:-1])))
        .otherwise(F.array(ring(pentagon)))
    )
    return c.select(F.col("c_custkey").alias("polygon_id"), "c_mktsegment", rings.alias("rings"))


@query("validate_polygons", """
SELECT c_custkey AS polygon_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'self_intersection' WHEN c_mktsegment = 'MACHINERY' THEN 'too_few_vertices'
  WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN c_acctbal > 5000 THEN 'hole_outside' WHEN c_acctbal < 0 THEN 'nested_holes' END
  WHEN c_acctbal < 0 THEN 'not_closed' END AS problem FROM customer""")
def validate_polygons(spark, folder):
    return G.validate_polygons(customer_polygons(spark, folder))


@query("scan_shapes", """
WITH rows AS (
  SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal > 9000 THEN NULL WHEN c_acctbal > 8000 THEN 1000000000 + c_nationkey ELSE c_custkey END AS instance_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'self_intersection' WHEN c_mktsegment = 'MACHINERY' THEN 'too_few_vertices'
      WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN c_acctbal > 5000 THEN 'hole_outside' WHEN c_acctbal < 0 THEN 'nested_holes' END
      WHEN c_acctbal < 0 THEN 'not_closed' END AS polygon
  FROM customer)
SELECT c_custkey, instance_id, CASE WHEN instance_id IS NULL THEN 'missing_identity' WHEN polygon IS NOT NULL THEN polygon
  WHEN count(*) OVER (PARTITION BY instance_id) > 1 THEN 'duplicate_identity' END AS problem FROM rows""")
def scan_shapes(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    shapes = customer_polygons(spark, folder).withColumnRenamed("polygon_id", "c_custkey").join(customers, "c_custkey")
    identity = (
        F.when((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_acctbal") > 9000), F.lit(None).cast("long"))
        .when(F.col("c_acctbal") > 8000, F.lit(1_000_000_000) + F.col("c_nationkey")).otherwise(F.col("c_custkey"))
    )
    return T.scan_shapes(shapes.withColumn("instance_id", identity.cast("long"))).select("c_custkey", "instance_id", "problem")


def nested_boxes(spark, folder):
    """Per supplier a shell and a box per line number around it, placed by the ship quantities."""
    items = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.count(F.lit(1)).alias("n")
    )
    x = F.col("l_linenumber") * 20.0 + F.pmod("p", F.lit(3))
    boxes = items.select(
        F.col("l_suppkey").alias("group_id"), F.col("l_linenumber").cast("long").alias("polygon_id"),
        F.array(box_ring(x, F.lit(5.0), x + 17 + F.pmod("p", F.lit(5)), F.lit(15.0))).alias("rings"),
    )
    lit = F.lit
    shell = F.array(box_ring(lit(0.0), lit(0.0), lit(163.0), lit(20.0)), box_ring(lit(1.0), lit(1.0), lit(3.0), lit(3.0)))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("group_id"), F.pmod("s_nationkey", lit(5)).alias("kind"))

    def extra(kind: int | None, polygon_id: int, rings) -> DataFrame:
        rows = suppliers if kind is None else suppliers.where(F.col("kind") == kind)
        return rows.select("group_id", lit(polygon_id).cast("long").alias("polygon_id"), rings.alias("rings"))

    framed = F.array(box_ring(lit(5.0), lit(1.0), lit(15.0), lit(4.0)), box_ring(lit(6.0), lit(2.0), lit(7.0), lit(3.0)))
    inner = F.array(box_ring(lit(1.5), lit(1.5), lit(2.0), lit(2.0)))
    return extra(None, 0, shell).unionByName(boxes).unionByName(extra(1, 100, shell)).unionByName(extra(2, 101, framed)).unionByName(extra(3, 102, inner))


NESTED_SQL = """
boxes AS (SELECT l_suppkey AS g, l_linenumber AS k, l_linenumber * 20 + min(l_partkey) % 3 AS x0, l_linenumber * 20 + min(l_partkey) % 3 + 17 + min(l_partkey) % 5 AS x1
          FROM lineitem GROUP BY l_suppkey, l_linenumber),
facts AS (SELECT s_suppkey AS g, s_nationkey % 5 AS kind, (SELECT count(*) FROM boxes WHERE g = s_suppkey) + (s_nationkey % 5 IN (1, 2, 3))::INT AS n,
          (SELECT coalesce(sum(x1 - x0), 0) FROM boxes WHERE g = s_suppkey) AS widths,
          (SELECT count(*) FROM boxes WHERE g = s_suppkey AND x1 >= 163) AS out_or_touch, (SELECT count(*) FROM boxes WHERE g = s_suppkey AND x1 > 163) AS outside,
          (SELECT count(*) FROM boxes a JOIN boxes b ON a.g = b.g AND a.k < b.k WHERE a.g = s_suppkey AND a.x1 >= b.x0) AS meet FROM supplier),
judged AS (SELECT *, CASE WHEN n = 0 THEN 'too_few_polygons' WHEN kind = 1 THEN 'ambiguous_shell' WHEN kind = 2 THEN 'hole_has_interiors'
  WHEN outside > 0 THEN 'not_contained' WHEN out_or_touch > 0 THEN 'touches_shell' WHEN meet > 0 THEN 'overlap' WHEN kind = 3 THEN 'nested' END AS problem FROM facts)"""


@query("assemble_holes", f"""
WITH {NESTED_SQL} SELECT CAST(g AS BIGINT) AS group_id, CASE WHEN kind <> 1 THEN CAST(0 AS BIGINT) END AS shell_id, CAST(n AS BIGINT) AS n_holes, problem,
  CASE WHEN problem IS NULL THEN n + 2 END AS n_rings, CASE WHEN problem IS NULL THEN (163 * 20 - 4 - widths * 10)::DOUBLE END AS area FROM judged""")
def assemble_holes(spark, folder):
    found = G.assemble_holes(nested_boxes(spark, folder))
    made = F.col("rings").isNotNull()
    return found.select(
        "group_id", "shell_id", "n_holes", "problem", F.when(made, F.size("rings")).cast("long").alias("n_rings"),
        F.when(made, F.round(polygon_area(F.col("rings")), 6)).alias("area"),
    )


@query("largest_polygon", """
WITH areas AS (SELECT o_orderpriority AS group_id, o_orderkey AS polygon_id, o_custkey * 2.0::DOUBLE AS area FROM orders),
top AS (SELECT group_id, max(area) AS area, count(*) AS n_polygons FROM areas GROUP BY 1)
SELECT group_id, CASE WHEN count(*) = 1 THEN min(polygon_id) END AS shell_id, t.area, n_polygons, count(*) = 1 AS is_unique
FROM top t JOIN areas a USING (group_id) WHERE a.area = t.area GROUP BY group_id, t.area, n_polygons""")
def largest_polygon(spark, folder):
    o = table(spark, folder, "orders")
    zero = F.lit(0.0)
    boxes = o.select(
        F.col("o_orderpriority").alias("group_id"), F.col("o_orderkey").alias("polygon_id"),
        F.array(box_ring(zero, zero, F.col("o_custkey").cast("double"), F.lit(2.0))).alias("rings"),
    )
    return G.largest_polygon(boxes)


@query("ellipse_to_polygon", """
SELECT c_custkey AS instance_id, j AS vertex, round(c_acctbal + cos((j % 64) * 2 * pi() / 64) * 10, 6) AS x,
  round(c_nationkey + sin((j % 64) * 2 * pi() / 64) * (1 + c_nationkey), 6) AS y
FROM customer, (SELECT unnest(range(0, 65)) AS j)""")
def ellipse_to_polygon(spark, folder):
    c = table(spark, folder, "customer")
    x, y, h = F.col("c_acctbal"), F.col("c_nationkey").cast("double"), F.col("c_nationkey") + 1.0
    corners = F.array(point(x - 10, y - h), point(x + 10, y - h), point(x + 10, y + h), point(x - 10, y + h))
    ellipses = c.select(F.col("c_custkey").alias("instance_id"), corners.alias("corners"))
    rings = S.ellipse_polygons(ellipses.repartition("instance_id"))  # a row becomes 65, so the few bytes of one file are spread first
    # not posexplode: the filter that Spark infers from it would work out each ring twice more
    vertices = rings.select("instance_id", F.posexplode_outer("ring").alias("vertex", "p")).where("vertex IS NOT NULL")
    return vertices.select(
        "instance_id", F.col("vertex").cast("long").alias("vertex"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")
    )


@query("circle_to_box", """
SELECT s_suppkey AS instance_id, CASE WHEN s_acctbal > 0 THEN s_nationkey - s_acctbal END AS min_x, CASE WHEN s_acctbal > 0 THEN 1 - s_acctbal END AS min_y,
  CASE WHEN s_acctbal > 0 THEN s_nationkey + s_acctbal END AS max_x, CASE WHEN s_acctbal > 0 THEN 1 + s_acctbal END AS max_y,
  CASE WHEN s_acctbal > 0 THEN 2 * s_acctbal END AS diameter FROM supplier""")
def circle_to_box(spark, folder):
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("instance_id"), F.col("s_nationkey").cast("double").alias("x"), F.lit(1.0).alias("y"), F.col("s_acctbal").alias("radius")
    )
    return S.circle_boxes(s).drop("x", "y", "radius")


@query("circles_qualify", "SELECT min(s_acctbal) > 0 AS qualifies FROM supplier")
def circles_qualify(spark, folder):
    return S.circles_qualify(table(spark, folder, "supplier"), "s_acctbal")


@query("rings_from_paths", """
SELECT c_custkey AS instance_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 1 END AS n_rings,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 5 WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 4 ELSE 5 END AS shell_size,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN CASE WHEN c_acctbal < 0 THEN 'hole_not_closed' ELSE 'missing_separator' END END AS problem FROM customer""")
def rings_from_paths(spark, folder):
    c = table(spark, folder, "customer")
    x = F.col("c_acctbal").cast("double")
    shell = box_ring(x, F.lit(0.0), x + 10, F.lit(10.0))
    hole = box_ring(x + 2, F.lit(2.0), x + 4, F.lit(4.0))
    start = F.slice(shell, 1, 1)
    open_hole = F.concat(F.slice(hole, 1, 4), F.array(point(x + 2, F.lit(2.5))))
    path = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(shell, hole, start))
        .when((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_acctbal") < 0), F.concat(shell, open_hole, start))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(shell, hole))
        .when(F.col("c_mktsegment") == "MACHINERY", F.slice(shell, 1, 4))
        .otherwise(shell)
    )
    parsed = S.rings_from_paths(c.select(F.col("c_custkey").alias("instance_id"), path.alias("path")))
    has = F.col("rings").isNotNull()
    return parsed.select(
        "instance_id", F.when(has, F.size("rings")).cast("long").alias("n_rings"),
        F.when(has, F.size(F.element_at("rings", 1))).cast("long").alias("shell_size"), F.col("path_problem").alias("problem"),
    )


@query("multipart_explode", """
SELECT s_suppkey AS instance_id, part, 10.0 + part * 0 AS area FROM supplier, (SELECT unnest([0, 1]) AS part) WHERE part <= s_suppkey % 2""")
def multipart_explode(spark, folder):
    from tesserae.bindings.regions import shapes
    from tesserae.operators.regions import expand_rendered_rows

    parts = expand_rendered_rows(shapes(spark, folder))
    return G.polygon_area_bounds(parts).select("instance_id", F.col("part").cast("long").alias("part"), F.round("area", 6).alias("area"))


def edited_rows(spark, folder):
    """Identities as an editor leaves them: some kept, some missing, one generated id copied to many rows."""
    name = (
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority").like("1%"), F.lit("__annotation_7"))
        .when(F.col("o_orderpriority").like("2%"), F.concat(F.lit("__annotation_"), (F.col("o_orderkey") + 100).cast("string")))
        .otherwise(F.concat(F.lit("cell_"), F.col("o_orderkey").cast("string")))
    )
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_pos"), name.alias("instance_id"))


EDITED_SQL = """
edited AS (SELECT o_orderkey AS row_pos, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority LIKE '1%' THEN '__annotation_7'
  WHEN o_orderpriority LIKE '2%' THEN '__annotation_' || (o_orderkey + 100) ELSE 'cell_' || o_orderkey END AS name FROM orders),
firsts AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY row_pos) AS r FROM edited),
kept AS (SELECT row_pos, CASE WHEN name IS NOT NULL AND r > 1 THEN NULL ELSE name END AS name FROM firsts),
high AS (SELECT max(CAST(substr(name, 14) AS BIGINT)) + 1 AS nxt FROM kept WHERE name LIKE '#_#_annotation#_%' ESCAPE '#')"""


@query("dedupe_generated_ids", f"WITH {EDITED_SQL} SELECT row_pos, name AS instance_id, false AS duplicate FROM kept")
def dedupe_generated_ids(spark, folder):
    return S.dedupe_generated_ids(edited_rows(spark, folder))


@query("generate_ids", f"""
WITH {EDITED_SQL} SELECT row_pos, coalesce(name, '__annotation_' || (nxt + row_number() OVER (PARTITION BY name IS NULL ORDER BY row_pos) - 1)) AS instance_id
FROM kept, high""")
def generate_ids(spark, folder):
    return S.generate_ids(edited_rows(spark, folder)).select("row_pos", "instance_id")


@query("generate_integer_ids", """
WITH edited AS (SELECT o_orderkey AS row_pos, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS id FROM orders),
high AS (SELECT greatest((SELECT max(id) FROM edited), (SELECT max(event_id) FROM events)) + 1 AS nxt)
SELECT row_pos, coalesce(id, nxt + row_number() OVER (PARTITION BY id IS NULL ORDER BY row_pos) - 1) AS instance_id FROM edited, high""")
def generate_integer_ids(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_pos"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("instance_id")
    )
    return S.generate_integer_ids(rows, used=table(spark, folder, "events").select(F.col("event_id").alias("instance_id")))


def catalog(spark, folder):
    """Parts as elements: the kind by type, the coordinate system by brand, the transform by size."""
    p = table(spark, folder, "part")
    kind = F.when(F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM"), "labels").otherwise("images")
    stretched, shift = F.col("p_size") > 40, F.col("p_size") % 4
    number = lambda c: c.cast("double")
    return p.select(
        F.concat_ws("-", "p_name", "p_partkey").alias("element"), kind.alias("kind"), F.col("p_brand").alias("coordinate_system"),
        F.when(stretched, 2.0).otherwise(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("d"), F.lit(1.0).alias("e"),
        number(shift).alias("xoff"), (number(shift) * 1e-9).alias("yoff"), F.lit(None).cast("double").alias("zoff"),
        F.lit(None).cast("long").alias("nz"), (F.length("p_name") * 100).cast("long").alias("ny"), F.lit(512).cast("long").alias("nx"),
    )


CATALOG_SQL = """
catalog AS (SELECT p_name || '-' || p_partkey AS element, CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'labels' ELSE 'images' END AS kind,
  p_brand AS coordinate_system, p_size <= 40 AS flat, p_size % 4 AS xoff, length(p_name) AS ny FROM part)"""


@query("element_catalog", f"WITH {CATALOG_SQL} SELECT element, kind, coordinate_system AS systems FROM catalog WHERE kind = 'labels' AND coordinate_system = 'Brand#3'")
def element_catalog(spark, folder):
    listed = K.element_catalog(catalog(spark, folder), "labels", "Brand#3")
    return listed.select("element", "kind", F.array_join("coordinate_systems", ",").alias("systems"))


@query("coordinate_systems_union", "SELECT DISTINCT p_brand AS coordinate_system FROM part UNION SELECT DISTINCT n_name FROM nation")
def coordinate_systems_union(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("coordinate_system"))
    return K.coordinate_systems(catalog(spark, folder), nations)


@query("name_collisions", """
SELECT lower(n) AS folded, count(*) AS n FROM (SELECT DISTINCT n, k FROM (SELECT p_name AS n, 'labels' AS k FROM part UNION ALL SELECT upper(p_name), 'images' FROM part))
GROUP BY 1 HAVING count(*) > 1""")
def name_collisions(spark, folder):
    p = table(spark, folder, "part")
    names = p.select(F.col("p_name").alias("element"), F.lit("labels").alias("kind")).union(p.select(F.upper("p_name"), F.lit("images")))
    return K.name_collisions(names)


@query("transform_is_translation", f"WITH {CATALOG_SQL} SELECT element, flat AS is_translation FROM catalog")
def transform_is_translation(spark, folder):
    return K.with_translation(catalog(spark, folder)).select("element", "is_translation")


@query("labels_in_coordinate_system", f"""
WITH {CATALOG_SQL} SELECT coordinate_system, count_if(flat) AS eligible, count_if(NOT flat) AS unavailable, count(*) AS total FROM catalog
WHERE kind = 'labels' GROUP BY 1""")
def labels_in_coordinate_system(spark, folder):
    return K.labels_in_coordinate_system(catalog(spark, folder))


@query("match_images_to_labels", f"""
WITH {CATALOG_SQL} SELECT l.coordinate_system, l.element AS labels, i.element AS image FROM catalog l JOIN catalog i
ON i.coordinate_system = l.coordinate_system AND i.ny = l.ny AND i.xoff = l.xoff AND l.kind = 'labels' AND i.kind = 'images' AND l.flat AND i.flat""")
def match_images_to_labels(spark, folder):
    return K.match_images_to_labels(catalog(spark, folder))


@query("image_discovery", f"""
WITH {CATALOG_SQL} SELECT l.coordinate_system, l.element AS labels,
  count_if(i.ny = l.ny AND i.xoff = l.xoff AND l.flat AND i.flat) AS matching, count(i.element) AS images,
  count(i.element) - count_if(i.ny = l.ny AND i.xoff = l.xoff AND l.flat AND i.flat) AS unavailable
FROM catalog l LEFT JOIN catalog i ON i.coordinate_system = l.coordinate_system AND i.kind = 'images' WHERE l.kind = 'labels' GROUP BY 1, 2""")
def image_discovery(spark, folder):
    return K.image_discovery(catalog(spark, folder))


@query("geometry_fingerprint", """
WITH shapes AS (SELECT c_mktsegment AS element, c_custkey AS pos, sha256('polygon|2|' || c_nationkey || '.0,' || c_nationkey * 2 || '.0;' || c_nationkey + 1 || '.0,0.0') AS d FROM customer),
l1 AS (SELECT element, pos // 65536 AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM shapes GROUP BY ALL),
l2 AS (SELECT element, sum(n) AS n, sha256(string_agg(d, '' ORDER BY b)) AS d FROM l1 GROUP BY element)
SELECT element, CAST(n AS BIGINT) AS n_rows, sha256(sha256(d)) AS fingerprint FROM l2""")
def geometry_fingerprint(spark, folder):
    from tesserae.functions.digest import geometry_fingerprint as fingerprint

    n = F.col("c_nationkey").cast("double")
    rows = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("element"), F.col("c_custkey").alias("row_pos"), F.lit("polygon").alias("shape_type"),
        F.array(point(n * 2, n), point(F.lit(0.0), n + 1)).alias("ring"),
    )
    return fingerprint(rows)
