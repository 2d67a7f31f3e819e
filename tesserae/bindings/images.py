"""Queries on images and label rasters drawn from line items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.bindings.registry import query, table
from tesserae.operators import histogram as H
from tesserae.operators import pixels as X
from tesserae.scale import ensure_checkpoint_dir
from tesserae.sources import raster as R


def image(spark, folder):
    """Two scales: every line item, and the mean per order as the coarse scale."""
    items = table(spark, folder, "lineitem")
    fine = items.select(
        F.lit("scan").alias("image"), F.lit("scale0").alias("scale"), F.col("l_returnflag").alias("channel"),
        F.col("l_discount").alias("value"),
    )
    coarse = items.groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_discount").alias("value")).select(
        F.lit("scan").alias("image"), F.lit("scale1").alias("scale"), F.col("l_returnflag").alias("channel"), "value"
    )
    return fine.unionByName(coarse)


def pixels(spark, folder):
    items = table(spark, folder, "lineitem")
    return items.select(
        F.col("l_returnflag").alias("region"), F.col("l_suppkey").alias("label"), F.col("l_linenumber").alias("y"),
        F.pmod("l_partkey", F.lit(512)).alias("x"), F.col("l_linestatus").alias("channel"),
        F.col("l_extendedprice").alias("value"),
    )


PIXEL_SQL = """
pixels AS (SELECT l_returnflag AS region, l_suppkey AS label, CAST(l_linenumber AS BIGINT) AS y, l_partkey % 512 AS x,
                  l_linestatus AS channel, l_extendedprice AS value FROM lineitem WHERE l_suppkey > 0),
plain AS (SELECT DISTINCT region, label, y, x FROM pixels)"""


def foreground(spark, folder):
    return R.scan_labels_pixels(pixels(spark, folder))


@query("scan_labels_pixels", f"WITH {PIXEL_SQL} SELECT region, label, count(*) AS n FROM pixels GROUP BY ALL")
def scan_labels_pixels(spark, folder):
    return foreground(spark, folder).groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))


@query("source_signature", f"""
WITH {PIXEL_SQL} SELECT region, 'scale0' AS scale, 'y,x' AS dims, max(y) + 1 AS height, max(x) + 1 AS width, 'int64' AS dtype
FROM pixels GROUP BY region""")
def source_signature(spark, folder):
    return R.source_signature(foreground(spark, folder))


@query("scan_image_channel", """
SELECT round(v, 6) AS value, count(*) AS n FROM (SELECT avg(l_discount) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
GROUP BY ALL""")
def scan_image_channel(spark, folder):
    values = R.scan_image_channel(image(spark, folder), "scan", "R", "scale1")
    return values.groupBy(F.round("value", 6).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("exclude_nan_zero", "SELECT l_discount AS value, count(*) AS n FROM lineitem WHERE l_discount <> 0 AND l_returnflag = 'A' GROUP BY ALL")
def exclude_nan_zero(spark, folder):
    values = R.scan_image_channel(image(spark, folder), "scan", "A")
    return H.exclude_values(values, zeros=True).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("select_channels", """
WITH channels AS (SELECT row_number() OVER (ORDER BY channel) - 1 AS position, channel FROM (SELECT DISTINCT l_returnflag AS channel FROM lineitem)),
requested AS (SELECT row_number() OVER (ORDER BY request) - 1 AS request_pos, request
              FROM (SELECT DISTINCT l_linestatus AS request FROM lineitem UNION SELECT DISTINCT l_returnflag FROM lineitem
                    UNION SELECT DISTINCT CAST(l_linenumber AS VARCHAR) FROM lineitem)),
resolved AS (SELECT r.request_pos, r.request, coalesce(n.position, i.position) AS position FROM requested r
             LEFT JOIN channels n ON n.channel = r.request
             LEFT JOIN channels i ON n.position IS NULL AND i.position = TRY_CAST(r.request AS BIGINT))
SELECT request_pos, request, position, channel,
       CASE WHEN position IS NULL THEN 'unknown'
            WHEN request_pos <> min(request_pos) OVER (PARTITION BY position) THEN 'duplicate' END AS problem
FROM resolved LEFT JOIN channels USING (position)""")
def select_channels(spark, folder):
    from tesserae.scale import number_rows

    items = table(spark, folder, "lineitem")
    channels = number_rows(items.select(F.col("l_returnflag").alias("channel")).distinct(), "channel", "position")
    names = items.select(
        F.explode(F.array("l_linestatus", "l_returnflag", F.col("l_linenumber").cast("string"))).alias("request")
    ).distinct()
    return R.select_channels(channels, number_rows(names, "request", "request_pos"))


@query("default_scale", """
WITH scales AS (SELECT p_brand AS image, p_name AS scale, max(p_size) * 400 AS y, count(*) * 300 AS x, min(p_partkey) AS pos
                FROM part GROUP BY ALL),
ranked AS (SELECT image, scale, y * x AS n, pos, y * x <= 16777216 AS fits FROM scales)
SELECT image, scale FROM ranked
QUALIFY row_number() OVER (PARTITION BY image ORDER BY fits DESC, CASE WHEN fits THEN -n ELSE n END, pos) = 1""")
def default_scale(spark, folder):
    parts = table(spark, folder, "part")
    scales = parts.groupBy(F.col("p_brand").alias("image"), F.col("p_name").alias("scale")).agg(
        F.lit(None).cast("long").alias("z"), (F.max("p_size") * 400).alias("y"), (F.count(F.lit(1)) * 300).alias("x"),
        F.min("p_partkey").alias("pos"),
    )
    return R.default_scale(scales)


def histogram_sql(values: str, bins: int, low: str, high: str, count: str = "count(v)") -> str:
    return f"""
WITH vals AS ({values}), ends AS (SELECT CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM vals),
edges AS (SELECT b AS bin, lo + b * ((hi - lo) / {bins}) AS lo, CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * ((hi - lo) / {bins}) END AS hi
          FROM ends, (SELECT unnest(range({bins})) AS b)),
hits AS (SELECT v, max(bin) AS bin FROM (SELECT v, bin FROM (SELECT v FROM vals) JOIN edges
         ON v >= lo AND (v < hi OR (bin = {bins - 1} AND v = hi))) GROUP BY ALL),
counted AS (SELECT bin, count(*) AS n FROM vals JOIN hits USING (v) GROUP BY bin)
SELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, {count} AS count FROM edges LEFT JOIN counted USING (bin)"""


def rounded(df):
    return df.withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9)})


@query("histogram", histogram_sql("SELECT l_extendedprice AS v FROM lineitem", 64, "min(v)", "max(v)", "coalesce(n, 0)"))
def histogram(spark, folder):
    values = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("value"))
    return rounded(H.histogram(H.exclude_values(values), bins=64))


@query("histogram_range_density", histogram_sql(
    "SELECT l_discount AS v FROM lineitem WHERE l_discount <> 0", 8, "min(0.025)", "max(0.075)",
    "round(coalesce(n, 0) / (SELECT sum(n) FROM counted) / (hi - lo), 6)"))
def histogram_range_density(spark, folder):
    values = table(spark, folder, "lineitem").select(F.col("l_discount").alias("value"))
    counts = H.histogram(H.exclude_values(values, zeros=True), bins=8, value_range=(0.025, 0.075), density=True)
    return rounded(counts).withColumn("count", F.round("count", 6))


@query("percentiles", """
SELECT q, round(quantile_cont(l_extendedprice, q / 100), 6) AS value FROM lineitem, (SELECT unnest([0.0::DOUBLE, 1, 25, 50, 99.5, 100]) AS q)
GROUP BY q""".replace("quantile_cont(l_extendedprice, q / 100)", """CASE q WHEN 0 THEN quantile_cont(l_extendedprice, 0.0)
 WHEN 1 THEN quantile_cont(l_extendedprice, 0.01) WHEN 25 THEN quantile_cont(l_extendedprice, 0.25)
 WHEN 50 THEN quantile_cont(l_extendedprice, 0.5) WHEN 99.5 THEN quantile_cont(l_extendedprice, 0.995)
 ELSE quantile_cont(l_extendedprice, 1.0) END"""))
def percentiles(spark, folder):
    values = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("value"))
    return H.percentiles(H.exclude_values(values), [0, 1, 25, 50, 99.5, 100, 25]).withColumn("value", F.round("value", 6))


@query("percentiles_approximate", "SELECT unnest([1.0::DOUBLE, 50, 99]) AS p, (SELECT count(*) FROM lineitem) AS n, true AS rank_is_near")
def percentiles_approximate(spark, folder):
    """The share of values below each percentile is off by a thousandth at most."""
    values = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("value"))
    found = H.approximate_percentiles(H.exclude_values(values), [1, 50, 99])
    three = found.agg(F.collect_list(F.struct(F.col("q").cast("double").alias("p"), F.col("value").alias("at")))).scalar()
    ends = values.select("value", F.inline(three))
    shares = ends.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("value") < F.col("at")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("at")).cast("int")).alias("up_to"),
    )
    return shares.select("p", "n", ((F.col("below") <= F.col("p") / 100 + 0.001) & (F.col("up_to") >= F.col("p") / 100 - 0.001)).alias("rank_is_near"))


@query("percentile_sketches", """
SELECT l_returnflag AS channel, p, count(*) AS n, true AS rank_is_near FROM lineitem, (SELECT unnest([1.0::DOUBLE, 50, 99]) AS p) GROUP BY ALL""")
def percentile_sketches(spark, folder):
    """Sketches per channel and image are stored and merged; the share of a channel's values below each percentile is nearly right."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("image"), F.col("l_extendedprice").alias("value"))
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    H.percentile_sketches(items, "channel", "image").write.parquet(path)
    found = H.sketch_percentiles(H.merged_sketches(spark.read.parquet(path), "channel"), [1, 50, 99], "channel")
    shares = items.join(F.broadcast(found.withColumnRenamed("value", "at")), "channel").groupBy("channel", F.col("q").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("value") < F.col("at")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("at")).cast("int")).alias("up_to"),
    )
    near = (F.col("below") <= F.col("p") / 100 + H.RANK_ERROR) & (F.col("up_to") >= F.col("p") / 100 - H.RANK_ERROR)
    return shares.select("channel", "p", "n", near.alias("rank_is_near"))


@query("canonical_centers", f"""
WITH {PIXEL_SQL}, requested AS (SELECT DISTINCT l_returnflag AS region, CAST(s_suppkey AS BIGINT) AS instance_id
                                FROM supplier, (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT r.region, instance_id, max(CASE WHEN y IS NOT NULL THEN 0.0::DOUBLE END) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx
FROM requested r LEFT JOIN pixels p ON p.region = r.region AND p.label = instance_id GROUP BY ALL""")
def canonical_centers(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("instance_id"))
    regions = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("region")
    found = X.canonical_centers(foreground(spark, folder), suppliers.select(regions, "instance_id"))
    return found.withColumns({c: F.round(c, 6) for c in ("cy", "cx")})


@query("missing_centers", f"""
WITH {PIXEL_SQL}, requested AS (SELECT DISTINCT l_returnflag AS region, CAST(s_suppkey AS BIGINT) AS instance_id
                                FROM supplier, (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT r.region, instance_id FROM requested r WHERE NOT EXISTS (SELECT 1 FROM pixels p WHERE p.region = r.region AND p.label = r.instance_id)""")
def missing_centers(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("instance_id"))
    regions = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("region")
    return X.missing_centers(X.canonical_centers(foreground(spark, folder), suppliers.select(regions, "instance_id")))


def _channel_sql(channel: str) -> str:
    when = f"FILTER (WHERE channel = '{channel}')"
    return ", ".join([
        f"round(sum(value) {when}, 2) AS sum__{channel}", f"round(avg(value) {when}, 6) AS mean__{channel}",
        f"round(avg(d2) {when} / 1e6, 4) AS var__{channel}", f"min(value) {when} AS min__{channel}", f"max(value) {when} AS max__{channel}",
        f"round(avg(d4) {when} / nullif(pow(avg(d2) {when}, 2), 0) - 3, 6) AS kurtosis__{channel}",
        f"round(avg(d3) {when} / nullif(pow(avg(d2) {when}, 1.5), 0), 6) AS skew__{channel}",
    ])


@query("intensity_features", f"""
WITH {PIXEL_SQL}, centred AS (SELECT *, value - avg(value) OVER (PARTITION BY region, label, channel) AS d FROM pixels),
powers AS (SELECT *, d * d AS d2, d * d * d AS d3, d * d * d * d AS d4 FROM centred)
SELECT region, label, {_channel_sql('O')}, {_channel_sql('F')} FROM powers GROUP BY region, label""")
def intensity_features(spark, folder):
    features = X.intensity_features(foreground(spark, folder), ["O", "F"])
    changed = {}
    for c in ("O", "F"):
        changed |= {
            f"sum__{c}": F.round(f"sum__{c}", 2), f"mean__{c}": F.round(f"mean__{c}", 6),
            f"var__{c}": F.round(F.col(f"var__{c}") / 1e6, 4),
            f"kurtosis__{c}": F.round(f"kurtosis__{c}", 6), f"skew__{c}": F.round(f"skew__{c}", 6),
        }
    return features.withColumns(changed)


@query("morphology_features", f"""
WITH {PIXEL_SQL},
border AS (SELECT * FROM plain p WHERE (SELECT count(*) FROM plain q WHERE q.region = p.region AND q.label = p.label
           AND abs(q.y - p.y) + abs(q.x - p.x) = 1) < 4),
weighed AS (SELECT p.region, p.label, p.y, p.x, sum(CASE WHEN q.y = p.y AND q.x = p.x THEN 1 WHEN q.y = p.y OR q.x = p.x THEN 2 ELSE 10 END) AS w
            FROM border p JOIN border q ON q.region = p.region AND q.label = p.label AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1
            GROUP BY ALL),
perimeters AS (SELECT region, label, sum(CASE WHEN w IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN w IN (21, 33) THEN sqrt(2)
               WHEN w IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM weighed GROUP BY ALL),
moments AS (SELECT region, label, CAST(count(*) AS DOUBLE) AS area, var_pop(y) + 1.0 / 12 AS vy, var_pop(x) + 1.0 / 12 AS vx, covar_pop(y, x) AS c
            FROM plain GROUP BY ALL),
axes AS (SELECT *, (vy + vx) / 2 + sqrt(pow((vy - vx) / 2, 2) + c * c) AS l1, (vy + vx) / 2 - sqrt(pow((vy - vx) / 2, 2) + c * c) AS l2 FROM moments)
SELECT region, label, area, round(sqrt(1 - l2 / l1), 6) AS eccentricity, round(4 * sqrt(l1), 6) AS major_axis_length,
       round(4 * sqrt(l2), 6) AS minor_axis_length, round(perimeter, 6) AS perimeter,
       round(sqrt(4 * area / pi()), 6) AS equivalent_diameter, round(sqrt(l1 / l2), 6) AS major_minor_axis_ratio,
       round(perimeter * perimeter / area, 6) AS perim_square_over_area,
       round(4 * sqrt(l1) / sqrt(4 * area / pi()), 6) AS major_axis_equiv_diam_ratio
FROM axes JOIN perimeters USING (region, label)""")
def morphology_features(spark, folder):
    features = X.morphology_features(foreground(spark, folder), hull=False)
    return features.withColumns({c: F.round(c, 6) for c in features.columns if c not in ("region", "label", "area")})


@query("morphology_hull_features", f"""
WITH {PIXEL_SQL},
lines AS (SELECT region, label, y, min(x) AS low, max(x) AS high FROM plain GROUP BY ALL),
corners AS (
  SELECT region, label, y + dy AS py, side, CASE side WHEN 1 THEN low ELSE -high END - du AS u
  FROM lines, (VALUES (-0.5::DOUBLE, 0.0::DOUBLE), (0.0, 0.5), (0.5, 0.0)) d(dy, du), (VALUES (1), (-1)) s(side)),
spans AS (SELECT region, label, unnest(range(min(y), max(y) + 1)) AS y FROM lines GROUP BY region, label),
reach AS (
  SELECT s.region, s.label, s.y, p.side, ceil(min(CASE WHEN p.py = q.py THEN p.u ELSE p.u + (q.u - p.u) * ((s.y - p.py) / (q.py - p.py)) END) - 1e-9) AS u
  FROM spans s JOIN corners p ON p.region = s.region AND p.label = s.label AND p.py <= s.y
  JOIN corners q ON q.region = s.region AND q.label = s.label AND q.side = p.side AND q.py >= s.y
  WHERE p.py < q.py OR p.py = s.y GROUP BY ALL),
rows_ AS (
  SELECT l.region, l.label, l.y, greatest(-r.u - l.u + 1, 0) AS n, (l.u - r.u) / 2 AS x
  FROM reach l JOIN reach r ON r.region = l.region AND r.label = l.label AND r.y = l.y AND l.side = 1 AND r.side = -1),
hulls AS (SELECT region, label, sum(n) AS hull, sum(n * y) / sum(n) AS hy, sum(n * x) / sum(n) AS hx FROM rows_ GROUP BY ALL),
objects AS (SELECT region, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM plain GROUP BY ALL)
SELECT region, label, area, CAST(hull AS BIGINT) AS convex_area, round((hull - area) / hull, 9) AS convex_hull_resid,
  round(sqrt(pow(cy - hy, 2) + pow(cx - hx, 2)) / sqrt(area), 6) AS centroid_dif
FROM objects JOIN hulls USING (region, label)""")
def morphology_hull_features(spark, folder):
    rows = X.morphology_features(foreground(spark, folder))
    return rows.select(
        "region", "label", F.col("area").cast("long").alias("area"), F.col("convex_area").cast("long").alias("convex_area"),
        F.round("convex_hull_resid", 9).alias("convex_hull_resid"), F.round("centroid_dif", 6).alias("centroid_dif"),
    )
