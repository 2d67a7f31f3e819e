"""Queries on points: line items as molecules without identity, events as molecules with one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.bindings.registry import query, table
from tesserae.functions.numeric import Affine
from tesserae.functions import text as X
from tesserae.functions.text import normalize_label
from tesserae.operators import points as P
from tesserae.operators import tiles as T
from tesserae.operators.coarse import coarse_levels, level_points
from tesserae.plans.build_tiles import plan_tiles
from tesserae.scale import settle
from tesserae.sources.footers import bounds_of_path
from tesserae.sources.points import PointColumns, scan_points

ITEMS = PointColumns("x", "y", "gene")
EVENTS = PointColumns("x", "y", "gene", "points_id")
LEAF = 1024.0
MAX_ROWS = 500


def item_points(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    label = F.concat(F.lit("  "), "l_returnflag", F.lit("-"), "l_linestatus", F.lit("\t"))
    return scan_points(
        items.select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), label.alias("gene")), ITEMS
    )


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return scan_points(
        events.select(
            F.col("user_id").alias("x"), F.col("value").alias("y"),
            F.col("event_type").alias("gene"), F.col("event_id").alias("points_id"),
        ),
        EVENTS,
    )


def part_points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items labelled by the name of their part: a wider dictionary."""
    items, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    return joined.select(
        F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("p_name").alias("gene")
    )


ITEM_SQL = """
points AS (SELECT l_extendedprice AS x, l_quantity AS y, '  ' || l_returnflag || '-' || l_linestatus || chr(9) AS gene,
                  regexp_replace('  ' || l_returnflag || '-' || l_linestatus || chr(9), '^\\s+|\\s+$', '', 'g') AS value
           FROM lineitem),
dict AS (SELECT value, n_points, row_number() OVER (ORDER BY value) - 1 AS value_id
         FROM (SELECT value, count(*) AS n_points FROM points GROUP BY value))"""

ENDS_SQL = """
ends AS (SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM points),
sizes AS (SELECT *, CASE WHEN greatest(x_max - x_min, y_max - y_min) <= 1024 THEN 1
                    ELSE CAST(ceil(log2(greatest(x_max - x_min, y_max - y_min) / 1024)) AS BIGINT) + 1 END AS n_levels
          FROM ends)"""

TILED_SQL = ITEM_SQL + "," + ENDS_SQL + """,
tiled AS (SELECT p.*, d.value_id, CAST(floor((x - x_min) / 1024.0) AS BIGINT) AS tile_x,
                 CAST(floor((y - y_min) / 1024.0) AS BIGINT) AS tile_y, n_levels - 1 AS level, x_min, y_min
          FROM points p JOIN dict d USING (value), sizes)"""


def tiled_items(spark: SparkSession, folder: str) -> tuple[DataFrame, T.TileGrid]:
    plan = plan_tiles(item_points(spark, folder), ITEMS, leaf=LEAF)
    return plan.annotated(), plan.grid


@query("scan_points", f"WITH {ITEM_SQL} SELECT gene, count(*) AS n, min(x) AS min_x, max(y) AS max_y FROM points GROUP BY gene")
def scan_points_query(spark, folder):
    return item_points(spark, folder).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("y").alias("max_y")
    )


@query("normalize_labels", f"WITH {ITEM_SQL} SELECT DISTINCT gene, value FROM points")
def normalize_labels(spark, folder):
    return item_points(spark, folder).select("gene").distinct().withColumn("value", normalize_label(F.col("gene")))


@query("validate_points", """
SELECT count(*) AS n_points, 0 AS bad_x, 0 AS bad_y, 0 AS missing_label, 0 AS empty_label,
       count(*) - count(event_id) AS missing_id, count(DISTINCT event_id) AS distinct_ids, CAST(NULL AS VARCHAR) AS problem
FROM events""")
def validate_points(spark, folder):
    return P.validate_points(event_points(spark, folder), EVENTS)


def faulty_points(spark, folder):
    """Events with infinite and missing coordinates, blank and missing labels and missing ids, by their attributes."""
    user, kind = F.col("user_id"), F.col("event_type")
    x = F.when(user % 11 == 0, F.lit(float("nan"))).when(user % 13 == 0, F.lit(float("-inf"))).when(user % 17 != 0, user.cast("double"))
    y = F.when(F.col("value") > 50, F.lit(float("inf"))).otherwise(F.col("value"))
    label = F.when(kind == "error", F.lit(None).cast("string")).when(kind == "click", F.lit(" \t\u00a0")).otherwise(kind)
    return table(spark, folder, "events").select(
        x.alias("x"), y.alias("y"), label.alias("gene"), F.when(user % 19 != 0, F.col("event_id")).alias("points_id")
    )


FAULTY_SQL = """
SELECT count(*) AS n_points, count_if(user_id % 11 = 0 OR user_id % 13 = 0 OR user_id % 17 = 0) AS bad_x, count_if(value > 50 OR value IS NULL) AS bad_y,
  count_if(event_type = 'error') AS missing_label, count_if(event_type = 'click') AS empty_label"""


@query("validate_points_faulty", FAULTY_SQL + """, count_if(user_id % 19 = 0) AS missing_id,
  count(DISTINCT CASE WHEN user_id % 19 <> 0 THEN event_id END) AS distinct_ids, 'bad_x' AS problem FROM events""")
def validate_points_faulty(spark, folder):
    return P.validate_points(faulty_points(spark, folder), EVENTS)


@query("fused_validation_faulty", FAULTY_SQL + """, 'bad_x' AS problem FROM events""")
def fused_validation_faulty(spark, folder):
    plain = PointColumns(x="x", y="y", label="gene")
    found = P.validation_of_profile(P.profile_points(faulty_points(spark, folder), plain).df, plain)
    return found.select("n_points", "bad_x", "bad_y", "missing_label", "empty_label", "problem")


@query("validate_points_duplicate_id", """
SELECT count(*) AS n_points, count(*) - count(l_extendedprice) AS bad_x, count(*) - count(l_quantity) AS bad_y,
       count(*) - count(l_returnflag) AS missing_label, 0 AS empty_label, 0 AS missing_id,
       count(DISTINCT l_orderkey || '/' || l_linenumber) AS distinct_ids, 'duplicate_id' AS problem
FROM lineitem""")
def validate_points_duplicate_id(spark, folder):
    items = table(spark, folder, "lineitem")
    named = items.select(
        F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_returnflag").alias("gene"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("points_id"),
    )
    return P.validate_points(named, EVENTS)


@query("value_counts_dictionary", f"WITH {ITEM_SQL} SELECT value_id, value, n_points FROM dict")
def value_counts_dictionary(spark, folder):
    return P.value_dictionary(item_points(spark, folder), "gene").values


@query("dense_value_ids", """
SELECT row_number() OVER (ORDER BY value) - 1 AS value_id, value, n_points
FROM (SELECT p_name AS value, count(*) AS n_points FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name)""")
def dense_value_ids(spark, folder):
    return P.value_dictionary(part_points(spark, folder), "gene").values


@query("filter_by_values", f"""
WITH {ITEM_SQL} SELECT y, x, value AS gene, value_id FROM points JOIN dict USING (value) WHERE value IN ('A-F', 'R-O')""")
def filter_by_values(spark, folder):
    points = item_points(spark, folder)
    dictionary = P.value_dictionary(points, "gene")
    return P.filter_by_values(points, ITEMS, dictionary, P.resolve_values(dictionary, [" R-O", "A-F "]))


@query("encode_labels", f"WITH {ITEM_SQL} SELECT x, y, value_id AS gene_id FROM points JOIN dict USING (value)")
def encode_labels(spark, folder):
    points = item_points(spark, folder)
    return P.encode_labels(points, ITEMS, P.value_dictionary(points, "gene"))


@query("join_dictionary", f"""
WITH dict AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS value_id
              FROM (SELECT DISTINCT p_name AS value FROM lineitem JOIN part ON l_partkey = p_partkey))
SELECT p_name AS gene, value_id, count(*) AS n, sum(l_quantity) AS total_y
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN dict ON p_name = value GROUP BY ALL""")
def join_dictionary(spark, folder):
    points = part_points(spark, folder)
    joined = P.join_dictionary(points, "gene", P.value_dictionary(points, "gene").values)
    return joined.groupBy("gene", "value_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total_y"))


@query("unknown_values", """
SELECT DISTINCT l_shipmode AS value FROM (SELECT p_type AS l_shipmode FROM part) WHERE l_shipmode NOT IN
  (SELECT event_type FROM events)""")
def unknown_values(spark, folder):
    dictionary = P.value_dictionary(event_points(spark, folder), "gene")
    return P.unknown_values(dictionary.values, table(spark, folder, "part").select("p_type"))


@query("sort_selection", f"""
WITH {ITEM_SQL} SELECT value_id, value, n_points FROM dict WHERE value IN ('N-O', 'A-F')""")
def sort_selection(spark, folder):
    dictionary = P.value_dictionary(item_points(spark, folder), "gene")
    return P.sort_selection(P.resolve_values(dictionary, ["N-O", "A-F"]))


@query("select_within_budget", """
SELECT least(count(*), 500) AS loaded, least(count(*), 500) AS distinct_ids, least(count(*), 500) AS from_source, least(count(*), 500) AS known_values
FROM events""")
def select_within_budget(spark, folder):
    """A sample has exactly the size of the budget, no row twice, and only rows and values of the source."""
    points = event_points(spark, folder)
    dictionary = P.value_dictionary(points, "gene")
    chosen = P.select_within_budget(points, EVENTS, dictionary, budget=500).points
    source = points.select("points_id", F.col("x").cast("float").alias("sx"), F.col("y").cast("float").alias("sy"), F.col("gene").alias("source_gene"))
    both = chosen.join(source, "points_id", "left").join(dictionary.values.select(F.col("value_id"), F.col("value").alias("named")), "value_id", "left")
    same = F.col("x").eqNullSafe(F.col("sx")) & F.col("y").eqNullSafe(F.col("sy")) & (F.col("gene") == F.col("source_gene"))
    return both.agg(
        F.count(F.lit(1)).alias("loaded"), F.count_distinct("points_id").alias("distinct_ids"), F.count_if(same).alias("from_source"),
        F.count_if(F.col("gene") == F.col("named")).alias("known_values"),
    )


@query("select_within_budget_exact", """
SELECT value AS y, user_id AS x, event_id AS points_id, event_type AS gene,
       (SELECT count(DISTINCT o.event_type) FROM events o WHERE o.event_type < e.event_type) AS value_id
FROM (SELECT CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS user_id, event_id, event_type
      FROM events) e""")
def select_within_budget_exact(spark, folder):
    points = event_points(spark, folder)
    chosen = P.select_within_budget(points, EVENTS, P.value_dictionary(points, "gene"), budget=10**9).points
    return chosen.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})


@query("selection_summary", """
SELECT count(*) AS loaded_count, count(*) AS total_count, 1000000000 AS budget, false AS is_sampled,
       CAST(NULL AS VARCHAR) AS warning FROM events WHERE event_type IN ('click', 'error')""")
def selection_summary(spark, folder):
    points = event_points(spark, folder)
    return P.select_within_budget(
        points, EVENTS, P.value_dictionary(points, "gene"), ["click", "error"], budget=10**9
    ).summary()


@query("fused_validation", f"""
WITH {ITEM_SQL} SELECT count(*) AS n_points, 0 AS bad_x, 0 AS bad_y, 0 AS missing_label, 0 AS empty_label,
  min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(NULL AS VARCHAR) AS problem FROM points""")
def fused_validation(spark, folder):
    return P.validation_of_profile(P.profile_points(item_points(spark, folder), ITEMS).df, ITEMS)


@query("bounds", """
SELECT min(l_extendedprice) AS x_min, max(l_extendedprice) AS x_max, min(l_quantity) AS y_min, max(l_quantity) AS y_max,
       min(l_extendedprice) AS x_origin, min(l_quantity) AS y_origin FROM lineitem""")
def bounds(spark, folder):
    return T.bounds(item_points(spark, folder))


@query("tile_levels", f"""
WITH {ITEM_SQL}, {ENDS_SQL}
SELECT level, 1024.0::DOUBLE * pow(2, n_levels - 1 - level) AS tile_size, level = n_levels - 1 AS is_exact
FROM (SELECT n_levels, unnest(range(0, n_levels)) AS level FROM sizes)""")
def tile_levels(spark, folder):
    return T.tile_levels(T.bounds(item_points(spark, folder)), LEAF)


@query("tile_annotate", f"""
WITH {TILED_SQL}
SELECT level || '/' || tile_x || '/' || tile_y AS tile_id, tile_x, tile_y,
       CAST(CAST(x - x_min - tile_x * 1024.0::DOUBLE AS FLOAT) AS DOUBLE) AS x_rel,
       CAST(CAST(y - y_min - tile_y * 1024.0::DOUBLE AS FLOAT) AS DOUBLE) AS y_rel, value_id AS gene_id
FROM tiled""")
def tile_annotate(spark, folder):
    tiled, _ = tiled_items(spark, folder)
    return tiled.withColumns({c: F.col(c).cast("double") for c in ("x_rel", "y_rel")})


TILE_COUNT_SQL = f"""
WITH {TILED_SQL}
SELECT level || '/' || tile_x || '/' || tile_y AS tile_id, tile_x, tile_y, value_id AS gene_id, count(*) AS n_points
FROM tiled GROUP BY ALL"""


@query("tile_counts", TILE_COUNT_SQL)
def tile_counts(spark, folder):
    tiled, grid = tiled_items(spark, folder)
    return T.tile_counts(tiled, grid.finest, "gene_id")


@query("tile_manifest", f"""
WITH {TILED_SQL}, numbered AS (
  SELECT level, tile_x, tile_y, (row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY x, y, gene) - 1) // {MAX_ROWS} AS shard
  FROM tiled)
SELECT level, level || '/' || tile_x || '/' || tile_y AS tile_id, tile_x, tile_y, count(*) AS n_points, shard AS tile_shard
FROM numbered GROUP BY ALL""")
def tile_manifest(spark, folder):
    tiled, grid = tiled_items(spark, folder)
    return T.tile_manifest(T.tile_counts(tiled, grid.finest), grid.finest, MAX_ROWS).withColumns(
        {"level": F.col("level").cast("long"), "tile_shard": F.col("tile_shard").cast("long")}
    )


@query("shard_rows", """
WITH ends AS (SELECT min(user_id) AS x0, min(value) AS y0 FROM events),
tiled AS (SELECT event_id AS points_id, CAST(floor((user_id - x0) / 64.0) AS BIGINT) AS tile_x,
                 CAST(floor((value - y0) / 64.0) AS BIGINT) AS tile_y FROM events, ends)
SELECT points_id, tile_x, tile_y, (row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY points_id) - 1) // 100 AS shard
FROM tiled""")
def shard_rows(spark, folder):
    points = event_points(spark, folder)
    grid = T.tile_grid(points, leaf=64.0)
    tiled = T.tile_annotate(points, grid, grid.finest)
    return T.shard_rows(tiled, "points_id", 100).select("points_id", "tile_x", "tile_y", "shard")


@query("tile_shard_number", """
WITH ends AS (SELECT min(user_id) AS x0, min(value) AS y0 FROM events),
chunks AS (SELECT 0 AS level, CAST(floor((user_id - x0) / 64.0) AS BIGINT) AS tile_x,
                  CAST(floor((value - y0) / 64.0) AS BIGINT) AS tile_y, event_type AS level_file, event_id // 1000 AS row_group,
                  count(*) AS n_points FROM events, ends GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY level, tile_x, tile_y ORDER BY level_file, row_group) - 1 AS tile_shard FROM chunks""")
def tile_shard_number(spark, folder):
    points = event_points(spark, folder)
    grid = T.tile_grid(points, leaf=64.0)
    tiled = T.tile_annotate(points, grid, grid.finest)
    chunks = tiled.groupBy(
        F.lit(0).cast("long").alias("level"), "tile_x", "tile_y", F.col("gene").alias("level_file"),
        F.floor(F.col("points_id") / 1000).alias("row_group"),
    ).agg(F.count(F.lit(1)).alias("n_points"))
    return T.tile_shard_number(chunks).withColumn("tile_shard", F.col("tile_shard").cast("long"))


@query("untile", f"WITH {ITEM_SQL} SELECT round(x, 2) AS x, round(y, 2) AS y, value_id AS gene_id FROM points JOIN dict USING (value)")
def untile(spark, folder):
    tiled, grid = tiled_items(spark, folder)
    return T.untile(tiled, grid, grid.finest).withColumns({c: F.round(c, 2) for c in ("x", "y")})


@query("grid_counts", f"""
WITH {ITEM_SQL} SELECT CAST(floor(x / 2048.0) AS BIGINT) AS cell_x, CAST(floor(y / 8.0) AS BIGINT) AS cell_y, value, count(*) AS n_points
FROM points GROUP BY ALL""")
def grid_counts(spark, folder):
    points = item_points(spark, folder)
    return T.grid_counts(points, 2048.0, 8.0, "gene").withColumn("value", normalize_label(F.col("gene"))).drop("gene")


@query("affine_transform", """
SELECT l_orderkey, l_linenumber, round(2.0 * l_extendedprice - 0.5 * l_quantity + 10.0, 6) AS x,
       round(0.25 * l_extendedprice + 1.5 * l_quantity - 3.0, 6) AS y FROM lineitem""")
def affine_transform(spark, folder):
    items = table(spark, folder, "lineitem")
    shift, stretch = Affine(xoff=10.0, yoff=-3.0), Affine(2.0, -0.5, 0.25, 1.5)
    affine = shift.after(stretch)
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    return items.select(
        "l_orderkey", "l_linenumber", F.round(affine.x(x, y), 6).alias("x"), F.round(affine.y(x, y), 6).alias("y")
    )


@query("display_titles", """
SELECT p_brand AS brand, p_type AS kind, CASE WHEN count(DISTINCT p_name) = 1 THEN p_brand || ': p_name=' || min(p_name)
         ELSE p_brand || ': ' || count(DISTINCT p_name) || ' p_name values' END AS selection,
       p_brand || CASE WHEN p_type = 'ECONOMY' THEN '[obs:' ELSE '[X:' END || min(p_name) || ']' AS styled,
       'Showing ' || format('{:,}', count(*)) || ' of ' || format('{:,}', CAST(sum(p_size) * 100 AS BIGINT))
         || ' selected points because the render point budget is 1,000.' AS warning
FROM part GROUP BY p_brand, p_type""")
def display_titles(spark, folder):
    grouped = table(spark, folder, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(
        F.count_distinct("p_name").alias("n"), F.min("p_name").alias("only"), F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("size")
    )
    source = F.when(F.col("kind") == "ECONOMY", "obs_column").otherwise("x_var")
    return grouped.select(
        "brand", "kind", X.selection_title(F.col("brand"), F.lit("p_name"), F.col("n"), F.lit("values"), F.col("only")).alias("selection"),
        X.styled_title(F.col("brand"), source, F.col("only")).alias("styled"),
        X.sampling_warning(F.col("rows"), F.col("size") * 100, F.lit(1000)).alias("warning"),
    )


COARSE_LEAF, COARSE_LEVELS, COARSE_CAPACITY, COARSE_CELLS, COARSE_SEED = 16.0, 4, 48, 4, 1


def apportion_sql(source: str, keys: str, item: str, count: str, target: str) -> str:
    """`source` with `quota`: what each item gets of its group's target, by weight `w`, in whole numbers."""
    before = f"PARTITION BY {keys} ORDER BY room / w, {item} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""(
  SELECT *, CAST(least({count}, each + base + CASE WHEN NOT is_full AND row_number() OVER (PARTITION BY {keys} ORDER BY part DESC NULLS LAST, {item})
    <= left_ - sum(CASE WHEN is_full THEN 0 ELSE base END) OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END) AS BIGINT) AS quota
  FROM (
    SELECT *, CASE WHEN is_full THEN room ELSE left_ * w // open_ END AS base, CASE WHEN NOT is_full THEN left_ * w % open_ END AS part
    FROM (
      SELECT *, rest - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER (PARTITION BY {keys}) AS left_,
        sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {keys}) AS open_
      FROM (
        SELECT *, room * (sum(w) OVER (PARTITION BY {keys}) - coalesce(sum(w) OVER ({before}), 0)) <= (rest - coalesce(sum(room) OVER ({before}), 0)) * w AS is_full
        FROM (
          SELECT *, {count} - each AS room, {target} - sum(each) OVER (PARTITION BY {keys}) AS rest
          FROM (SELECT *, CASE WHEN {target} >= count(*) OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END AS each FROM {source}))))))"""


def coarse_sql() -> str:
    cells, shift = COARSE_CELLS, COARSE_CELLS.bit_length() - 1
    parts = [f"""points AS (
  SELECT event_id AS id, event_type AS value, CAST(floor((user_id - x0) / {COARSE_LEAF / cells}) AS BIGINT) AS fx,
    CAST(floor((events.value - y0) / {COARSE_LEAF / cells}) AS BIGINT) AS fy,
    ('0x' || substr(md5('{COARSE_SEED}:' || event_type || ':' || event_id), 1, 15))::BIGINT AS h
  FROM events, (SELECT min(user_id) AS x0, min(value) AS y0 FROM events)),
kept_0 AS (SELECT *, fx >> {shift} AS tx, fy >> {shift} AS ty, (fy & {cells - 1}) * {cells} + (fx & {cells - 1}) AS cell FROM points),
counts_0 AS (SELECT tx AS px, ty AS py, cell, value, count(*) AS n FROM kept_0 GROUP BY ALL),
totals AS (SELECT value, CAST(sum(n) AS BIGINT) AS n FROM counts_0 GROUP BY value),
boosts AS (SELECT value, least(4, greatest(1, CAST(floor(sqrt((SELECT sum(n) / count(*) FROM totals) / n)) AS BIGINT))) AS boost FROM totals)"""]
    for k in range(COARSE_LEVELS):
        if k:
            parts.append(f"""counts_{k} AS (
  SELECT px >> 1 AS px, py >> 1 AS py, (py & 1) * 2 + (px & 1) AS cell, value, n
  FROM (SELECT px, py, value, CAST(sum(quota) AS BIGINT) AS n FROM quotas_{k - 1} WHERE quota > 0 GROUP BY ALL))""")
        strata = apportion_sql(f"strata_{k}", "px, py", "cell", "stratum", "goal")
        rows = apportion_sql(f"rows_{k}", "px, py, cell", "value", "n", "target")
        stratum = f"((ty >> {k - 1}) & 1) * 2 + ((tx >> {k - 1}) & 1)" if k else "k.cell"
        group = f"tx >> {k - 1}, ty >> {k - 1}" if k else "tx, ty, k.cell"
        parts.append(f"""strata_{k} AS (
  SELECT *, CAST(floor(sqrt(stratum::DOUBLE) * 1024) AS BIGINT) AS w, least({COARSE_CAPACITY << k}, sum(stratum) OVER (PARTITION BY px, py)) AS goal
  FROM (SELECT px, py, cell, CAST(sum(n) AS BIGINT) AS stratum FROM counts_{k} GROUP BY ALL)),
targets_{k} AS (SELECT px, py, cell, quota AS target FROM {strata}),
rows_{k} AS (
  SELECT px, py, cell, value, n, target, CAST(floor(sqrt(n::DOUBLE) * 1024) AS BIGINT) * boost AS w
  FROM counts_{k} JOIN boosts USING (value) JOIN targets_{k} USING (px, py, cell)),
quotas_{k} AS (SELECT px, py, cell, value, n, quota FROM {rows}),
kept_{k + 1} AS (
  SELECT k.* EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {group}, k.value ORDER BY h, id) AS r FROM kept_{k} k) k
  JOIN quotas_{k} q ON q.px = tx >> {k} AND q.py = ty >> {k} AND q.cell = {stratum} AND q.value = k.value WHERE r <= quota)""")
    levels = " UNION ALL ".join(f"SELECT id, value, tx, ty, {k} AS level FROM kept_{k + 1}" for k in range(COARSE_LEVELS))
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, value, tx AS tile_x, ty AS tile_y, max(level) AS coarsest FROM ({levels}) GROUP BY ALL"


def coarse_events(spark, folder):
    points = event_points(spark, folder)
    grid = T.tile_grid(points, leaf=COARSE_LEAF, n_levels=COARSE_LEVELS)
    return coarse_levels(points, grid, "points_id", "gene", capacity=COARSE_CAPACITY, cells=COARSE_CELLS, seed=COARSE_SEED)


@query("coarse_levels", coarse_sql())
def coarse_levels_query(spark, folder):
    """The sampled pyramid over the events: which points are kept, and up to which level."""
    return coarse_events(spark, folder).select(F.col("points_id").alias("id"), F.col("gene").alias("value"), "tile_x", "tile_y", "coarsest")


@query("coarse_tile_counts", f"""
SELECT level, tx >> level AS tile_x, ty >> level AS tile_y, value, count(*) AS n_points
FROM (SELECT value, tile_x AS tx, tile_y AS ty, coarsest FROM ({coarse_sql()})), (SELECT unnest(range({COARSE_LEVELS})) AS level)
WHERE coarsest >= level GROUP BY ALL""")
def coarse_tile_counts(spark, folder):
    """Points per level, tile and value: the manifest of the pyramid."""
    coarse = settle(coarse_events(spark, folder)).df
    levels = None
    for level in range(COARSE_LEVELS):
        counted = level_points(coarse, level).groupBy("tile_x", "tile_y", F.col("gene").alias("value")).agg(F.count(F.lit(1)).alias("n_points"))
        counted = counted.select(F.lit(level).cast("long").alias("level"), "*")
        levels = counted if levels is None else levels.unionAll(counted)
    return levels


@query("bounds_from_footers", """
SELECT min(l_extendedprice) AS x_min, max(l_extendedprice) AS x_max, min(l_quantity) AS y_min, max(l_quantity) AS y_max,
  min(l_extendedprice) AS x_origin, min(l_quantity) AS y_origin FROM lineitem""")
def bounds_from_footers(spark, folder):
    return bounds_of_path(spark, f"{folder}/lineitem.parquet", "l_extendedprice", "l_quantity")
