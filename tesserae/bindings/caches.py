"""Queries on center caches, persisted components, tiles on disk and saved classifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.bindings.images import PIXEL_SQL, foreground
from tesserae.bindings.points import EVENTS, LEAF, event_points, item_points, ITEMS
from tesserae.bindings.registry import query, table
from tesserae.operators import centers as C
from tesserae.operators import classify as M
from tesserae.operators import points as P
from tesserae.operators.set_tree import changed_buckets, set_digests, set_tree, updated_tree
from tesserae.plans.build_tiles import build_tiles
from tesserae.scale import ensure_checkpoint_dir, settle
from tesserae.sources import components as S
from tesserae.sources import raster as R
from tesserae.sources.footers import signature_of_path


def scratch(spark) -> str:
    """A fresh folder next to the session's checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def item_obs(spark, folder):
    """One row per object in the rasters."""
    return foreground(spark, folder).select("region", F.col("label").alias("instance_id")).distinct()


DIGEST_SQL = """
ids AS (SELECT DISTINCT l_returnflag AS region, l_suppkey AS id FROM lineitem WHERE l_suppkey > 0),
leaves AS (SELECT region, id >> 16 AS b, sha256(unhex(string_agg(lpad(lower(hex(id)), 16, '0'), '' ORDER BY id))) AS d FROM ids GROUP BY ALL),
level1 AS (SELECT region, b >> 16 AS b, sha256(unhex(string_agg(lpad(lower(hex(b)), 16, '0') || d, '' ORDER BY b))) AS d FROM leaves GROUP BY ALL),
level2 AS (SELECT region, b >> 16 AS b, sha256(unhex(string_agg(lpad(lower(hex(b)), 16, '0') || d, '' ORDER BY b))) AS d FROM level1 GROUP BY ALL),
roots AS (SELECT region, b >> 16 AS b, sha256(unhex(string_agg(lpad(lower(hex(b)), 16, '0') || d, '' ORDER BY b))) AS d FROM level2 GROUP BY ALL),
digests AS (
  SELECT roots.region, n AS n_obs, 'sha256-tree:' || sha256(unhex(
    lpad(lower(hex(length('tesserae/instance-set'))), 16, '0') || lower(hex(encode('tesserae/instance-set'))) || '0001'
    || lpad(lower(hex(length(roots.region))), 16, '0') || lower(hex(encode(roots.region))) || lpad(lower(hex(n)), 16, '0') || d)) AS digest
  FROM roots JOIN (SELECT region, count(*) AS n FROM ids GROUP BY region) c ON c.region = roots.region)"""


@query("region_binding_digest", f"WITH {DIGEST_SQL} SELECT region, n_obs, digest, CAST(NULL AS VARCHAR) AS problem FROM digests")
def region_binding_digest(spark, folder):
    return C.region_binding_digest(item_obs(spark, folder))


@query("region_binding_digest_problems", """
WITH rows AS (SELECT o_orderstatus AS region, o_custkey AS id FROM orders)
SELECT region, count(*) AS n_obs, CAST(NULL AS VARCHAR) AS digest, CASE WHEN min(id) <= 0 THEN 'not_positive' ELSE 'duplicate' END AS problem
FROM rows GROUP BY region""")
def region_binding_digest_problems(spark, folder):
    return C.region_binding_digest(table(spark, folder, "orders").select(F.col("o_orderstatus").alias("region"), F.col("o_custkey").alias("instance_id")))


def cache(spark, folder):
    """A cache over three regions: one as it should be, one computed from another raster size by an older algorithm, one
    without an entry; and the live regions."""
    obs, pixels = item_obs(spark, folder), foreground(spark, folder)
    live = settle(C.live_regions(obs, R.source_signature(pixels))).df
    stale = F.col("region") == "N"
    entry = C.region_entry(
        F.col("region"), F.when(stale, F.col("height") + 1).otherwise(F.col("height")), F.col("width"), F.col("dtype"), F.col("n_obs"),
        F.col("digest"), F.when(stale, 2).otherwise(1),
    )
    registry = C.registry_text(live.where("region <> 'R'").select("region", entry.alias("entry")), "region", "instance_id")
    from tesserae.operators.pixels import canonical_centers

    return obs, pixels, live, registry, canonical_centers(pixels, obs)


@query("center_cache_state", """
SELECT DISTINCT l_returnflag AS region, CASE l_returnflag WHEN 'A' THEN 'valid' WHEN 'N' THEN 'stale' ELSE 'partial' END AS state,
  CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN 'source_signature_mismatch,algorithm_version_mismatch' ELSE 'region_not_registered' END AS codes,
  CASE l_returnflag WHEN 'A' THEN 'reuse' WHEN 'N' THEN 'refresh' ELSE 'extend' END AS action FROM lineitem""")
def center_cache_state(spark, folder):
    _, _, live, registry, matrix = cache(spark, folder)
    return C.update_action(C.center_cache_state(live, registry, matrix, region_key="region", instance_key="instance_id"))


@query("center_cache_state_invalid", """
SELECT DISTINCT l_returnflag AS region, 'invalid' AS state, 'top_level_contract_mismatch' AS codes FROM lineitem""")
def center_cache_state_invalid(spark, folder):
    _, _, live, registry, matrix = cache(spark, folder)
    return C.center_cache_state(live, registry, matrix, region_key="sample", instance_key="instance_id")


@query("merge_centers", f"""
WITH {PIXEL_SQL}, centers AS (SELECT region, label AS instance_id, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM pixels GROUP BY ALL)
SELECT region, instance_id, CASE WHEN region = 'N' THEN -1.0 ELSE 0.0 END AS cz, CASE WHEN region = 'N' THEN -1.0 ELSE cy END AS cy,
  CASE WHEN region = 'N' THEN -1.0 ELSE cx END AS cx FROM centers""")
def merge_centers(spark, folder):
    obs, _, live, registry, matrix = cache(spark, folder)
    states = C.center_cache_state(live, registry, matrix, region_key="region", instance_key="instance_id")
    merged = C.merge_centers(obs, "R", matrix, matrix, states)
    return merged.withColumns({c: F.round(F.nanvl(c, F.lit(-1.0)), 6) for c in ("cz", "cy", "cx")})


@query("center_cache_update", """
SELECT DISTINCT l_returnflag AS region, 'refresh' AS action, l_returnflag <> 'R' AS registered, CASE WHEN l_returnflag = 'R' THEN 0 ELSE n END AS centers
FROM lineitem JOIN (SELECT l_returnflag AS r, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey > 0 GROUP BY 1) ON r = l_returnflag""")
def center_cache_update(spark, folder):
    obs, pixels, live, registry, matrix = cache(spark, folder)
    action, merged, text = C.update_centers(obs, "N", pixels, live, registry, matrix, region_key="region", instance_key="instance_id")
    counts = merged.groupBy("region").agg(F.count_if(~F.isnan("cy")).alias("centers"))
    entries = C.parse_entries(text).select("region", F.col("entry_ok").alias("registered"))
    return counts.join(entries, "region", "left").select(
        "region", F.lit(action).alias("action"), F.coalesce("registered", F.lit(False)).alias("registered"), "centers"
    )


def ordered_obs(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_pos"), F.col("c_mktsegment").alias("region"), F.col("c_custkey").alias("instance_id"), "c_acctbal"
    )


@query("write_table_components", """
SELECT 'obs' AS component, count(*) AS n FROM customer UNION ALL SELECT 'obsm/size', count(*) FROM customer
UNION ALL SELECT 'uns', count(DISTINCT c_mktsegment) FROM customer""")
def write_table_components(spark, folder):
    """Write, then write again with one matrix gone and the metadata grown, and count what is there."""
    path, obs = scratch(spark), ordered_obs(spark, folder)
    matrices = {k: obs.select("row_pos", F.array("c_acctbal").alias("features")) for k in ("size", "gone")}
    S.write_table_components(spark, path, ["obs", "obsm/size", "obsm/gone", "uns/colors"], obs=obs, obsm=matrices, uns={"colors/first": "[]"})
    names = [r[0] for r in obs.select("region").distinct().collect()]
    S.write_table_components(spark, path, ["obsm/gone", "uns/colors", "uns/colors/first"], uns={f"colors/{n}": "[]" for n in names})
    counts = None
    for component in ("obs", "obsm/size", "obsm/gone", "uns"):
        found = S.read_component(spark, path, component)
        if found is not None:
            row = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(component).alias("component"), "n")
            counts = row if counts is None else counts.unionByName(row)
    return counts


@query("reload_checked", "SELECT c_custkey AS row_pos, c_mktsegment AS region, c_custkey AS instance_id, c_acctbal FROM customer")
def reload_checked(spark, folder):
    path, obs = scratch(spark), ordered_obs(spark, folder)
    S.write_table_components(spark, path, ["obs/region"], obs=obs)
    return S.reload_checked(spark, path, obs)


@query("reload_problems", """
SELECT count(*) AS rows_memory, count(*) AS rows_disk, 0 AS unmatched_rows, count_if(c_acctbal < 0) AS region_changes, count_if(c_nationkey = 4) AS instance_changes,
  'region' AS problem FROM customer""")
def reload_problems(spark, folder):
    customer = table(spark, folder, "customer")
    disk = customer.select(
        F.col("c_custkey").alias("row_pos"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("region"),
        F.when(F.col("c_nationkey") == 4, -1).otherwise(F.col("c_custkey")).alias("instance_id"),
    )
    return S.reload_problems(ordered_obs(spark, folder), disk)


@query("write_value_dictionary", """
SELECT row_number() OVER (ORDER BY event_type) - 1 AS gene_id, event_type AS gene, count(*) AS n_transcripts FROM events GROUP BY event_type""")
def write_value_dictionary(spark, folder):
    path = scratch(spark)
    S.write_value_dictionary(P.value_dictionary(event_points(spark, folder), "gene").values, path)
    return spark.read.parquet(path)


@query("write_tiled_level", """
WITH ends AS (SELECT min(l_extendedprice) AS x0, min(l_quantity) AS y0 FROM lineitem)
SELECT CAST(floor((l_extendedprice - x0) / 1024.0) AS BIGINT) AS tile_x, CAST(floor((l_quantity - y0) / 1024.0) AS BIGINT) AS tile_y, count(*) AS n_points,
  true AS capped FROM lineitem, ends GROUP BY ALL""")
def write_tiled_level(spark, folder):
    """Tiles on disk: total per tile, and whether every shard is within its size."""
    manifest = build_tiles(item_points(spark, folder), ITEMS, scratch(spark), leaf=LEAF, max_rows=500)
    return manifest.groupBy("tile_x", "tile_y").agg(
        F.sum("n_points").alias("n_points"), F.bool_and(F.col("n_points") <= 500).alias("capped")
    )


@query("classifier_save_load", """
SELECT true AS same_columns, true AS same_predictions, count_if(embedding[2] <= CAST(0.2 AS DOUBLE)) AS n FROM embeddings""")
def classifier_save_load(spark, folder):
    """Save and load a forest, and compare both on all usable rows."""
    from tesserae.bindings.classification import objects
    from tesserae.sources.models import classifier_load, classifier_save

    rows, path = objects(spark, folder), scratch(spark)
    trained = M.train_classifier(M.resolve_scopes(rows, None, None), [f"f{i}" for i in range(64)], trees=5)
    classifier_save(trained, path)
    loaded = classifier_load(path)
    again = M.predict_classifier(rows, loaded).select("instance_id", F.col("pred_class").alias("again"))
    return M.predict_classifier(rows, trained).join(again, "instance_id").agg(
        F.lit(loaded.feature_columns == trained.feature_columns).alias("same_columns"),
        F.bool_and(F.col("pred_class") == F.col("again")).alias("same_predictions"), F.count(F.lit(1)).alias("n"),
    )


@query("signature_from_footers", f"""
WITH {PIXEL_SQL} SELECT region, 'scale0' AS scale, 'y,x' AS dims, max(y) + 1 AS height, max(x) + 1 AS width, 'int64' AS dtype FROM pixels GROUP BY region""")
def signature_from_footers(spark, folder):
    """Signatures of rasters that are stored with a folder per region."""
    path = scratch(spark)
    foreground(spark, folder).write.partitionBy("region").parquet(path)
    return signature_of_path(spark, path)


@query("set_tree_update", f"WITH {DIGEST_SQL} SELECT region, n_obs, digest FROM digests")
def set_tree_update(spark, folder):
    """Digests after the objects of the later half of the items came to those of the earlier half: only their paths are hashed again."""
    items = foreground(spark, folder)
    half = table(spark, folder, "lineitem").where("l_suppkey > 0").agg(F.percentile_approx("l_shipdate", 0.5)).first()[0]
    early = table(spark, folder, "lineitem").where((F.col("l_suppkey") > 0) & (F.col("l_shipdate") < half)).select(
        F.col("l_returnflag").alias("region"), F.col("l_suppkey").alias("instance_id")).distinct()
    every = items.select("region", F.col("label").alias("instance_id")).distinct()
    tree = settle(set_tree(early)).df
    return set_digests(updated_tree(tree, every.join(early, ["region", "instance_id"], "left_anti"), every))


@query("set_tree_changes", """
WITH ids AS (SELECT o_orderstatus AS region, o_custkey AS id, bool_or(o_totalprice > 100000) AS dear FROM orders GROUP BY ALL)
SELECT DISTINCT region, id >> 16 AS b FROM ids WHERE NOT dear""")
def set_tree_changes(spark, folder):
    """Buckets in which the customers of an order state differ from those with a dear order."""
    ids = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("region"), F.col("o_custkey").alias("instance_id"), "o_totalprice")
    trees = [settle(set_tree(rows.select("region", "instance_id").distinct())).df for rows in (ids, ids.where("o_totalprice > 100000"))]
    return changed_buckets(*trees)
