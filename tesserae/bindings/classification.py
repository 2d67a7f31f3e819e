"""Queries on object classification and annotation: embeddings as features, their labels as classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.bindings.registry import query, table
from tesserae.operators import annotate as A
from tesserae.operators import classify as C
from tesserae.plans import apply_model as APPLY
from tesserae.plans.apply_model import apply_classifier_to_pixels, feature_matrix


def objects(spark, folder):
    """Two regions by sign of the first feature; a NaN where the second is large; classes where the third is positive."""
    e = table(spark, folder, "embeddings")
    first = F.col("embedding")[0]
    features = F.transform(
        F.col("embedding"), lambda v, i: F.when((i == 1) & (v > 0.2), F.lit(float("nan"))).otherwise(v.cast("double"))
    )
    return e.select(
        F.when(first >= 0, "left").otherwise("right").alias("region"), (F.col("vec_id") + 1).alias("instance_id"), features.alias("features"),
        F.when(F.col("embedding")[2] > 0, F.col("label") + 1).cast("long").alias("user_class"),
    )


OBJECT_SQL = """
objects AS (SELECT CASE WHEN embedding[1] >= 0 THEN 'left' ELSE 'right' END AS region, vec_id + 1 AS instance_id,
            embedding[2] <= CAST(0.2 AS DOUBLE) AS valid, CASE WHEN embedding[3] > 0 THEN CAST(label + 1 AS BIGINT) END AS user_class FROM embeddings)"""


def given_predictions(spark, folder):
    """Predictions for usable rows of one region, from the stored labels."""
    rows = C.finite_feature_mask(objects(spark, folder)).where("feature_valid and region = 'left'")
    classes = table(spark, folder, "embeddings").select((F.col("vec_id") + 1).alias("instance_id"), (F.col("label") + 1).cast("long").alias("pred_class"))
    return rows.join(classes, "instance_id").select("region", "instance_id", "pred_class", (1 / F.col("pred_class")).alias("pred_confidence"))


def predicted_before(spark, folder):
    return objects(spark, folder).select(
        "region", "instance_id", F.col("user_class").alias("pred_class"), F.when(F.col("user_class").isNotNull(), F.lit(0.5)).alias("pred_confidence")
    )


@query("finite_feature_mask", f"WITH {OBJECT_SQL} SELECT instance_id, valid AS feature_valid FROM objects")
def finite_feature_mask(spark, folder):
    return C.finite_feature_mask(objects(spark, folder)).select("instance_id", "feature_valid")


@query("resolve_scopes", f"""
WITH {OBJECT_SQL} SELECT instance_id, true AS in_training, region = 'left' AS in_prediction, valid AS train_eligible,
  region = 'left' AND valid AS predict_eligible FROM objects""")
def resolve_scopes(spark, folder):
    scoped = C.resolve_scopes(objects(spark, folder), None, ["left"])
    return scoped.select("instance_id", "in_training", "in_prediction", "train_eligible", "predict_eligible")


@query("training_summary", f"""
WITH {OBJECT_SQL} SELECT count(*) AS training_rows, count_if(valid) AS training_eligible, count_if(region = 'left') AS prediction_rows,
  count_if(region = 'left' AND valid) AS prediction_eligible, count_if(valid AND user_class IS NOT NULL) AS labeled,
  count(DISTINCT user_class) FILTER (WHERE valid) AS classes, 64 AS n_features, count_if(NOT valid) AS training_excluded,
  count_if(region = 'left' AND NOT valid) AS prediction_excluded, 'ready' AS reason FROM objects""")
def training_summary(spark, folder):
    return C.training_summary(C.resolve_scopes(objects(spark, folder), None, ["left"]))


@query("training_classes", f"WITH {OBJECT_SQL} SELECT DISTINCT user_class FROM objects WHERE valid AND user_class IS NOT NULL")
def training_classes(spark, folder):
    return C.training_classes(C.resolve_scopes(objects(spark, folder), None, ["left"]))


def checked_predictions(predicted, scoped):
    """Per predicted object, whether its class was one to learn and its confidence is the largest of that many shares."""
    learned = scoped.where("train_eligible and user_class is not null").agg(F.collect_set("user_class")).scalar()
    known = F.array_contains(learned, F.col("pred_class"))
    sure = F.col("pred_confidence").between(1 / F.size(learned) - 1e-9, F.lit(1.0))
    return predicted.select("region", "instance_id", known.alias("class_is_known"), sure.alias("confidence_is_share"))


@query("train_classifier", f"""
WITH {OBJECT_SQL} SELECT region, instance_id, true AS class_is_known, true AS confidence_is_share FROM objects WHERE valid""")
def train_classifier(spark, folder):
    scoped = C.resolve_scopes(objects(spark, folder), None, None)
    trained = C.train_classifier(scoped, [f"f{i}" for i in range(64)], trees=20)
    return checked_predictions(C.predict_classifier(objects(spark, folder), trained), scoped)


@query("predict_classifier", f"""
WITH {OBJECT_SQL} SELECT region, instance_id, true AS class_is_known, true AS confidence_is_share FROM objects WHERE valid AND region = 'right'""")
def predict_classifier(spark, folder):
    scoped = C.resolve_scopes(objects(spark, folder), ["left"], ["right"])
    trained = C.train_classifier(scoped, [f"f{i}" for i in range(64)], trees=20)
    return checked_predictions(C.predict_classifier(objects(spark, folder).where("region = 'right'"), trained), scoped)


@query("classify_separable", f"""
WITH {OBJECT_SQL} SELECT region, instance_id, CASE WHEN region = 'left' THEN 1 ELSE 2 END AS pred_class FROM objects""")
def classify_separable(spark, folder):
    """Features of two values that give the class away are learned exactly."""
    rows = objects(spark, folder).withColumn("features", F.array(F.when(F.col("region") == "left", 0.0).otherwise(1.0), F.lit(3.0)))
    labeled = rows.withColumn("user_class", F.when(F.col("region") == "left", F.lit(1)).otherwise(F.lit(2)).cast("long"))
    trained = C.train_classifier(C.resolve_scopes(labeled, None, None), ["side", "constant"], trees=8)
    return C.predict_classifier(rows, trained).select("region", "instance_id", F.col("pred_class").cast("int").alias("pred_class"))


PREDICTED_SQL = OBJECT_SQL + """,
after AS (SELECT o.region, o.instance_id, CASE WHEN region = 'right' THEN user_class WHEN valid THEN CAST(label + 1 AS BIGINT) END AS pred_class,
          CASE WHEN region = 'right' THEN CASE WHEN user_class IS NOT NULL THEN 0.5::DOUBLE END WHEN valid THEN 1.0::DOUBLE / (label + 1) END AS pred_confidence,
          user_class AS old_class, CASE WHEN user_class IS NOT NULL THEN 0.5::DOUBLE END AS old_confidence
          FROM objects o JOIN embeddings ON vec_id + 1 = instance_id)"""


@query("write_predictions", f"WITH {PREDICTED_SQL} SELECT region, instance_id, pred_class, pred_confidence FROM after")
def write_predictions(spark, folder):
    return C.write_predictions(predicted_before(spark, folder), given_predictions(spark, folder), ["left"])


@query("prediction_change", f"""
WITH {PREDICTED_SQL} SELECT count_if(pred_class IS DISTINCT FROM old_class) AS class_changes,
  count_if(pred_confidence IS DISTINCT FROM old_confidence) AS confidence_changes FROM after""")
def prediction_change(spark, folder):
    before = predicted_before(spark, folder)
    return C.prediction_change(before, C.write_predictions(before, given_predictions(spark, folder), ["left"]))


@query("clear_predictions", f"""
WITH {OBJECT_SQL} SELECT region, instance_id, CASE WHEN region = 'right' THEN user_class END AS pred_class,
  CASE WHEN region = 'right' AND user_class IS NOT NULL THEN 0.5::DOUBLE END AS pred_confidence FROM objects""")
def clear_predictions(spark, folder):
    return C.clear_predictions(predicted_before(spark, folder), ["left"])


@query("prediction_summary", f"WITH {OBJECT_SQL} SELECT count_if(valid) AS predicted, count_if(NOT valid) AS skipped FROM objects WHERE region = 'left'")
def prediction_summary(spark, folder):
    return C.prediction_summary(objects(spark, folder), ["left"])


@query("state_invariants", f"""
WITH {OBJECT_SQL}, state AS (SELECT user_class - 1 AS user_class, CASE WHEN valid THEN user_class END AS pred_class,
  CASE WHEN user_class IS NOT NULL THEN user_class / 5.0::DOUBLE END AS pred_confidence FROM objects)
SELECT 'user_class_positive' AS rule, count_if(user_class <= 0) AS violations FROM state
UNION ALL SELECT 'pred_class_positive', count_if(pred_class <= 0) FROM state
UNION ALL SELECT 'missing_together', count_if((pred_class IS NULL) <> (pred_confidence IS NULL)) FROM state
UNION ALL SELECT 'confidence_in_unit', count_if(pred_confidence < 0 OR pred_confidence > 1) FROM state""")
def state_invariants(spark, folder):
    rows = C.finite_feature_mask(objects(spark, folder)).select(
        (F.col("user_class") - 1).alias("user_class"), F.when(F.col("feature_valid"), F.col("user_class")).alias("pred_class"),
        (F.col("user_class") / 5).alias("pred_confidence"),
    )
    return C.state_invariants(rows)


@query("observed_class_check", """
SELECT DISTINCT CAST(p_size AS BIGINT) AS category FROM part WHERE p_size NOT IN (SELECT label + 1 FROM embeddings)""")
def observed_class_check(spark, folder):
    observed = table(spark, folder, "part").select(F.col("p_size").alias("category"))
    declared = table(spark, folder, "embeddings").select((F.col("label") + 1).cast("long").alias("category")).distinct()
    return C.observed_class_check(observed, declared)


def matrices(spark, folder):
    """A matrix per brand: rows are parts; one brand has rows of two widths, another a column more."""
    extra = F.when(F.col("p_brand") == "Brand#3", F.pmod("p_size", F.lit(2))).when(F.col("p_brand") == "Brand#4", F.lit(1)).otherwise(F.lit(0))
    values = F.array_repeat(F.col("p_retailprice"), (F.lit(3) + extra).cast("int"))
    return table(spark, folder, "part").select(F.col("p_brand").alias("key"), values.alias("features"))


def matrix_metadata(spark, folder):
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("key")).distinct()
    return brands.where("key <> 'Brand#5'").select(
        "key", F.when(F.col("key") == "Brand#6", "other").otherwise("custom_obsm").alias("source_kind"),
        F.array(F.lit("a"), F.lit("b"), F.when(F.col("key") == "Brand#7", "").otherwise("c")).alias("feature_columns"),
    )


@query("inspect_feature_metadata", """
WITH keys AS (SELECT DISTINCT p_brand AS key, false AS missing FROM part UNION SELECT DISTINCT p_type, true FROM part),
states AS (SELECT key, CASE WHEN missing THEN 'missing_matrix' WHEN key = 'Brand#3' THEN 'invalid_matrix' WHEN key = 'Brand#5' THEN 'unregistered'
            WHEN key IN ('Brand#4', 'Brand#6', 'Brand#7') THEN 'registered_mismatched' ELSE 'registered_valid' END AS status, missing FROM keys)
SELECT key, status, CASE WHEN NOT missing THEN CASE WHEN key IN ('Brand#3', 'Brand#4') THEN 4 ELSE 3 END END AS n_features,
  CASE WHEN NOT missing AND key NOT IN ('Brand#5', 'Brand#7') THEN 3 END AS metadata_n_features FROM states""")
def inspect_feature_metadata(spark, folder):
    parts = table(spark, folder, "part")
    keys = parts.select(F.explode(F.array("p_brand", "p_type")).alias("key")).distinct()
    facts = C.matrix_facts(matrices(spark, folder))
    return C.inspect_feature_metadata(keys, facts, matrix_metadata(spark, folder), F.col("n_rows"))


@query("register_feature_metadata", """
SELECT key, CASE WHEN key = 'Brand#5' THEN 'Brand#5_0,Brand#5_1,Brand#5_2' WHEN key = 'Brand#7' THEN 'a,b,' ELSE 'a,b,c' END AS names
FROM (SELECT DISTINCT p_brand AS key FROM part)""")
def register_feature_metadata(spark, folder):
    facts = C.matrix_facts(matrices(spark, folder))
    registered = C.register_feature_metadata(facts, matrix_metadata(spark, folder), "Brand#5")
    return registered.select("key", F.array_join("feature_columns", ",").alias("names"))


@query("schema_compatible", """
SELECT key, CASE WHEN key = 'Brand#5' THEN 'no_metadata' WHEN key = 'Brand#7' THEN 'columns_differ'
  WHEN key IN ('Brand#3', 'Brand#4') THEN 'width_differs_from_metadata' END AS problem FROM (SELECT DISTINCT p_brand AS key FROM part)""")
def schema_compatible(spark, folder):
    facts = C.matrix_facts(matrices(spark, folder)).select("key", F.col("max_width").alias("live_width"))
    targets = facts.join(matrix_metadata(spark, folder), "key", "left")
    return C.schema_compatible(targets, F.lit(["a", "b", "c"]), F.lit(3)).select("key", "problem")


def item_objects(spark, folder):
    items = table(spark, folder, "lineitem")
    pixels = items.where("l_suppkey > 0").select(
        F.col("l_returnflag").alias("region"), F.col("l_suppkey").alias("label"), F.col("l_linenumber").cast("long").alias("y"),
        F.pmod("l_partkey", F.lit(512)).alias("x"), F.col("l_linestatus").alias("channel"), F.col("l_extendedprice").alias("value"),
    )
    return pixels.select("region", F.col("label").alias("instance_id")).distinct(), pixels


ITEM_OBJECT_SQL = """
items AS (SELECT DISTINCT l_returnflag AS region, l_suppkey AS instance_id FROM lineitem WHERE l_suppkey > 0)"""


@query("apply_model", f"""
WITH {ITEM_OBJECT_SQL} SELECT region, count(*) AS objects, CASE WHEN region = 'A' THEN 0 ELSE count(*) END AS predicted,
  CASE WHEN region = 'A' THEN 0 ELSE count(*) END AS of_known_classes FROM items GROUP BY region""")
def apply_model(spark, folder):
    """Train on one region whose classes follow from its features, then apply to the two others."""
    obs, pixels = item_objects(spark, folder)
    intensity, morphology = ["mean", "max"], ["area", "eccentricity"]
    features, names = feature_matrix(pixels, ["O", "F"], intensity, morphology)
    labeled = features.where("region = 'A'").withColumn("user_class", F.when(F.col("features")[0] > 52000, F.lit(2)).otherwise(F.lit(1)))
    trained = C.train_classifier(C.resolve_scopes(labeled, None, None), names, trees=10)
    written, _ = apply_classifier_to_pixels(
        obs, pixels, trained, ["N", "R"], ["A", "N", "R"], channels=["O", "F"], intensity=intensity, morphology=morphology
    )
    known = F.col("pred_class").isin(*trained.class_ids) & F.col("pred_confidence").between(0.5, 1.0)
    return written.groupBy("region").agg(
        F.count(F.lit(1)).alias("objects"), F.count("pred_class").alias("predicted"), F.count_if(known).alias("of_known_classes")
    )


@query("apply_from_path", f"""
WITH {ITEM_OBJECT_SQL} SELECT region, count(*) AS objects, CASE WHEN region = 'A' THEN 0 ELSE count(*) END AS predicted,
  'N=image N,R=image R' AS targets, '{{"1":"#FFFF00","2":"#1CE6FF"}}' AS palette, (SELECT count(*) FROM items WHERE region <> 'A') AS n_predicted_rows
FROM items GROUP BY region""")
def apply_from_path(spark, folder):
    """Save a classifier and a table, apply from their paths, and read back what was persisted."""
    from tesserae.bindings.caches import scratch
    from tesserae.sources.components import read_component, write_table_components
    from tesserae.sources.models import classifier_save

    obs, pixels = item_objects(spark, folder)
    features, names = feature_matrix(pixels, ["O", "F"], ["mean"], ["area"])
    labeled = features.where("region = 'A'").withColumn("user_class", F.when(F.col("features")[0] > 52000, F.lit(2)).otherwise(F.lit(1)))
    trained = C.train_classifier(C.resolve_scopes(labeled, None, None), names, trees=5)
    path = scratch(spark)
    classifier_save(trained, f"{path}/classifier")
    write_table_components(spark, f"{path}/table", ["obs"], obs=obs)
    # one image per region in the shared system, of a height of its own; another system lacks one of them
    sizes = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(F.count(F.lit(1)).alias("ny"))
    places = sizes.withColumn("coordinate_system", F.explode(F.array(F.lit("global"), F.when(F.col("region") != "R", F.lit("partial")))))
    both = places.where("coordinate_system is not null").select(
        "coordinate_system", "ny", F.explode(F.array(
            F.struct(F.col("region").alias("element"), F.lit("labels").alias("kind")),
            F.struct(F.concat(F.lit("image "), F.col("region")).alias("element"), F.lit("images").alias("kind")),
        )).alias("e"),
    )
    one, zero = F.lit(1.0), F.lit(0.0)
    catalog = both.select(
        "e.element", "e.kind", "coordinate_system", one.alias("a"), zero.alias("b"), zero.alias("d"), one.alias("e"), zero.alias("xoff"),
        zero.alias("yoff"), zero.alias("zoff"), F.lit(1).alias("nz"), "ny", F.lit(512).alias("nx"),
    )
    imaged = pixels.withColumn("image", F.concat(F.lit("image "), F.col("region")))
    APPLY.apply_from_path(
        spark, f"{path}/classifier", f"{path}/table", catalog, imaged, ["N", "R"], class_column="kind", confidence_column="sure"
    )
    notes = read_component(spark, f"{path}/table", "uns")
    applied = notes.where("path = 'applied/kind'").select("json").scalar()
    return read_component(spark, f"{path}/table", "obs").groupBy("region").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("kind").isin(1, 2) & F.col("sure").between(0.5, 1.0)).alias("predicted")
    ).withColumns({
        "targets": F.array_join(F.from_json(F.get_json_object(applied, "$.targets"), "array<string>"), ","),
        "palette": notes.where("path = 'colors/kind'").select("json").scalar(),
        "n_predicted_rows": F.get_json_object(applied, "$.n_predicted_rows").cast("long"),
    })


@query("apply_config", f"""
WITH {ITEM_OBJECT_SQL} SELECT true AS applied, CAST(NULL AS VARCHAR) AS classifier_path, '{{"trees":"5","seed":"{C.SEED}"}}' AS source_classifier_config,
  'table' AS table_name, 'features' AS feature_key, 'N' AS regions, count(*) AS n_predicted_rows, 0 AS n_skipped_feature_invalid_rows,
  'pred_class' AS pred_class_column, 'pred_confidence' AS pred_confidence_column, true AS stamp_is_utc FROM items WHERE region = 'N'""")
def apply_config(spark, folder):
    obs, pixels = item_objects(spark, folder)
    features, names = feature_matrix(pixels, ["O", "F"], ["mean"], [])
    labeled = features.withColumn("user_class", F.when(F.col("features")[0] > 52000, F.lit(2)).otherwise(F.lit(1)))
    trained = C.train_classifier(C.resolve_scopes(labeled, None, None), names, trees=5)
    row = apply_classifier_to_pixels(obs, pixels, trained, ["N"], ["A", "N", "R"], channels=["O", "F"], intensity=["mean"])[1]
    stamp = F.col("apply_timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    recent = F.abs(F.unix_timestamp(F.to_timestamp("apply_timestamp")) - F.unix_timestamp(F.current_timestamp())) < 86400
    return row.withColumn("regions", F.array_join("prediction_regions", ",")).withColumn("stamp_is_utc", stamp & recent).drop("apply_timestamp", "prediction_regions")


def annotated(spark, folder):
    """Orders annotated by priority, where it is not the lowest."""
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("region"), F.col("o_orderkey").alias("instance_id"),
        F.when(~F.col("o_orderpriority").like("5%"), F.col("o_orderpriority")).alias("note"), "o_totalprice",
    )


def matched_orders(spark, folder):
    return annotated(spark, folder).where("o_totalprice > 200000")


@query("annotation_effect", """
WITH rows AS (SELECT CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority END AS note FROM orders WHERE o_totalprice > 200000)
SELECT count(*) AS matched, count_if(note IS NULL) AS missing, count_if(note = '1-URGENT') AS equal, count_if(note <> '1-URGENT') AS other,
  count_if(note IS DISTINCT FROM '1-URGENT') AS changed, count_if(note = '1-URGENT') AS unchanged, count_if(note <> '1-URGENT') AS overwritten, 0 AS removed FROM rows""")
def annotation_effect(spark, folder):
    return A.annotation_effect(matched_orders(spark, folder), "note", "1-URGENT")


@query("set_user_class", """
SELECT o_orderstatus AS region, o_orderkey AS instance_id, CASE WHEN o_totalprice > 200000 THEN NULL WHEN o_orderstatus = 'F' THEN 3 END AS user_class FROM orders""")
def set_user_class(spark, folder):
    obs = annotated(spark, folder).select("region", "instance_id")
    first = A.set_user_class(obs, obs.where("region = 'F'"), 3)
    return A.set_user_class(first, matched_orders(spark, folder), None)


@query("change_count", "SELECT count_if(o_orderstatus = 'F') AS changed FROM orders")
def change_count(spark, folder):
    obs = annotated(spark, folder).select("region", "instance_id")
    return A.change_count(obs, A.set_user_class(obs, obs.where("region = 'F'"), 3), "user_class")


@query("query_ids_to_rows", """
SELECT o_orderstatus AS region, o_orderkey AS instance_id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def query_ids_to_rows(spark, folder):
    obs = annotated(spark, folder)
    heavy = table(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("instance_id"))
    matched = heavy.join(obs.select("region", "instance_id"), "instance_id")
    return A.query_ids_to_rows(obs, matched).select("region", "instance_id", "o_totalprice")


@query("annotate_guarded", """
SELECT o_orderstatus AS region, o_orderkey AS instance_id, o_totalprice,
  CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority END AS note FROM orders""")
def annotate_guarded(spark, folder):
    obs = annotated(spark, folder)
    snapshot = A.snapshot_of(obs, matched_orders(spark, folder), "note")
    prepared = A.PreparedAnnotation(snapshot, "note", "existing", "sha256:a", "sig")
    reviewed = A.annotation_effect(matched_orders(spark, folder), "note", "large").first().asDict()
    return A.annotate_guarded(obs, prepared, "large", reviewed, digest="sha256:a", signature="sig", cache_state="valid")
