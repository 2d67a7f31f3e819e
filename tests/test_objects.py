import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions.digest import geometry_fingerprint
from tesserae.functions.numeric import Affine
from tesserae.operators import annotate as A
from tesserae.operators import centers as C
from tesserae.operators import classify as M
from tesserae.operators.pixels import canonical_centers
from tesserae.operators.regions import class_feature_rows
from tesserae.operators.tiles import TileGrid
from tesserae.plans.query_annotation import review_annotation
from tesserae.sources import components as S
from tesserae.sources import raster as R
from tesserae.sources.models import classifier_load, classifier_save
from tesserae.streaming.counts import streaming_tile_counts, streaming_value_counts

OBS = "region string, instance_id long"
NAMES = ["above", "share"]


def separable(spark, n=26):
    rows = [("a" if i % 2 else "b", i, [float(i > 13), i / n], 1 + (i > 13)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, OBS + ", features array<double>, user_class long")


@pytest.fixture(scope="module")
def trained(spark):
    return M.train_classifier(M.resolve_scopes(separable(spark), None, None), NAMES, trees=20)


def test_separable_classes_are_learned(spark, trained):
    df = separable(spark)
    got = {r.instance_id: (r.pred_class, r.pred_confidence) for r in M.predict_classifier(df, trained).collect()}
    assert all(c == 1 + (i > 13) and 0.5 < p <= 1 for i, (c, p) in got.items()) and len(got) == 26
    again = M.train_classifier(M.resolve_scopes(df, None, None), NAMES, trees=20)
    assert {r.instance_id: (r.pred_class, r.pred_confidence) for r in M.predict_classifier(df, again).collect()} == got


def test_sparse_class_ids_map_back(spark):
    df = separable(spark).withColumn("user_class", F.when(F.col("user_class") == 1, 40).otherwise(7))
    model = M.train_classifier(M.resolve_scopes(df, None, None), NAMES, trees=5)
    assert {r.pred_class for r in M.predict_classifier(df, model).collect()} == {7, 40} == set(model.class_ids)


def test_training_needs_two_classes(spark):
    df = separable(spark).withColumn("user_class", F.lit(1))
    with pytest.raises(ValueError, match="two"):
        M.train_classifier(M.resolve_scopes(df, None, None), NAMES, trees=5)


def test_save_and_load(spark, trained, tmp_path):
    path = str(tmp_path / "model")
    classifier_save(trained, path)
    loaded = classifier_load(path)
    assert (loaded.class_ids, loaded.feature_columns, loaded.config) == (trained.class_ids, trained.feature_columns, trained.config)
    text = spark.read.text(f"{path}/metadata").first()[0]
    for change in ({"schema_version": 2}, {"kind": "x"}, {"feature_columns": ["one"]}, {"feature_columns": "above"}):
        spark.createDataFrame([(json.dumps({**json.loads(text), **change}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        with pytest.raises(ValueError):
            classifier_load(path)


def reason(spark, rows, training=None, prediction=("a",)):
    df = spark.createDataFrame(rows, OBS + ", features array<double>, user_class long")
    return M.training_summary(M.resolve_scopes(df, training, list(prediction))).first()


NAN = float("nan")


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("b", 1, [1.0], 1)], "no_prediction_rows"),
        ([("a", 1, [NAN], 1)], "no_usable_prediction_rows"),
        ([("a", 1, [], 1)], "no_features"),
        ([("a", 1, [1.0], 1)], "too_few_labels"),
        ([("a", 1, [1.0], 1), ("a", 2, [1.0], 1)], "too_few_classes"),
        ([("a", 1, [1.0], 1), ("a", 2, [NAN], 2)], "too_few_labels"),
        ([("a", 1, [1.0], 1), ("b", 2, [1.0], 2)], "ready"),
    ],
)
def test_first_training_reason(spark, rows, expected):
    assert reason(spark, rows)["reason"] == expected


def test_no_usable_training_rows(spark):
    assert reason(spark, [("a", 1, [1.0], 1), ("b", 2, [NAN], 2)], training=["b"])["reason"] == "no_usable_training_rows"


def test_finite_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, NAN],), ([float("inf"), 0.0],), ([None, 1.0],), ([],), (None,)], "features array<double>")
    assert [r.feature_valid for r in M.finite_feature_mask(df).collect()] == [True, False, False, False, True, False]


def test_prediction_write_clears_its_scope_only(spark):
    obs = spark.createDataFrame([("a", 1, 9, 0.9), ("a", 2, 9, 0.9), ("b", 1, 9, 0.9)], OBS + ", pred_class long, pred_confidence double")
    kind = OBS + ", pred_class long, pred_confidence double"
    fresh = spark.createDataFrame([("a", 1, 3, 0.5)], kind)
    got = {(r.region, r.instance_id): (r.pred_class, r.pred_confidence) for r in M.write_predictions(obs, fresh, ["a"]).collect()}
    assert got == {("a", 1): (3, 0.5), ("a", 2): (None, None), ("b", 1): (9, 0.9)}
    bare = M.write_predictions(obs.select("region", "instance_id"), fresh, ["a"])
    assert {(r.region, r.instance_id): r.pred_class for r in bare.collect()} == {("a", 1): 3, ("a", 2): None, ("b", 1): None}
    with pytest.raises(Exception, match="positive"):
        M.write_predictions(obs, spark.createDataFrame([("a", 1, 0, 0.5)], kind), ["a"]).collect()
    with pytest.raises(Exception, match="scope"):
        M.write_predictions(obs, spark.createDataFrame([("b", 1, 2, 0.5)], kind), ["a"]).collect()
    assert M.clear_predictions(obs.select("region", "instance_id"), None).columns == ["region", "instance_id"]
    with pytest.raises(ValueError):
        M.clear_predictions(obs.drop("pred_class"), None)


def test_state_rules(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (1, None, 0.5), (2, 3, None), (3, 4, 1.5)], "user_class long, pred_class long, pred_confidence double")
    got = {r.rule: r.violations for r in M.state_invariants(df).collect()}
    assert got == {"user_class_positive": 1, "pred_class_positive": 0, "missing_together": 2, "confidence_in_unit": 1}
    assert M.state_invariants(df.drop("pred_class")).where("rule = 'both_columns'").first()["violations"] == 4


def test_register_metadata(spark):
    facts = M.matrix_facts(spark.createDataFrame([("m", [1.0, 2.0]), ("m", [3.0, 4.0]), ("bad", [1.0]), ("bad", [1.0, 2.0])], "key string, features array<double>"))
    empty = spark.createDataFrame([], "key string, source_kind string, feature_columns array<string>")
    assert M.register_feature_metadata(facts, empty, "m").first()["feature_columns"] == ["m_0", "m_1"]
    named = M.register_feature_metadata(facts, empty, "m", feature_columns=["x", " y "])
    assert named.first()["feature_columns"] == ["x", "y"]
    for key, options in (("none", {}), ("bad", {}), ("m", {"feature_columns": ["x"]}), ("m", {"feature_columns": ["x", "x"]}), ("m", {"feature_columns": ["x", ""]})):
        with pytest.raises(ValueError):
            M.register_feature_metadata(facts, empty, key, **options)
    with pytest.raises(ValueError, match="overwrite"):
        M.register_feature_metadata(facts, named, "m")
    assert M.register_feature_metadata(facts, named, "m", overwrite=True).count() == 1


def test_class_rows_fill_absent_columns(spark):
    df = spark.createDataFrame([("a", "2.0"), ("a", "x")], "region string, instance_id string")
    row = class_feature_rows(df).collect()
    assert len(row) == 1 and tuple(row[0]) == ("a", 2, None, None, None)


# Annotation -------------------------------------------------------------------------------------------------------


def notes(spark):
    return spark.createDataFrame([("r", 1, None), ("r", 2, "A"), ("r", 3, "B"), ("r", 4, "B")], OBS + ", note string")


def test_set_and_remove(spark):
    obs = notes(spark)
    chosen = obs.where("instance_id <= 3")
    effect = A.annotation_effect(chosen, "note", "C").first().asDict()
    assert effect == {"matched": 3, "missing": 1, "equal": 0, "other": 2, "changed": 3, "unchanged": 0, "overwritten": 2, "removed": 0}
    assert [r.note for r in A.annotate_matched(obs, chosen, "note", "C").orderBy("instance_id").collect()] == ["C", "C", "C", "B"]
    removed = A.annotation_effect(chosen, "note", None).first()
    assert (removed.removed, removed.unchanged, removed.overwritten) == (2, 1, 0)
    assert [r.note for r in A.annotate_matched(obs, chosen, "note", None).orderBy("instance_id").collect()] == [None, None, None, "B"]


@pytest.mark.parametrize(
    "column, value, mode",
    [
        ("region", "x", "existing"), ("absent", "x", "existing"), ("pred_class", "x", "existing"), ("note", "x", "new"), ("user_class", 1, "new"),
        ("fresh", None, "new"), ("note", " ", "existing"), ("note", 3, "existing"), ("note", True, "existing"), ("fresh", 0, "new"), ("note", "x", "other"),
    ],
)
def test_annotation_rejections(spark, column, value, mode):
    obs = notes(spark).withColumn("pred_class", F.lit(1))
    with pytest.raises(ValueError):
        A.annotate_matched(obs, obs.limit(1), column, value, mode)


def test_user_classes(spark):
    obs = notes(spark)
    chosen = obs.where("instance_id = 2")
    assert A.set_user_class(obs, chosen, None) is obs
    once = A.set_user_class(obs, chosen.union(chosen), 4)
    assert {r.instance_id: r.user_class for r in once.collect()} == {1: None, 2: 4, 3: None, 4: None}
    assert A.change_count(once, A.set_user_class(once, chosen, 4), "user_class").first()[0] == 0
    for bad in (0, True, -3, "x"):
        with pytest.raises(ValueError):
            A.set_user_class(obs, chosen, bad)


SQUARE = [[[(0.0, 0.0), (2.5, 0.0), (2.5, 2.5), (0.0, 2.5), (0.0, 0.0)]]]


def test_guarded_annotation(spark):
    obs = notes(spark).withColumns({"cz": F.lit(0.0), "cy": F.lit(1.0), "cx": F.col("instance_id").cast("double")})
    polygons = spark.createDataFrame([(0, SQUARE[0])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    reviewed = review_annotation(obs, obs, polygons, "note", "C", digest="d", signature="s", affine=Affine(a=1.0))
    assert reviewed.effect["matched"] == 2
    now = {"digest": "d", "signature": "s", "cache_state": "valid"}

    def apply(table=obs, expected=None, **changed):
        return A.annotate_guarded(table, reviewed.prepared, "C", expected or reviewed.effect, **{**now, **changed})

    assert {r.instance_id: r.note for r in apply().collect()} == {1: "C", 2: "C", 3: "B", 4: "B"}
    for changed in ({"digest": "x"}, {"signature": "x"}, {"cache_state": "stale"}):
        with pytest.raises(ValueError, match="changed"):
            apply(**changed)
    for table, name in (
        (obs.where("instance_id > 1"), "rows"), (obs.withColumn("note", F.lit("Z")), "values"), (obs.withColumn("cx", F.col("cx") + 1e-9), "centers"),
        (obs.drop("note"), "column"),
    ):
        with pytest.raises(ValueError, match=name):
            apply(table)
    with pytest.raises(ValueError, match="expected"):
        apply(expected={"matched": 5})


# Centers ----------------------------------------------------------------------------------------------------------


def python_digest(region, ids, domain=b"tesserae/instance-set"):
    """Ids in buckets of 65536 consecutive values, hashed; hashes in buckets of buckets; the root with a header."""
    text = region.encode()
    header = len(domain).to_bytes(8, "big") + domain + (1).to_bytes(2, "big") + len(text).to_bytes(8, "big") + text + len(ids).to_bytes(8, "big")
    level = {}
    for i in sorted(ids):
        level.setdefault(i >> 16, []).append(i.to_bytes(8, "big"))
    level = {b: hashlib.sha256(b"".join(parts)).digest() for b, parts in level.items()}
    for _ in range(3):
        above = {}
        for b in sorted(level):
            above.setdefault(b >> 16, []).append(b.to_bytes(8, "big") + level[b])
        level = {b: hashlib.sha256(b"".join(parts)).digest() for b, parts in above.items()}
    return "sha256-tree:" + hashlib.sha256(header + level[0]).hexdigest()


def test_digest_is_byte_exact(spark):
    sets = {"a": [5, 1, 70000, 2**40], "é b": [3], "big": list(range(1, 2000, 3)), "edge": [65535, 65536, 131071, 131072, 2**32 - 1, 2**32]}
    df = spark.createDataFrame([(r, i) for r, ids in sets.items() for i in ids], OBS).repartition(5)
    got = {r.region: (r.n_obs, r.digest, r.problem) for r in C.region_binding_digest(df).collect()}
    assert got == {r: (len(ids), python_digest(r, ids), None) for r, ids in sets.items()}
    other = C.region_binding_digest(df, domain="other").where("region = 'a'").first()
    assert other.digest == python_digest("a", sets["a"], b"other")


def test_digest_tells_sets_apart(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 70000, 2**33, 2**50)], OBS)
    digest = C.region_binding_digest(df).first().digest
    assert digest == C.region_binding_digest(df.repartition(3)).first().digest
    assert digest != C.region_binding_digest(df.where("instance_id <> 70000").union(spark.createDataFrame([("a", 70001)], OBS))).first().digest


@pytest.mark.parametrize("ids, problem", [([1, 1], "duplicate"), ([0, 1], "not_positive"), ([-1], "not_positive"), ([None, 1], "not_positive")])
def test_digest_rejections(spark, ids, problem):
    row = C.region_binding_digest(spark.createDataFrame([("a", i) for i in ids], OBS)).first()
    assert row.problem == problem and row.digest is None


LINK = {"region_key": "region", "instance_key": "instance_id"}


@pytest.fixture(scope="module")
def cached(spark):
    """Two regions, their rasters, and a complete valid cache."""
    pixels = spark.createDataFrame(
        [(r, i, y, x) for r in ("a", "b") for i in (1, 2) for y in range(3) for x in range(i * 2)], "region string, label long, y long, x long"
    ).cache()
    obs = spark.createDataFrame([(r, i) for r in ("a", "b") for i in (1, 2)], OBS)
    live = C.live_regions(obs, R.source_signature(pixels)).cache()
    entries = live.select("region", C.region_entry(F.col("region"), F.col("height"), F.col("width"), F.col("dtype"), F.col("n_obs"), F.col("digest")).alias("entry"))
    return obs, pixels, live, C.registry_text(entries, **LINK).cache(), canonical_centers(pixels, obs).cache()


def state(live, registry, matrix, region="a", **options):
    row = C.center_cache_state(live, registry, matrix, **{**LINK, **options}).where(F.col("region") == region).first()
    return row.state, row.codes


def rewritten(spark, registry, change):
    data = json.loads(registry.first()[0])
    change(data)
    return spark.createDataFrame([(json.dumps(data, separators=(",", ":")),)], "registry string")


def test_cache_states(spark, cached):
    _, _, live, registry, matrix = cached
    assert state(live, registry, matrix) == ("valid", "")
    assert state(live, None, None) == ("absent", "")
    assert state(live, None, matrix) == ("invalid", "matrix_without_metadata")
    assert state(live, registry, None) == ("invalid", "metadata_without_matrix")
    assert state(live, registry, matrix, matrix_problem="not float64") == ("invalid", "matrix_invalid")
    assert state(live, registry, matrix, region_key="other") == ("invalid", "top_level_contract_mismatch")
    assert state(live.withColumn("width", F.col("width") + 1), registry, matrix) == ("stale", "source_signature_mismatch")
    assert state(live.withColumn("n_obs", F.col("n_obs") + 1), registry, matrix) == ("stale", "table_signature_mismatch")
    assert state(live, registry, matrix.withColumn("cz", F.lit(1.0))) == ("stale", "region_coordinates_invalid")
    assert state(live, registry, matrix.withColumn("cy", F.lit(float("nan")))) == ("stale", "region_coordinates_invalid")


@pytest.mark.parametrize(
    "change, expected",
    [
        (lambda d: d.update(schema_version=2), ("invalid", "schema_version_unsupported")),
        (lambda d: d.pop("schema_version"), ("invalid", "top_level_contract_mismatch")),
        (lambda d: d.update(schema_version="x"), ("invalid", "metadata_invalid")),
        (lambda d: d.update(extra=1), ("invalid", "top_level_contract_mismatch")),
        (lambda d: d.update(axes=["x", "y", "z"]), ("invalid", "top_level_contract_mismatch")),
        (lambda d: d.update(region_key=""), ("invalid", "metadata_invalid")),
        (lambda d: d["regions"]["b"].update(extra=1), ("invalid", "region_metadata_invalid")),
        (lambda d: d["regions"]["b"]["coverage"].update(n_obs=0), ("invalid", "region_metadata_invalid")),
        (lambda d: d["regions"]["b"]["coverage"].update(instance_set_digest="sha256:1"), ("invalid", "region_metadata_invalid")),
        (lambda d: d["regions"]["b"]["source"].update(dtype="float64"), ("invalid", "region_metadata_invalid")),
        (lambda d: d["regions"]["b"]["calculation"].pop("method"), ("invalid", "region_metadata_invalid")),
        (lambda d: d["regions"]["b"].update(generated_by={"package": "p"}), ("valid", "")),
        (lambda d: d["regions"].pop("a"), ("partial", "region_not_registered")),
        (lambda d: d["regions"]["a"]["calculation"].update(algorithm_version=2), ("stale", "algorithm_version_mismatch")),
    ],
)
def test_registry_contract(spark, cached, change, expected):
    _, _, live, registry, matrix = cached
    assert state(live, rewritten(spark, registry, change), matrix) == expected


def test_cache_update(spark, cached):
    obs, pixels, live, registry, matrix = cached
    args = (obs, "a", pixels, live)
    action, same, text = C.update_centers(*args, registry, matrix, **LINK)
    assert action == "reuse" and same is matrix and text is registry
    assert C.update_centers(*args, registry, matrix, **LINK, force=True)[0] == "refresh"
    action, fresh, text = C.update_centers(*args, None, None, **LINK)
    assert action == "create" and fresh.where("region = 'a' and isnan(cy)").count() == 0 and fresh.where("region = 'b' and isnan(cy)").count() == 2
    action, both, text = C.update_centers(obs, "b", pixels, live, text, fresh, **LINK)
    assert action == "extend" and both.where("isnan(cy)").count() == 0
    assert state(live, text, both) == state(live, text, both, region="b") == ("valid", "")
    broken = rewritten(spark, registry, lambda d: d.update(schema_version=9))
    action, rebuilt, text = C.update_centers(*args, broken, matrix, **LINK)
    assert action == "rebuild" and rebuilt.where("region = 'b' and isnan(cy)").count() == 2
    with pytest.raises(ValueError, match="no center"):
        C.update_centers(obs, "a", pixels.where("label = 1"), live, None, None, **LINK)


def test_fingerprint_depends_on_order(spark):
    def shapes(order):
        rows = [("e", p, "polygon", [(float(i), 1.0)]) for p, i in enumerate(order)]
        return spark.createDataFrame(rows, "element string, row_pos long, shape_type string, ring array<struct<x:double,y:double>>")

    first = geometry_fingerprint(shapes([1, 2, 3])).first()
    assert first.n_rows == 3 and first == geometry_fingerprint(shapes([1, 2, 3]).repartition(3)).first()
    assert geometry_fingerprint(shapes([2, 1, 3])).first().fingerprint != first.fingerprint


# Components and streams -------------------------------------------------------------------------------------------


def test_components(spark, tmp_path):
    path = str(tmp_path / "table")
    obs = spark.createDataFrame([(0, "a", 1), (1, "a", 2)], "row_pos long, region string, instance_id long")
    matrix = spark.createDataFrame([(0, [1.0])], "row_pos long, features array<double>")
    S.write_table_components(spark, path, ["obs/x", "obsm/m", "uns/p/q", "uns/p"], obs=obs, obsm={"m": matrix}, uns={"p/q": "1", "p/r": "2", "z": "3"})
    assert sorted(r.path for r in S.read_component(spark, path, "uns").collect()) == ["p/q", "p/r"]
    S.write_table_components(spark, path, ["uns/z", "uns/p/q"], uns={"z": "3"})
    assert sorted(r.path for r in S.read_component(spark, path, "uns").collect()) == ["p/r", "z"]
    S.write_table_components(spark, path, ["obsm/m"])
    assert S.read_component(spark, path, "obsm/m") is None and S.read_component(spark, path, "obs").count() == 2
    changed = S.read_component(spark, path, "obs").withColumn("seen", F.lit(True))
    S.write_table_components(spark, path, ["obs/seen"], obs=changed)
    assert S.reload_checked(spark, path, obs).columns == ["row_pos", "region", "instance_id", "seen"]
    for memory, problem in (
        (obs.limit(1), "row_count"), (obs.withColumn("row_pos", F.col("row_pos") + 5), "row_identity"), (obs.withColumn("region", F.lit("b")), "region"),
        (obs.withColumn("instance_id", F.lit(1)), "instance"),
    ):
        with pytest.raises(ValueError, match=problem):
            S.reload_checked(spark, path, memory)
    for bad in ([], ["X"], ["obsm"], ["uns"], ["other/x"]):
        with pytest.raises(ValueError):
            S.write_table_components(spark, path, bad)


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = [(float(i % 9), float(i % 5), " g " if i % 2 else "h") for i in range(200)]
    folder = str(tmp_path / "points")
    spark.createDataFrame(rows, "x double, y double, gene string").repartition(4).write.parquet(folder)
    stream = spark.readStream.schema("x double, y double, gene string").option("maxFilesPerTrigger", 1).parquet(folder)
    grid = TileGrid(0.0, 0.0, 9.0, 5.0, 4.0, 1)
    for name, counted in (("by_value", streaming_value_counts(stream, "gene")), ("by_tile", streaming_tile_counts(stream, grid, 0))):
        query = counted.writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert {r.value: r.n_points for r in spark.table("by_value").collect()} == {"g": 100, "h": 100}
    assert spark.table("by_tile").agg(F.sum("n_points")).first()[0] == 200
