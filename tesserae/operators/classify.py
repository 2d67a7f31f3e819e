"""Object classification on annotation tables with a feature array per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numeric import all_finite, is_finite
from tesserae.operators.points import problem_of
from tesserae.scale import settle

KEYS = ["region", "instance_id"]

# The default forest and the smallest training set.
TREES, SEED, MIN_LABELED = 100, 0, 2

SOURCE_KINDS = ("add_feature_matrix", "custom_obsm")


def finite_feature_mask(df: DataFrame, features: str = "features", out: str = "feature_valid") -> DataFrame:
    """True where every feature is finite."""
    return df.withColumn(out, all_finite(F.col(features)))


def in_scope(regions: Sequence[str] | None) -> Column:
    return F.lit(True) if regions is None else F.col("region").isin(list(regions))


def resolve_scopes(df: DataFrame, training: Sequence[str] | None, prediction: Sequence[str] | None) -> DataFrame:
    """Flags per row: in the training or prediction scope (None means all regions), and usable there."""
    valid = all_finite(F.col("features"))
    return df.withColumns(
        {
            "in_training": in_scope(training), "in_prediction": in_scope(prediction),
            "train_eligible": in_scope(training) & valid, "predict_eligible": in_scope(prediction) & valid,
        }
    )


def training_summary(scoped: DataFrame) -> DataFrame:
    """One row of counts over a scoped table and the first reason not to train (`ready` if none)."""
    labeled = F.col("train_eligible") & F.col("user_class").isNotNull()
    counts = scoped.agg(
        F.count_if("in_training").alias("training_rows"), F.count_if("train_eligible").alias("training_eligible"),
        F.count_if("in_prediction").alias("prediction_rows"), F.count_if("predict_eligible").alias("prediction_eligible"),
        F.count_if(labeled).alias("labeled"), F.count_distinct(F.when(labeled, F.col("user_class"))).alias("classes"),
        F.max(F.size("features")).cast("long").alias("n_features"),
    )
    rules = [
        (F.col("prediction_rows") == 0, "no_prediction_rows"),
        (F.col("prediction_eligible") == 0, "no_usable_prediction_rows"),
        (F.coalesce("n_features", F.lit(0)) == 0, "no_features"),
        ((F.col("training_rows") > 0) & (F.col("training_eligible") == 0), "no_usable_training_rows"),
        (F.col("labeled") < MIN_LABELED, "too_few_labels"),
        (F.col("classes") < 2, "too_few_classes"),
    ]
    return counts.withColumns(
        {
            "training_excluded": F.col("training_rows") - F.col("training_eligible"),
            "prediction_excluded": F.col("prediction_rows") - F.col("prediction_eligible"),
            "reason": F.coalesce(problem_of(rules), F.lit("ready")),
        }
    )


def training_classes(scoped: DataFrame) -> DataFrame:
    return scoped.where("train_eligible and user_class is not null").select("user_class").distinct()


@dataclass(frozen=True)
class Classifier:
    """A trained forest with what is needed to apply it elsewhere."""

    model: RandomForestClassificationModel
    class_ids: tuple[int, ...]
    feature_columns: tuple[str, ...]
    feature_key: str
    source_kind: str = "custom_obsm"
    config: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.feature_columns or any(not c for c in self.feature_columns):
            raise ValueError("A classifier needs at least one named feature column.")
        if len(self.feature_columns) != self.model.numFeatures:
            raise ValueError("The feature columns do not match the width of the model.")
        if self.source_kind not in SOURCE_KINDS:
            raise ValueError(f"source_kind must be one of {SOURCE_KINDS}.")


def train_classifier(
    scoped: DataFrame, feature_columns: Sequence[str], feature_key: str = "features", *,
    trees: int = TREES, seed: int = SEED, source_kind: str = "custom_obsm",
) -> Classifier:
    """Random forest on labelled, usable rows of the training scope. Class ids are indexed densely and mapped back."""
    # Training reads its rows many times: cut their lineage, which may reach back to pixels.
    kept = settle(scoped.where("train_eligible and user_class is not null").select("user_class", "features")).df
    rows = kept.select(
        F.col("user_class").cast("string").alias("class"), array_to_vector(F.col("features").cast("array<double>")).alias("vector")
    )
    index = StringIndexer(inputCol="class", outputCol="index", stringOrderType="alphabetAsc").fit(rows)
    if len(index.labels) < 2:
        raise ValueError("Training needs at least two labelled classes.")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="index", numTrees=trees, seed=seed)
    # The copy leaves out the training summary, which drags the session into every task that applies the model.
    model = forest.fit(index.transform(rows)).copy()
    return Classifier(
        model, tuple(int(v) for v in index.labels), tuple(feature_columns), feature_key, source_kind,
        {"trees": trees, "seed": seed},
    )


def predict_classifier(df: DataFrame, classifier: Classifier) -> DataFrame:
    """`region, instance_id, pred_class, pred_confidence` for rows with finite features."""
    usable = df.where(all_finite(F.col("features"))).select(
        *KEYS, array_to_vector(F.col("features").cast("array<double>")).alias("vector")
    )
    ids = F.lit(list(classifier.class_ids))
    return classifier.model.transform(usable).select(
        *KEYS, F.element_at(ids, F.col("prediction").cast("int") + 1).cast("long").alias("pred_class"),
        F.array_max(vector_to_array("probability")).alias("pred_confidence"),
    )


def _column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def write_predictions(
    obs: DataFrame, predictions: DataFrame, regions: Sequence[str] | None, *,
    class_column: str = "pred_class", confidence_column: str = "pred_confidence",
) -> DataFrame:
    """Clear every row in scope, then set the predicted ones; rows out of scope keep their values.

    `predictions` has one row per object; a class below one or an object out of scope stops the job.
    """
    fresh = predictions.select(
        *KEYS,
        F.when(F.col("pred_class") > 0, F.col("pred_class")).otherwise(
            F.raise_error(F.lit("Predicted classes must be positive.")).cast("long")
        ).alias("__class"),
        F.col("pred_confidence").alias("__confidence"),
    )
    joined = obs.join(fresh, KEYS, "left")
    scope = in_scope(regions)

    def merged(new: str, old: str, kind: str) -> Column:
        stray = F.raise_error(F.lit("A prediction lies outside the prediction scope.")).cast(kind)
        kept = F.when(F.col(new).isNotNull(), stray).otherwise(_column_or_null(obs, old, kind))
        return F.when(scope, F.col(new)).otherwise(kept)

    return joined.withColumns(
        {
            class_column: merged("__class", class_column, "long"),
            confidence_column: merged("__confidence", confidence_column, "double"),
        }
    ).drop("__class", "__confidence")


def clear_predictions(obs: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    """Missing class and confidence in scope. Columns that do not exist are not created."""
    present = [c for c in ("pred_class", "pred_confidence") if c in obs.columns]
    if len(present) == 1:
        raise ValueError("pred_class and pred_confidence must both exist or both be absent.")
    return obs.withColumns({c: F.when(~in_scope(regions), F.col(c)) for c in present})


def prediction_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows changed class or confidence, to skip a write that would change nothing."""
    old = before.select(
        *KEYS, _column_or_null(before, "pred_class", "long").alias("__class"),
        _column_or_null(before, "pred_confidence", "double").alias("__confidence"),
    )
    return after.join(old, KEYS).agg(
        F.count_if(~F.col("pred_class").eqNullSafe(F.col("__class"))).alias("class_changes"),
        F.count_if(~F.col("pred_confidence").eqNullSafe(F.col("__confidence"))).alias("confidence_changes"),
    )


def prediction_summary(df: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    """Rows in scope that can be predicted and rows skipped for unusable features."""
    valid = all_finite(F.col("features"))
    return df.where(in_scope(regions)).agg(
        F.count_if(valid).alias("predicted"), F.count_if(~valid).alias("skipped")
    )


def state_invariants(obs: DataFrame) -> DataFrame:
    """Violations of the classification columns as `(rule, violations)`; both prediction columns or neither."""
    has = {c: c in obs.columns for c in ("user_class", "pred_class", "pred_confidence")}
    rules: list[tuple[str, Column]] = []
    if has["user_class"]:
        rules.append(("user_class_positive", F.count_if(F.col("user_class") <= 0)))
    if has["pred_class"] != has["pred_confidence"]:
        rules.append(("both_columns", F.count(F.lit(1))))
    if has["pred_class"] and has["pred_confidence"]:
        confidence = F.col("pred_confidence")
        missing = confidence.isNull() | F.isnan(confidence)
        rules += [
            ("pred_class_positive", F.count_if(F.col("pred_class") <= 0)),
            ("missing_together", F.count_if(F.col("pred_class").isNull() != missing)),
            ("confidence_in_unit", F.count_if(~missing & ~(is_finite(confidence) & confidence.between(0, 1)))),
        ]
    if not rules:
        rules.append(("no_columns", F.lit(0).cast("long")))
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (n, _) in enumerate(rules)])
    return obs.agg(*[c.alias(f"v{i}") for i, (_, c) in enumerate(rules)]).select(F.inline(rows))


def observed_class_check(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed classes that are not declared categories, or not positive."""
    classes = observed.select(F.col("category").cast("long").alias("category")).where("category is not null").distinct()
    return classes.join(declared.select("category").distinct().withColumn("declared", F.lit(True)), "category", "left").where(
        F.col("declared").isNull() | (F.col("category") <= 0)
    ).select("category")


# Feature matrix metadata ------------------------------------------------------------------------------------------


def matrix_facts(matrices: DataFrame) -> DataFrame:
    """Live facts per matrix key from `(key, features)`: rows and the narrowest and widest row."""
    return matrices.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size("features")).alias("min_width"), F.max(F.size("features")).alias("max_width"),
        F.count_if(F.col("features").isNull()).alias("n_null"),
    )


def inspect_feature_metadata(keys: DataFrame, facts: DataFrame, metadata: DataFrame, n_obs: int | Column) -> DataFrame:
    """Status per key: missing_matrix, invalid_matrix, unregistered, registered_valid or registered_mismatched.

    `metadata` is `(key, source_kind, feature_columns array<string>)`.
    """
    n_obs = F.lit(n_obs) if isinstance(n_obs, int) else n_obs
    joined = keys.select("key").join(facts, "key", "left").join(
        metadata.withColumn("registered", F.lit(True)), "key", "left"
    )
    width = F.col("max_width")
    broken = (F.col("n_null") > 0) | (F.col("min_width") != width) | (F.col("n_rows") != n_obs)
    names = F.col("feature_columns")
    bad_names = names.isNull() | (F.size(names) == 0) | F.exists(names, lambda c: c.isNull() | (c == ""))
    bad_kind = ~F.coalesce(F.col("source_kind").isin(*SOURCE_KINDS), F.lit(False))
    mismatch = bad_kind | F.coalesce(bad_names, F.lit(True)) | (F.size(names) != width)
    status = (
        F.when(F.col("n_rows").isNull(), "missing_matrix").when(broken, "invalid_matrix")
        .when(F.col("registered").isNull(), "unregistered").when(mismatch, "registered_mismatched")
        .otherwise("registered_valid")
    )
    return joined.select(
        "key", status.alias("status"), width.cast("long").alias("n_features"),
        F.when(~bad_names, F.size(names)).cast("long").alias("metadata_n_features"),
    )


def register_feature_metadata(
    facts: DataFrame, metadata: DataFrame, key: str, *, feature_columns: Sequence[str] | None = None,
    overwrite: bool = False, dtype: str = "float64",
) -> DataFrame:
    """Metadata table with an entry for an existing matrix; default names are `key_0`, `key_1`, ..."""
    found = facts.where(F.col("key") == key).first()
    if found is None:
        raise ValueError(f"Feature matrix {key} is not available.")
    if found["n_null"] or found["min_width"] != found["max_width"]:
        raise ValueError(f"Feature matrix {key} has rows of different width.")
    width = found["max_width"]
    if feature_columns is None:
        names = [f"{key}_{i}" for i in range(width)]
    else:
        names = [str(c).strip() for c in feature_columns]
        if len(names) != width:
            raise ValueError(f"{len(names)} feature columns are named, but the matrix has {width}.")
        if any(not n for n in names) or len(set(names)) != len(names):
            raise ValueError("Feature columns must be non-empty and unique.")
    taken = metadata.where(F.col("key") == key).limit(1).count() > 0
    if taken and not overwrite:
        raise ValueError(f"Feature matrix {key} already has metadata; pass overwrite=True to replace it.")
    entry = facts.sparkSession.range(1).select(
        F.lit(key).alias("key"), F.lit("custom_obsm").alias("source_kind"), F.lit(names).alias("feature_columns"),
        F.lit(1).alias("schema_version"), F.lit("numpy").alias("backend"), F.lit(dtype).alias("dtype"),
        F.lit(["custom_obsm"]).alias("features"),
    )
    return metadata.where(F.col("key") != key).unionByName(entry, allowMissingColumns=True)


def schema_compatible(targets: DataFrame, model_columns: Column, model_width: Column) -> DataFrame:
    """`problem` per target matrix `(key, feature_columns, live_width)`: the names must be equal in order, and the live
    width must match both the names and the model."""
    names = F.col("feature_columns")
    rules = [
        (names.isNull(), "no_metadata"),
        (names != model_columns, "columns_differ"),
        (F.size(names) != F.col("live_width"), "width_differs_from_metadata"),
        (model_width != F.col("live_width"), "width_differs_from_model"),
    ]
    return targets.withColumn("problem", problem_of(rules))


def apply_config(
    spark, classifier: Classifier, *, table_name: str, regions: Sequence[str], predicted: int, skipped: int,
    classifier_path: str | None = None, class_column: str = "pred_class", confidence_column: str = "pred_confidence",
) -> DataFrame:
    """Provenance row of one apply run."""
    from tesserae.functions.text import utc_stamp

    return spark.range(1).select(
        F.lit(True).alias("applied"), utc_stamp().alias("apply_timestamp"), F.lit(classifier_path).cast("string").alias("classifier_path"),
        F.to_json(F.create_map(*[F.lit(str(v)) for kv in (classifier.config or {"": ""}).items() for v in kv])).alias("source_classifier_config"),
        F.lit(table_name).alias("table_name"), F.lit(classifier.feature_key).alias("feature_key"),
        F.lit(list(regions)).alias("prediction_regions"), F.lit(predicted).cast("long").alias("n_predicted_rows"),
        F.lit(skipped).cast("long").alias("n_skipped_feature_invalid_rows"),
        F.lit(class_column).alias("pred_class_column"), F.lit(confidence_column).alias("pred_confidence_column"),
    )
