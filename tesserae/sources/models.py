"""Saved classifiers: a model folder and one JSON line of metadata."""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession

from tesserae.operators.classify import Classifier

SCHEMA_VERSION = 1
KIND = "tesserae-object-classifier"
MODEL_TYPE = "RandomForestClassificationModel"


def classifier_save(classifier: Classifier, path: str) -> None:
    spark = SparkSession.active()
    classifier.model.write().overwrite().save(f"{path}/model")
    text = json.dumps(
        {
            "kind": KIND, "schema_version": SCHEMA_VERSION, "model_type": MODEL_TYPE, "class_ids": list(classifier.class_ids),
            "feature_columns": list(classifier.feature_columns), "feature_key": classifier.feature_key,
            "source_kind": classifier.source_kind, "config": classifier.config,
        }
    )
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def classifier_load(path: str) -> Classifier:
    """Load and check kind, schema version, model type and the agreement of names and model width."""
    spark = SparkSession.active()
    row = spark.read.text(f"{path}/metadata").first()
    if row is None:
        raise ValueError(f"{path} holds no classifier metadata.")
    data = json.loads(row[0])
    if data.get("kind") != KIND or data.get("model_type") != MODEL_TYPE:
        raise ValueError(f"{path} is not a saved object classifier.")
    if data.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"Classifier schema version {data.get('schema_version')!r} is not supported.")
    columns = data.get("feature_columns")
    if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
        raise ValueError("Classifier feature columns must be a list of names.")
    model = RandomForestClassificationModel.load(f"{path}/model")
    return Classifier(
        model, tuple(data["class_ids"]), tuple(columns), data["feature_key"], data["source_kind"], data["config"]
    )
