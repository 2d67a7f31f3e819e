"""From raw documents to token ids: toxicity, near duplicates, repeated passages, benchmark passages, encoding.

`STAGES` lists the stages in order. Each takes (spark, docs, folder of tables) and returns a DataFrame; all but the last return
the columns of `documents`. `run` applies them one after the other and writes each result as a table in the shared folder.
A stage starts when its input is written, and frees what the one before it sent to the workers.

Each stage takes null, empty, blank and very long texts, null and repeated ids, repeated rows, empty tables and extra columns of
any name; what becomes of them is stated at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import byte_bpe, jaccard_join, string_tiling, suffix_array, toxicity
from tesserae.llm.shared import new_stage, stored

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the network, trained on the labelled rows of `docs`, scores under the threshold.

    Texts without words stay, and so does everything if no row has a label. Rows alike in text share their fate, also without an id.
    """
    new_stage(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each component of similar documents.

    Texts without words have no component and stay; so do rows without an id. Rows of an id that is repeated stay or go together.
    """
    new_stage(spark)
    return jaccard_join.one_per_component(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the byte strings that a document with a smaller id has as well.

    Every row stays. A null text stays null, a text that is a copy becomes empty, and `n_chars` follows the text. Texts of rows without
    an id, and repeats within one document, stay as they are.
    """
    new_stage(spark)
    return suffix_array.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that don't hold most of a benchmark item.

    Items without a text, or with fewer than five words, hit nothing; an item counts without an id, too. Texts without words stay.
    """
    new_stage(spark)
    return string_tiling.without_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to. A null text has no tokens; all rows stay."""
    new_stage(spark)
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
