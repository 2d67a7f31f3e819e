"""Table components as parquet folders: `obs`, `obsm/<key>` and `uns` (path and JSON text), each written on its own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.points import problem_of
from tesserae.sources.files import delete, exists, replace_folder


def _overwrite(df: DataFrame, path: str) -> None:
    """Replace a folder, which the plan itself may read, once the new rows are written."""
    replace_folder(df.sparkSession, path, df.write.parquet)


def write_value_dictionary(values: DataFrame, path: str) -> None:
    """`gene_id, gene, n_transcripts` with a fixed schema in id order."""
    rows = values.select(
        F.col("value_id").cast("long").alias("gene_id"), F.col("value").cast("string").alias("gene"), F.col("n_points").cast("long").alias("n_transcripts")
    ).orderBy("gene_id")
    _overwrite(rows, path)


def write_table_components(
    spark: SparkSession, path: str, selected: Iterable[str], *, obs: DataFrame | None = None,
    obsm: Mapping[str, DataFrame] | None = None, uns: Mapping[str, str] | None = None,
) -> list[str]:
    """Persist only the selected components, named `obs[/column]`, `obsm/key` or `uns/a/b`.

    Any obs name writes the whole table. A selected entry that is absent in memory is deleted on disk. Paths below
    another selected uns path are redundant.
    """
    wanted = sorted(set(selected))
    if not wanted:
        raise ValueError("Select at least one table component.")
    unknown = [w for w in wanted if w.split("/")[0] not in ("obs", "obsm", "uns") or (w != "obs" and "/" not in w)]
    if unknown:
        raise ValueError(f"Unknown table component(s): {unknown}.")
    if any(w == "obs" or w.startswith("obs/") for w in wanted):
        if obs is None:
            raise ValueError("The obs table is needed to persist it.")
        _overwrite(obs, f"{path}/obs")
    for key in [w.removeprefix("obsm/") for w in wanted if w.startswith("obsm/")]:
        if obsm and key in obsm:
            _overwrite(obsm[key], f"{path}/obsm/{key}")
        else:
            delete(spark, f"{path}/obsm/{key}")
    prefixes = [w.removeprefix("uns/") for w in wanted if w.startswith("uns/")]
    prefixes = [p for p in prefixes if not any(q != p and p.startswith(q + "/") for q in prefixes)]
    if prefixes:
        under = F.lit(False)
        for p in prefixes:
            under = under | (F.col("path") == p) | F.col("path").startswith(p + "/")
        fresh = [(k, v) for k, v in (uns or {}).items() if any(k == p or k.startswith(p + "/") for p in prefixes)]
        table = spark.createDataFrame(fresh, "path string, json string")
        if exists(spark, f"{path}/uns"):
            table = spark.read.parquet(f"{path}/uns").where(~under).unionByName(table)
        _overwrite(table, f"{path}/uns")
    return wanted


def read_component(spark: SparkSession, path: str, component: str) -> DataFrame | None:
    folder = f"{path}/{component}"
    return spark.read.parquet(folder) if exists(spark, folder) else None


def reload_problems(memory: DataFrame, disk: DataFrame, row_pos: str = "row_pos") -> DataFrame:
    """Whether a reload may replace rows: both sides are matched on their row position. One row of counts and `problem`."""
    def text(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("string")

    joined = memory.alias("m").join(disk.alias("d"), F.col(f"m.{row_pos}") == F.col(f"d.{row_pos}"), "full")
    both = F.col(f"m.{row_pos}").isNotNull() & F.col(f"d.{row_pos}").isNotNull()
    counts = joined.agg(
        F.count(f"m.{row_pos}").alias("rows_memory"), F.count(f"d.{row_pos}").alias("rows_disk"),
        F.count_if(~both).alias("unmatched_rows"),
        F.count_if(both & ~text("m", "region").eqNullSafe(text("d", "region"))).alias("region_changes"),
        F.count_if(both & ~text("m", "instance_id").eqNullSafe(text("d", "instance_id"))).alias("instance_changes"),
    )
    rules = [
        (F.col("rows_memory") != F.col("rows_disk"), "row_count"), (F.col("unmatched_rows") > 0, "row_identity"),
        (F.col("region_changes") > 0, "region"), (F.col("instance_changes") > 0, "instance"),
    ]
    return counts.withColumn("problem", problem_of(rules))


def reload_checked(spark: SparkSession, path: str, memory: DataFrame, row_pos: str = "row_pos") -> DataFrame:
    """The persisted table, if its rows are those in memory, row by row."""
    disk = read_component(spark, path, "obs")
    if disk is None:
        raise ValueError(f"{path} holds no obs component.")
    absent = [c for c in ("region", "instance_id", row_pos) if c not in disk.columns]
    if absent:
        raise ValueError(f"The persisted table lacks linkage column(s): {', '.join(absent)}.")
    found = reload_problems(memory, disk, row_pos).first()
    if found["problem"]:
        raise ValueError(f"The persisted table does not match the one in memory: {found['problem']}.")
    return disk
