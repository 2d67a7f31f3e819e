"""Parquet files with one tile per row group, written by the tasks that hold the tiles.

Spark's writer closes a row group by its bytes, so that a group holds parts of many tiles. Here a task gets rows in tile order, closes
a row group where a tile ends or is full, and reports each group. A reader that knows the group's number reads that
tile alone. A task writes under a name of its own and renames the file when it is complete: an attempt that fails leaves no
file that counts, and one that is repeated puts the same groups in the same place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.scale import ship_package
from tesserae.sources.files import hadoop_path, qualified

REPORT = "part int, level_file string, row_group int, tile_x long, tile_y long, n_points long"
FOOTERS_PER_TASK = 64


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI that `qualified` gave."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def file_name(part: int) -> str:
    return f"part-{part:06d}.parquet"


class _File:
    """One file being written, and the rows of the tile that is open."""

    def __init__(self, uri: str, part: int, level: int, columns: list[str], max_rows: int) -> None:
        self.fs, self.folder = open_filesystem(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.level, self.columns, self.max_rows = part, level, columns, max_rows
        self.hidden = f"{self.folder}/.{file_name(part)}-{uuid.uuid4().hex}"
        self.writer: pq.ParquetWriter | None = None
        self.tile: tuple[int, int] | None = None
        self.held: list[pa.RecordBatch] = []
        self.rows = 0
        self.report: list[tuple] = []

    def add(self, tile: tuple[int, int], rows: pa.RecordBatch) -> None:
        if tile != self.tile:
            self._close_group()
            self.tile = tile
        while rows.num_rows:
            fits = rows.slice(0, self.max_rows - self.rows)
            self.held.append(fits)
            self.rows += fits.num_rows
            rows = rows.slice(fits.num_rows)
            if self.rows == self.max_rows:
                self._close_group()

    def _close_group(self) -> None:
        if not self.rows:
            return
        x, y = self.tile
        names = pa.repeat(f"{self.level}/{x}/{y}", self.rows)
        rows = pa.Table.from_batches(self.held).select(self.columns).add_column(0, "tile_id", names)
        if self.writer is None:
            self.writer = pq.ParquetWriter(self.hidden, rows.schema, filesystem=self.fs, compression="zstd")
        self.writer.write_table(rows, row_group_size=self.rows)
        self.report.append((self.part, file_name(self.part), len(self.report), x, y, self.rows))
        self.held, self.rows = [], 0

    def close(self) -> pa.RecordBatch:
        self._close_group()
        self.writer.close()
        self.fs.move(self.hidden, f"{self.folder}/{file_name(self.part)}")
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*self.report), kinds)]
        return pa.record_batch(columns, ["part", "level_file", "row_group", "tile_x", "tile_y", "n_points"])

    def give_up(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.fs.delete_file(self.hidden)


def write_row_groups(df: DataFrame, folder: str, level: int, part: str, parts: int, max_rows: int) -> DataFrame:
    """Write `df(tile_x, tile_y, ...)` into files by `part` (0 to before `parts`), each in row-major tile order, one tile per row
    group and at most `max_rows` rows in a group. Gives the report of the groups, `REPORT`; the files are written when that is run.
    """
    ship_package(df.sparkSession)
    uri = qualified(df.sparkSession, folder)
    columns = [c for c in df.columns if c != part]
    ordered = df.repartitionById(parts, F.col(part).cast("int")).sortWithinPartitions(part, "tile_y", "tile_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                number, x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (part, "tile_x", "tile_y"))
                fresh = np.flatnonzero((number[1:] != number[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
                edges = [0, *fresh.tolist(), batch.num_rows]
                for a, b in zip(edges[:-1], edges[1:]):
                    if file is None or file.part != number[a]:
                        if file is not None:
                            yield file.close()
                        file = _File(uri, int(number[a]), level, columns, max_rows)
                    file.add((int(x[a]), int(y[a])), batch.slice(a, b - a))
            if file is not None:
                done, file = file, None
                yield done.close()
        finally:
            if file is not None:
                file.give_up()

    return ordered.mapInArrow(run, REPORT)


def footer_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the row groups of a folder, from the footers of its files; no rows are read."""
    ship_package(spark)
    filesystem, target = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in filesystem.listStatus(target)]
    files = [(n,) for n in sorted(names) if n.endswith(".parquet") and not n.startswith((".", "_"))]
    uri = qualified(spark, folder)
    listed = spark.createDataFrame(files, "name string").repartition(max(1, -(-len(files) // FOOTERS_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_filesystem(uri)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with filesystem.open_input_file(f"{path}/{name}") as handle:
                    footer = pq.ParquetFile(handle).metadata
                rows = []
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    columns = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
                    x, y = columns["tile_x"], columns["tile_y"]
                    if (x.min, y.min) != (x.max, y.max):
                        raise ValueError(f"Row group {g} of {name} holds several tiles.")
                    rows.append((int(name[5:-8]), name, g, x.min, y.min, group.num_rows))
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.record_batch(columns, ["part", "level_file", "row_group", "tile_x", "tile_y", "n_points"])

    return listed.mapInArrow(run, REPORT)


def read_row_groups(groups: DataFrame, folder: str, columns: list[str], schema: str) -> DataFrame:
    """The rows of chosen groups `(level_file, row_group)`: each task opens its files and reads only these groups."""
    ship_package(groups.sparkSession)
    uri = qualified(groups.sparkSession, folder)
    chosen = groups.select("level_file", "row_group").repartition("level_file").sortWithinPartitions("level_file", "row_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_filesystem(uri)
        for batch in batches:
            wanted: dict[str, list[int]] = {}
            for name, group in zip(batch.column("level_file").to_pylist(), batch.column("row_group").to_pylist()):
                wanted.setdefault(name, []).append(group)
            for name, numbers in wanted.items():
                with filesystem.open_input_file(f"{path}/{name}") as handle:
                    file = pq.ParquetFile(handle)
                    for number in numbers:
                        yield from file.read_row_group(number, columns=columns).select(columns).to_batches()

    return chosen.mapInArrow(run, schema)
