"""Paths: which file system they belong to, for Spark and for tasks, and folders that are replaced as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path itself."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = hadoop_path(spark, path)
    return filesystem.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    filesystem, target = hadoop_path(spark, path)
    filesystem.delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, so that tasks take it to the same file system as Spark does."""
    filesystem, target = hadoop_path(spark, path)
    return filesystem.makeQualified(target).toString()


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let `write` fill a hidden folder next to `path` and put it in the place of `path` when it is whole.

    If the writing fails, `path` is as it was. What was there is moved aside before it is deleted, so one of
    the two is complete at any moment. Where a rename is no single step, as in object stores, readers should wait for the end.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex
    made, old = (f"{parent}/_{kind}-{mark}-{name.replace('=', '-')}" for kind in ("new", "old"))
    try:
        write(made)
    except BaseException:
        delete(spark, made)
        raise
    filesystem, target = hadoop_path(spark, path)
    fresh, aside = hadoop_path(spark, made)[1], hadoop_path(spark, old)[1]
    filesystem.mkdirs(fresh)
    had = filesystem.exists(target)
    if had and not filesystem.rename(target, aside):
        raise OSError(f"{path} cannot be replaced.")
    if not filesystem.rename(fresh, target):
        if had:
            filesystem.rename(aside, target)
        raise OSError(f"{path} cannot be put in place.")
    filesystem.delete(aside, True)
