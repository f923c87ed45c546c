"""Small file-system helpers that work on any file system Spark can reach."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file listings spell it."""
    system, target = _file_system(spark, path)
    return system.makeQualified(target).toString()


def uri_form(spark: SparkSession, path: str) -> str:
    """The path as the file metadata column spells it, percent signs and all."""
    return spark.sparkContext._jvm.org.apache.spark.paths.SparkPath.fromPathString(path).urlEncoded()


def is_folder(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def has_match(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob pattern names anything."""
    system, target = _file_system(spark, pattern)
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def glob_literal(path: str) -> str:
    """The path with what a glob pattern would read as wild cards made literal."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def folder_times(spark: SparkSession, path: str) -> dict[str, float]:
    """Modification time in seconds of each entry of a folder, by its path below the one given."""
    if not is_folder(spark, path):
        return {}
    system, target = _file_system(spark, path)
    return {f"{path}/{s.getPath().getName()}": s.getModificationTime() / 1000 for s in system.listStatus(target)}


def create_once(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it was there."""
    system, target = _file_system(spark, path)
    try:
        return system.createNewFile(target)
    except Py4JJavaError:  # some stores report a lost race as an error
        if exists(spark, path):
            return False
        raise


def delete(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``v=N`` folders below ``path`` that were written to the end."""
    if not is_folder(spark, path):
        return []
    system, target = _file_system(spark, path)
    numbers = []
    for status in system.listStatus(target):
        match = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        if match and exists(spark, f"{path}/{match.group(0)}/_SUCCESS"):
            numbers.append(int(match.group(1)))
    return sorted(numbers)
