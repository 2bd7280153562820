"""Stored tables that are replaced as a whole: a new version is written beside the old one and takes its place by renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at(path))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at(path), True)


def recover(spark: SparkSession, path: str) -> None:
    """If a replacement stopped between its two renames, finish it."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(path + ".old")):
        fs.rename(at(path + ".old"), at(path))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one where there is none yet."""
    recover(spark, path)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    """Put ``df``, which may read from ``path``, in its place; at every moment the old or the new version is whole."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(at(path + ".old"), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(path + ".old"))
    fs.rename(at(path + ".new"), at(path))
    fs.delete(at(path + ".old"), True)
