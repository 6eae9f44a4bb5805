"""Library files as a listing, by Spark's binaryFile source without reading their content."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_roots(setting: str) -> list[str]:
    """Roots of a setting whose parts stand between colons."""
    return [p for p in (setting or "").split(":") if p.strip()]


@F.pandas_udf(T.StringType())
def resolved(paths: pd.Series) -> pd.Series:
    """Paths with links followed, as the executor sees them: roots must be mounted on all executors."""
    return paths.map(os.path.realpath, na_action="ignore")


def missing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that are no folder, by whatever file system they name; a scan must not start with one,
    as everything below it would count as gone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [(r, jvm.org.apache.hadoop.fs.Path(r)) for r in roots]
    return [r for r, p in paths if not (p.getFileSystem(conf).exists(p) and p.getFileSystem(conf).getFileStatus(p).isDirectory())]


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, resolved_path, size_bytes, mtime of all files below the roots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    path = F.regexp_replace("path", "^file:/+", "/")
    listed = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("ms"))
    resolve = F.udf(os.path.realpath, "string")  # only paths pass through Python
    return listed.select("path", resolved("path").alias("resolved_path"), "size_bytes", (F.col("ms") / 1000.0).alias("mtime"))
