"""Tables as version folders: a change reads the current version and writes the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import conform, empty


def _path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Complete versions of a table, by any file system Spark knows."""
    path, files = _path(spark, f"{folder}/{name}")
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    done = [p.getName() for p in found if p.getName().startswith("v") and files.exists(_path(spark, f"{p}/_SUCCESS")[0])]
    return sorted(int(n[1:]) for n in done)


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    have = versions(spark, folder, name)
    if not have:
        return empty(spark, name)
    return conform(spark.read.parquet(f"{folder}/{name}/v{have[-1]}"), name)


def commit(df: DataFrame, folder: str, name: str, base: int | None = None) -> int:
    """Write df as the table's next version; readers see it once its job has succeeded.

    The version's number is claimed by creating a file, which succeeds for one writer only. base is
    the version that df was made from: if another writer has taken the next one, this one raises
    instead of undoing the other's change, and the caller reads again. Without base, numbers that
    are claimed (by a writer that is at work, or was lost) are passed over.
    """
    spark = df.sparkSession
    if base is None:
        path, files = _path(spark, f"{folder}/{name}/_claims")
        claimed = [int(s.getPath().getName()[1:]) for s in files.listStatus(path)] if files.exists(path) else []
        base = max([*versions(spark, folder, name), *claimed], default=0)
    number = base + 1
    claim, files = _path(spark, f"{folder}/{name}/_claims/v{number}")
    if not files.createNewFile(claim):
        raise RuntimeError(f"version {number} of {name} is taken by another writer")
    try:
        conform(df, name).write.mode("error").parquet(f"{folder}/{name}/v{number}")
    except Exception:
        files.delete(_path(spark, f"{folder}/{name}/v{number}")[0], True)
        files.delete(claim, False)
        raise
    return number
