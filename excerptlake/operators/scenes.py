"""Scenes: loading with durations, colour signatures, subsampling, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.scalars import parse_color_sig, parse_hash
from .numbering import numbered


def _by_video():
    return Window.partitionBy("video_id").orderBy("scene_index")


def with_durations(scenes: DataFrame) -> DataFrame:
    """scene_duration: seconds to the next stored scene of the video, null for its last."""
    return scenes.withColumn("scene_duration", F.lead("timestamp_sec").over(_by_video()) - F.col("timestamp_sec"))


def long_enough(scenes: DataFrame, min_duration: float) -> DataFrame:
    """Scenes that last min_duration, and those whose duration is unknown."""
    return scenes.filter(F.col("scene_duration").isNull() | (F.col("scene_duration") >= min_duration))


def load_scenes(scenes: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Scenes for matching: durations known before short ones go, hashes parsed once, place among
    the kept scenes, and colour signatures of the video's own length only.

    All windows share the video_id partitioning and order, so there is one shuffle and one sort.
    """
    kept = long_enough(with_durations(scenes), cfg.min_scene_duration)
    whole = Window.partitionBy("video_id")
    sig = F.when(F.length("color_sig") > 0, F.length("color_sig"))
    kept = kept.withColumns(
        {
            "pos": F.row_number().over(_by_video()) - 1,
            "n_kept": F.count("*").over(whole),
            "sig_len": F.first(sig, ignorenulls=True).over(
                _by_video().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )
    return kept.select(
        "video_id", "scene_index", "pos", "n_kept", "timestamp_sec", "scene_duration",
        *[parse_hash(F.col(c)).alias(h) for c, h in (("phash", "h0"), ("phash_cropped", "h1"), ("phash_flipped", "h2"))],
        F.when(F.length("color_sig") == F.col("sig_len"), parse_color_sig(F.col("color_sig"))).alias("color"),
    )


def scene_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("video_id").agg(F.count("*").alias("n_scenes"))


def _evenly(k: Column, n: Column, most: int) -> Column:
    """Whether row k of n is int(i * n / most) for some i under most, or there are no more than most rows."""
    step = n / F.lit(most)
    i = F.ceil(k / step)  # the least candidate, but for rounding
    hit = lambda x: (F.floor(x * step) == k) & (x >= 0) & (x < most)
    return (n <= most) | hit(i) | hit(i - 1) | hit(i + 1)


def even_subsample(rows: DataFrame, most: int, order_by: list[str], partition_by: list[str] = ()) -> DataFrame:
    """Rows number int(i * n / most) for i under most, of n rows in order; all rows if there are
    no more than that. most = 0 keeps all."""
    if not most:
        return rows
    window = Window.partitionBy(*partition_by)
    placed = rows.withColumns({"__k": F.row_number().over(window.orderBy(*order_by)) - 1, "__n": F.count("*").over(window)})
    return placed.filter(_evenly(F.col("__k"), F.col("__n"), most)).drop("__k", "__n")


def stratified_sample(rows: DataFrame, n: int, key: list[str]) -> DataFrame:
    """n rows spread evenly over the sorted key, without a window over all rows."""
    return numbered(rows, key).filter(_evenly(F.col("__k"), F.col("__n"), n)).select(*rows.columns)


def replace_scenes(scenes: DataFrame, fingerprinted: DataFrame, fresh: DataFrame) -> DataFrame:
    """Scenes after a fingerprint run: videos in `fingerprinted` keep only their fresh scenes."""
    old = scenes.join(fingerprinted.select("video_id").distinct(), "video_id", "left_anti")
    return old.select(*scenes.columns).unionByName(fresh.select(*scenes.columns))
