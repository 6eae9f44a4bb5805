"""Incremental inventory as a stream: each batch of listed files is probed against the catalog.

An extension of the idempotent re-scan; the batch step is the batch operators' own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import inventory, versioned

LISTING = "path string, resolved_path string, size_bytes long, mtime double"


def watch_listings(
    spark: SparkSession, listings: str, catalog: str, checkpoint: str, probe: Callable[[DataFrame], DataFrame], now: Callable[[], float]
):
    """A query that upserts the videos of new listing files (Parquet) into the catalog and ends."""

    def step(files: DataFrame, _: int) -> None:
        videos = versioned.current(spark, catalog, "videos")
        todo = inventory.needs_probe(inventory.video_files(files), videos)
        probed = probe(todo).persist()
        try:
            moves = inventory.move_candidates(probed, videos)
            at = now()
            moved = inventory.apply_moves(videos, probed, moves, at)
            rest = probed.join(moves.select("path"), "path", "left_anti")
            versioned.commit(inventory.upsert_videos(moved, rest, at), catalog, "videos")
        finally:
            probed.unpersist()

    stream = spark.readStream.schema(LISTING).parquet(listings)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
