"""A whole scan: inventory, fingerprint and match in their order, over a catalog of versioned tables.

`python -m excerptlake.job CATALOG ROOT [ROOT ...]` runs inventory (by ffprobe) and match; run() takes
functions for probing and fingerprinting, as frames are extracted outside this package. One scan
runs at a time: it claims the catalog by creating a file. Its Spark jobs carry the tag TAG, so that
cancel() ends them from another thread; what earlier stages committed stays, and a scan that starts
again finds in the catalog what is left to do.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import STAGES, MatchConfig, chosen_stages, stages_from
from .operators import inventory, matching, scenes, versioned
from .operators.numbering import numbered
from .session import ship
from .sources import library, probes

TAG = "excerptlake-scan"

#: Of files (path, size_bytes, mtime) the probed ones, with duration_sec, width, height, codec, container, has_audio.
Probe = Callable[[DataFrame], DataFrame]
#: Of videos (id, path, ...) their scenes and their audio fingerprints, in the columns of those tables but the scenes' id.
Fingerprint = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def cancel(spark: SparkSession) -> None:
    """End the running jobs of a scan; its stage raises and commits nothing."""
    spark.sparkContext.cancelJobsWithTag(TAG)


def take_inventory(spark: SparkSession, catalog: str, roots: list[str], probe: Probe, limit: int, now: float) -> None:
    """Probe new and changed files, follow moves, and mark what is gone below the roots."""
    videos = versioned.current(spark, catalog, "videos")
    files = inventory.video_files(library.list_files(spark, roots))
    todo, _ = inventory.probe_worklist(files, videos, limit)
    probed = probe(todo).persist()
    try:
        moves = inventory.move_candidates(probed, videos)
        moved = inventory.apply_moves(videos, probed, moves, now)
        rest = probed.join(moves.select("path"), "path", "left_anti")
        versioned.commit(inventory.upsert_videos(moved, rest, now), catalog, "videos")
    finally:
        probed.unpersist()
    videos, decisions = (versioned.current(spark, catalog, t) for t in ("videos", "decisions"))
    versioned.commit(inventory.reconcile_missing(videos, files, decisions, roots, now), catalog, "videos")


def take_fingerprints(spark: SparkSession, catalog: str, fingerprint: Fingerprint, limit: int, now: float) -> None:
    """Fingerprint the videos that have none; those that gave no scene are marked too."""
    videos = versioned.current(spark, catalog, "videos")
    todo = inventory.fingerprint_worklist(videos, limit).persist()
    try:
        done = todo.select(F.col("id").alias("video_id"))
        new, audio = fingerprint(todo)
        old = versioned.current(spark, catalog, "scenes")
        first = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
        new = numbered(new, ["video_id", "scene_index"]).join(F.broadcast(first)).withColumn("id", F.col("base") + F.col("__k") + 1)
        versioned.commit(scenes.replace_scenes(old, done, new.select(*old.columns)), catalog, "scenes")
        heard = versioned.current(spark, catalog, "audio_fp")
        versioned.commit(heard.join(done, "video_id", "left_anti").select(*heard.columns).unionByName(audio.select(*heard.columns)), catalog, "audio_fp")
        marked = videos.join(done.select(F.col("video_id").alias("id"), F.lit(now).alias("at")), "id", "left")
        marked = marked.withColumn("fingerprinted_at", F.coalesce("at", "fingerprinted_at"))
        versioned.commit(marked.select(*videos.columns), catalog, "videos")
    finally:
        todo.unpersist()


def take_matches(spark: SparkSession, catalog: str, cfg: MatchConfig, now: float) -> None:
    """Match all fingerprinted videos anew and replace the stored matches."""
    tables = [versioned.current(spark, catalog, t) for t in ("videos", "scenes", "audio_fp", "match_feedback")]
    stored, _ = matching.store_matches(matching.match_run(*tables, cfg), tables[0])
    rows = numbered(stored, ["preview_id", "candidate_id"])
    versioned.commit(rows.withColumn("id", F.col("__k") + 1).withColumn("computed_at", F.lit(now)), catalog, "matches")


def run(
    spark: SparkSession, catalog: str, roots: list[str], probe: Probe, fingerprint: Fingerprint,
    stages: list[str] = STAGES, start: str | None = None, limit: int = 0, cfg: MatchConfig = MatchConfig(), now: Callable[[], float] = time.time,
) -> list[str]:
    """Run the chosen stages, from `start` on, and give their names. limit bounds the files probed and
    the videos fingerprinted (0: all)."""
    ship(spark)
    problems = [f"unknown stage {s}" for s in stages if s not in STAGES] + [f"not a folder: {r}" for r in library.missing_roots(spark, roots)]
    if problems:
        raise ValueError("; ".join(problems))
    claim, files = versioned._path(spark, f"{catalog}/_scan")
    if not files.createNewFile(claim):
        raise RuntimeError("a scan is running; delete _scan in the catalog if it was lost")
    steps = {
        "inventory": lambda: take_inventory(spark, catalog, roots, probe, limit, now()),
        "fingerprint": lambda: take_fingerprints(spark, catalog, fingerprint, limit, now()),
        "match": lambda: take_matches(spark, catalog, cfg, now()),
    }
    ran = []
    spark.sparkContext.addJobTag(TAG)
    try:
        for stage in stages_from(chosen_stages(stages), start):
            steps[stage]()
            ran.append(stage)
    finally:
        spark.sparkContext.removeJobTag(TAG)
        files.delete(claim, False)
    return ran


def main() -> None:
    parser = argparse.ArgumentParser(description="Inventory and matching of stored fingerprints.")
    parser.add_argument("catalog")
    parser.add_argument("roots", nargs="+")
    parser.add_argument("--stages", nargs="+", default=["inventory", "match"], choices=["inventory", "match"])
    parser.add_argument("--limit", type=int, default=0)
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()

    def probe(files: DataFrame) -> DataFrame:
        return probes.probe_files(files).withColumn("container", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))

    def fingerprint(videos: DataFrame):
        raise NotImplementedError("frames are extracted by the caller of run()")

    print(run(spark, args.catalog, args.roots, probe, fingerprint, args.stages, limit=args.limit))


if __name__ == "__main__":
    main()
