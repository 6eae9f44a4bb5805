"""Catalog inventory: what to probe, what vanished, what came back, what moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import VIDEO_SUFFIXES
from ..functions.scalars import basename, under_any_root
from ..schemas import TABLES
from .numbering import numbered

_COLUMNS = [f.name for f in TABLES["videos"].fields]
_PROBED = ("size_bytes", "duration_sec", "width", "height", "codec", "container", "has_audio", "mtime", "probed_at")


def video_files(listing: DataFrame) -> DataFrame:
    """Files with a video suffix; of several that resolve to one file, the first path.

    listing: path, resolved_path, size_bytes, mtime.
    """
    suffix = F.lower(F.regexp_extract(basename(F.col("path")), r"^.+(\.[^.]+)$", 1))
    kept = listing.filter(suffix.isin(*VIDEO_SUFFIXES))
    first = F.min(F.struct("path", "size_bytes", "mtime")).alias("f")
    return kept.groupBy("resolved_path").agg(first).select("f.*")


def needs_probe(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Files that are unknown, or whose size or time differs from the catalog's."""
    known = videos.select("path", F.col("size_bytes").alias("known_size"), F.col("mtime").alias("known_mtime"), F.lit(True).alias("known"))
    same = F.col("size_bytes").eqNullSafe(F.col("known_size")) & F.col("mtime").eqNullSafe(F.col("known_mtime"))
    joined = files.join(known, "path", "left")
    return joined.filter(F.col("known").isNull() | ~same).select(*files.columns)


def probe_worklist(files: DataFrame, videos: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` files that need probing, by path (0: all), and the number left for later.

    Limit is a top-k, so no task sorts all files.
    """
    todo = needs_probe(files, videos)
    taken = todo.orderBy("path").limit(limit) if limit else todo
    deferred = todo.agg(F.greatest(F.count("*") - F.lit(limit), F.lit(0)).alias("n_deferred"))
    if not limit:
        deferred = deferred.select(F.lit(0).cast("long").alias("n_deferred"))
    return taken, deferred


def _staged(decisions: DataFrame) -> DataFrame:
    return decisions.filter("status = 'staged'").select(F.col("preview_id").alias("id")).distinct()


def newly_missing(videos: DataFrame, present: DataFrame, decisions: DataFrame, roots: list[str]) -> DataFrame:
    """Ids of unflagged videos under a scanned root that are neither present nor staged."""
    gone = videos.filter(F.col("missing_since").isNull() & under_any_root(F.col("path"), roots)).select("id", "path")
    gone = gone.join(present.select("path"), "path", "left_anti")
    return gone.join(_staged(decisions), "id", "left_anti").select("id")


def recovered(videos: DataFrame, present: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids of flagged videos that are present or staged."""
    flagged = videos.filter(F.col("missing_since").isNotNull()).select("id", "path")
    back = flagged.join(present.select("path").distinct().withColumn("here", F.lit(True)), "path", "left")
    back = back.join(_staged(decisions).withColumn("staged", F.lit(True)), "id", "left")
    return back.filter(F.col("here") | F.col("staged")).select("id")


def reconcile_missing(videos: DataFrame, present: DataFrame, decisions: DataFrame, roots: list[str], now: float) -> DataFrame:
    """videos with missing_since set on what vanished and cleared on what is accounted for."""
    gone = newly_missing(videos, present, decisions, roots).withColumn("gone", F.lit(True))
    back = recovered(videos, present, decisions).withColumn("back", F.lit(True))
    joined = videos.join(gone, "id", "left").join(back, "id", "left")
    since = F.when(F.col("gone"), F.lit(now)).when(F.col("back"), F.lit(None)).otherwise(F.col("missing_since"))
    return joined.withColumn("missing_since", since.cast("double")).select(*videos.columns)


def move_candidates(probed: DataFrame, videos: DataFrame) -> DataFrame:
    """path, id: new files that are the only missing video of their size and duration, moved.

    Each missing video is taken once, by the first new path.
    """
    key = ["size_bytes", "duration_sec"]
    missing = videos.filter(F.col("missing_since").isNotNull())
    alone = missing.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    new = probed.join(videos.select("path"), "path", "left_anti")
    first = new.groupBy(*key).agg(F.min("path").alias("path"))
    return first.join(alone, key).select("path", "id")


def apply_moves(videos: DataFrame, probed: DataFrame, moves: DataFrame, now: float) -> DataFrame:
    """videos after moves: the row keeps id and fingerprint and takes the new file's path and probe."""
    new = probed.withColumn("probed_at", F.lit(now)).join(moves, "path")
    new = new.select("id", *[F.col(c).alias(f"new_{c}") for c in ("path", *_PROBED)], F.lit(True).alias("moved"))
    joined = videos.join(new, "id", "left")
    take = lambda c, value: F.when(F.col("moved"), value).otherwise(F.col(c)).alias(c)
    out = {c: F.col(f"new_{c}") for c in ("path", *_PROBED)}
    out |= {"filename": basename(F.col("new_path")), "missing_since": F.lit(None).cast("double")}
    return joined.select(*[take(c, out[c]) if c in out else F.col(c) for c in videos.columns])


def upsert_videos(videos: DataFrame, probed: DataFrame, now: float) -> DataFrame:
    """videos after probing: known paths take the probe and lose their fingerprint and missing mark,
    new paths get the next ids in path order."""
    old = videos.select(*[F.col(c).alias(f"old_{c}") for c in _COLUMNS])
    fresh = probed.withColumn("probed_at", F.lit(now)).withColumn("is_new", F.lit(True))
    joined = old.join(fresh, F.col("old_path") == F.col("path"), "full_outer")
    take = F.col("is_new")
    values = {c: F.when(take, F.col(c)).otherwise(F.col(f"old_{c}")) for c in _PROBED}
    values |= {
        "path": F.coalesce("old_path", "path"),
        "filename": F.coalesce(F.col("old_filename"), basename(F.col("path"))),
        "role_guess": F.coalesce(F.col("old_role_guess"), F.lit("unknown")),
        "id": F.col("old_id"),
        **{c: F.when(take.isNull(), F.col(f"old_{c}")) for c in ("fingerprinted_at", "missing_since")},
    }
    merged = joined.select(*[values[c].alias(c) for c in _COLUMNS])
    return merged.filter("id is not null").unionByName(number_rows(merged.filter("id is null"), videos))


def number_rows(new: DataFrame, videos: DataFrame) -> DataFrame:
    """new rows with ids after the catalog's greatest, in path order; only a batch's new files are
    numbered."""
    base = videos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__base"))
    placed = numbered(new, ["path"]).join(F.broadcast(base))
    return placed.withColumn("id", F.col("__base") + F.col("__k") + 1).select(*new.columns)


def fingerprint_worklist(videos: DataFrame, limit: int = 0) -> DataFrame:
    """Videos without a fingerprint by id; limit 0 is no limit."""
    todo = videos.filter(F.col("fingerprinted_at").isNull()).select("id", "path", "duration_sec", "width", "height")
    return todo.orderBy("id").limit(limit) if limit else todo.orderBy("id")
