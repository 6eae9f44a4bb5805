"""Review queue: pages, totals, details, playability and staged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAGE_SIZE
from ..functions.scalars import dirname, fmt_time, video_meta
from ..schemas import EVIDENCE


def pending_queue(matches: DataFrame, videos: DataFrame, decisions: DataFrame) -> DataFrame:
    """The best match, among candidates that aren't missing, of each undecided preview that isn't."""
    here = videos.filter(F.col("missing_since").isNull())
    side = lambda who: here.select(F.col("id").alias(f"{who}_id"), F.col("filename").alias(f"{who}_filename"))
    open_ = matches.join(side("preview"), "preview_id").join(side("candidate"), "candidate_id")
    decided = decisions.filter(F.col("status").isNotNull()).select("preview_id")
    open_ = open_.join(decided, "preview_id", "left_anti")
    best = Window.partitionBy("preview_id").orderBy(F.desc("combined_score"), "candidate_id")
    return (
        open_.withColumn("rank", F.row_number().over(best))
        .filter("rank = 1")
        .select("preview_id", "preview_filename", "candidate_id", "candidate_filename", "visual_score", "audio_score", "combined_score")
    )


def page(rows: DataFrame, number: int, *order: Column, size: int = PAGE_SIZE) -> DataFrame:
    """One page in the given order; pages start at 1 and lower numbers mean the first."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def pending_page(matches, videos, decisions, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return page(pending_queue(matches, videos, decisions), number, F.desc("combined_score"), F.asc("preview_id"), size=size)


def decision_queue(decisions: DataFrame, videos: DataFrame, status: str) -> DataFrame:
    """Decided previews of one status, also without a match and while missing."""
    p = videos.select(F.col("id").alias("preview_id"), F.col("filename").alias("preview_filename"))
    c = videos.select(F.col("id").alias("candidate_id"), F.col("filename").alias("candidate_filename"))
    chosen = decisions.filter(F.col("status") == status)
    joined = chosen.withColumnRenamed("matched_candidate_id", "candidate_id").join(p, "preview_id").join(c, "candidate_id", "left")
    return joined.select("preview_id", "preview_filename", "candidate_id", "candidate_filename", "decided_at")


def decision_page(decisions, videos, status: str, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return page(decision_queue(decisions, videos, status), number, F.desc("decided_at"), F.asc("preview_id"), size=size)


def decision_totals(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count("*").alias("n"))


def page_meta(total: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """total_count and total_pages (1 at least) from a row with column n."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / size))
    return total.select(F.col("n").alias("total_count"), pages.cast("long").alias("total_pages"))


def dashboard_stats(videos: DataFrame, matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of totals, from one aggregate per table."""
    v = videos.agg(F.count("*").alias("total_videos"), F.count("fingerprinted_at").alias("fingerprinted_videos"))
    m = matches.agg(F.countDistinct("preview_id").alias("previews_with_match"))
    d = decisions.agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("approved_delete", "approved"), ("staged", "staged"), ("rejected", "rejected"))]
    )
    return v.crossJoin(m).crossJoin(d)  # one row each


def missing_files(videos: DataFrame, decisions: DataFrame) -> DataFrame:
    staged = decisions.filter("status = 'staged'").select(F.col("preview_id").alias("id"))
    gone = videos.filter(F.col("missing_since").isNotNull()).join(staged, "id", "left_anti")
    return gone.select("id", "path", "filename", "missing_since").orderBy("missing_since", "id")


def video_by_id(videos: DataFrame, video_id: int) -> DataFrame:
    return videos.filter(F.col("id") == video_id)


def review_detail(matches: DataFrame, videos: DataFrame, scenes: DataFrame, preview_id: int | None = None) -> DataFrame:
    """Candidates with what the page shows of them, best first; of one preview, or of all.

    scene_count is of all stored scenes, unlike the score's denominator.
    """
    chosen = matches if preview_id is None else matches.filter(F.col("preview_id") == preview_id)
    c = videos.select(
        F.col("id").alias("candidate_id"), F.col("filename").alias("candidate_filename"), dirname(F.col("path")).alias("candidate_folder"),
        video_meta(F.col("duration_sec"), F.col("width"), F.col("height"), F.col("size_bytes")).alias("candidate_meta"),
        F.col("missing_since").alias("candidate_missing_since"),
    )
    counts = scenes.groupBy(F.col("video_id").alias("preview_id")).agg(F.count("*").alias("preview_scene_count"))
    joined = chosen.join(c, "candidate_id").join(counts, "preview_id", "left")
    return joined.select(
        "preview_id", "candidate_id", "candidate_filename", "candidate_folder", "candidate_meta", "candidate_missing_since",
        "visual_score", "audio_score", "combined_score", F.coalesce("preview_scene_count", F.lit(0)).alias("preview_scene_count"),
    ).orderBy("preview_id", F.desc("combined_score"), "candidate_id")


def parse_evidence(text: Column) -> Column:
    """Stored evidence back to structs; null and empty text give an empty list."""
    return F.coalesce(F.from_json(text, EVIDENCE), F.array().cast(EVIDENCE))


def match_summary(evidence: Column) -> list[Column]:
    """Columns that sum up a pair's evidence, and whether it is weak."""
    ts = lambda k: F.transform(evidence, lambda m: m[k])
    span = lambda k: F.coalesce(F.array_max(ts(k)) - F.array_min(ts(k)), F.lit(0.0))
    return measures_summary(F.size(evidence), span("preview_ts"), span("candidate_ts"))


def measures_summary(n: Column | str, preview_span: Column | str, candidate_span: Column | str) -> list[Column]:
    """match_summary of a pair whose number of matches and spans are known."""
    n, p, c = (F.col(x) if isinstance(x, str) else x for x in (n, preview_span, candidate_span))
    weak = (n == 1) | ((n > 1) & (c < 2.0))
    return [n.cast("long").alias("n_matched"), fmt_time(p).alias("preview_span"), fmt_time(c).alias("candidate_span"), weak.alias("weak")]


def seek_points(evidence: Column, key: str) -> Column:
    """Times of the evidence, one per tenth of a second (the first), in ascending order."""
    tenth = lambda m: F.format_number(F.round(m[key], 1), 1)
    items = F.array_sort(F.transform(evidence, lambda m, i: F.struct(tenth(m).alias("k"), i.alias("i"), m[key].alias("t"))))
    # sorted by tenth and place, an item is the first of its tenth if the one before it has another
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(items, lambda x: x["k"]))
    first = F.filter(items, lambda x, j: ~F.get(before, j).eqNullSafe(x["k"]) | (j == 0))
    return F.array_sort(F.transform(first, lambda x: x["t"]))


# --- playing ---------------------------------------------------------------------------------

PROBE = "struct<streams:array<struct<codec_name:string,codec_tag:string,codec_type:string>>,format:struct<format_name:string>>"
NATIVE_FORMATS = ("mp4", "matroska", "webm")
NO_TAG = ("0x0000", "0x0", "0", "")


def playability(probe_json: Column) -> Column:
    """struct(needs_remux, video_codec, audio_codec, safe_to_remux) from a probe's JSON."""
    probe = F.from_json(probe_json, PROBE)
    streams = F.coalesce(probe["streams"], F.array().cast("array<struct<codec_name:string,codec_tag:string,codec_type:string>>"))
    of = lambda kind: F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(1))
    video, audio = of("video"), of("audio")
    name = F.coalesce(probe["format"]["format_name"], F.lit(""))
    native = F.lit(False)
    for family in NATIVE_FORMATS:
        native = native | name.contains(family)
    untagged = name.contains("mp4") & F.trim(F.coalesce(video["codec_tag"], F.lit(""))).isin(*NO_TAG)
    video_codec = F.when(video.isNotNull(), video["codec_name"])
    audio_codec = F.when(video.isNotNull() & audio.isNotNull(), audio["codec_name"])
    return F.struct(
        (video.isNotNull() & (untagged | ~native)).alias("needs_remux"),
        video_codec.alias("video_codec"),
        audio_codec.alias("audio_codec"),
        (F.coalesce(video_codec == "h264", F.lit(False)) & (audio_codec.isNull() | (audio_codec == "aac"))).alias("safe_to_remux"),
    )


def staged_paths(previews: DataFrame, listing: DataFrame, stage_dir: str) -> DataFrame:
    """preview_id, staged_path: the name with the id's suffix if it is there, else the plain one.

    previews: preview_id, path. listing: path of each file in the staging folder.
    """
    name = F.substring_index("path", "/", -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    root = F.lit(stage_dir.rstrip("/") + "/")
    wanted = previews.select(
        "preview_id", F.concat(root, name).alias("plain"),
        F.concat(root, stem, F.lit("__"), F.col("preview_id").cast("string"), suffix).alias("suffixed"),
    )
    files = listing.select("path").distinct()
    found = wanted.join(files.withColumnRenamed("path", "s"), F.col("suffixed") == F.col("s"), "left")
    found = found.join(files.withColumnRenamed("path", "p"), F.col("plain") == F.col("p"), "left")
    return found.select("preview_id", F.coalesce("s", "p").alias("staged_path"))


def staging_summary(listing: DataFrame) -> DataFrame:
    """Entries in the staging folder, folders counted too, and the bytes of its files."""
    size = F.when(~F.col("is_dir"), F.col("size_bytes"))
    return listing.agg(F.count("*").alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"))
