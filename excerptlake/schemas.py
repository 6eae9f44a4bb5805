"""Table schemas of the catalog, and reading with columns that older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in text.split())])


_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType()}

EVIDENCE = (
    "array<struct<distance:int,candidate_ts:double,variant:string,preview_ts:double,"
    "preview_scene_duration:double,candidate_scene_duration:double>>"
)

#: Column order and types are the catalog's public format (fixed values).
TABLES = {
    "videos": _schema(
        "id:l path:s filename:s size_bytes:l duration_sec:d width:i height:i codec:s container:s has_audio:i "
        "mtime:d role_guess:s probed_at:d fingerprinted_at:d missing_since:d"
    ),
    "scenes": _schema("id:l video_id:l scene_index:i timestamp_sec:d phash:s phash_cropped:s phash_flipped:s color_sig:s"),
    "audio_fp": _schema("video_id:l duration_sec:d fingerprint:s fp_ok:i"),
    "matches": _schema(
        "id:l preview_id:l candidate_id:l visual_score:d audio_score:d combined_score:d scene_matches_json:s computed_at:d"
    ),
    "decisions": _schema("preview_id:l status:s matched_candidate_id:l decided_at:d note:s"),
    "match_feedback": _schema("preview_id:l candidate_id:l status:s decided_at:d"),
    "scan_runs": _schema(
        "id:l params_json:s status:s stage:s stage_total:l stage_done:l stage_started_at:d message:s started_at:d "
        "updated_at:d finished_at:d target_workers:i resume_baseline_done:l resume_baseline_elapsed:d"
    ),
}

#: Values of columns that a file without them has.
DEFAULTS = {
    "videos": {"has_audio": 1, "role_guess": "unknown"},
    "audio_fp": {"fp_ok": 1},
    "match_feedback": {"status": "not_a_match"},
    "scan_runs": {"stage_done": 0, "resume_baseline_done": 0, "resume_baseline_elapsed": 0.0},
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the table's column order and types; absent columns get their default or null."""
    have, defaults = set(df.columns), DEFAULTS.get(name, {})
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet files; files written before a column existed are read with its default."""
    return conform(spark.read.option("mergeSchema", "true").parquet(f"{folder.rstrip('/')}/{name}"), name)
