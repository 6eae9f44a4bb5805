"""Changes to the review tables, each a transform from old rows to new ones.

Nothing is updated in place: callers write the result to a new version folder (see versioned.py).
Deletes cascade by anti-joins, as files know no foreign keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: rows of new replace those of old with the same keys, but for the columns keep_old."""
    renamed = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in new.columns if c not in keys], F.lit(True).alias("__new"))
    joined = old.withColumn("__old", F.lit(True)).join(renamed, keys, "full_outer")
    pick = lambda c: (
        F.when(F.col("__old") & F.lit(c in keep_old), F.col(c)).when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    )
    return joined.select(*[F.col(c) if c in keys else pick(c) for c in old.columns])


def upsert_decisions(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """One decision a preview; an approved deletion is stored as staged."""
    status = F.when(F.col("status") == "approved_delete", "staged").otherwise(F.col("status"))
    return latest_wins(decisions, new.withColumn("status", status), ["preview_id"])


def dismiss(matches: DataFrame, feedback: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and feedback after marking pairs (preview_id, candidate_id, decided_at) as no match;
    a pair that was marked before only takes the new time."""
    key = ["preview_id", "candidate_id"]
    marked = latest_wins(feedback, pairs.select(*key, F.lit("not_a_match").alias("status"), "decided_at"), key, keep_old=("status",))
    return matches.join(pairs.select(*key), key, "left_anti").select(*matches.columns), marked


def undo(decisions: DataFrame, previews: DataFrame) -> DataFrame:
    return decisions.join(previews.select("preview_id"), "preview_id", "left_anti").select(*decisions.columns)


def delete_videos(tables: dict[str, DataFrame], victims: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting victims (id): children go, a decision's candidate becomes null."""
    victims = victims.select("id").distinct()
    without = lambda t, column: tables[t].join(victims, tables[t][column] == victims["id"], "left_anti")
    out = {"videos": without("videos", "id"), "scenes": without("scenes", "video_id"), "audio_fp": without("audio_fp", "video_id")}
    for name in ("matches", "match_feedback"):
        for who in ("preview", "candidate"):
            table = out.get(name, tables[name])
            gone = victims.withColumnRenamed("id", f"{who}_id")
            out[name] = table.join(gone, f"{who}_id", "left_anti").select(*tables[name].columns)
    kept = without("decisions", "preview_id")
    gone = victims.select(F.col("id").alias("__gone"))
    nulled = F.when(F.col("__gone").isNull(), F.col("matched_candidate_id")).alias("matched_candidate_id")
    kept = kept.join(gone, F.col("matched_candidate_id") == F.col("__gone"), "left")
    out["decisions"] = kept.select(*[nulled if c == "matched_candidate_id" else F.col(c) for c in tables["decisions"].columns])
    return out


def prunable(videos: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids of missing videos that aren't staged."""
    staged = decisions.filter("status = 'staged'").select(F.col("preview_id").alias("id"))
    return videos.filter(F.col("missing_since").isNotNull()).select("id").join(staged, "id", "left_anti")


def prune_missing(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    victims = prunable(tables["videos"], tables["decisions"])
    return delete_videos(tables, victims), victims


def trim_to_sample(tables: dict[str, DataFrame], keep: DataFrame) -> dict[str, DataFrame]:
    """All tables with only the videos in keep (id)."""
    victims = tables["videos"].select("id").join(keep.select("id"), "id", "left_anti")
    return delete_videos(tables, victims)


def purge_staging(decisions: DataFrame) -> DataFrame:
    status = F.when(F.col("status") == "staged", "deleted").otherwise(F.col("status"))
    return decisions.withColumn("status", status)


def interrupt_stale(runs: DataFrame) -> DataFrame:
    """Runs that a stopped driver left running are interrupted."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def latest_state(progress: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The state of each run from an append-only log: of every column, the last value that isn't null."""
    last = Window.partitionBy(key).orderBy(order, "seq")
    whole = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [c for c in progress.columns if c not in (key, "seq")]
    filled = progress.select(key, F.row_number().over(last).alias("__n"), *[F.last(c, ignorenulls=True).over(whole).alias(c) for c in columns])
    return filled.filter("__n = 1").select(key, *columns)
