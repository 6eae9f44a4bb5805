"""Scan runs: progress, resuming, settings sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS = "struct<limit:bigint,fp_workers:int>"


def latest_scan(runs: DataFrame) -> DataFrame:
    """The run with the greatest id, a top-1."""
    return runs.orderBy(F.desc("id")).limit(1)


def scan_progress(runs: DataFrame, now: Column) -> DataFrame:
    """id, done, total, eta_sec: progress over all attempts at the stage.

    The rate is everything done over all active seconds; without done items or a total there is no
    estimate.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    started = F.col("stage_started_at")
    elapsed = F.when(started.isNotNull() & (started != 0), F.greatest(F.lit(0.0), now - started)).otherwise(0.0)
    active = zero("resume_baseline_elapsed") + elapsed
    done = zero("stage_done") + zero("resume_baseline_done")
    total = F.col("stage_total") + zero("resume_baseline_done")
    out = runs.select("id", done.alias("done"), total.alias("total"), active.alias("active"))
    rate = F.when(F.col("active") > 0, F.col("done") / F.col("active"))
    eta = F.when((rate > 0) & F.col("total").isNotNull(), (F.col("total") - F.col("done")) / rate)
    return out.select("id", "done", "total", eta.alias("eta_sec"))


def resume_plan(runs: DataFrame) -> DataFrame:
    """What a resumed run starts with.

    The live worker target replaces the stored one. A limit shrinks by what all attempts have done,
    and 0 then means that nothing is left. Matching starts afresh, so it carries nothing over.
    """
    params = F.from_json("params_json", PARAMS)
    fresh = F.coalesce(F.col("stage") == "match", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ran = (F.col("stage_started_at") != 0) & (F.col("finished_at") != 0)
    last = F.when(ran, F.greatest(F.lit(0.0), F.col("finished_at") - F.col("stage_started_at"))).otherwise(0.0)
    done = F.when(fresh, 0).otherwise(zero("resume_baseline_done") + zero("stage_done"))
    elapsed = F.when(fresh, 0.0).otherwise(zero("resume_baseline_elapsed") + last)
    planned = runs.select(
        "id",
        F.when(zero("target_workers") != 0, F.col("target_workers")).otherwise(params["fp_workers"]).alias("fp_workers"),
        F.col("stage").alias("start_stage"),
        params["limit"].alias("run_limit"),
        done.cast("long").alias("baseline_done"),
        elapsed.alias("baseline_elapsed"),
        F.when(~fresh, F.col("started_at")).alias("started_at"),
        fresh.alias("fresh"),
    )
    limited = ~F.col("fresh") & (F.col("run_limit") != 0) & (F.col("baseline_done") != 0)
    left = F.when(limited, F.greatest(F.lit(0), F.col("run_limit") - F.col("baseline_done")))
    return planned.withColumn("first_stage_limit", left).drop("fresh", "run_limit")


def best_setting(results: DataFrame, metric: str, prefer: Column | None = None) -> DataFrame:
    """The row with the least metric, among preferred rows if there are any."""
    rank = F.when(prefer, 0).otherwise(1) if prefer is not None else F.lit(0)
    rest = [c for c in results.columns if c != metric]
    return results.agg(F.min(F.struct(rank.alias("r"), F.col(metric), *rest)).alias("best")).select(*[f"best.{c}" for c in results.columns])
