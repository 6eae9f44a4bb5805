"""External media tools: their text output parsed by columns, their calls in mapInPandas.

The tools (ffprobe, ffmpeg, fpcalc) may be absent; a call that can't be made gives nulls.
"""

from __future__ import annotations

import os
import signal
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int>>,"
    "format:struct<duration:string,size:string>>"
)


def parse_probe(text: Column) -> Column:
    """struct(duration_sec, width, height, codec, has_audio) of a probe's JSON; null without video."""
    probe = F.from_json(text, PROBE)
    streams = probe["streams"]
    video = F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(1))
    duration = F.coalesce(probe["format"]["duration"].try_cast("double"), F.lit(0.0))
    audio = F.exists(streams, lambda s: s["codec_type"] == "audio").cast("int")
    return F.when(
        video.isNotNull(),
        F.struct(
            duration.alias("duration_sec"), video["width"].alias("width"), video["height"].alias("height"),
            video["codec_name"].alias("codec"), F.coalesce(audio, F.lit(0)).alias("has_audio"),
        ),
    )


def parse_showinfo(log: Column) -> Column:
    """Times of the frames that a showinfo log lists."""
    found = F.regexp_extract_all(log, F.lit(r"pts_time:(\S+)"), 1)
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def parse_fpcalc(text: Column) -> Column:
    """struct(fingerprint, duration_sec, fp_ok) of fpcalc's lines."""
    value = lambda key: F.regexp_extract(text, f"(?m)^{key}=(.*)$", 1)
    has = F.coalesce(text.rlike("(?m)^FINGERPRINT="), F.lit(False))
    return F.struct(
        F.when(has, value("FINGERPRINT")).alias("fingerprint"),
        F.when(has, value("DURATION").try_cast("double")).alias("duration_sec"),
        has.cast("int").alias("fp_ok"),
    )


def run_bounded(command: list[str], timeout: float) -> str | None:
    """Standard output and error of a command, or None if it fails to start or end in time.

    The command leads its own process group, which is killed as a whole on a timeout; both pipes
    are drained by communicate(), so a chatty tool can't block.
    """
    try:
        process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, start_new_session=True)
    except OSError:
        return None
    try:
        output, _ = process.communicate(timeout=timeout)
    except subprocess.TimeoutExpired:
        os.killpg(process.pid, signal.SIGKILL)
        process.communicate()
        return None
    return output if process.returncode == 0 else None


def call_tool(files: DataFrame, command: list[str], column: str, timeout: float = 30.0) -> DataFrame:
    """files with the output of `command path` for each path in an extra column."""

    def run(batches):
        for rows in batches:
            yield pd.concat([rows, pd.Series([run_bounded([*command, p], timeout) for p in rows["path"]], rows.index, object, column)], axis=1)

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + f", {column} string")


FFPROBE = ["ffprobe", "-v", "error", "-show_entries", "format=duration,size:stream=codec_type,codec_name,width,height", "-of", "json"]
FPCALC = ["fpcalc", "-raw", "-length", "120"]


def probe_files(files: DataFrame) -> DataFrame:
    """files with the probe's fields; files that can't be probed are left out."""
    probed = call_tool(files, FFPROBE, "probe_json").withColumn("probe", parse_probe(F.col("probe_json")))
    return probed.filter("probe is not null").select(*files.columns, "probe.*")


def fingerprint_audio(files: DataFrame) -> DataFrame:
    called = call_tool(files, FPCALC, "fpcalc", 60.0)
    return called.select(*files.columns, parse_fpcalc(F.col("fpcalc")).alias("audio")).select(*files.columns, "audio.*")


def scene_filter(threshold: float = 0.3) -> str:
    """The frame filter that keeps the first frame and scene changes."""
    return f"select='gt(scene,{threshold})+eq(n,0)',showinfo"
