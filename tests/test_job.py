"""A scan of all stages with stand-ins for the external tools."""

import pytest
from pyspark.sql import functions as F

from excerptlake import job
from excerptlake.operators import versioned


def probe(files):
    # the size stands for the duration
    return files.select(
        "path", "size_bytes", F.col("size_bytes").cast("double").alias("duration_sec"), F.lit(640).alias("width"), F.lit(360).alias("height"),
        F.lit("h264").alias("codec"), F.lit("mp4").alias("container"), F.lit(1).alias("has_audio"), "mtime",
    )


def fingerprint(videos):
    # scenes of ten seconds, alike in all videos
    scenes = videos.select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_sec") / 10).cast("int") - 1)).alias("scene_index"))
    digest = lambda tag: F.substring(F.md5(F.concat(F.col("scene_index").cast("string"), F.lit(tag))), 1, 16)
    scenes = scenes.select(
        "video_id", "scene_index", (F.col("scene_index") * 10.0).alias("timestamp_sec"), digest("").alias("phash"),
        digest("c").alias("phash_cropped"), digest("f").alias("phash_flipped"), F.lit("").alias("color_sig"),
    )
    return scenes, videos.select(F.col("id").alias("video_id"), "duration_sec", F.lit("").alias("fingerprint"), F.lit(0).alias("fp_ok"))


def test_whole_scan(spark, tmp_path):
    root, catalog = tmp_path / "lib", str(tmp_path / "catalog")
    root.mkdir()
    for name, size in (("preview.mp4", 60), ("whole.mp4", 200), ("notes.txt", 50)):
        (root / name).write_bytes(b"x" * size)
    args = (spark, catalog, [str(root)], probe, fingerprint)
    assert job.run(*args, now=lambda: 5.0) == ["inventory", "fingerprint", "match"]
    videos = {r.filename: r for r in versioned.current(spark, catalog, "videos").collect()}
    assert sorted(videos) == ["preview.mp4", "whole.mp4"] and all(r.fingerprinted_at == 5.0 and r.missing_since is None for r in videos.values())
    assert versioned.current(spark, catalog, "scenes").count() == 26
    found = [(r.id, r.preview_id, r.candidate_id, r.visual_score) for r in versioned.current(spark, catalog, "matches").collect()]
    assert found == [(1, videos["preview.mp4"].id, videos["whole.mp4"].id, 1.0)]

    (root / "whole.mp4").unlink()
    assert job.run(*args, start="inventory", stages=["match", "inventory"], now=lambda: 6.0) == ["inventory", "match"]
    gone = {r.filename: r.missing_since for r in versioned.current(spark, catalog, "videos").collect()}
    assert gone == {"preview.mp4": None, "whole.mp4": 6.0}


def test_scans_that_must_not_start(spark, tmp_path):
    args = (probe, fingerprint)
    with pytest.raises(ValueError):
        job.run(spark, str(tmp_path / "c"), [str(tmp_path / "nope")], *args)
    with pytest.raises(ValueError):
        job.run(spark, str(tmp_path / "c"), [str(tmp_path)], *args, stages=["dance"])
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "_scan").touch()
    with pytest.raises(RuntimeError):
        job.run(spark, str(tmp_path / "c"), [str(tmp_path)], *args)
    assert job.cancel(spark) is None
