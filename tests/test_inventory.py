"""Inventory, versions, review and run operators on hand-written cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from excerptlake import config
from excerptlake.functions import imaging
from excerptlake.functions import scalars as S
from excerptlake.operators import inventory, mutations, review, scans, scenes, versioned
from excerptlake.schemas import TABLES, conform, empty
from excerptlake.sources import library, probes
from excerptlake.streaming.inventory import LISTING, watch_listings


def videos(spark, rows):
    return conform(spark.createDataFrame(rows, "id long, path string, size_bytes long, mtime double, duration_sec double, missing_since double"), "videos")


def decisions(spark, rows):
    return spark.createDataFrame(rows, TABLES["decisions"]) if rows else empty(spark, "decisions")


def test_sizes_round_as_the_reference_does(spark):
    """Halves to even, and 1.15 as the binary number it is; rounded up before."""
    sizes = [m * 2**20 // 20 for m in range(20, 500)] + [4608**2 * 5, 1536**2, 2**30 - 1, 2**30 + 2**28, 2**40 + 2**38, 2**53 + 2**49, 10**18 + 7]

    def shown(size):
        for unit in ("B", "KB", "MB", "GB"):
            if size < 1024:
                return f"{size:.0f} {unit}" if unit in ("B", "KB") else f"{size:.1f} {unit}"
            size /= 1024
        return f"{size:.1f} TB"

    df = spark.createDataFrame([(v,) for v in sizes], "v long").select("v", S.fmt_size(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == {v: shown(float(v)) for v in sizes}


def test_library_listing(spark, tmp_path):
    for name in ("a/one.mp4", "b/two.MKV", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 7)
    (tmp_path / "b" / "link.mp4").symlink_to(tmp_path / "a" / "one.mp4")
    listed = library.list_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    found = {r.path.rsplit("/", 1)[1]: r.size_bytes for r in inventory.video_files(listed).collect()}
    assert found == {"one.mp4": 7, "two.MKV": 7}
    assert library.split_roots("/a::/b: ") == ["/a", "/b"]
    there = [str(tmp_path / "a"), str(tmp_path / "nope"), str(tmp_path / "a" / "one.mp4")]
    assert library.missing_roots(spark, there) == there[1:]


def test_limit_after_filter(spark):
    known = videos(spark, [(i, f"/lib/{i}.mp4", 1, 1.0, 1.0, None) for i in range(5)])
    files = spark.createDataFrame([(f"/lib/{i}.mp4", 1, 1.0) for i in range(8)], "path string, size_bytes long, mtime double")
    taken, deferred = inventory.probe_worklist(files, known, 2)
    assert (taken.count(), deferred.first()[0]) == (2, 1)
    taken, deferred = inventory.probe_worklist(files, known, 0)
    assert (taken.count(), deferred.first()[0]) == (3, 0)


@pytest.mark.parametrize(
    "path, missing, status, present, expected",
    [
        ("/a/x.mp4", None, None, False, (1, 0)), ("/ab/x.mp4", None, None, False, (0, 0)), ("/a/x.mp4", 5.0, None, True, (0, 1)),
        ("/a/x.mp4", None, "staged", False, (0, 0)), ("/a/x.mp4", 5.0, "staged", False, (0, 1)), ("/a/x.mp4", None, "rejected", False, (1, 0)),
    ],
)
def test_reconcile(spark, path, missing, status, present, expected):
    v = videos(spark, [(1, path, 1, 1.0, 1.0, missing)])
    d = decisions(spark, [(1, status, None, 1.0, None)] if status else [])
    here = spark.createDataFrame([(path,)] if present else [], "path string")
    counts = inventory.newly_missing(v, here, d, ["/a/"]).count(), inventory.recovered(v, here, d).count()
    assert counts == expected
    after = inventory.reconcile_missing(v, here, d, ["/a/"], 9.0).first().missing_since
    assert after == (9.0 if expected[0] else None if expected[1] else missing)


@pytest.mark.parametrize("missing, expected", [([5.0], 1), ([], None), ([5.0, 6.0], None), ([None], None)])
def test_moves(spark, missing, expected):
    v = videos(spark, [(k + 1, f"/old/{k}.mp4", 10, 1.0, 2.5, m) for k, m in enumerate(missing)] + [(99, "/other.mp4", 11, 1.0, 2.5, None)])
    new = spark.createDataFrame([("/new/b.mp4", 10, 2.5), ("/new/a.mp4", 10, 2.5)], "path string, size_bytes long, duration_sec double")
    found = [tuple(r) for r in inventory.move_candidates(new, v).collect()]
    assert found == ([("/new/a.mp4", expected)] if expected else [])


def test_queue_falls_back_to_second_best(spark):
    v = conform(spark.createDataFrame([(1, "p", None), (2, "c", 5.0), (3, "d", None)], "id long, filename string, missing_since double"), "videos")
    m = conform(spark.createDataFrame([(1, 1, 2, 0.95), (2, 1, 3, 0.5)], "id long, preview_id long, candidate_id long, combined_score double"), "matches")
    assert [r.candidate_id for r in review.pending_queue(m, v, empty(spark, "decisions")).collect()] == [3]
    assert review.pending_queue(m, v, decisions(spark, [(1, "staged", 2, 1.0, None)])).count() == 0
    assert [r.preview_id for r in review.decision_queue(decisions(spark, [(1, "staged", 7, 1.0, None)]), v, "staged").collect()] == [1]


def test_prune_nulls_references(spark):
    tables = {n: empty(spark, n) for n in TABLES}
    tables["videos"] = conform(spark.createDataFrame([(1, None), (2, 5.0)], "id long, missing_since double"), "videos")
    tables["decisions"] = decisions(spark, [(1, "rejected", 2, 1.0, None)])
    after, victims = mutations.prune_missing(tables)
    assert [r.id for r in victims.collect()] == [2] and [r.id for r in after["videos"].collect()] == [1]
    assert [tuple(r)[:3] for r in after["decisions"].collect()] == [(1, "rejected", None)]


def run_row(**values):
    base = dict.fromkeys(f.name for f in TABLES["scan_runs"].fields)
    return base | {"id": 1, "params_json": json.dumps({"limit": 1000, "fp_workers": 4}), "status": "paused"} | values


def runs(spark, **values):
    return spark.createDataFrame([run_row(**values)], TABLES["scan_runs"])


def test_resume(spark):
    plan = scans.resume_plan(runs(spark, stage="fingerprint", stage_done=134, target_workers=8, started_at=5.0)).first()
    assert (plan.first_stage_limit, plan.fp_workers, plan.started_at) == (866, 8, 5.0)
    assert scans.resume_plan(runs(spark, stage="fingerprint", stage_done=84, resume_baseline_done=50)).first().first_stage_limit == 866
    plan = scans.resume_plan(runs(spark, stage="match", stage_done=5, started_at=5.0)).first()
    assert (plan.baseline_done, plan.baseline_elapsed, plan.started_at, plan.first_stage_limit) == (0, 0.0, None, None)
    assert scans.resume_plan(runs(spark, stage="fingerprint", stage_done=1200)).first().first_stage_limit == 0


def test_progress(spark):
    row = scans.scan_progress(runs(spark, stage_done=188, stage_total=188, resume_baseline_done=12), F.lit(10.0)).first()
    assert (row.done, row.total) == (200, 200)
    row = scans.scan_progress(runs(spark, stage_done=10, stage_total=20, stage_started_at=100.0), F.lit(200.0)).first()
    assert row.eta_sec == pytest.approx(100.0)
    assert scans.scan_progress(runs(spark, stage_done=0, stage_total=20), F.lit(200.0)).first().eta_sec is None


@pytest.mark.parametrize("value, expected", [(60.0, 300), (None, 300), (0.0, 300), (2757.0, 2757), (100000.0, 3600)])
def test_timeout(spark, value, expected):
    assert spark.createDataFrame([(value,)], "d double").select(S.extract_timeout(F.col("d"))).first()[0] == expected


@pytest.mark.parametrize("value, expected", [(None, 4), (6, 6), (999, 8), (0, 2)])
def test_workers(spark, value, expected):
    assert spark.createDataFrame([(value,)], "w int").select(S.clamp_workers(F.col("w"), 4, 8)).first()[0] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"streams": [{"codec_type": "video", "codec_name": "h264", "codec_tag": "0x0000"}], "format": {"format_name": "mov,mp4"}}', (True, True)),
        ('{"streams": [{"codec_type": "video", "codec_name": "h264", "codec_tag": "avc1"}], "format": {"format_name": "mov,mp4"}}', (False, True)),
        ('{"streams": [{"codec_type": "video", "codec_name": "vp9", "codec_tag": "0x0000"}], "format": {"format_name": "matroska,webm"}}', (False, False)),
        ('{"streams": [{"codec_type": "video", "codec_name": "h264", "codec_tag": "27"}], "format": {"format_name": "mpegts"}}', (True, True)),
        ('{"streams": [], "format": {"format_name": "mp4"}}', (False, False)), ("not json", (False, False)), (None, (False, False)),
    ],
)
def test_playability(spark, text, expected):
    p = spark.createDataFrame([(text,)], "t string").select(review.playability(F.col("t")).alias("p")).first().p
    assert (p.needs_remux, p.safe_to_remux) == expected


def test_staged_collision(spark):
    files = spark.createDataFrame([("/s/preview.mp4",), ("/s/preview__20.mp4",)], "path string")
    previews = spark.createDataFrame([(10, "/a/preview.mp4"), (20, "/b/preview.mp4"), (30, "/c/gone.mp4")], "preview_id long, path string")
    found = {r.preview_id: r.staged_path for r in review.staged_paths(previews, files, "/s").collect()}
    assert found == {10: "/s/preview.mp4", 20: "/s/preview__20.mp4", 30: None}


def test_formats(spark):
    size = lambda v: spark.createDataFrame([(v,)], "v long").select(S.fmt_size(F.col("v"))).first()[0]
    assert [size(v) for v in (None, 0, 1023, 1024, 5 << 20, 3 << 30, 2 << 40)] == ["—", "0 B", "1023 B", "1 KB", "5.0 MB", "3.0 GB", "2.0 TB"]
    lasts = lambda v: spark.createDataFrame([(v,)], "v double").select(S.fmt_duration(F.col("v"))).first()[0]
    assert [lasts(v) for v in (None, 45.0, 200.0, 4500.0, -3.0, 2.5)] == ["—", "45s", "3m 20s", "1h 15m", "0s", "2s"]


def test_versions(spark, tmp_path):
    assert versioned.current(spark, str(tmp_path), "decisions").count() == 0
    versioned.commit(decisions(spark, [(1, "staged", 2, 1.0, None)]), str(tmp_path), "decisions")
    old = versioned.current(spark, str(tmp_path), "decisions")
    assert versioned.commit(mutations.purge_staging(old), str(tmp_path), "decisions") == 2
    assert versioned.current(spark, str(tmp_path), "decisions").first().status == "deleted"
    assert versioned.commit(old, str(tmp_path), "decisions", base=2) == 3
    with pytest.raises(RuntimeError):  # made from version 2, but version 3 is there
        versioned.commit(old, str(tmp_path), "decisions", base=2)
    (tmp_path / "decisions" / "_claims" / "v4").touch()  # a writer that was lost
    assert versioned.current(spark, str(tmp_path), "decisions").count() == 1
    assert versioned.commit(old, str(tmp_path), "decisions") == 5


def test_new_rows_all_get_ids(spark):
    """Under the default partition merging: wide rows, of which a count alone would plan less."""
    n = 200_000
    known = videos(spark, [(7, "/lib/00000009.mp4", 1, 1.0, 1.0, None)])
    wide = spark.range(n).select(
        F.format_string("/lib/%08d.mp4", F.col("id") * 7919 % n).alias("path"), F.col("id").alias("size_bytes"), F.lit(1.0).alias("duration_sec"),
        F.lit(1).alias("width"), F.lit(1).alias("height"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("codec"),
        F.sha2(F.col("id").cast("string"), 512).alias("container"), F.lit(1).alias("has_audio"), F.lit(1.0).alias("mtime"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = inventory.upsert_videos(known, wide, 5.0).select("id", "path").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == n and rows[0].id == 7 and rows[0].path == "/lib/00000009.mp4"
    new = [r for r in rows if r.id != 7]
    assert [r.id for r in new] == list(range(8, n + 7)) and [r.path for r in new] == sorted(r.path for r in new)


def test_even_samples(spark):
    rows = spark.range(8000).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("wide"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "512KB")
    try:
        assert [r.id for r in scenes.stratified_sample(rows, 4, ["id"]).select("id").orderBy("id").collect()] == [0, 2000, 4000, 6000]
    finally:
        spark.conf.unset(key)
    assert scenes.stratified_sample(rows.limit(0), 4, ["id"]).count() == 0
    assert scenes.stratified_sample(rows.limit(3), 4, ["id"]).count() == 3


def test_seek_points(spark):
    times = [1.04, 9.0, 1.01, 0.96, 9.04, None, 5.0, 5.0]
    df = spark.createDataFrame([([{"t": t} for t in times],), ([],)], "e array<struct<t:double>>")
    got = [r[0] for r in df.select(review.seek_points(F.col("e"), "t")).collect()]
    assert got[0][:3] == [1.04, 5.0, 9.0] and got[0][3:] == [None] and got[1] == []


def test_stream_of_listings(spark, tmp_path):
    folder, catalog = str(tmp_path / "in"), str(tmp_path / "catalog")
    probe = lambda files: files.selectExpr(
        "path", "size_bytes", "2.5D as duration_sec", "1 as width", "1 as height", "'h264' as codec", "'mp4' as container", "1 as has_audio", "mtime"
    )
    for batch in ([("/a/1.mp4", "/a/1.mp4", 1, 1.0)], [("/a/1.mp4", "/a/1.mp4", 2, 1.0), ("/a/2.mp4", "/a/2.mp4", 1, 1.0)]):
        spark.createDataFrame(batch, LISTING).write.mode("append").parquet(folder)
        watch_listings(spark, folder, catalog, str(tmp_path / "checkpoint"), probe, lambda: 7.0).awaitTermination(120)
    found = {(r.id, r.path, r.size_bytes) for r in versioned.current(spark, catalog, "videos").collect()}
    assert found == {(1, "/a/1.mp4", 2), (2, "/a/2.mp4", 1)}


def test_requests():
    assert config.validate_scan(["inventory"], ["/a"], ["/a"], "none", 4, 8) == []
    assert len(config.validate_scan(["x"], ["/b"], ["/a"], "cuda", True, 8)) == 4
    assert config.chosen_stages(["match", "inventory"]) == ["inventory", "match"]
    assert config.stages_from(["inventory", "match"], "match") == ["match"]
    assert config.stages_from(["inventory"], "nope") == ["inventory"]


def test_tools():
    assert probes.run_bounded(["echo", "x"], 5) == "x\n"
    assert probes.run_bounded(["sleep", "30"], 0.2) is None
    assert probes.run_bounded(["/no/such/tool"], 1) is None and probes.run_bounded(["false"], 5) is None


def test_frames(spark):
    noise = np.random.default_rng(0).integers(0, 256, (180, 320, 3), dtype=np.uint8)
    black, solid = np.zeros((180, 320, 3), np.uint8), np.full((360, 640, 3), (128, 64, 200), np.uint8)
    assert imaging.is_blank(black) and imaging.is_blank(solid) and not imaging.is_blank(noise)
    assert imaging.perceptual_hash(black) == imaging.perceptual_hash(np.zeros((480, 720, 3), np.uint8)) == "0" * 16
    flipped = imaging.perceptual_hash(noise[:, ::-1])
    rows = [(bytearray(x.tobytes()), x.shape[1], x.shape[0]) for x in (black, noise)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "p binary, w int, h int").select(imaging.fingerprint_frames("p", "w", "h").alias("f")).select("f.*")
    got = df.collect()
    assert got[0].blank and got[0].phash is None and not got[1].blank and len(got[1].color_sig) == 64 and got[2].blank is None
    assert flipped != imaging.perceptual_hash(noise) and imaging.color_signature(solid).count("f") == 1
