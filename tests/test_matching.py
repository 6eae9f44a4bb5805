"""Scene and pair scoring on hand-written cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from excerptlake.config import MatchConfig
from excerptlake.functions import scalars as S
from excerptlake.operators import matching, scenes
from excerptlake.operators.hamming import hamming_join
from excerptlake.schemas import TABLES, conform, empty

H1, H2, H3 = "ff00ff00ff00ff00", "00ff00ff00ff00ff", "ffff0000ffff0000"
FREE = MatchConfig(min_scene_duration=0.0)


def scene_rows(spark, videos):
    """{video: [(ts, hash[, color])]} as scenes."""
    rows = [
        (v * 100 + k, v, k, float(s[0]), s[1], s[1], s[1], s[2] if len(s) > 2 else None)
        for v, listed in videos.items()
        for k, s in enumerate(listed)
    ]
    return spark.createDataFrame(rows, TABLES["scenes"])


def video_rows(spark, durations):
    return conform(spark.createDataFrame([(i, d, 1.0) for i, d in durations.items()], "id long, duration_sec double, fingerprinted_at double"), "videos")


def score(spark, preview, candidate):
    """Scores of preview 1 against candidate 2, or None."""
    rows = scene_rows(spark, {1: preview, 2: candidate})
    videos = video_rows(spark, {1: 10.0, 2: 100.0})
    best = matching.best_scene_matches(videos, scenes.load_scenes(rows, FREE), empty(spark, "match_feedback"), FREE)
    found = matching.pair_scores(matching.within_color(best, FREE)).filter("preview_id = 1").collect()
    return found[0] if found else None


def test_identical_scene(spark):
    r = score(spark, [(1.0, H1)], [(5.0, H1)])
    assert (r.n_matched, r.scene_matches[0].distance, r.scene_matches[0].candidate_ts) == (1, 0, 5.0)
    assert r.scene_matches[0].variant == "normal-vs-normal" and r.match_spread_sec == 0.0


@pytest.mark.parametrize(
    "preview, candidate",
    [([(1.0, "f" * 16)], [(1.0, "0" * 16)]), ([(1.0, H1)], []), ([], [(1.0, H1)]), ([(1.0, H1, "f" * 64)], [(5.0, H1, "0" * 64)])],
)
def test_no_match(spark, preview, candidate):
    assert score(spark, preview, candidate) is None


def test_three_scenes(spark):
    r = score(spark, [(1, H1), (2, H2), (3, H3)], [(10, H1), (20, H2), (30, H3)])
    assert (r.visual_score, r.match_spread_sec, r.distinct_candidate_matches) == (1.0, 2.0, 3)


def test_clustered_intro(spark):
    r = score(spark, [(0.2, H1), (1.0, H2), (1.8, H3)], [(0.1, H1), (0.9, H2), (1.7, H3)])
    assert r.match_spread_sec == pytest.approx(1.6) and r.distinct_candidate_matches == 3


def test_repeated_intro(spark):
    r = score(spark, [(1, H1), (50, H1), (100, H1)], [(5, H1)])
    assert (r.n_matched, r.match_spread_sec, r.candidate_match_spread_sec, r.distinct_candidate_matches) == (3, 99.0, 0.0, 1)


def test_independent_scenes(spark):
    r = score(spark, [(1, H1), (50, H2), (100, H3)], [(10, H1), (200, H2), (400, H3)])
    assert (r.match_spread_sec, r.candidate_match_spread_sec, r.distinct_candidate_matches) == (99.0, 390.0, 3)


def test_flash_frame(spark):
    preview = [(t, H1) for t in (16.4, 35.2, 40.6, 73.0, 78.9, 138.3)] + [(533.1, H2)]
    r = score(spark, preview, [(75.68, H1), (717.6, H2)])
    assert (r.n_matched, r.distinct_candidate_matches) == (7, 2)
    assert r.candidate_match_spread_sec == pytest.approx(717.6 - 75.68)


def test_durations_and_short_scenes(spark):
    rows = scene_rows(spark, {1: [(0, H1), (1, H1), (2, H1), (10, H1), (20, H1)]})
    kept = scenes.load_scenes(rows, MatchConfig(min_scene_duration=2.0)).orderBy("pos").collect()
    assert [r.timestamp_sec for r in kept] == [2.0, 10.0, 20.0]
    assert [r.scene_duration for r in kept] == [8.0, 10.0, None] and kept[0].n_kept == 3


def test_top_n(spark):
    rows = [(1, 100 + i, i / 20) for i in range(20)] + [(2, 100, 0.5), (2, 200, 0.5)]
    df = spark.createDataFrame(rows, "preview_id long, candidate_id long, combined_score double")
    found = {(r.preview_id, r.candidate_id) for r in matching.top_n(df, 5).filter("preview_id = 1").collect()}
    assert found == {(1, 100 + i) for i in range(15, 20)}
    assert [r.candidate_id for r in matching.top_n(df, 1).filter("preview_id = 2").collect()] == [100]


@pytest.mark.parametrize(
    "a, b, expected",
    [("1,2,3", "1 2 3", 1.0), ("15", "0", 1.0), ("31", "0", 0.0), ("1,2,3", "1", 1.0), ("", "1", 0.0), ("1,x", "1", 0.0), ("-1", "0", 1.0), (None, "1", 0.0)],
)
def test_audio_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    value = S.audio_similarity(S.parse_chromaprint(F.col("a")), S.parse_chromaprint(F.col("b")))
    assert df.select(value).first()[0] == expected


def test_packed_colors(spark):
    """Packed colours are as far apart as the arrays they stand for, whatever their length."""
    r = random.Random(3)
    color = lambda n: [r.randrange(16) for _ in range(n)]
    rows = [(color(n), color(m)) for n, m in [(64, 64)] * 20 + [(1, 1), (16, 16), (17, 17), (63, 63), (100, 100), (64, 63), (3, 20)]]
    rows += [([0] * 64, [15] * 64), ([15] * 64, [0] * 64), ([7] * 64, [7] * 64), (None, color(64)), (color(64), None), (None, None)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = df.select(S.packed_color_distance(S.packed_color(a), S.packed_color(b)).alias("p"), F.coalesce(S.color_distance(a, b), F.lit(0.0)).alias("q")).collect()
    assert [x.p for x in got] == pytest.approx([x.q for x in got], abs=1e-12) and max(x.q for x in got) == 1.0


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_shuffled_once_and_nothing_is_broadcast(spark):
    """Evidence goes by preview to its scores; colours and details of scenes are there when a pair is made."""
    rows = scene_rows(spark, {1: [(1, H1), (2, H2)], 2: [(1, H1), (9, H3)]})
    best = matching.best_scene_matches(video_rows(spark, {1: 10.0, 2: 100.0}), scenes.load_scenes(rows, FREE), empty(spark, "match_feedback"), FREE)
    plan = planned(matching.pair_scores(matching.within_color(best, FREE)))
    assert "Broadcast" not in plan and "hashpartitioning(candidate_id" not in plan
    assert plan[: plan.index("SortMergeJoin")].count("Exchange") == 1


def test_listed_pairs_are_not_shuffled(spark):
    videos, feedback = video_rows(spark, {1: 10.0, 2: 100.0, 3: 100.0}), spark.createDataFrame([(1, 2, "not_a_match", 1.0)], TABLES["match_feedback"])
    counts = spark.createDataFrame([(1, 3), (3, 5)], "video_id long, n_scenes long")
    pairs, cost = matching.candidate_pairs(videos, feedback), matching.pair_cost(videos, feedback, counts)
    assert [tuple(r) for r in cost.collect()] == [(1, 3, 15)]
    for df in (pairs, cost):
        plan = planned(df)
        assert "Broadcast" not in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_dismissed_pairs_stay_out(spark):
    videos = video_rows(spark, {1: 10.0, 2: 100.0, 3: 100.0})
    feedback = spark.createDataFrame([(1, 2, "not_a_match", 1.0)], TABLES["match_feedback"])
    assert [tuple(r) for r in matching.candidate_pairs(videos, feedback).collect()] == [(1, 3)]


@pytest.mark.parametrize("threshold", [0, 1, 2, 5, 8, 11])
def test_hamming_join_finds_all(spark, threshold):
    r = random.Random(threshold)
    base = [r.getrandbits(64) for _ in range(8)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 12))) for b in base for _ in range(12)} | {0, (1 << 64) - 1}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed] + [(None,), (signed[0],)], "hash long")
    got = {tuple(x) for x in hamming_join(df, df, threshold).collect()}
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b, distance(a, b)) for a in signed for b in signed if distance(a, b) <= threshold}


def test_stale_rows_are_counted(spark):
    ranked = spark.createDataFrame([(1, 2, 1.0, None, 1.0), (1, 9, 1.0, None, 1.0)], "preview_id long, candidate_id long, visual_score double, audio_score double, combined_score double")
    ranked = ranked.withColumn("scene_matches", F.array())
    stored, stale = matching.store_matches(ranked, video_rows(spark, {1: 1.0, 2: 2.0}))
    assert [r.candidate_id for r in stored.collect()] == [2] and stale.first()[0] == 1
