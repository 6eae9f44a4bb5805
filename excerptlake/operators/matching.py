"""Matching previews to candidates: pairs, scene evidence, scores, guards, ranking.

The evidence join goes by hash: distinct hashes meet in hamming_self_join, and the nearest scene of a
candidate is found for each distinct triple of hashes. Measures of pairs are made in cells of previews
and candidates (functions/pairing.py), evidence lists by one join of scenes, under the duration rule; videos that share no hash within the threshold never form a pair, so the
work follows matching scenes, not videos squared. No table that grows is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VARIANTS, MatchConfig
from ..functions import pairing
from ..functions.scalars import audio_similarity, combined_score, packed_color, packed_color_distance, parse_chromaprint
from ..session import work_folder, written
from .hamming import hamming_self_join
from .scenes import load_scenes


def fingerprinted_videos(videos: DataFrame) -> DataFrame:
    """Videos that take part in matching; missing ones do too and are hidden only in the queue."""
    return videos.filter(F.col("fingerprinted_at").isNotNull()).select("id", "duration_sec")


def dismissed_pairs(feedback: DataFrame) -> DataFrame:
    return feedback.filter("status = 'not_a_match'").select("preview_id", "candidate_id").distinct()


def duration_rule(p: Column, c: Column, cfg: MatchConfig) -> Column:
    """Both durations known, not zero and the candidate's positive; their ratio within the limits."""
    ratio = p / c
    return (p != 0) & (c > 0) & (ratio >= cfg.min_ratio) & (ratio <= cfg.max_ratio)


#: Slices that candidates are dealt to, so that a bucket of durations is no single task.
DEALT = 8


def _of_preview(pairs: DataFrame, name: str) -> DataFrame:
    """preview_id and the candidates of its pairs as one list: a preview takes it along, so that no
    pair is shuffled to be looked up. Decisions and results of a preview are few."""
    return pairs.groupBy("preview_id").agg(F.collect_set("candidate_id").alias(name)).hint("merge")


def _not_dismissed() -> Column:
    """Whether candidate_id isn't in the preview's list `dismissed`, which may be null."""
    return F.coalesce(~F.array_contains("dismissed", F.col("candidate_id")), F.lit(True))


def _duration_pairs(p: DataFrame, c: DataFrame, feedback: DataFrame, cfg: MatchConfig, base: float) -> DataFrame:
    """All pairs of p (preview_id, pd and more) and c (candidate_id, cd and more) within the duration
    rule that weren't dismissed.

    The ratio is a range, so durations are put into logarithmic buckets: a candidate stands in its
    own, a preview in all that its eligible candidates can be in; an equi-join on buckets remains.
    Everything about a side stands in its row before the join: pairs are made and never shuffled.
    """
    bucket = lambda d: F.floor(F.log(d) / math.log(base)).cast("int")
    reach = F.sequence(bucket(F.col("pd") / cfg.max_ratio) - 1, bucket(F.col("pd") / cfg.min_ratio) + 1)
    p = p.join(_of_preview(dismissed_pairs(feedback), "dismissed"), "preview_id", "left").withColumn("bucket", F.explode(reach))
    p = p.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    c = c.withColumn("bucket", bucket(F.col("cd"))).withColumn("slice", F.pmod(F.xxhash64("candidate_id"), F.lit(DEALT)).cast("int"))
    met = p.join(c.hint("merge"), ["bucket", "slice"]).filter("preview_id <> candidate_id")
    return met.filter(duration_rule(F.col("pd"), F.col("cd"), cfg) & _not_dismissed())


def _sides(videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = fingerprinted_videos(videos).filter("duration_sec > 0")
    return known.toDF("preview_id", "pd"), known.toDF("candidate_id", "cd")


def candidate_pairs(videos: DataFrame, feedback: DataFrame, cfg: MatchConfig = MatchConfig(), base: float = 2.0) -> DataFrame:
    """preview_id, candidate_id of all pairs within the duration rule that weren't dismissed."""
    return _duration_pairs(*_sides(videos), feedback, cfg, base).select("preview_id", "candidate_id")


def pair_cost(videos: DataFrame, feedback: DataFrame, counts: DataFrame, cfg: MatchConfig = MatchConfig(), base: float = 2.0) -> DataFrame:
    """Scene comparisons of each of the candidate_pairs that have scenes, the weight by which work can be dealt."""
    n = counts.select(F.col("video_id").alias("vid"), "n_scenes").hint("merge")
    p, c = (d.join(n, d[d.columns[0]] == n.vid).drop("vid").withColumnRenamed("n_scenes", f"{d.columns[1]}_n") for d in _sides(videos))
    pairs = _duration_pairs(p, c, feedback, cfg, base)
    return pairs.select("preview_id", "candidate_id", (F.col("pd_n") * F.col("cd_n")).alias("cost"))


#: Cells of previews and of candidates: a candidate's scene goes to each cell of previews, and the other way round.
PREVIEW_CELLS, CANDIDATE_CELLS = 12, 3

HASHES = ["h0", "h1", "h2"]


def _faces(videos: DataFrame, scenes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Faces, the distinct triples of hashes, by number; and scenes of known videos with their face."""
    known = fingerprinted_videos(videos).hint("merge")
    scenes = scenes.join(known, F.col("video_id") == F.col("id")).select(
        "video_id", "duration_sec", "pos", "n_kept", "timestamp_sec", "scene_duration", packed_color(F.col("color")).alias("color"), *HASHES
    )
    scenes = written(scenes, f"{folder}/scenes")
    faces = written(scenes.select(*HASHES).distinct().withColumn("face", F.monotonically_increasing_id()), f"{folder}/faces")
    named = faces.toDF(*[f"of_{h}" for h in HASHES], "face").hint("merge")
    same = reduce(lambda a, b: a & b, [F.col(h).eqNullSafe(F.col(f"of_{h}")) for h in HASHES])
    return faces, written(scenes.join(named, same).drop(*named.columns[:-1], *HASHES), f"{folder}/placed")


def _near_faces(faces: DataFrame, cfg: MatchConfig, folder: str) -> DataFrame:
    """s, t and near: of all their hashes within the threshold the least (distance, variant of s, variant of t), as one number."""
    shown = faces.select("face", F.posexplode(F.array(*HASHES)).alias("v", "hash")).filter("hash is not null")
    links = written(hamming_self_join(shown.select("hash"), cfg.hash_threshold), f"{folder}/links")
    met = links.join(shown.toDF("s", "pv", "left_hash").hint("merge"), "left_hash")
    met = met.join(shown.toDF("t", "cv", "right_hash").hint("merge"), "right_hash")
    return met.groupBy("s", "t").agg(F.min(F.col("distance") * 16 + F.col("pv") * 4 + F.col("cv")).alias("near"))


def _nearest(placed: DataFrame, near: DataFrame) -> DataFrame:
    """For each face and candidate video the nearest scene: the least (distance, scene, preview variant, candidate variant).

    A face that repeats in a video counts once, at its first scene: no later one can be nearer.
    """
    first = F.min(F.struct("pos", "timestamp_sec", "scene_duration", "color", "duration_sec")).alias("c")
    c = placed.groupBy(F.col("face").alias("t"), F.col("video_id").alias("candidate_id")).agg(first)
    distance, variants = F.floor(F.col("near") / 16).cast("int"), F.col("near") % 16
    order = F.struct(distance.alias("distance"), F.col("c.pos").alias("c_pos"), variants.alias("variants"), F.col("c"))
    least = near.join(c.hint("merge"), "t").groupBy("s", "candidate_id").agg(F.min(order).alias("m"))
    return least.select(
        "s", "candidate_id", "m.distance", "m.c_pos", F.floor(F.col("m.variants") / 4).cast("int").alias("pv"), (F.col("m.variants") % 4).cast("int").alias("cv"),
        F.col("m.c.timestamp_sec").alias("candidate_ts"), F.col("m.c.scene_duration").alias("c_duration"), F.col("m.c.color").alias("c_color"),
        F.col("m.c.duration_sec").alias("cd"),
    )


class Evidence:
    """Scenes of fingerprinted videos and, for each face, the nearest scene of every candidate, written once.

    Scenes of equal hashes (a face) have the same nearest scenes, so those are found by face; what all
    pairs need is made from them in one join, each row once.
    """

    def __init__(self, videos: DataFrame, scenes: DataFrame, feedback: DataFrame, cfg: MatchConfig = MatchConfig()):
        self.cfg, self.folder = cfg, work_folder(videos.sparkSession)
        self.feedback = feedback
        faces, self.placed = _faces(videos, scenes, self.folder)
        self.near = written(_near_faces(faces, cfg, self.folder), f"{self.folder}/near")

    @cached_property
    def nearest(self) -> DataFrame:
        return written(_nearest(self.placed, self.near), f"{self.folder}/nearest")

    def _cells(self) -> DataFrame:
        """Everything that a cell of previews and candidates needs to make its pairs, as rows of four kinds.

        Only faces that are near another one or stand in two videos can give a pair; the rest stay out.
        """
        videos = self.placed.groupBy("face").agg((F.min("video_id") < F.max("video_id")).alias("several"))
        near = self.near.filter("s <> t").unionByName(self.near.filter("s = t").join(videos.filter("several").hint("merge"), F.col("s") == F.col("face")).drop("face", "several"))
        near = written(near, f"{self.folder}/shared")
        met = near.select(F.col("s").alias("face")).distinct().hint("merge")
        scenes = written(self.placed.filter("duration_sec > 0").join(met, "face", "left_semi"), f"{self.folder}/met")
        of_preview = lambda c: F.pmod(F.xxhash64(c), F.lit(PREVIEW_CELLS)).cast("int")
        of_candidate = lambda c: F.pmod(F.xxhash64(c), F.lit(CANDIDATE_CELLS)).cast("int")
        all_previews = F.explode(F.sequence(F.lit(0), F.lit(PREVIEW_CELLS - 1)))
        all_candidates = F.explode(F.sequence(F.lit(0), F.lit(CANDIDATE_CELLS - 1)))

        def rows(df, kind, id_, face, p, c, **given):
            none = {"duration": F.lit(0.0), "number": F.lit(0), "n_kept": F.lit(0), "ts": F.lit(0.0), "color": F.lit(None)} | given
            types = {"duration": "double", "number": "long", "n_kept": "int", "ts": "double", "color": "array<bigint>"}
            named = [F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(face).alias("face"), *[none[k].cast(t).alias(k) for k, t in types.items()]]
            return df.select((p * CANDIDATE_CELLS + c).alias("cell"), *named)

        detail = {"duration": F.col("duration_sec"), "number": F.col("pos"), "n_kept": F.col("n_kept"), "ts": F.col("timestamp_sec"), "color": F.col("color")}
        found = scenes.select(of_preview("video_id").alias("p"), F.col("face").alias("s")).distinct().join(near.hint("merge"), "s")
        said = dismissed_pairs(self.feedback)
        once = lambda df, cells: df.withColumn("at", cells)
        kinds = [
            rows(once(scenes, all_candidates), pairing.PREVIEW, "video_id", "face", of_preview("video_id"), F.col("at"), **detail),
            rows(once(scenes, all_previews), pairing.CANDIDATE, "video_id", "face", F.col("at"), of_candidate("video_id"), **detail),
            rows(once(found, all_candidates), pairing.NEAR, "s", "t", F.col("p"), F.col("at"), number=F.col("near")),
            rows(said, pairing.DISMISSED, "preview_id", "candidate_id", of_preview("preview_id"), of_candidate("candidate_id")),
        ]
        return reduce(DataFrame.unionByName, kinds)

    def measured(self, kept, *columns: str) -> DataFrame:
        """preview_id, candidate_id and measures of the pairs that `kept` (functions/pairing.py) chooses of a cell's, with matching colours."""
        rule, color = (self.cfg.min_ratio, self.cfg.max_ratio), self.cfg.color_threshold

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from pairing.pairs_in_cell(pa.Table.from_batches(batches), rule, color, kept, list(columns))

        types = {pa.int64(): "long", pa.float64(): "double"}
        schema = "preview_id long, candidate_id long" + "".join(f", {c} {types[pairing.COLUMNS[c]]}" for c in columns)
        return self._cells().groupBy("cell").applyInArrow(pairs, schema)

    def scored(self, kept=pairing.everything, *columns: str) -> DataFrame:
        """The measures of pair_scores, without evidence lists: all of them, or `columns`."""
        df = self.measured(kept, *(columns or pairing.COLUMNS))
        return df.withColumn("visual_score", F.col("n_matched") / F.col("n_kept")).drop("n_kept") if "n_kept" in df.columns else df

    def passed(self) -> DataFrame:
        """The scored pairs that pass the guards."""
        c = self.cfg
        return self.scored(pairing.guarded(c.min_visual_score, c.min_matched_scenes, c.min_match_spread, c.min_candidate_match_spread))

    def most_matched(self, n: int) -> DataFrame:
        """The scored pairs that can be among the n best of their preview by visual score, ties by candidate: n of each cell at most."""
        return self.scored(pairing.most_matched(n), "n_matched", "n_kept")

    def best(self, only: DataFrame | None = None) -> DataFrame:
        """For each preview scene and candidate video, the nearest candidate scene; of the pairs in `only`, if given."""
        p = self.placed.select(
            F.col("video_id").alias("preview_id"), F.col("duration_sec").alias("pd"), F.col("pos").alias("p_pos"), F.col("face").alias("s"),
            "n_kept", F.col("timestamp_sec").alias("preview_ts"), F.col("scene_duration").alias("p_duration"), F.col("color").alias("p_color"),
        )
        p = p.join(_of_preview(dismissed_pairs(self.feedback), "dismissed"), "preview_id", "left")
        rule = duration_rule(F.col("pd"), F.col("cd"), self.cfg) & (F.col("preview_id") != F.col("candidate_id")) & _not_dismissed()
        if only is not None:
            p = p.join(_of_preview(only, "wanted"), "preview_id")
            rule = rule & F.array_contains("wanted", F.col("candidate_id"))
        return p.join(self.nearest.hint("merge"), "s").filter(rule).select(
            "preview_id", "candidate_id", "p_pos", "distance", "c_pos", "pv", "cv", "n_kept", "preview_ts", "p_duration", "candidate_ts", "c_duration",
            packed_color_distance(F.col("p_color"), F.col("c_color")).alias("color_distance"),
        )


def best_scene_matches(videos: DataFrame, scenes: DataFrame, feedback: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """For each preview scene and candidate video, the nearest candidate scene within the threshold.

    Ties go to the first candidate scene, then preview variant, then candidate variant. `scenes`
    comes from load_scenes.
    """
    return Evidence(videos, scenes, feedback, cfg).best()


def within_color(best: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Matches whose colours agree; the guard looks at the nearest scene only, so it comes after it."""
    return best.filter(F.col("color_distance") <= cfg.color_threshold)


def pair_scores(matched: DataFrame) -> DataFrame:
    """Evidence list and visual measures of each pair.

    A preview's rows are brought together once, as they are; many partitions keep each one's pairs in memory.
    """
    label = lambda v: F.element_at(F.array(*map(F.lit, VARIANTS)), v + 1)
    evidence = F.struct("p_pos", "near", "candidate_ts", "preview_ts", "p_duration", "c_duration")
    pv, cv = (lambda e: F.shiftright(e["near"], 2).bitwiseAND(F.lit(3))), (lambda e: e["near"].bitwiseAND(F.lit(3)))
    shown = lambda e: F.struct(
        F.shiftright(e["near"], 4).alias("distance"), e["candidate_ts"].alias("candidate_ts"), F.concat_ws("-vs-", label(pv(e)), label(cv(e))).alias("variant"),
        e["preview_ts"].alias("preview_ts"), e["p_duration"].alias("preview_scene_duration"), e["c_duration"].alias("candidate_scene_duration"),
    )
    matched = matched.withColumn("near", F.col("distance") * 16 + F.col("pv") * 4 + F.col("cv")).drop("distance", "pv", "cv", "c_pos", "color_distance")
    parts = 4 * int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return matched.repartition(parts, "preview_id").groupBy("preview_id", "candidate_id").agg(
        F.count("*").alias("n_matched"),
        (F.count("*") / F.first("n_kept")).alias("visual_score"),
        (F.max("preview_ts") - F.min("preview_ts")).alias("match_spread_sec"),
        (F.max("candidate_ts") - F.min("candidate_ts")).alias("candidate_match_spread_sec"),
        F.count_distinct("candidate_ts").alias("distinct_candidate_matches"),
        F.transform(F.array_sort(F.collect_list(evidence)), shown).alias("scene_matches"),
    )


def with_audio(pairs: DataFrame, audio: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """audio_score where both sides have a usable fingerprint, and the combined score."""
    usable = audio.filter((F.col("fp_ok") != 0) & (F.col("fingerprint") != ""))
    side = lambda who: usable.select(
        F.col("video_id").alias(f"{who}_id"), F.lit(True).alias(f"{who}_ok"), parse_chromaprint(F.col("fingerprint")).alias(f"{who}_fp")
    ).hint("merge")
    joined = pairs.join(side("preview"), "preview_id", "left").join(side("candidate"), "candidate_id", "left")
    both = F.col("preview_ok") & F.col("candidate_ok")
    scored = joined.withColumn("audio_score", F.when(both, audio_similarity(F.col("preview_fp"), F.col("candidate_fp"))))
    scored = scored.withColumn("combined_score", combined_score(F.col("visual_score"), F.col("audio_score"), cfg))
    return scored.drop("preview_ok", "candidate_ok", "preview_fp", "candidate_fp")


def guarded(pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs with enough score and independent evidence."""
    rules = [
        F.col("visual_score") >= cfg.min_visual_score,
        F.col("distinct_candidate_matches") >= cfg.min_matched_scenes,
        F.col("match_spread_sec") >= cfg.min_match_spread,
        F.col("candidate_match_spread_sec") >= cfg.min_candidate_match_spread,
    ]
    return pairs.filter(reduce(lambda a, b: a & b, rules))


def top_n(pairs: DataFrame, n: int, by: str = "combined_score") -> DataFrame:
    """The n best candidates of each preview with their rank; ties go to the smaller candidate_id.

    Spark limits the groups of the window before the shuffle, so a preview with very many
    candidates sends n rows a task.
    """
    order = Window.partitionBy("preview_id").orderBy(F.desc(by), "candidate_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def ranked_pairs(evidence: Evidence, audio: DataFrame) -> DataFrame:
    """The ranked matches of each preview without their evidence lists. Audio is compared of pairs that pass the guards only."""
    cfg = evidence.cfg
    return top_n(with_audio(evidence.passed(), audio, cfg), cfg.top_n)


def match_run(
    videos: DataFrame, scenes: DataFrame, audio: DataFrame, feedback: DataFrame, cfg: MatchConfig = MatchConfig()
) -> DataFrame:
    """All stages from stored fingerprints to the ranked matches of each preview, with the evidence of these."""
    evidence = Evidence(videos, load_scenes(scenes, cfg), feedback, cfg)
    ranked = written(ranked_pairs(evidence, audio), f"{evidence.folder}/ranked")
    lists = pair_scores(within_color(evidence.best(ranked), cfg)).select("preview_id", "candidate_id", "scene_matches")
    return ranked.join(lists.hint("merge"), ["preview_id", "candidate_id"])


def store_matches(ranked: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the matches table, without pairs whose videos are gone, and how many those were."""
    ids = videos.select("id")
    alive = ranked.join(ids.withColumnRenamed("id", "preview_id"), "preview_id", "left_semi")
    alive = alive.join(ids.withColumnRenamed("id", "candidate_id"), "candidate_id", "left_semi")
    stored = alive.withColumn("scene_matches_json", F.to_json("scene_matches", {"ignoreNullFields": "false"}))
    stale = ranked.agg(F.count("*").alias("n")).crossJoin(alive.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("n_stale"))
    columns = ["preview_id", "candidate_id", "visual_score", "audio_score", "combined_score", "scene_matches_json"]
    return stored.select(*columns), stale
