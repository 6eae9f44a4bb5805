"""The catalog's tables derived from the test tables, as Spark columns and as SQL text.

Every view stands here twice; tests compare the two row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import conform

ROOTS = ["/lib/src0", "/lib/src1", "/lib/src2", "/lib/src3", "/lib/src4"]
NOW = 1_800_000_000.0
STAGE_DIR = "/stage"


class Fixtures:
    """Views over the tables in sf_dir; each is built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def videos(self) -> DataFrame:
        i = F.col("doc_id")
        path = F.concat(F.lit("/lib/"), "source", F.lit("/"), i.cast("string"), F.lit(".mp4"))
        return conform(
            self.table("documents").select(
                i.alias("id"), path.alias("path"), F.concat(i.cast("string"), F.lit(".mp4")).alias("filename"),
                F.col("n_chars").alias("size_bytes"), (F.col("n_chars") / F.lit(10.0)).alias("duration_sec"),
                F.when(i % 13 != 0, 640 + i % 5 * 640).alias("width"), F.when(i % 13 != 0, 360 + i % 5 * 360).alias("height"),
                F.lit("h264").alias("codec"), F.col("lang").alias("container"), F.lit(1).alias("has_audio"),
                (F.lit(1.6e9) + i).alias("mtime"), F.lit("unknown").alias("role_guess"),
                F.when(i % 17 != 0, F.lit(1.7e9)).alias("fingerprinted_at"), F.when(i % 7 == 0, F.lit(1.7e9) + i).alias("missing_since"),
            ),
            "videos",
        )

    def lines(self) -> DataFrame:
        parts = self.table("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        earlier = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        return parts.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(earlier), F.lit(0)))

    def scenes(self) -> DataFrame:
        i, line = F.col("doc_id"), F.col("line")
        # the last digit goes by the video, so that copies of a line have near hashes, not equal ones
        digit = F.lower(F.hex(i % 16))
        digest = lambda tag: F.concat(F.substring(F.md5(F.concat(line, F.lit(tag))), 1, 15), digit)
        swap = i % 3 == 0
        return conform(
            self.lines().filter(F.length("line") > 20).select(
                (i * 100000 + F.col("pos")).alias("id"), i.alias("video_id"), F.col("pos").alias("scene_index"),
                (F.col("before") / F.lit(10.0)).alias("timestamp_sec"),
                F.when(swap, digest("#f")).otherwise(digest("")).alias("phash"), digest("#c").alias("phash_cropped"),
                F.when(swap, digest("")).otherwise(digest("#f")).alias("phash_flipped"),
                F.sha2(F.when(i % 5 == 0, F.concat(line, "source")).otherwise(line), 256).alias("color_sig"),
            ),
            "scenes",
        )

    def audio_fp(self) -> DataFrame:
        i = F.col("doc_id")
        number = F.transform(F.split("text", "\n"), lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10))
        return conform(
            self.table("documents").select(
                i.alias("video_id"), (F.col("n_chars") / F.lit(10.0)).alias("duration_sec"),
                F.array_join(number, ",").alias("fingerprint"), F.when(i % 5 != 0, 1).otherwise(0).alias("fp_ok"),
            ),
            "audio_fp",
        )

    def matches(self) -> DataFrame:
        """Three made-up candidates of each document but every fourth, as the queue's input."""
        i = F.col("doc_id")
        docs = self.table("documents").select(i)
        made = docs.filter(i % 4 != 0).select(i.alias("preview_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
        made = made.withColumn("candidate_id", F.col("preview_id") + F.col("k"))
        made = made.join(docs.withColumnRenamed("doc_id", "candidate_id"), "candidate_id", "left_semi")
        visual = ((F.col("preview_id") * 37 + F.col("k") * 11) % 100) / F.lit(100.0)
        audio = F.when((F.col("preview_id") + F.col("k")) % 3 != 0, (F.col("preview_id") * 13 % 50) / F.lit(50.0))
        made = made.withColumns({"visual_score": visual, "audio_score": audio})
        mixed = F.when(F.col("audio_score").isNotNull(), 0.65 * F.col("visual_score") + 0.35 * F.col("audio_score"))
        return conform(
            made.select(
                (F.col("preview_id") * 10 + F.col("k")).alias("id"), "preview_id", "candidate_id", "visual_score", "audio_score",
                F.coalesce(mixed, F.col("visual_score")).alias("combined_score"), F.lit(NOW).alias("computed_at"),
            ),
            "matches",
        )

    def decisions(self) -> DataFrame:
        i = F.col("doc_id")
        status = F.when(F.col("toxic") == 1, "staged").when(F.col("quality") == 0, "rejected")
        return conform(
            self.table("labels").select(
                i.alias("preview_id"), status.alias("status"), (i + 1).alias("matched_candidate_id"), (F.lit(1.7e9) + i).alias("decided_at")
            ).filter("status is not null"),
            "decisions",
        )

    def match_feedback(self) -> DataFrame:
        i = F.col("doc_id")
        rows = self.table("labels").filter("toxic = 1").select(
            i.alias("preview_id"), (i + 1).alias("candidate_id"), F.lit("not_a_match").alias("status"), (F.lit(1.7e9) + i).alias("decided_at")
        )
        return conform(rows, "match_feedback")

    def scan_runs(self) -> DataFrame:
        i = F.col("event_id")
        pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
        params = F.format_string('{"limit": %d, "fp_workers": %d}', i % 4 * 500, i % 7 + 2)
        return conform(
            self.table("events").select(
                i.alias("id"), params.alias("params_json"), pick("running", "paused", "failed", "interrupted").alias("status"),
                pick("inventory", "fingerprint", "match").alias("stage"),
                F.when(i % 6 != 0, i % 997).alias("stage_total"), (i % 211).alias("stage_done"),
                F.when(i % 5 != 0, F.lit(1.7e9) + i).alias("stage_started_at"), F.concat(F.lit("line\\n "), "props").alias("message"),
                (F.lit(1.7e9) - i % 50).alias("started_at"), (F.lit(1.7e9) + i).alias("updated_at"),
                F.when(i % 8 != 0, F.lit(1.7e9) + i * 2).alias("finished_at"), F.when(i % 9 != 0, i % 12).alias("target_workers"),
                (i % 31).alias("resume_baseline_done"), (i % 17 / F.lit(2.0)).alias("resume_baseline_elapsed"),
            ),
            "scan_runs",
        )

    def present(self) -> DataFrame:
        return self.videos().filter("id % 11 <> 0").select("path")

    def listing(self) -> DataFrame:
        """Files on disk: most known, some changed, moved or new, some of other kinds, some twice."""
        v = self.videos().filter("id % 11 <> 0")
        i = F.col("id")
        suffix = F.when(i % 10 == 3, ".MKV").when(i % 10 == 4, ".txt").otherwise(".mp4")
        moved = F.concat(F.lit("/lib/new/"), i.cast("string"), suffix)
        path = F.when((i % 10).isin(3, 4) | (i % 7 == 0), moved).otherwise(F.col("path"))
        base = v.select(
            path.alias("path"), path.alias("resolved_path"), (F.col("size_bytes") + F.when(i % 10 == 5, 1).otherwise(0)).alias("size_bytes"), "mtime", "duration_sec",
        )
        twice = base.filter("size_bytes % 9 = 0").select(F.concat(F.lit("/zlink"), "path").alias("path"), "resolved_path", "size_bytes", "mtime", "duration_sec")
        return base.unionByName(twice)

    def probed(self) -> DataFrame:
        """Probe results of the listed video files."""
        from ..operators.inventory import video_files

        files = video_files(self.listing())
        durations = self.listing().select("path", "duration_sec")
        return files.join(durations, "path").select(
            "path", "size_bytes", "duration_sec", F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit("h264").alias("codec"),
            F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("container"), F.lit(1).alias("has_audio"), "mtime",
        )

    def graded(self) -> DataFrame:
        """Hashes with graded distances: signs of embeddings over their median."""
        from ..functions.scalars import median_sign_hash

        return self.table("embeddings").select("vec_id", "label", median_sign_hash(F.col("embedding")).alias("hash"))


#: The same views for the oracle.
VIEWS = {
    "videos": """SELECT doc_id AS id, '/lib/' || source || '/' || doc_id || '.mp4' AS path, doc_id || '.mp4' AS filename,
        n_chars AS size_bytes, n_chars / 10.0::DOUBLE AS duration_sec,
        CASE WHEN doc_id % 13 <> 0 THEN 640 + doc_id % 5 * 640 END::INT AS width,
        CASE WHEN doc_id % 13 <> 0 THEN 360 + doc_id % 5 * 360 END::INT AS height,
        'h264' AS codec, lang AS container, 1::INT AS has_audio, 1.6e9::DOUBLE + doc_id AS mtime, 'unknown' AS role_guess,
        NULL::DOUBLE AS probed_at, CASE WHEN doc_id % 17 <> 0 THEN 1.7e9::DOUBLE END AS fingerprinted_at,
        CASE WHEN doc_id % 7 = 0 THEN 1.7e9::DOUBLE + doc_id END AS missing_since FROM documents""",
    "lines": """SELECT doc_id, source, pos, line, coalesce(sum(length(line) + 1) OVER
        (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))""",
    "scenes": """SELECT doc_id * 100000 + pos AS id, doc_id AS video_id, pos::INT AS scene_index, before / 10.0::DOUBLE AS timestamp_sec,
        substr(md5(CASE WHEN doc_id % 3 = 0 THEN line || '#f' ELSE line END), 1, 15) || lower(to_hex(doc_id % 16)) AS phash,
        substr(md5(line || '#c'), 1, 15) || lower(to_hex(doc_id % 16)) AS phash_cropped,
        substr(md5(CASE WHEN doc_id % 3 = 0 THEN line ELSE line || '#f' END), 1, 15) || lower(to_hex(doc_id % 16)) AS phash_flipped,
        sha256(CASE WHEN doc_id % 5 = 0 THEN line || source ELSE line END) AS color_sig FROM lines WHERE length(line) > 20""",
    "audio_fp": """SELECT doc_id AS video_id, n_chars / 10.0::DOUBLE AS duration_sec,
        array_to_string(list_transform(string_split(text, chr(10)), lambda x: ('0x' || substr(md5(x), 1, 8))::UBIGINT::VARCHAR), ',') AS fingerprint,
        CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END::INT AS fp_ok FROM documents""",
    "matches": """SELECT preview_id * 10 + k AS id, preview_id, preview_id + k AS candidate_id, visual_score, audio_score,
        CASE WHEN audio_score IS NOT NULL THEN 0.65::DOUBLE * visual_score + 0.35::DOUBLE * audio_score ELSE visual_score END AS combined_score,
        NULL::VARCHAR AS scene_matches_json, 1800000000.0::DOUBLE AS computed_at FROM (
        SELECT doc_id AS preview_id, k, ((doc_id * 37 + k * 11) % 100) / 100.0::DOUBLE AS visual_score,
        CASE WHEN (doc_id + k) % 3 <> 0 THEN (doc_id * 13 % 50) / 50.0::DOUBLE END AS audio_score
        FROM documents, (VALUES (1), (2), (3)) AS t(k) WHERE doc_id % 4 <> 0) WHERE preview_id + k IN (SELECT doc_id FROM documents)""",
    "decisions": """SELECT * FROM (SELECT doc_id AS preview_id, CASE WHEN toxic = 1 THEN 'staged' WHEN quality = 0 THEN 'rejected' END AS status,
        doc_id + 1 AS matched_candidate_id, 1.7e9::DOUBLE + doc_id AS decided_at, NULL::VARCHAR AS note FROM labels) WHERE status IS NOT NULL""",
    "match_feedback": """SELECT doc_id AS preview_id, doc_id + 1 AS candidate_id, 'not_a_match' AS status, 1.7e9::DOUBLE + doc_id AS decided_at
        FROM labels WHERE toxic = 1""",
    "scan_runs": """SELECT event_id AS id, '{"limit": ' || (event_id % 4 * 500) || ', "fp_workers": ' || (event_id % 7 + 2) || '}' AS params_json,
        ['running', 'paused', 'failed', 'interrupted'][event_id % 4 + 1] AS status, ['inventory', 'fingerprint', 'match'][event_id % 3 + 1] AS stage,
        CASE WHEN event_id % 6 <> 0 THEN event_id % 997 END AS stage_total, event_id % 211 AS stage_done,
        CASE WHEN event_id % 5 <> 0 THEN 1.7e9::DOUBLE + event_id END AS stage_started_at, 'line\\n ' || props AS message,
        1.7e9::DOUBLE - event_id % 50 AS started_at, 1.7e9::DOUBLE + event_id AS updated_at,
        CASE WHEN event_id % 8 <> 0 THEN 1.7e9::DOUBLE + event_id * 2 END AS finished_at,
        CASE WHEN event_id % 9 <> 0 THEN event_id % 12 END::INT AS target_workers, event_id % 31 AS resume_baseline_done,
        event_id % 17 / 2.0::DOUBLE AS resume_baseline_elapsed FROM events""",
    "present": "SELECT path FROM videos WHERE id % 11 <> 0",
    "base_files": """SELECT CASE WHEN id % 10 IN (3, 4) OR id % 7 = 0 THEN '/lib/new/' || id ||
        CASE WHEN id % 10 = 3 THEN '.MKV' WHEN id % 10 = 4 THEN '.txt' ELSE '.mp4' END ELSE path END AS path,
        size_bytes + CASE WHEN id % 10 = 5 THEN 1 ELSE 0 END AS size_bytes, mtime, duration_sec FROM videos WHERE id % 11 <> 0""",
    "listing": """SELECT path, path AS resolved_path, size_bytes, mtime, duration_sec FROM base_files UNION ALL
        SELECT '/zlink' || path, path, size_bytes, mtime, duration_sec FROM base_files WHERE size_bytes % 9 = 0""",
    "files": """SELECT min(path) AS path, arg_min(size_bytes, path) AS size_bytes, arg_min(mtime, path) AS mtime, arg_min(duration_sec, path) AS duration_sec
        FROM listing WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN
        ('.avi', '.flv', '.m4v', '.mkv', '.mov', '.mp4', '.mpeg', '.mpg', '.ts', '.webm', '.wmv') GROUP BY resolved_path""",
    "graded": """SELECT vec_id, label, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x:
        (CASE WHEN x > list_sort(embedding[2:64])[32] THEN 1 ELSE 0 END)::HUGEINT)), lambda h, x: h * 2 + x) AS wide FROM embeddings""",
}
