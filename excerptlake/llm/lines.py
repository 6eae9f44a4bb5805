"""Line dedup: repeated runs of lines, and repeated content-defined chunks of lines.

Runs of MIN_WORDS words or more are found wherever they begin and end: of each line the shortest run
of that many words from it on and up to it is a candidate. Every line of a longer run lies in such a
candidate inside the run, so a run that occurs again anywhere goes as a whole, whatever stands
around it; the run of the candidates that repeat is as long as the repeat is.

Shorter repeats count as chunks of several lines: a rolling hash over the last WINDOW line hashes
ends a chunk after a line where it is 0 modulo DIVISOR, once the chunk has MIN_LINES lines
(MAX_LINES end it anyway; a shorter rest joins the last chunk). Boundaries follow content, so a
passage shifted within another text mostly falls into the same chunks again, but not at its edges.

Of each candidate the first by (doc_id, hash of the text, place) stays and the others go, after their bytes were
compared with the first one's. An occurrence that overlaps the first one within a document is part
of it and stays.

Plan: (key, place) rows without text find the repeated keys by a pre-aggregated minimum; repeated
spans at the same distance from their first ones are joined to runs; only then text moves, once for
each run, to be compared; the removed places go back to the documents by doc_id. Every join has one
row per key on one side, so hot keys can be split by skew handling; they are sort-merge joins by
hint, as what they join to grows with the input and is never broadcast.

Defined cases: null text stays null; a text without repeats stays as it is, a text whose lines
all go is the empty text (the row stays); rows equal in doc_id and text count as one document, so
their copies at one place are all first; rows that share a doc_id only are documents in the order
of a hash of their text; null doc_id sorts before all others; other columns stay,
n_chars, where there is one, follows the new text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, extended, map_arrow, table, work_folder

WINDOW, DIVISOR, MIN_LINES, MAX_LINES, MIN_WORDS = 2, 2, 2, 64, 50
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """Begin and end line of each chunk; the chunks cover all lines in order."""
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    bounds, begin, rolling = [], 0, 0
    out_factor = pow(_BASE, WINDOW, 1 << 64)
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * out_factor) & _MASK
        size = i + 1 - begin
        if size >= MIN_LINES and ((rolling >> 32) % DIVISOR == 0 or size >= MAX_LINES):
            bounds.append((begin, i + 1))
            begin = i + 1
    if begin < len(lines):
        if len(lines) - begin < MIN_LINES and bounds:
            begin = bounds.pop()[0]
        bounds.append((begin, len(lines)))
    return bounds


def candidates(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, end line, chunk) of the chunks that may be removed as repeats."""
    lines = text.split(b"\n")
    out = []
    for a, b in chunk_bounds(lines):
        chunk = b"\n".join(lines[a:b])
        if chunk and (b - a >= MIN_LINES or len(chunk.split()) >= MIN_WORDS):
            out.append((a, b, chunk))
    return out


def passages(lines: list[bytes]) -> set[tuple[int, int]]:
    """Begin and end of the shortest runs with MIN_WORDS words from each line on, and up to each line.

    Each line of any run of MIN_WORDS words or more lies in one of these that lies in the run: the
    one from this line on, or else the one up to the run's end.
    """
    total = [0]
    for line in lines:
        total.append(total[-1] + len(line.split()))
    out, end, begin = set(), 0, 0
    for i in range(len(lines)):
        while end < len(lines) and total[end] - total[i] < MIN_WORDS:
            end += 1
        if total[end] - total[i] < MIN_WORDS:
            break
        out.add((i, end))
    for j in range(1, len(total)):
        if total[j] < MIN_WORDS:
            continue
        while total[j] - total[begin + 1] >= MIN_WORDS:
            begin += 1
        out.add((begin, j))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th and text of the rows with text; th tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, place and n (first line and number of lines), k1 and k2 (128 bits of hash) of what
    may be removed as a repeat: the candidates and the passages."""

    def make():
        digest = xxhash.xxh3_128_digest

        def step(batch):
            rows, places, counts, keys = [], [], [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary())):
                text = text.as_buffer().to_pybytes()
                lines = text.split(b"\n")
                hashes = b"".join([digest(x) for x in lines])  # a span's key hashes these, whatever its length
                for a, b in passages(lines) | {(a, b) for a, b, _ in candidates(text)}:
                    rows.append(row)
                    places.append(a)
                    counts.append(b - a)
                    keys.append(digest(hashes[16 * a : 16 * b]))
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            own = [batch.column(k).take(pa.array(rows, pa.int32())) for k in (0, 1)]
            columns = [*own, pa.array(places, pa.int32()), pa.array(counts, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "place", "n", "k1", "k2"])

        return step

    return map_arrow(_rows(docs), make, "doc_id long, th long, place int, n int, k1 long, k2 long")


def repeated_runs(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, th, place, n, first_doc, first_th, first_place: runs of lines that occur before, by their hashes.

    Repeated spans that lie at the same distance from their first ones and overlap or touch are one run.
    """
    at = F.struct("doc_id", "th", "place")
    firsts = spans(docs).groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count("*").alias("spans"))
    firsts = cut(firsts.filter("spans > 1").drop("spans"), f"{folder}/firsts")
    found = spans(docs).join(firsts.hint("merge"), ["k1", "k2"])
    # a span that overlaps its first one within a document is part of it
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    found = found.filter(~same | (F.col("first.place") + F.col("n") <= F.col("place"))).select(
        "doc_id", "th", "place", (F.col("place") + F.col("n")).alias("end"),
        F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"), (F.col("place") - F.col("first.place")).alias("shift"),
    )
    key = ["doc_id", "th", "first_doc", "first_th", "shift"]
    pair = Window.partitionBy(*key).orderBy("place")
    reached = F.max("end").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.withColumn("new", F.coalesce(F.col("place") > reached, F.lit(True)).cast("int"))
    numbered = begun.withColumn("run", F.sum("new").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*key, "run").agg(F.min("place").alias("place"), F.max("end").alias("end"))
    runs = runs.select(*key[:4], "place", (F.col("end") - F.col("place")).alias("n"), (F.col("place") - F.col("shift")).alias("first_place"))
    return cut(runs, f"{folder}/runs")


def run_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, th, place, n and the bytes of each of the distinct places (doc_id, th, place, n)."""
    wanted = places.groupBy(F.col("doc_id").alias("did"), F.col("th").alias("dth")).agg(F.collect_set(F.struct("place", "n")).alias("places"))
    own = (F.col("th") == F.col("dth")) & F.col("doc_id").eqNullSafe(F.col("did"))
    joined = _rows(docs).join(wanted.hint("merge"), own).select("doc_id", "th", "text", "places")

    def make():
        def step(batch):
            for k in range(batch.num_rows):  # a batch each: a document's runs may hold its text several times
                lines = batch.column(2)[k].as_py().encode().split(b"\n")
                at = [(x["place"], x["n"]) for x in batch.column(3)[k].as_py()]
                texts = [b"\n".join(lines[a : a + n]) for a, n in at]
                rows = [pa.array([batch.column(j)[k].as_py()] * len(at), pa.int64()) for j in (0, 1)]
                columns = [*rows, *(pa.array(list(x), pa.int32()) for x in zip(*at)), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "place", "n", "bytes"])

        return step

    return map_arrow(joined, make, "doc_id long, th long, place int, n int, bytes binary")


def repeated_places(docs: DataFrame, folder: str) -> DataFrame:
    """did, dth, places: first line and number of lines of the runs to remove from each row that has any."""
    runs = repeated_runs(docs, folder)
    first_places = runs.select(F.col("first_doc").alias("doc_id"), F.col("first_th").alias("th"), F.col("first_place").alias("place"), "n")
    texts = run_texts(docs, runs.select("doc_id", "th", "place", "n").union(first_places))
    # repeated rows give a place several times
    texts = cut(texts.groupBy("doc_id", "th", "place", "n").agg(F.min("bytes").alias("bytes")), f"{folder}/texts")

    def with_bytes(rows: DataFrame, doc: str, th: str, place: str, name: str) -> DataFrame:
        of = texts.select(F.col("doc_id").alias("o"), F.col("th").alias("h"), F.col("place").alias("q"), F.col("n").alias("l"), F.col("bytes").alias(name))
        same = (F.col(th) == F.col("h")) & (F.col(place) == F.col("q")) & (F.col("n") == F.col("l")) & F.col(doc).eqNullSafe(F.col("o"))
        return rows.join(of.hint("merge"), same).drop("o", "h", "q", "l")

    found = with_bytes(with_bytes(runs, "doc_id", "th", "place", "bytes"), "first_doc", "first_th", "first_place", "first_bytes")
    found = found.filter(F.col("bytes") == F.col("first_bytes"))
    marks = found.groupBy(F.col("doc_id").alias("did"), F.col("th").alias("dth")).agg(F.collect_set(F.struct("place", "n")).alias("places"))
    return cut(marks, f"{folder}/marks")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines, n_removed_lines beside it."""
    spark = docs.sparkSession
    marks = repeated_places(docs, work_folder(spark))
    taken = ("text", "n_lines", "n_removed_lines")
    rest = [f.name for f in docs.schema.fields if f.name not in taken]
    inner = [F.col(f"`{name}`") for name in rest]
    base = docs.select(F.struct(*inner).alias("row"), F.col("doc_id").cast("long").alias("did"), F.col("text").cast("string").alias("text"))
    marks = marks.withColumnsRenamed({"did": "mark_id", "dth": "mark_th"})
    own = (F.xxhash64("text") == F.col("mark_th")) & F.col("did").eqNullSafe(F.col("mark_id"))
    joined = base.join(marks.hint("merge"), own, "left").select("row", "text", "places")

    def make():
        def step(batch):
            texts, counts, gone = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = [] if text is None else text.split("\n")
                drop = set()
                for x in places or ():
                    drop.update(range(x["place"], min(x["place"] + x["n"], len(lines))))
                if drop:
                    text = "\n".join([line for k, line in enumerate(lines) if k not in drop])
                texts.append(text)
                counts.append(len(lines))
                gone.append(len(drop))
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_removed_lines"])

        return step

    schema = extended(joined.select("row", "text"), n_lines="long", n_removed_lines="long")
    out = map_arrow(joined, make, schema)
    columns = [F.length("text").cast("long").alias(n) if n == "n_chars" else F.col(f"row.`{n}`").alias(n) for n in rest]
    return out.select(*columns, "text", "n_lines", "n_removed_lines")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", "text")
