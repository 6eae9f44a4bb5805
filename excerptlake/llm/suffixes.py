"""Removal of long repeats by a logarithmic family of suffix indexes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Whole suffix arrays hold a number for each byte, several times the input, so the arrays
here are sparse: of each LENGTH-byte string the K-byte gram with the least hash (the leftmost of
equal ones) is its anchor, a function of the string alone, so equal strings have their anchors at
the same offset. A run of strings with one anchor is a segment. Suffixes are entered at anchors
only, about one in 14 bytes, and ordered by the hash of what they begin with.

Index family: documents come in batches by ascending doc_id. A batch is sorted into an array, which
is merge-scanned against the arrays of all levels; then it becomes a level, and levels of like size
merge, so there are logarithmically many and each entry is merged logarithmically often. The key
space is split into buckets, and each has its own family, so tasks hold BUCKET_BYTES of input each.

Two passes find the exact answer. The first enters segments: a segment that an earlier document
has is a repeat as a whole. Where an anchor gram has come before, but in another segment, both
segments may share some strings: they are handed to the second pass, which enters their single
LENGTH-byte strings into a family of the same kind. Strings are compared by 64 bits of hash within a
bucket chosen by other bits. Then the ranges go back to the documents, which are cut byte by byte.

Defined cases: null text is empty; texts under LENGTH bytes keep everything; a null doc_id counts
as smaller than all others; documents with equal doc_id don't repeat each other, and if their texts
differ each is cut by its own ranges; extra columns are ignored by the query; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, cut, input_bytes, map_arrow, table, text_or_empty, work_folder

LENGTH, K = 50, 24
BUCKET_BYTES = 1 << 20
#: Bytes of text a map task gathers before it deals their entries to buckets; entries of a batch.
UNIT_BYTES, BATCH = 8 << 20, 1 << 16
BUCKETS_A_TASK = 8
BLOCK = 1 << 22  # strings of one document looked at together
#: Share of a sample (of about SAMPLE_BYTES of input) from which an anchor gram is hot, and the group
#: of its entries, which are dealt by key and all looked at in the second pass.
HOT_SHARE, SAMPLE_BYTES, HOT = 1 << 12, 4 << 20, np.uint32(0xFFFFFFFF)
#: Neighbouring segments of at most 27 strings that one entry may stand for.
MERGED = 2000
NULL_ID = -(1 << 63)
_INDEX = np.uint64((1 << 24) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15


# --- anchors ---------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes, from runs of doubling length."""
    power, length = np.uint64(_MULTIPLIER), 1
    run = data.astype(np.uint64) + np.uint64(1)
    total, total_length = None, 0
    while True:
        if size & 1:
            if total is None:
                total, total_length = run, length
            else:
                n = len(data) - (total_length + length) + 1
                total = total[:n] * power + run[total_length : total_length + n]
                total_length += length
        size >>= 1
        if not size:
            break
        n = len(data) - 2 * length + 1
        run = run[:n] * power + run[length : length + n]
        with np.errstate(over="ignore"):
            power = power * power
        length *= 2
    total = total ^ total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    length = 1
    out = values
    while 2 * length <= width:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - length : width - length + n])


def segments(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a text: anchor gram hash, first string and number of strings per segment."""
    raw = np.frombuffer(text, np.uint8)
    for begin in range(0, len(raw) - LENGTH + 1, BLOCK):
        data = raw[begin : begin + BLOCK + LENGTH - 1]
        grams = gram_hashes(data, K)
        keyed = grams & ~_INDEX | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_least(keyed, LENGTH - K + 1) & _INDEX).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        yield grams[anchor[first]], first + begin, np.diff(np.append(first, len(anchor)))


# --- index family ----------------------------------------------------------------------------


class IndexFamily:
    """Levels of sorted arrays of the entries (group, key) seen so far, each key once.

    add() takes the entries of a run of documents, all later than those before, and tells for each
    whether an earlier document has its key, and whether one has its group under another key.
    Entries whose group is met under another key later on are marked; marked() gives them.
    """

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, group: np.ndarray, key: np.ndarray, doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((doc, key))
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least = np.empty(len(key), doc.dtype)
        least[order] = np.repeat(doc[order][first], np.diff(np.append(first, len(key))))
        repeat = doc > least
        by_group = np.lexsort((doc, group))
        edge = np.flatnonzero(np.concatenate([[True], group[by_group][1:] != group[by_group][:-1]]))
        sizes = np.diff(np.append(edge, len(group)))
        earliest = np.empty(len(group), doc.dtype)
        earliest[by_group] = np.repeat(doc[by_group][edge], sizes)
        met = doc > earliest
        latest = np.empty(len(group), doc.dtype)
        latest[by_group] = np.repeat(doc[by_group][np.append(edge[1:], len(group)) - 1], sizes)
        wanted = latest > doc  # a later document of the batch has the group
        for level in self.levels:
            place = np.minimum(np.searchsorted(level["keys"], key), len(level["keys"]) - 1)
            repeat |= level["keys"][place] == key
        new = ~repeat
        for level in self.levels:
            low = np.searchsorted(level["group"], group[new], "left")
            high = np.searchsorted(level["group"], group[new], "right")
            hit = high > low
            met[np.flatnonzero(new)[hit]] = True
            change = np.zeros(len(level["group"]) + 1, np.int64)
            np.add.at(change, low[hit], 1)
            np.add.at(change, high[hit], -1)
            level["wanted"] |= np.cumsum(change[:-1]) > 0
        enter = order[first]
        enter = enter[~repeat[enter]]
        if len(enter):
            enter = enter[np.argsort(group[enter], kind="stable")]
            self.levels.append(
                {"group": group[enter], "keys": np.sort(key[enter]), "row": row[enter], "wanted": met[enter] | wanted[enter]}
            )
        while len(self.levels) > 1 and len(self.levels[-2]["group"]) < 2 * len(self.levels[-1]["group"]):
            self._merge()
        return repeat, met

    def _merge(self) -> None:
        """Merge the two smallest levels."""
        a, b = self.levels.pop(), self.levels.pop()
        group = np.concatenate([a["group"], b["group"]])
        order = np.argsort(group, kind="stable")
        merged = {k: np.concatenate([a[k], b[k]])[order] for k in ("row", "wanted")}
        self.levels.append({"group": group[order], "keys": np.sort(np.concatenate([a["keys"], b["keys"]]), kind="stable"), **merged})

    def marked(self) -> np.ndarray:
        """Rows of entries whose group came again under another key."""
        return np.concatenate([x["row"][x["wanted"]] for x in self.levels] or [np.zeros(0, np.int64)])


def ordered_batches(doc: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the entries in runs of about BATCH by ascending doc; a document is never split."""
    order = np.argsort(doc, kind="stable")
    ranked = doc[order]
    begin = 0
    while begin < len(order):
        end = min(begin + BATCH, len(order))
        end = int(np.searchsorted(ranked, ranked[end - 1], "right"))
        yield order[begin:end]
        begin = end


# --- passes ----------------------------------------------------------------------------------

#: Entries of a bucket from one map unit, as packed arrays (fixed widths, little-endian).
WIDTHS = {"groups": "<u4", "keys": "<u8", "docs": "<i8", "rids": "<i8", "firsts": "<u4", "sizes": "<u2"}
BLOBS = "bucket int, " + ", ".join(f"{k} binary" for k in WIDTHS)


class Dealer:
    """Gathers entries of a map task and deals them to buckets in packed rows, a unit after another.

    Within a unit, an entry whose key an earlier document of the unit has is a repeat already: it
    goes aside, in a row of the unit's own that no bucket has to look at. So a key that very many
    documents have reaches its bucket once a unit.
    """

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.bytes = buckets, [], 0

    def put(self, bucket: np.ndarray, **entries: np.ndarray) -> None:
        """Entries of one document in text order; neighbours that touch and have one key become one
        entry, of MERGED neighbours at most."""
        key = entries["keys"]
        if (key[1:] == key[:-1]).any():
            begins = np.concatenate([[True], (key[1:] != key[:-1]) | (entries["firsts"][1:] != entries["firsts"][:-1] + entries["sizes"][:-1])])
            begins[::MERGED] = True
            first = np.flatnonzero(begins)
            sizes = np.add.reduceat(entries["sizes"], first)
            bucket, entries = bucket[first], {k: v[first] for k, v in entries.items()} | {"sizes": sizes}
        self.parts.append({"bucket": bucket, **entries})

    def _rows(self, whole: dict[str, np.ndarray], bucket: np.ndarray, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(bucket))
        arrays = [pa.array(bucket[first], pa.int32())]
        for name, width in WIDTHS.items():
            raw, size = whole[name][order].astype(width).tobytes(), np.dtype(width).itemsize
            arrays.append(pa.array([raw[a * size : b * size] for a, b in zip(first.tolist(), ends.tolist())], pa.binary()))
        batch = pa.RecordBatch.from_arrays(arrays, names=["bucket", *WIDTHS])
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        whole = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        self.parts, self.bytes = [], 0
        if not len(whole["keys"]):
            return
        # equal keys are in one bucket, as they begin with one anchor gram
        order = np.argsort(whole["keys"])
        key, doc = whole["keys"][order], whole["docs"][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        later = np.zeros(len(key), bool)
        later[order] = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
        own = np.flatnonzero(~later)
        yield from self._rows(whole, whole["bucket"], own[np.argsort(whole["bucket"][own], kind="stable")])
        if later.any():
            seed = int(whole["keys"][0]) % self.buckets  # the unit's own place, the same if it runs again
            yield from self._rows(whole, np.full(len(doc), -1 - seed, np.int64), np.flatnonzero(later))


def _rid(text: bytes, distinct: bool) -> int:
    """Tells apart texts of one doc_id, where doc_ids are not unique; else 0."""
    if not distinct:
        return 0
    digest = xxhash.xxh64_intdigest(text, 42)  # as Spark's xxhash64 has it
    return digest - (1 << 64) if digest >> 63 else digest


def hot_groups(docs: DataFrame, size: int) -> np.ndarray:
    """Anchor grams that make up 1 in HOT_SHARE of a sample's segments, or more: at most HOT_SHARE
    numbers. What is hot decides only how entries are dealt, so a sample will do."""
    one_in = max(1, size // SAMPLE_BYTES)
    sample = docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(one_in)) == 0)

    def make():
        def step(batch):
            found = [g for text in batch.column(1).cast(pa.binary()) for g, _, _ in segments(text.as_buffer().to_pybytes())]
            grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"])

        return step

    counted = map_arrow(sample, make, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") >= max(64, total // HOT_SHARE)).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def deal_segments(docs: DataFrame, buckets: int, distinct: bool, hot: np.ndarray) -> DataFrame:
    """First pass, map side: all segments of all documents, packed by bucket of the anchor gram, or
    of the segment where the gram is hot."""

    def run(batches):
        dealer = Dealer(buckets)
        for batch in batches_of(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                raw = text.as_buffer().to_pybytes()
                rid = _rid(raw, distinct)
                for grams, first, count in segments(raw):
                    last = first + (count + LENGTH - 1)
                    keys = np.fromiter(
                        (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first)
                    )
                    spread, group = grams >> np.uint64(32), (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    if len(hot):
                        is_hot = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
                        spread, group = np.where(is_hot, keys >> np.uint64(32), spread), np.where(is_hot, HOT, group)
                    doc = np.full(len(first), NULL_ID if doc_id is None else doc_id, np.int64)
                    dealer.put(
                        (spread % np.uint64(buckets)).astype(np.int64), groups=group, keys=keys, docs=doc,
                        rids=np.full(len(first), rid), firsts=first.astype(np.int64), sizes=count.astype(np.int64),
                    )
                dealer.bytes += len(raw)
                if dealer.bytes >= UNIT_BYTES:
                    yield from dealer.flush()
        yield from dealer.flush()

    return docs.mapInArrow(run, BLOBS)


def deal_strings(found: DataFrame, buckets: int, distinct: bool) -> DataFrame:
    """Second pass, map side: every string of the segments handed over, packed by bucket of its hash."""

    def run(batches):
        dealer = Dealer(buckets)
        for batch in batches_of(batches):
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                starts = sorted({a + k for a, n in ((x["first"], x["size"]) for x in wanted) for k in range(n)})
                hashes = [xxhash.xxh3_128_intdigest(raw[a : a + LENGTH]) for a in starts]
                keys = np.fromiter((h & 0xFFFFFFFFFFFFFFFF for h in hashes), np.uint64, len(hashes))
                bucket = np.fromiter(((h >> 64) % buckets for h in hashes), np.int64, len(hashes))
                doc = np.full(len(starts), NULL_ID if doc_id is None else doc_id, np.int64)
                dealer.put(
                    bucket, groups=np.zeros(len(starts), np.uint32), keys=keys, docs=doc,
                    rids=np.full(len(starts), _rid(raw, distinct)), firsts=np.array(starts, np.int64),
                    sizes=np.ones(len(starts), np.int64),
                )
                dealer.bytes += 16 * len(starts)
                if dealer.bytes >= UNIT_BYTES:
                    yield from dealer.flush()
        yield from dealer.flush()

    return found.mapInArrow(run, BLOBS)


RANGES = "doc_id long, rid long, first long, size int, whole boolean"


def scan_buckets(blobs: DataFrame, buckets: int, grouped: bool = True) -> DataFrame:
    """Reduce side of both passes: whole=true where the entry repeats an earlier document's; false
    where only its group was met, be it before or after it. Single strings come without groups."""

    def run(batches):
        held: dict[str, list[bytes]] = {k: [] for k in WIDTHS}
        at = None
        for batch in batches:
            for k, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket < 0:
                    x = {n: np.frombuffer(batch.column(j)[k].as_py(), WIDTHS[n]) for j, n in enumerate(WIDTHS, 1)}
                    yield from ranges(x, np.arange(len(x["docs"])), np.ones(len(x["docs"]), bool))
                    continue
                if at is not None and bucket != at:
                    yield from scan(held)
                    held = {n: [] for n in WIDTHS}
                at = bucket
                for j, name in enumerate(WIDTHS, 1):
                    held[name].append(batch.column(j)[k].as_py())
        if at is not None:
            yield from scan(held)

    def scan(held):
        x = {name: np.frombuffer(b"".join(parts), WIDTHS[name]) for name, parts in held.items()}
        held.clear()
        if not grouped:
            x["groups"] = (x["keys"] >> np.uint64(32)).astype(np.uint32)
        family = IndexFamily()
        again = np.zeros(len(x["docs"]), bool)
        asked = np.zeros(len(x["docs"]), bool)
        for rows in ordered_batches(x["docs"]):
            repeat, met = family.add(x["groups"][rows], x["keys"][rows], x["docs"][rows], rows)
            again[rows] = repeat
            asked[rows] = met & ~repeat
        if not grouped:
            yield from ranges(x, np.flatnonzero(again), again)
            return
        asked[family.marked()] = True
        asked |= (x["groups"] == HOT) & ~again  # a hot group has come elsewhere
        yield from ranges(x, np.flatnonzero(again | asked), again)

    def ranges(x, out, again):
        for at in range(0, len(out), 50_000):
            o = out[at : at + 50_000]
            doc = x["docs"][o]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc.astype(np.int64), mask=doc == NULL_ID), pa.array(x["rids"][o].astype(np.int64)),
                    pa.array(x["firsts"][o].astype(np.int64)), pa.array(x["sizes"][o].astype(np.int32)), pa.array(again[o]),
                ],
                names=["doc_id", "rid", "first", "size", "whole"],
            )

    tasks = -(-buckets // BUCKETS_A_TASK)  # a task works through its buckets one after another
    dealt = blobs.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, RANGES)


def by_document(docs: DataFrame, ranges: DataFrame, how: str, distinct: bool) -> DataFrame:
    """doc_id, text and the row's ranges, which its length bounds; where doc_ids aren't unique, rows
    are told apart by a hash of their text."""
    listed = ranges.groupBy(F.col("doc_id").alias("of"), "rid").agg(F.collect_list(F.struct("first", "size")).alias("ranges"))
    rows = docs.withColumn("own", F.xxhash64("text") if distinct else F.lit(0).cast("long"))
    same = (F.col("own") == F.col("rid")) & F.col("doc_id").eqNullSafe(F.col("of"))
    return rows.join(listed.hint("merge"), same, how).select("doc_id", "text", "ranges")


def find_repeats(docs: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """doc_id, rid, first, size of the runs of strings to remove; whether rids are in use."""
    size = input_bytes(docs)
    buckets = max(1, -(-size // BUCKET_BYTES))
    distinct = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    first = cut(scan_buckets(deal_segments(docs, buckets, distinct, hot_groups(docs, size)), buckets), f"{folder}/segments")
    open_segments = by_document(docs, first.filter("not whole"), "inner", distinct)
    strings = scan_buckets(deal_strings(open_segments, buckets, distinct), buckets, grouped=False)
    second = cut(strings, f"{folder}/strings")
    return first.filter("whole").unionByName(second).select("doc_id", "rid", "first", "size"), distinct


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ranges, distinct = find_repeats(rows, work_folder(docs.sparkSession))
    found = by_document(rows, ranges, "left", distinct)

    def make():
        def step(batch):
            out = []
            lists = batch.column(2)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            firsts = flat.field(0).to_numpy().astype(np.int64)
            sizes = flat.field(1).to_numpy().astype(np.int64)
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                raw = text.as_buffer().to_pybytes()
                a, b = int(offsets[k]), int(offsets[k + 1])
                if a == b or not lists[k].is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, firsts[a:b], 1)
                np.add.at(change, firsts[a:b] + sizes[a:b] + LENGTH - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            n, removed, spans, kept = zip(*out)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

        return step

    return map_arrow(found, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
