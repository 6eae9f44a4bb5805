"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments of SEGMENT bytes (shorter items are one). A
segment of m bytes holds m // Q disjoint q-grams; EDIT_RATE * m edits spoil at most one each, so a
region within that budget shares at least m // Q - budget of them, on diagonals that differ by at
most the budget. All q-grams of a text, 8 bytes read as one number, are looked up in a table of the
segments' q-grams; hits are counted in overlapping diagonal bands, each region lying whole in one
band; bands that reach the bound are verified by a bit-parallel alignment of the bytes the band covers. What passes is a
region of the text that equals the segment up to the budget.

Letters are compared after lower-casing A-Z. Items under Q bytes hold no q-gram; their exact places are
found. An excerpt that holds no whole segment is found if the segment's unmatched rest is within the
budget: of a long item, any excerpt of SEGMENT + STRIDE bytes is sure to be found, a shorter one may be.

The benchmark's table is broadcast only up to MAX_BENCHMARK bytes of items; a larger benchmark is
worked through in slices of that size, a pass over the documents each, and the matches united.

Defined cases: null texts and items are empty and match nothing; equal items all name their id;
null item_ids are left out; each row is judged by itself, repeated rows too; extra columns stay;
an empty benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, map_arrow, table

Q, SEGMENT, STRIDE, EDIT_RATE = 8, 120, 60, 0.1
MAX_BENCHMARK = 16 << 20
#: Bytes of text looked at in one go, and the size of the first, approximate look-up table.
BLOCK, TABLE_BITS = 1 << 20, 20
#: Hits from which a block is searched in windows of WINDOW bytes, PART segments after PART.
DENSE, WINDOW, PART = 1 << 20, 1024, 512


def segments_of(item: bytes) -> list[bytes]:
    if len(item) <= SEGMENT:
        return [item] if len(item) >= Q else []
    starts = [*range(0, len(item) - SEGMENT, STRIDE), len(item) - SEGMENT]
    return [item[a : a + SEGMENT] for a in dict.fromkeys(starts)]


def budget_of(segment: bytes) -> int:
    """Edits allowed; at least one q-gram always survives them."""
    return min(int(EDIT_RATE * len(segment)), len(segment) // Q - 1)


@lru_cache(4096)
def letter_masks(pattern: bytes) -> dict[int, int]:
    """For each byte, the places of the pattern where it stands, as bits."""
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def least_cost(masks: dict[int, int], m: int, text: bytes, anchored: bool) -> tuple[int, int]:
    """Least edit cost of a pattern of m bytes against text[begin:end] and the first such end.

    A column of the alignment is kept as bits of its vertical differences (bit-parallel dynamic
    programming). begin is free, or 0 if anchored; end is free.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        x = equal | down
        d = (((equal & up) + up) ^ up) | equal
        right_up = down | (full & ~(d | up))
        right_down = up & d
        if right_up & top:
            cost += 1
        elif right_down & top:
            cost -= 1
        right_up = (right_up << 1 | anchored) & full
        right_down = right_down << 1 & full
        up = right_down | (full & ~(x | right_up))
        down = right_up & x
        if cost < best[0]:
            best = (cost, j)
    return best


def align(pattern: bytes, text: bytes, budget: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of pattern in text, the bytes a diagonal band covers; None over budget."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    cost, end = least_cost(letter_masks(pattern), len(pattern), text, False)
    if cost > budget:
        return None
    # the same alignment read backwards from its end gives its start
    _, back = least_cost(letter_masks(pattern[::-1]), len(pattern), text[:end][::-1], True)
    return cost, end - back, end


class Index:
    """The q-grams of a slice of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        parts: dict[bytes, list[int]] = {}
        for item_id, text in items:
            raw = text.encode().lower()
            for segment in segments_of(raw) if len(raw) >= Q else [raw] * bool(raw):
                parts.setdefault(segment, []).append(item_id)
        self.segments = [*parts]
        self.items = [sorted(set(ids)) for ids in parts.values()]
        self.short: dict[int, dict[int, int]] = {}
        for s, segment in enumerate(self.segments):
            if len(segment) < Q:
                self.short.setdefault(len(segment), {})[int.from_bytes(segment, "little")] = s
        self.budgets = np.array([max(0, budget_of(s)) for s in self.segments], np.int64)
        self.bounds = np.array([len(s) // Q for s in self.segments], np.int64) - self.budgets
        grams, owners, places = [], [], []
        for s, segment in enumerate(self.segments):
            for at in range(0, len(segment) - Q + 1, Q):
                grams.append(int.from_bytes(segment[at : at + Q], "little"))
                owners.append(s)
                places.append(at)
        order = np.argsort(np.array(grams, np.uint64), kind="stable")
        sorted_grams = np.array(grams, np.uint64)[order]
        self.owners, self.places = np.array(owners, np.int64)[order], np.array(places, np.int64)[order]
        self.grams, self.first, self.counts = np.unique(sorted_grams, return_index=True, return_counts=True)
        # occurrences by q-gram and segment, ascending, as the sort is stable
        self.placed = np.repeat(np.arange(len(self.grams)), self.counts) * len(self.segments) + self.owners
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.grams)] = True
        self.width = 2 * int(self.budgets.max(initial=0)) + 1  # diagonals that a region's hits span

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the q-grams of data that the benchmark has, and their number in grams."""
        n = len(data) - Q + 1
        grams = np.empty(n, np.uint64)
        for k in range(Q):
            whole = (len(data) - k) // Q
            grams[k::Q] = data[k : k + whole * Q].view("<u8")[: len(grams[k::Q])]
        at = np.flatnonzero(self.table[self._slot(grams)])
        found = grams[at]
        number = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        ok = self.grams[number] == found
        return at[ok], number[ok]

    def regions(self, size: int, at: np.ndarray, number: np.ndarray, part: int | None = None) -> list[tuple[int, int]]:
        """(segment, first diagonal of a band) for bands that hold enough shared q-grams, of hits in
        `size` bytes; for all segments, or for PART of them from `part` on."""
        begin, times = self.first[number], self.counts[number]
        if part is not None:
            begin, end = (np.searchsorted(self.placed, number * len(self.segments) + s) for s in (part, min(part + PART, len(self.segments))))
            times = end - begin
        if not times.sum():
            return []
        ends = np.cumsum(times)
        entry = np.arange(ends[-1]) + np.repeat(begin - (ends - times), times)
        owner = self.owners[entry]
        diagonal = np.repeat(at, times) - self.places[entry] + SEGMENT  # never negative
        band = diagonal // self.width
        bands = size // self.width + SEGMENT // self.width + 3
        key = np.concatenate([owner * bands + band, owner * bands + band - 1])  # bands of double width
        place = np.concatenate([self.places[entry]] * 2) // Q
        each = np.unique(key * (SEGMENT // Q) + place)  # a q-gram of the segment counts once a band
        keys, counts = np.unique(each // (SEGMENT // Q), return_counts=True)
        good = keys[counts >= self.bounds[keys // bands]]
        return [(int(k // bands), int(k % bands) * self.width - SEGMENT) for k in good]

    def search(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) of the verified regions of one lower-cased text."""
        out = set(self.short_places(data))
        raw = np.frombuffer(data, np.uint8)
        memo: dict[tuple[int, bytes], tuple | None] = {}
        step = BLOCK - 2 * SEGMENT - 4 * self.width
        for begin in range(0, max(1, len(data)), step):  # blocks overlap by more than a region
            block = raw[begin : begin + BLOCK]
            if len(block) < Q or not len(self.grams):
                continue
            at, number = self.hits(block)
            if self.counts[number].sum() <= DENSE:
                out.update(self._verified(data, begin, self.regions(len(block), at, number), memo))
            else:
                out.update(self._dense(data, begin, len(block), memo))
        return sorted(out)

    def _verified(self, data: bytes, begin: int, regions: list[tuple[int, int]], memo: dict) -> Iterator[tuple[int, int, int, int]]:
        """Regions that align; equal stretches of text are aligned with a segment once."""
        for s, diagonal in regions:
            segment, budget = self.segments[s], int(self.budgets[s])
            low = max(0, begin + diagonal - budget)
            window = data[low : begin + diagonal + 2 * self.width + len(segment) + budget]
            key = (s, window)
            if key not in memo:
                if len(memo) >= 1 << 14:
                    memo.clear()
                memo[key] = align(segment, window, budget)
            got = memo[key]
            if got:
                yield s, low + got[1], low + got[2], got[0]

    def _dense(self, data: bytes, begin: int, size: int, memo: dict) -> Iterator[tuple[int, int, int, int]]:
        """A block with very many hits (runs and repeats that the benchmark has too), in short windows
        that overlap by more than a region. Equal windows are searched once, and q-grams that very many
        segments have are looked at for some segments after another, so memory is bounded."""
        seen: dict[bytes, list] = {}
        end = min(begin + size, len(data))
        for low in range(begin, end, WINDOW - 2 * SEGMENT - 4 * self.width):
            window = data[low : min(low + WINDOW, end)]
            if window not in seen:
                found: set = set()
                raw = np.frombuffer(window, np.uint8)
                at, number = self.hits(raw) if len(raw) >= Q else (np.zeros(0, np.int64),) * 2
                for part in range(0, len(self.segments), PART):
                    found.update(self._verified(window, 0, self.regions(len(raw), at, number, part), memo))
                seen[window] = sorted(found)
            for s, a, b, edits in seen[window]:
                yield s, low + a, low + b, edits

    def short_places(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """Exact places of the segments under Q bytes, which hold no q-gram."""
        for length, keys in self.short.items():
            raw = np.frombuffer(data, np.uint8)
            n = len(raw) - length + 1
            if n <= 0:
                continue
            grams = np.zeros(n, np.uint64)
            for k in range(length):
                grams |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
            for at in np.flatnonzero(np.isin(grams, np.fromiter(keys, np.uint64, len(keys)))).tolist():
                yield keys[int(grams[at])], at, at + length, 0


def slices(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark in parts whose size was checked; one part as a rule."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // MAX_BENCHMARK) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = items if parts == 1 else items.filter(part == k)
        yield [(r.item_id, r.text) for r in rows.collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with matches: array of (item_id, start, end, edits), code points, end exclusive."""
    spark = docs.sparkSession
    kept = docs.select(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "matches"])
    kind = "array<struct<item_id:long,start:long,end:long,edits:int>>"
    out = kept.withColumn("matches", F.lit(None).cast(kind))
    for items in slices(benchmark):
        shared = spark.sparkContext.broadcast(items)  # at most MAX_BENCHMARK bytes of text

        def make(shared=shared, name=uuid.uuid4().hex):
            index = _index(name, shared)
            place = {}

            def step(batch):
                if not place:
                    place.update(text=batch.schema.get_field_index("text"), matches=batch.schema.get_field_index("matches"))
                found = []
                texts = batch.column(place["text"]).cast(pa.binary())
                before = batch.column(place["matches"]).to_pylist()
                for text, had in zip(texts, before):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    found.append((had or []) + describe(index, raw))
                columns = batch.columns
                columns[place["matches"]] = pa.array(found, batch.column(place["matches"]).type)
                return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

            return step

        out = map_arrow(out, make, out.schema)
    return out


_built: dict[str, Index] = {}


def _index(name: str, shared) -> Index:
    """A worker's index of a slice, built once; it holds one slice at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(shared.value)
    return _built[name]


def describe(index: Index, raw: bytes) -> list[dict]:
    """Verified regions of one text by item, touching regions of an item joined."""
    regions = index.search(raw.lower())
    if not regions:
        return []
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    by_item: dict[int, list] = {}
    for s, a, b, edits in sorted(regions, key=lambda x: x[1:3]):
        for item in index.items[s]:
            spans = by_item.setdefault(item, [])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
                spans[-1][2] = max(spans[-1][2], edits)
            else:
                spans.append([a, b, edits])
    return [
        {"item_id": item, "start": int(begins[a]), "end": int(begins[b]), "edits": e}
        for item, spans in sorted(by_item.items())
        for a, b, e in spans
    ]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"))
    matches = F.coalesce("matches", F.array().cast("array<struct<item_id:long,start:long,end:long,edits:int>>"))
    return found.select(
        "doc_id",
        (F.size(matches) > 0).alias("contaminated"),
        F.array_distinct(F.transform(matches, lambda m: m["item_id"])).alias("item_ids"),
        F.concat_ws(
            ",",
            F.transform(matches, lambda m: F.concat_ws(":", *[m[k].cast("string") for k in ("item_id", "start", "end", "edits")])),
        ).alias("spans"),
    )
