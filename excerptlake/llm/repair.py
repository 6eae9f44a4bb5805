"""Token-ID files: Re-Pair grammar compression per shard, with random access.

Texts are encoded by the tokenizers library. Its normaliser and splitter never join text over ASCII
white space, so the chunks between are encoded one by one, equal ones of a batch once. A chunk of
printable ASCII and Latin-1 letters is cut into the splitter's pieces here, and the library's model
merges those that the worker's bounded cache doesn't know; any other chunk (with a control sign, a
mark, another script, a special token) goes through the whole library.

A shard is a run of whole documents in ascending doc_id order. Re-Pair counts adjacent id pairs,
gives the most frequent ones new symbols and replaces them, round after round, until no pair is
frequent enough. A round takes many pairs at once, the frequent first, and none whose symbols
would compete with a chosen one; within a run of equal symbols, pairs count from the left.
Rules and the expansion length of each symbol are stored, so any range of ids is decoded by
expanding only the symbols that reach into it (read_documents).

File format: Parquet files in the shared folder, a row per shard: shard order (part, seq), its first
id's place within the part and its number of ids, doc_ids and their token counts, the rules as pairs,
the symbol lengths and the symbol sequence, as little-endian unsigned 32-bit integers. Parquet's writer commits whole files only, so
a lost executor leaves no half shard, and any store Spark knows can hold them.

Defined cases: null text is empty and holds the end id alone; null doc_id sorts first; rows with
equal doc_id stay apart, ordered by a hash of their text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols, gather, vocabulary
from .common import batches_of, cut, input_bytes, table, text_or_empty, work_folder

END = 1
#: Ids of a shard (a longer document is a shard of its own) and bytes of text dealt to a part.
SHARD_IDS, PART_BYTES = 1 << 19, 16 << 20
#: Parts whose offsets the driver adds up and broadcasts; beyond 1 TB parts grow instead.
MAX_PARTS = 1 << 16
#: A pair is frequent from MIN_COUNT occurrences in its shard on; a round looks at the most frequent pairs.
MIN_COUNT, PAIRS_A_ROUND = 24, 4096
SLOT_BITS = 18
#: Pieces a worker's cache holds (some 200 bytes each) before it starts anew.
CACHE = 400_000
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: Chunks of these have no other composed form, and lower-casing gives one letter for each.
PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: In lower-cased plain chunks without apostrophe these are pieces, and so is what stands between them.
SIGNS = r"([0-9]|[!-&(-/:-@\[-`{-~]+)"
#: The pre-tokenizer's pattern (fixed value of the vocabulary's format) over lower-cased plain chunks.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


# --- encoding --------------------------------------------------------------------------------


class WordEncoder:
    """Ids of whole texts by the tokenizers library, piece by piece with a bounded cache."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.marks = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.symbols = str.maketrans({chr(b): c for b, c in byte_symbols().items()})
        self._clear()

    def _clear(self) -> None:
        """An empty cache: the number of each piece, and the ids of the pieces one after another."""
        self.known: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        """Ids of a lower-cased plain piece: the library's model alone merges it."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.merge(piece)]

    def _encode(self, key: str, kind: int) -> list[int]:
        """Ids of a piece (kind 0), of a plain chunk with apostrophes (1), or of any other chunk (2)."""
        if kind == 0:
            return self._piece(key)
        if kind == 1:
            return [*chain.from_iterable(map(self._piece, PIECES.findall(key.lower())))]
        return self.tokenizer.encode(key, add_special_tokens=False).ids

    def _numbers(self, keys: list[str], kind: np.ndarray | int) -> np.ndarray:
        """The numbers of distinct keys in the cache; the unknown are encoded and entered."""
        numbers = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            kinds = np.broadcast_to(kind, len(keys))[new].tolist()
            found = [self._encode(keys[k], of) for k, of in zip(new.tolist(), kinds)]
            numbers[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(map(keys.__getitem__, new.tolist()), numbers[new].tolist()))
            ends = self.ends[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            self.ends = np.concatenate([self.ends, ends])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32)])
        return numbers

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after another and their offsets."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        for mark in self.marks:  # the library finds these before it normalises or splits
            plain = pc.and_not(plain, pc.match_substring(chunks, mark))
        simple = pc.and_not(plain, pc.match_substring(chunks, "'"))
        lowered = pc.utf8_lower(pc.filter(chunks, simple))
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(lowered, SIGNS, " \\1 ")))
        coded = split.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist(), 0)[coded.indices.to_numpy()]
        whole = pc.filter(chunks, pc.invert(simple))
        kinds = np.where(pc.filter(plain, pc.invert(simple)).to_numpy(zero_copy_only=False), 1, 2)
        others = self._numbers(whole.to_pylist(), kinds)
        # pieces of each chunk, in the chunks' order
        mask = simple.to_numpy(zero_copy_only=False)
        amount = np.ones(len(chunks), np.int64)
        amount[mask] = np.diff(split.offsets.to_numpy())
        taken = np.empty(int(amount.sum()), np.int64)
        of_simple = np.repeat(mask, amount)
        taken[of_simple], taken[~of_simple] = numbers, others
        ids, ends = gather(self.pool, self.ends[taken], self.ends[taken + 1] - self.ends[taken])
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(amount)])]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and their offsets (len(texts) + 1)."""
        if len(self.known) >= CACHE or len(self.pool) >= 8 * CACHE:
            self._clear()
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null("")))
        starts = split.offsets.to_numpy().astype(np.int64)
        flat = split.flatten()
        coded = flat.dictionary_encode()
        pool, bounds = self._chunks(coded.dictionary)
        codes = coded.indices.to_numpy()
        ids, ends = gather(pool, bounds[codes], np.diff(bounds)[codes])
        return ids, np.concatenate([[0], ends])[starts - starts[0]]


@lru_cache(2)
def load_words(path: str) -> WordEncoder:
    """A worker's encoder, whose cache serves its later tasks too."""
    return WordEncoder(path)


# --- Re-Pair ---------------------------------------------------------------------------------


@dataclass
class Grammar:
    """Symbols below `base` are ids; symbol base + i stands for rules[i]. lengths[i] is its expansion's."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def expanded_lengths(self) -> np.ndarray:
        """How many ids each symbol of the sequence stands for."""
        out = np.ones(len(self.sequence), np.int64)
        made = self.sequence >= self.base
        out[made] = self.lengths[self.sequence[made].astype(np.int64) - self.base]
        return out

    def groups(self) -> list[tuple[int, int]]:
        """Runs of rules that hold no symbol of their own run, in order."""
        newest = self.rules.max(axis=1) - self.base if len(self.rules) else np.zeros(0, np.int64)
        out, begin = [], 0
        while begin < len(newest):
            own = newest[begin:] >= begin
            end = begin + int(own.argmax()) if own.any() else len(newest)
            out.append((begin, end))
            begin = end
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for. Only rules that these reach are expanded, each once."""
        symbols = symbols.astype(np.int64)
        groups = self.groups()
        needed = np.zeros(len(self.rules), bool)
        needed[symbols[symbols >= self.base] - self.base] = True
        for begin, end in reversed(groups):
            children = self.rules[begin:end][needed[begin:end]].ravel()
            needed[children[children >= self.base] - self.base] = True
        # an id is found at its own place in the pool, an expansion where it was put
        size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        at = np.concatenate([np.arange(self.base), np.zeros(len(self.rules), np.int64)])
        pool = np.empty(self.base + int(self.lengths[needed].sum()), np.uint32)
        pool[: self.base] = np.arange(self.base)
        used = self.base
        for begin, end in groups:
            made = begin + np.flatnonzero(needed[begin:end])
            children = self.rules[made].ravel()
            ids, ends = gather(pool, at[children], size[children])
            at[self.base + made] = used + np.concatenate([[0], ends])[:-1:2]
            pool[used : used + len(ids)] = ids
            used += len(ids)
        return gather(pool, at[symbols], size[symbols])[0]

    def decode(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids low..high of the shard; only the symbols that reach into the range are expanded."""
        ends = np.cumsum(self.expanded_lengths())
        total = int(ends[-1]) if len(ends) else 0
        high = total if high is None else min(high, total)
        if low >= high:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
        before = int(ends[first - 1]) if first else 0
        return self.expand(self.sequence[first : last + 1])[low - before : high - before]


def chosen_pairs(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of frequent pairs, the most frequent first, of which no two can overlap: a symbol
    that ends one chosen pair begins none, except in the pair of a symbol with itself."""
    begins: set[int] = set()
    finishes: set[int] = set()
    out = []
    order = np.lexsort((right, left, -counts))[:PAIRS_A_ROUND]
    for k, a, b in zip(order.tolist(), left[order].tolist(), right[order].tolist()):
        if a in finishes or b in begins or (a == b and a in begins):
            continue
        begins.add(a)
        finishes.add(b)
        out.append(k)
    return np.array(out, np.int64)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def compress(ids: np.ndarray, base: int) -> Grammar:
    """The grammar of one shard: rounds go on until no pair is left that occurs MIN_COUNT times.

    A pair of old symbols never becomes more frequent, so each round looks only at places whose
    pair was frequent before or holds a symbol of the last round.
    """
    sequence = ids.astype(np.int64)
    rules: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    size = np.ones(1, np.int64)  # of symbol base + k at k + 1; of ids at 0
    live = np.ones(len(sequence), bool)
    table = np.zeros(1 << SLOT_BITS, np.int64)
    while True:
        at = np.flatnonzero(live[:-1])
        left, right = sequence[at], sequence[at + 1]
        # only a symbol paired with itself can overlap: of a run, every second place counts
        twice = np.flatnonzero(left == right)
        if len(twice):
            fresh = np.concatenate([[True], np.diff(at[twice]) != 1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(twice)), 0))
            counted = np.ones(len(at), bool)
            counted[twice[(np.arange(len(twice)) - begin) % 2 == 1]] = False
            at, left, right = at[counted], left[counted], right[counted]
        key = left << 32 | right
        slot = _slot(key)
        often = np.bincount(slot, minlength=1 << SLOT_BITS)[slot] >= MIN_COUNT
        live[at[~often]] = False
        at, key, slot = at[often], key[often], slot[often]
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        counts = np.diff(np.append(edge, len(ordered)))
        pairs, counts = ordered[edge[counts >= MIN_COUNT]], counts[counts >= MIN_COUNT]
        if not len(pairs):
            break
        pick = np.sort(chosen_pairs(pairs >> 32, pairs & 0xFFFFFFFF, counts))
        _, first = np.unique(_slot(pairs[pick]), return_index=True)  # of two pairs with one slot, the second waits
        found = pairs[pick[np.sort(first)]]
        table[_slot(found)] = np.arange(len(found))
        place = table[slot]
        hit = found[np.minimum(place, len(found) - 1)] == key
        at, place = at[hit], place[hit]
        pair_rows = np.column_stack([found >> 32, found & 0xFFFFFFFF])
        sequence[at] = base + len(size) - 1 + place
        size = np.concatenate([size, size[np.maximum(pair_rows - base + 1, 0)].sum(1)])
        rules.append(pair_rows)
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        live[np.maximum(at - 2, 0)] = True  # where the place before was itself taken into a new symbol
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence, live = sequence[keep], live[keep]
    return Grammar(base, np.concatenate(rules), size[1:], sequence)


# --- shard files -----------------------------------------------------------------------------

FILE = "part int, seq int, first long, n_ids long, base int, doc_ids binary, nulls binary, counts binary, rules binary, lengths binary, sequence binary"


def _u32(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def grammar_of(row: dict) -> Grammar:
    read = lambda name: np.frombuffer(row[name], "<u4").astype(np.int64)
    return Grammar(row["base"], read("rules").reshape(-1, 2), read("lengths"), read("sequence"))


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END) -> DataFrame:
    """Encode docs, write the shard files below folder and give them as a DataFrame."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    wanted = min(MAX_PARTS, -(-input_bytes(docs) // PART_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # rows of one doc_id spread too
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        encoder = load_words(path)
        base = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        part, seq, first, pending, doc_ids, counts = 0, 0, 0, [], [], []

        def shard():
            nonlocal seq, first
            grammar = compress(np.concatenate(pending), base)
            row = {
                "part": part, "seq": seq, "first": first, "n_ids": sum(counts), "base": base,
                "doc_ids": np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
                "nulls": bytes(d is None for d in doc_ids),
                "counts": _u32(np.array(counts, np.int64)), "rules": _u32(grammar.rules),
                "lengths": _u32(grammar.lengths), "sequence": _u32(grammar.sequence),
            }
            seq, first = seq + 1, first + row["n_ids"]
            pending.clear(), doc_ids.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in FILE.split(", "))])
        held = 0
        for batch in batches_of(batches, 1 << 30, 6 << 20):  # the larger a batch, the fewer distinct chunks
            part = batch.column(0)[0].as_py()
            ids, bounds = encoder.encode_batch(batch.column(2))
            for doc_id, a, b in zip(batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if held and held + b - a + 1 > SHARD_IDS:
                    yield shard()
                    held = 0
                pending.append(np.append(ids[a:b], np.uint32(end_id)))
                doc_ids.append(doc_id)
                counts.append(b - a + 1)
                held += b - a + 1
        if held:
            yield shard()

    return cut(numbered.mapInArrow(run, FILE), f"{folder}/shards")


def placed(shards: DataFrame) -> DataFrame:
    """shards with `first` counted over all of them, not within the part."""
    # a row per part, of which there are at most MAX_PARTS or shuffle partitions
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r.part, at))
        at += r.n
    offsets = F.broadcast(shards.sparkSession.createDataFrame(starts, "p int, part_start long"))
    joined = shards.join(offsets, F.col("part") == F.col("p"))
    return joined.withColumn("first", F.col("first") + F.col("part_start")).drop("p", "part_start")


def _documents(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, first places and numbers of ids of a shard's documents."""
    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
    nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
    return pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls), np.cumsum(counts) - counts, counts


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32, decoded from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, begins, counts = _documents(row)
                data = memoryview(grammar_of(row).decode().astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), (begins + counts).tolist())]
                columns = [doc_ids, pa.array(begins + row["first"]), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents of the DataFrame wanted (doc_id), by random access: a shard's
    rules are expanded only where these documents reach them."""
    listed = shards.withColumn("shard", F.struct("part", "seq"))
    schema = "part int, seq int, place int, doc_id long"

    def index(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids = _documents(row)[0]
                whole = [pa.array([row[n]] * len(doc_ids), pa.int32()) for n in ("part", "seq")]
                columns = [*whole, pa.array(np.arange(len(doc_ids)), pa.int32()), doc_ids]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "place", "doc_id"])

    named = listed.select("part", "seq", "doc_ids", "nulls", "counts").mapInArrow(index, schema)
    asked = wanted.select(F.col("doc_id").cast("long").alias("w")).distinct()
    found = named.join(asked, F.col("doc_id").eqNullSafe(F.col("w")))
    places = found.groupBy("part", "seq").agg(F.collect_list("place").alias("places"))  # at most a shard's documents

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, begins, counts = _documents(row)
                grammar, chosen = grammar_of(row), sorted(row["places"])
                ids = [grammar.decode(int(begins[k]), int(begins[k] + counts[k])) for k in chosen]
                columns = [doc_ids.take(pa.array(chosen)), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    return shards.join(places, ["part", "seq"]).mapInArrow(run, "doc_id long, ids array<long>")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, vocabulary("word_bpe_49k.json"), work_folder(spark)))
