"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

A piece of the pre-tokenizer is a row of symbols; leaf i of the tree holds the merge rank of
symbols i and i+1 together with i. The root is the least rank and, among equal ranks, the
leftmost place, so it names the next merge; a merge updates three leaves in logarithmic time.
Merging ends when the root holds no rank. A piece of n bytes takes O(n log n), however long.

Around it, work is shared: a batch's texts are cut at blanks (where no piece can cross), equal
chunks are found by Arrow's dictionary encoding, and only chunks that the worker's bounded cache
doesn't know are encoded. Decoding takes ids to bytes by the vocabulary and joins them.

Defined cases: a null text is the empty text (no ids, hash of the empty string); special-token
strings in a text become their id, as the library has it; repeated rows and null doc_ids are
kept row by row; extra columns are ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, map_arrow, table, text_or_empty

#: The pre-tokenizer's pattern (fixed value of the vocabulary's format), with white space spelt out.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A blank between white space, or last after white space: cutting there would split a piece.
UNSAFE = f"{_WS} (?:{_WS}|$)"
#: Pieces in each of a worker's two cache generations; a full young one replaces the old one,
#: so the cache's memory is fixed (about 250 bytes a piece, some 200 MB a worker).
CACHE = 400_000
LONG_PIECE = 60


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: Latin-1's visible characters stand for themselves,
    the others follow in order from code point 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge_pairs(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols by lowest rank, leftmost first, until no pair has a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    if n == 2:
        found = merges.get((symbols[0], symbols[1]))
        return [found[1]] if found else symbols
    symbols = [*symbols]
    none = 1 << 62
    size = 1 << (n - 2).bit_length()
    tree = [none] * (2 * size)
    for i in range(n - 1):
        found = merges.get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0] * n + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after = [*range(1, n + 1)]
    before = [*range(-1, n - 1)]

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a < b else b
            if tree[node] == best:
                return
            tree[node] = best
            node >>= 1

    while tree[1] < none:
        i = tree[1] % n
        gone = after[i]
        symbols[i] = merges[symbols[i], symbols[gone]][1]
        beyond = after[i] = after[gone]
        if gone < n - 1:
            put(gone, none)
        if beyond < n:
            before[beyond] = i
            found = merges.get((symbols[i], symbols[beyond]))
            put(i, found[0] * n + i if found else none)
        else:
            put(i, none)
        left = before[i]
        if left >= 0:
            found = merges.get((symbols[left], symbols[i]))
            put(left, found[0] * n + left if found else none)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        stand_in = byte_symbols()
        self.byte_ids = [vocab[stand_in[b]] for b in range(256)]
        back = {c: b for b, c in stand_in.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.arrow_bytes = pa.array(self.token_bytes, pa.large_binary())
        self.decimals = [str(i) for i in range(size)]
        self.pieces = regex.compile(PIECES)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                ids = self.byte_ids
                got = tuple(merge_pairs([ids[b] for b in piece.encode()], self.merges))
            if len(piece) <= LONG_PIECE:
                if len(self.young) >= self.cache:
                    self.old, self.young = self.young, {}
                self.young[piece] = got
        return got

    def encode_plain(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.encode_piece, self.pieces.findall(text))))

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        if not self.specials:
            return [*self.encode_plain(text)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.encode_plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return [*out, *self.encode_plain(text[at:])]

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32) and their offsets (len(texts) + 1)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, UNSAFE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.flatten()
        # the first chunk of a text stands bare, each later one takes the blank before it
        first = np.zeros(len(flat), bool)
        first[starts[:-1][np.diff(starts) > 0]] = True
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        n_words = len(words)
        spaced = [self.encode_plain(" " + w) for w in words]
        keys = np.where(first, 0, codes)
        bare = [self.encode_plain(words[c]) for c in codes[first].tolist()]
        keys[first] = n_words + np.arange(len(bare))
        sequences = spaced + bare
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        pool = np.fromiter(chain.from_iterable(sequences), np.int32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        ids, chunk_ends = gather(pool, begin[keys], lengths[keys])
        bounds = np.concatenate([[0], chunk_ends])[starts]
        if not pc.any(odd).as_py():
            return ids, bounds
        parts, sizes = [], []
        for i, slow in enumerate(odd.to_pylist()):
            part = np.array(self.encode(texts[i].as_py()), np.int32) if slow else ids[bounds[i] : bounds[i + 1]]
            parts.append(part)
            sizes.append(len(part))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def gather(pool: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate pool[begin[i] : begin[i] + lengths[i]] for all i; also the running ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.arange(total) + np.repeat(begin - (ends - lengths), lengths)
    return pool[places], ends


@lru_cache(2)
def load(path: str, cache: int = CACHE) -> ByteBpe:
    return ByteBpe(path, cache)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int) and decoded (string) for the text column; other columns stay."""
    rest = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    kept = docs.select(*[F.col(f"`{f.name}`") for f in rest])
    schema = extended(kept, ids="array<int>", decoded="string")

    def make():
        bpe = load(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, bounds = bpe.encode_batch(batch.column(batch.schema.get_field_index(text)))
            lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(ids, pa.int32()))
            whole = join_bytes(bpe, ids, bounds)
            decoded = [b.decode("utf-8", "replace") for b in whole]
            columns = [*batch.columns, lists.cast(pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids", "decoded"])

        return step

    return map_arrow(kept, make, schema)


def join_bytes(bpe: ByteBpe, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    taken = bpe.arrow_bytes.take(pa.array(ids, pa.int32()))
    ends = taken.buffers()[1]
    places = np.frombuffer(ends, np.int64, len(taken) + 1 + taken.offset)[taken.offset :] if len(taken) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2] or b"")
    cuts = places[bounds].tolist()
    return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def digests(docs: DataFrame, path: str, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text and, if wanted, its ids."""

    def make():
        bpe = load(path, cache)
        names = pa.array(bpe.decimals, pa.large_string())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, bounds = bpe.encode_batch(batch.column(1))
            lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), names.take(pa.array(ids, pa.int32())))
            listed = pc.binary_join(lists, pa.scalar(",", pa.large_string()))
            decoded = (b.decode("utf-8", "replace").encode() for b in join_bytes(bpe, ids, bounds))
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in listed], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(rows, make, schema)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
