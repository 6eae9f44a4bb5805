"""SimHash near-duplicate groups by anchor-point covering.

Fingerprint: words are runs without ASCII white space after lower-casing A-Z; each run of
`shingle` words, joined by single blanks (fewer words: all of them; none: fingerprint zero),
is hashed by XXH64 with seed 42; a bit is set if it is set in over half of the hashes.

Covering: two fingerprints that differ in at most 3 of 64 bits differ in at most one bit in one
of their 32-bit halves. The anchors of a half are the 2^27 words of the perfect (31,26) Hamming
code with one free bit beside it: covering radius 1. Each fingerprint has its home anchor within
that radius and is replicated to every anchor within radius plus threshold, 1 + 1 (at most 17).
If halves of x and y differ in at most one bit, x's home is within 1 + 1 of y, so the two meet at
that anchor, where the whole 64 bits are compared. Nothing is lost and nothing is capped.

Equal fingerprints are one node, so a group of copies, however large, is one row here; only links
between different fingerprints are made. All joins are merge joins: their tables grow with the input,
and a broadcast is built in the driver's memory. Components come from alternating star contractions, each
round written to the shared folder.

Defined cases: null text is the empty text; all texts without words share fingerprint zero and
are linked; null doc_ids keep their row but name no component; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, text_or_empty, work_folder
from .graph import connected_components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Positions 1..31 of a Hamming word whose number has bit j set, as masks over bits 0..30.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) < shingle:
        return [digest(b" ".join(words), SEED)]
    return [digest(b" ".join(run), SEED) for run in zip(*(words[i:] for i in range(shingle)))]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    hashes = np.array(shingle_hashes(text, shingle), ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounded, however long the text
        part = hashes[at : at + 8192]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a signed long) of each row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column(1).cast(pa.binary())]
            signed = np.array(values, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(rows, make, "doc_id long, fp long")


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each 32-bit half, and all anchors within distance 2: (home, owner, anchor)."""
    word = values & 0x7FFFFFFF
    syndrome = np.zeros(len(values), np.int64)
    for j, mask in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(word & mask).astype(np.int64) & 1) << j
    flip = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    home = values ^ flip
    own = np.arange(len(values))
    owners, found = [own, own], [home, home ^ (1 << 31)]
    for p in range(1, 32):  # pairs of positions p < q whose numbers XOR to the syndrome
        q = p ^ syndrome
        ok = (syndrome > 0) & (q > p)
        owners.append(own[ok])
        found.append((values ^ (1 << (p - 1)) ^ (np.int64(1) << np.maximum(q - 1, 0)))[ok])
    return home, np.concatenate(owners), np.concatenate(found)


def covering(nodes: DataFrame) -> DataFrame:
    """(anchor, fp, home): each fingerprint at its home anchors and at every anchor within reach."""

    def make():
        def step(batch: pa.RecordBatch):
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for half in (0, 1):
                part = (fp >> (32 * half)) & 0xFFFFFFFF
                home, owner, anchor = anchors(part)
                out.append((anchor | half << 32, fp[owner], anchor == home[owner]))
            a, f, h = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(f), pa.array(h)], names=["anchor", "fp", "home"])

        return step

    return map_arrow(nodes.select("fp"), make, "anchor long, fp long, home boolean")


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs src < dst of different fingerprints with at most `threshold` differing bits."""
    if threshold > 3:
        raise ValueError("two halves with distance 1 each cover thresholds up to 3")
    placed = covering(nodes)
    at_home = placed.filter("home").select("anchor", F.col("fp").alias("x"))
    reach = placed.select("anchor", F.col("fp").alias("y"))
    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold)
    met = at_home.hint("merge").join(reach, "anchor").filter(near)
    return met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links, itself included."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    marked = cut(with_fingerprint(docs, shingle), f"{folder}/fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), f"{folder}/nodes")
    edges = cut(links(nodes, threshold), f"{folder}/links")
    roots = connected_components(edges, f"{folder}/components")
    placed = nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_fp = placed.join(named.hint("merge"), "root").select(F.col("fp").alias("node_fp"), "component_id")
    return marked.join(by_fp.hint("merge"), marked.fp == by_fp.node_fp).select("doc_id", "fp", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
