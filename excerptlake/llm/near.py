"""Near-copy groups of documents: Jaccard similarity of 5-word shingle sets of 0.8 or more.

Words are those of simhash.py, shingles have five, as 64-bit hashes; equal sets are one node. Groups
are the connected components of all pairs of nodes with similarity 4/5 or more, compared exactly.

SimHash comes first, by the operator of op6: rows whose fingerprints (simhash.py) are equal or differ in
at most 3 bits are candidates, of equal ones each with one of them; the exact comparison follows.
Components of what is similar need no further comparison within.

SimHash misses pairs, so what it left apart is completed from prefixes: with all shingles in one global order, two sets of n and m shingles
with that similarity share one among the first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1. Any order
is exact; this one has the hashes in ascending order, but those frequent in a sample of documents
last, so that a common line joins nothing by itself. Fingerprints of 64 bits can't do this alone: at
similarity 0.8 they differ in some 10 bits, at times in many more.

Two sets must also share so many shingles of their prefixes as their sizes ask for; such pairs are
compared in full.

Large groups: a shingle's core is the component of its least node so far. In each of a few rounds the
other nodes are compared with one node of the core, drawn anew, and components grow by what is
similar; only nodes that all rounds leave outside then meet the others, and of those pairs only the
ones go on whose sketches don't rule the similarity out. The sketch is a bound, so no pair is lost.

Defined cases: null text is the empty text; texts without words are one node; null doc_ids name a
component only where it has no other, and stand for it only then; rows that share a doc_id are told
apart by their text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, map_arrow, text_or_empty, work_folder
from .graph import connected_components

SHINGLE = 5
#: The similarity is NEAR / OF.
NEAR, OF = 4, 5
#: One in SAMPLE nodes is counted for the order; shingles of SEEN rows there come last, MOST of them.
SAMPLE, SEEN, MOST = 8, 4, 100_000
SLICES = 8
#: Longs of a set's sketch, and rounds of comparisons with one node of the core.
SKETCH, ROUNDS = 8, 1


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: its words' hashes, each made once a
    batch, are combined by place and mixed. Fewer words than a shingle has are one shingle."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()))))
    coded = split.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    words = np.fromiter((digest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = words[coded.indices.to_numpy()]
    starts = split.offsets.to_numpy()
    starts = (starts - starts[0]).tolist()
    runs = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        runs += hashes[k : k + len(runs)] * _POWERS[k]
    runs = _mixed(runs)
    out = []
    for a, b in zip(starts, starts[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        else:  # an empty text splits into one empty word
            short = hashes[a:b][hashes[a:b] != 0]
            out.append(_mixed((short * _POWERS[: len(short)]).sum(keepdims=True, dtype=np.uint64)) if len(short) else short)
    return out


def node_of(shingles: np.ndarray) -> int:
    key = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return key - (1 << 64) if key >> 63 else key


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, which with doc_id tells rows apart: rows equal in both are one document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets(batch.column(1))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH classes of hashes, whether the set holds an odd number of it, as bits.

    Two sketches differ in no more bits than their sets differ in elements.
    """
    odd = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCHES = [f"b{k}" for k in range(SKETCH)]


def with_node(docs: DataFrame) -> DataFrame:
    """doc_id, th, node, sketch and SimHash fingerprint of each row."""

    def make():
        def step(batch):
            sets = _sets(batch)
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
            columns = [batch.column(0), batch.column(2), pa.array([node_of(s) for s in sets], pa.int64())]
            columns += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH)]
            prints = [simhash.fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1).cast(pa.binary())]
            columns.append(pa.array(np.array(prints, np.uint64).view(np.int64)))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", *SKETCHES, "fp"])

        return step

    return map_arrow(_texts(docs), make, "doc_id long, th long, node long, " + ", ".join(f"{b} long" for b in SKETCHES) + ", fp long")


def simhash_pairs(marked: DataFrame, folder: str) -> DataFrame:
    """Pairs src < dst of nodes that SimHash finds: of each fingerprint its nodes with the least of them,
    and the least ones of any two fingerprints that simhash.links links."""
    prints = cut(marked.select("fp", "node").distinct(), f"{folder}/prints")
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("least")), f"{folder}/least")
    linked = cut(simhash.links(least), f"{folder}/linked")
    same = prints.join(least.hint("merge"), "fp").select(F.col("least").alias("x"), F.col("node").alias("y"))
    named = lambda end, k: least.select(F.col("fp").alias(end), F.col("least").alias(k)).hint("merge")
    close = linked.join(named("src", "x"), "src").join(named("dst", "y"), "dst").select("x", "y")
    return same.union(close).filter("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that come last in the order, ascending."""

    def make():
        def step(batch):
            chosen = [s for s in _sets(batch) if len(s) and node_of(s) % SAMPLE == 0]
            values = np.concatenate([np.zeros(0, np.uint64), *chosen]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values)], names=["shingle"])

        return step

    counted = map_arrow(_texts(docs), make, "shingle long").groupBy("shingle").count().filter(F.col("count") >= SEEN)
    rows = counted.orderBy(F.desc("count"), "shingle").limit(MOST).collect()
    return np.sort(np.array([r.shingle for r in rows], np.int64).view(np.uint64))


def prefixes(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """shingle, node and n (size of its set) for the prefix of each set."""

    def make():
        def step(batch):
            for s in _sets(batch):
                if len(s):
                    n = len(s)
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(n, bool)
                    first = np.concatenate([s[~late], s[late]])[: n - (NEAR * n + OF - 1) // OF + 1]
                    columns = [first.view(np.int64), np.full(len(first), node_of(s), np.int64), np.full(len(first), n, np.int32)]
                    out.append(columns)
                if len(out) >= 256:
                    yield flush()
            if out:
                yield flush()

        out: list[list[np.ndarray]] = []

        def flush():
            columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["shingle", "node", "n"])

        return step

    return map_arrow(_texts(docs), make, "shingle long, node long, n int")


def shared_places(places: DataFrame, folder: str) -> DataFrame:
    """Rows of places whose shingle two nodes have, each once; in slices, which bounds what is shuffled at once."""
    out = None
    for k in range(SLICES):
        part = places.filter(F.expr(f"pmod(shingle, {SLICES}) = {k}"))
        shared = part.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
        found = cut(part.join(shared.select("shingle").hint("merge"), "shingle", "left_semi").distinct(), f"{folder}/hits/{k}")
        out = found if out is None else out.union(found)
    return out


def possible(met: DataFrame) -> DataFrame:
    """Pairs src < dst that may have the similarity, of a row (src, n1, dst, n2) for each shingle in both prefixes.

    Up to the end of the prefix that ends first in the order, two sets share no more than these; so
    not more than these and what the larger set has beyond its prefix in all.
    """
    beyond = F.floor((NEAR * F.greatest("n1", "n2") + OF - 1) / OF) - 1
    counted = met.groupBy("src", "dst", "n1", "n2").agg(F.count("*").alias("shared"))
    return counted.filter((OF + NEAR) * (F.col("shared") + beyond) >= NEAR * (F.col("n1") + F.col("n2"))).select("src", "dst")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs src < dst whose sets have the similarity; and the pairs, written down."""
    pairs = cut(pairs, f"{folder}/pairs")
    involved = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    wanted = nodes.join(involved, "node").select(F.col("first.doc_id").alias("did"), F.col("first.th").alias("h"))
    texts = _texts(docs).join(wanted.hint("merge"), (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("did")), "left_semi")

    def make():
        def step(batch):
            sets = _sets(batch)
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

        return step

    sets = map_arrow(texts, make, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))
    sets = cut(sets, f"{folder}/sets")
    left = sets.select(F.col("node").alias("src"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("y"))
    both = pairs.join(left.hint("merge"), "src").join(right.hint("merge"), "dst").select("src", "dst", "x", "y")

    def compare():
        def step(batch):
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(OF * shared >= NEAR * (len(x) + len(y) - shared))
            return batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

        return step

    return cut(map_arrow(both, compare, "src long, dst long"), f"{folder}/links"), pairs


def _side(rows: DataFrame, k: str) -> DataFrame:
    return rows.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "root", "inside", *SKETCHES)])


def _met(x: DataFrame, y: DataFrame, rule) -> DataFrame:
    """(src, n1, dst, n2) of the pairs of a shingle that obey rule and that sizes and sketches allow:
    sets that differ in more than a ninth of the sum of their sizes aren't similar."""
    bits = F.lit(0)
    for b in SKETCHES:
        bits = bits + F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y")))
    sized = OF * F.least("n_x", "n_y") >= NEAR * F.greatest("n_x", "n_y")
    few = (OF + NEAR) * bits <= (OF - NEAR) * (F.col("n_x") + F.col("n_y"))
    met = x.join(y.hint("merge"), "shingle").filter((F.col("root_x") != F.col("root_y")) & rule & sized & few)
    turned = F.col("node_x") > F.col("node_y")
    pick = lambda c, first, second: F.when(turned, F.col(f"{c}_{second}")).otherwise(F.col(f"{c}_{first}"))
    return met.select(pick("node", "x", "y").alias("src"), pick("n", "x", "y").alias("n1"), pick("node", "y", "x").alias("dst"), pick("n", "y", "x").alias("n2"))


def _cored(placed: DataFrame) -> DataFrame:
    """placed with inside: whether a node is in the component of the shingle's least node."""
    core = placed.groupBy("shingle").agg(F.min(F.struct("node", "root")).alias("c")).select("shingle", F.col("c.root").alias("core"))
    return placed.join(core.hint("merge"), "shingle").withColumn("inside", F.col("root") == F.col("core"))


def met_hub(placed: DataFrame, number: int) -> DataFrame:
    """Each shingle's nodes outside its core with one of the core, another one for each number."""
    known = _cored(placed)
    draw = F.struct(F.xxhash64("node", F.lit(number)), "node", "n", "root", "inside", *SKETCHES)
    hub = known.filter("inside").groupBy("shingle").agg(F.min(draw).alias("h")).select("shingle", "h.*")
    return _met(_side(known.filter("not inside"), "x"), _side(hub, "y"), F.lit(True))


def met_apart(placed: DataFrame) -> DataFrame:
    """Each shingle's nodes outside its core with all others of other components, each pair once."""
    known = _cored(placed)
    once = F.col("inside_y") | (F.col("node_x") < F.col("node_y"))
    return _met(_side(known.filter("not inside"), "x"), _side(known, "y"), once)


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, node), and for each node (node, root, first): the group's node, and of the
    group's rows the first (by doc_id, nulls last, then th) as a struct."""
    folder = work_folder(docs.sparkSession)
    marked = cut(with_node(docs), f"{folder}/marked")
    nodes = cut(marked.groupBy("node").agg(*[F.first(b).alias(b) for b in SKETCHES], F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")), f"{folder}/nodes")
    places = cut(prefixes(docs, frequent(docs)), f"{folder}/prefixes")
    hits = shared_places(places, folder)

    hits = cut(hits.join(nodes.select("node", *SKETCHES).hint("merge"), "node"), f"{folder}/known")
    links, tried = verified(docs, nodes, simhash_pairs(marked, f"{folder}/simhash"), f"{folder}/simhash")
    for k in range(ROUNDS + 1):
        roots = cut(connected_components(links, f"{folder}/components{k}"), f"{folder}/roots{k}")
        placed = hits.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = cut(placed, f"{folder}/placed{k}") if k == ROUNDS else placed
        if k < ROUNDS:
            found, pairs = verified(docs, nodes, met_hub(placed, k).select("src", "dst").distinct(), f"{folder}/hubs{k}")
            links, tried = links.union(found), tried.union(pairs)
    rest = possible(met_apart(placed)).join(tried.hint("merge"), ["src", "dst"], "left_anti")
    links = links.union(verified(docs, nodes, rest, f"{folder}/rest")[0])

    roots = connected_components(links, f"{folder}/second")
    named = nodes.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = cut(named, f"{folder}/named")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return marked, named.select("node", "root").join(least, "root")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over similar pairs, itself included."""
    marked, named = groups(docs)
    return marked.join(named, "node").select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group, one for each: of rows equal in doc_id and text
    any one. All columns stay."""
    _, named = groups(docs)
    kept = named.select("first").distinct().select(F.col("first.doc_id").alias("__did"), F.col("first.th").alias("__h"))
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64(text_or_empty())})
    same = (F.col("__th") == F.col("__h")) & F.col("__id").eqNullSafe(F.col("__did"))
    found = rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["__th", "__id"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
