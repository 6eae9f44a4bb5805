"""Document fingerprints as Merkle trees over sections, paragraphs and clauses, by built-in functions only.

A text is split into sections at blank lines, a section into paragraphs at line ends, a paragraph
into clauses: up to CLAUSE characters that end at a punctuation mark or after a word that ends in e
or s, or CLAUSE characters of any script. All splits lose nothing. Clauses are the leaves, 32 bits of
hash each; a paragraph's node hashes the row of its leaves, a section's the row of its paragraphs,
the root the row of sections. The fingerprint is the tree as text, each level in base 64:

    root ; sections ; paragraphs ; leaves ; number of paragraphs in each section, of leaves in each paragraph

so that equal roots mean equal texts, and where roots differ, the first differing section and in it
the first differing paragraph locate the edit (first_difference). Likeness descends from the roots: sections
that both trees have count whole, of the others the paragraphs that both have, of the others the
leaves. It is the share of both texts' leaves that lie under a common node: 1 for equal texts,
about a half for a text of which half was replaced.

The next document in doc_id order comes from one shuffle: doc_id ranges of about SHARD_BYTES (their
bounds from approximate quantiles of doc_id alone) are window partitions, and the first row of each
range is also dealt, as a guest, to the range before it; the very first one to the last range. Ranges
are many more than shuffle partitions, so that these are even. There are at most MAX_SHARDS ranges,
which bounds what the driver adds up and broadcasts; from 64 GB on they grow, sorted by spilling.

Defined cases: null text is empty; null doc_ids sort first and, like rows of one doc_id, by a hash of
the text; a single document is its own next; extra columns are ignored; an empty table gives no
rows; two empty texts have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_bytes, table, text_or_empty

SHARD_BYTES, MAX_SHARDS, FAN = 1 << 20, 1 << 16, 256
CLAUSE = r"(?s).{0,63}?(?:[\n\p{P}|]|[es] )|.{1,64}"
BITS = 0xFFFFFFFF


def _node(of: Column) -> Column:
    """A node of 32 bits over an array of hashes."""
    return F.xxhash64(of).bitwiseAND(F.lit(BITS))


def tree(text: Column) -> Column:
    """Sections as array of (node, paragraphs: array of (node, leaves))."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), 0), lambda c: F.xxhash64(c).bitwiseAND(F.lit(BITS)))
    paragraph = lambda p: F.transform(F.array(leaves(p)), lambda x: F.struct(_node(x).alias("node"), x.alias("leaves")))[0]
    section = lambda ps: F.struct(_node(F.transform(ps, lambda p: p["node"])).alias("node"), ps.alias("paragraphs"))
    split = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))
    return F.transform(split, section)


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: s["paragraphs"]))


def _leaves(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: p["leaves"]))


def _nodes(of: Column) -> Column:
    return F.transform(of, lambda x: x["node"])


def _packed(hashes: Column) -> Column:
    return F.base64(F.unhex(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), "")))


def fingerprint(sections: Column, text: Column) -> Column:
    """The fingerprint's text from tree(); its root hashes the text to 128 bits besides."""
    paragraphs = _paragraphs(sections)
    root = F.concat(F.lpad(F.hex(_node(_nodes(sections))), 8, "0"), F.upper(F.md5(text)))
    shape = lambda xs, of: F.array_join(F.transform(xs, lambda x: F.size(x[of])), ",")
    return F.concat_ws(
        ";", root, _packed(_nodes(sections)), _packed(_nodes(paragraphs)), _packed(_leaves(paragraphs)), shape(sections, "paragraphs"), shape(paragraphs, "leaves")
    )


def unlike(a: Column, b: Column) -> Column:
    """How many of a's leaves lie under no node that b has too, from the sections down."""
    sections_b = _nodes(b)
    sections = F.filter(a, lambda s: ~F.array_contains(sections_b, s["node"]))
    paragraphs_b = _nodes(_paragraphs(b))
    paragraphs = F.filter(_paragraphs(sections), lambda p: ~F.array_contains(paragraphs_b, p["node"]))
    return F.size(F.array_except(_leaves(paragraphs), _leaves(_paragraphs(b))))


def likeness(a: Column, b: Column) -> Column:
    """The share of two trees' distinct leaves that lie under common nodes."""
    total = F.size(F.array_distinct(_leaves(_paragraphs(a)))) + F.size(F.array_distinct(_leaves(_paragraphs(b))))
    return F.when(total == 0, 1.0).otherwise(1.0 - (unlike(a, b) + unlike(b, a)) / F.greatest(total, F.lit(1)))


def first_difference(a: Column, b: Column) -> Column:
    """From two fingerprints, struct(section, paragraph): the numbers (from 1) of the first differing
    section and of the first differing paragraph of the text; null if the texts are equal."""
    part = lambda x, k: F.split_part(x, F.lit(";"), F.lit(k))

    def first(k):
        levels = [F.regexp_extract_all(F.hex(F.unbase64(part(x, k))), F.lit("[0-9A-F]{8}"), 0) for x in (a, b)]
        return F.array_position(F.zip_with(*levels, lambda x, y: ~x.eqNullSafe(y)), True)

    return F.when(part(a, 1) != part(b, 1), F.struct(first(2).alias("section"), first(3).alias("paragraph")))


def _range_number(column: Column, tops: Column, groups: Column) -> Column:
    """How many of the sorted bounds are at most the column's value: of the groups' first bounds, and
    then of one group."""
    count = lambda values: F.size(F.filter(values, lambda b: b <= column))
    group = count(tops)
    return F.when(group == 0, 0).otherwise((group - 1) * FAN + count(F.element_at(groups, F.greatest(group, F.lit(1)))))


def in_order(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, th, text, shard, guest: ranges of doc_id, each with its successor's first row as guest."""
    spark = docs.sparkSession
    points = [k / shards for k in range(1, shards)] or [0.5]
    found = docs.agg(
        F.percentile_approx("doc_id", points, max(10_000, 10 * shards)).alias("bounds"),
        F.avg(F.col("doc_id").isNull().cast("int")).alias("nulls"),
    ).first()
    bounds = sorted(set(found["bounds"] or [])) if shards > 1 else []
    groups = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    # a row of at most MAX_SHARDS numbers
    one = spark.createDataFrame([([g[0] for g in groups], groups)], "tops array<long>, groups array<array<long>>")
    # rows without doc_id come first, in as many ranges of the hash as their share asks for
    empty = max(1, int(shards * (found["nulls"] or 0)))
    slot = F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * empty).cast("int")
    number = F.when(F.col("doc_id").isNull(), F.least(slot, F.lit(empty - 1))).otherwise(empty + _range_number(F.col("doc_id"), F.col("tops"), F.col("groups")))
    numbered = docs.join(F.broadcast(one)).withColumn("range", number).drop("tops", "groups")
    # a number per range: a proven bound for driver and broadcast
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")
    rows = numbered.select("range", key.alias("key")).groupBy("range").agg(F.min("key").alias("first")).collect()
    firsts = sorted((r["range"], r["first"]["doc_id"], r["first"]["th"]) for r in rows)
    to = [(first, th, firsts[k - 1][0]) for k, (_, first, th) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(to, "first_id long, first_th long, guest_range int"))
    joined = numbered.join(heads, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")), "left")
    own = F.struct(F.col("range").alias("shard"), F.lit(0).alias("guest"))
    as_guest = F.struct(F.col("guest_range").alias("shard"), F.lit(1).alias("guest"))
    places = F.when(F.col("guest_range").isNull(), F.array(own)).otherwise(F.array(own, as_guest))
    return joined.select("doc_id", "th", "text", F.explode(places).alias("at")).select("doc_id", "th", "text", "at.shard", "at.guest")


def edit_fingerprints(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The fingerprints of each text and of its edited text, and their likenesses."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    shards = shards or max(1, min(MAX_SHARDS, input_bytes(docs) // SHARD_BYTES))
    dealt = in_order(rows, shards).withColumn("sections", tree(F.col("text")))
    order = Window.partitionBy("shard").orderBy("guest", F.col("doc_id").asc_nulls_first(), "th", "text")
    paired = dealt.select(
        "doc_id", "text", "guest", "sections",
        F.lead("text").over(order).alias("next_text"),
        F.lead("sections").over(order).alias("next_sections"),
    ).filter("guest = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)
    )
    return (
        paired.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_sections", tree(F.col("edited")))
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("sections"), F.col("text")).alias("fingerprint"),
            fingerprint(F.col("edited_sections"), F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("sections"), F.col("edited_sections")).alias("near_edited"),
            likeness(F.col("sections"), F.col("next_sections")).alias("near_next"),
        )
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
