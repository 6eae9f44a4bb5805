"""Corpus pipeline: documents are filtered, deduplicated, decontaminated and tokenised.

Counted as part of the training-data operators. Each stage takes (spark, docs, sf_dir), works on
all of docs and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from excerptlake.llm import bpe, decontam, lines, near, toxicity
from excerptlake.llm.common import cut, table, work_folder


#: Pieces that a worker keeps for tokenise, fewer than by default: workers hold other stages' caches too.
PIECES = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model is fitted on labelled rows of docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, column="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def beside(docs: DataFrame, names: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) in the columns of docs, whose own columns of these names are put aside meanwhile."""
    aside = {c: f"__aside{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    out = step(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before, n_chars counted anew; a document whose lines all go
    keeps its row."""
    return beside(docs, ("n_lines", "n_removed_lines"), lines.dedup_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, or one without where
    none has any. Near copies are found by op6's SimHash and compared exactly: their sets of 5-word
    shingles are similar to 0.8 or more; similar pairs beyond SimHash's 3 bits are added to these."""
    return near.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region that equals a benchmark passage up to the edit budget."""
    benchmark = table(spark, sf_dir, "benchmark")
    return beside(docs, ("matches",), lambda rows: decontam.find_matches(rows, benchmark).filter(F.coalesce(F.size("matches"), F.lit(0)) <= 0))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hashes of ids and decoded text."""
    return bpe.digests(docs, bpe.vocabulary("byte_bpe_50k.json"), with_ids=True, cache=PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: No SQL can express these stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again for the next."""
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
