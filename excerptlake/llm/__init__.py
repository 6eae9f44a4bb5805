"""Operators of a training-data pipeline over documents, conversations and benchmark tables.

Nothing else in the library imports this subpackage. queries() and oracle_sql() hold the
operator queries; the pipeline itself is corpus_pipeline.py at the repository's top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import bpe, decontam, lines, merkle, quotes, repair, secrets, simhash, suffixes, toxicity

    return {
        "op1_secrets": secrets.op1,
        "op2_token_files": repair.op2,
        "op3_bpe": bpe.op3,
        "op4_toxicity": toxicity.op4,
        "op5_merkle": merkle.op5,
        "op6_simhash": simhash.op6,
        "op7_quotation_links": quotes.op7,
        "op8_line_dedup": lines.op8,
        "op9_decontamination": decontam.op9,
        "op10_suffix_dedup": suffixes.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {}
