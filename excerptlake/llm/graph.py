"""Connected components of a link table by alternating large-star and small-star contractions.

Each round replaces links by links to smaller nodes and keeps components; it ends when a round
changes nothing, after a number of rounds logarithmic in a component's size. Every round is
written to the shared folder, so lineage stays short and a lost executor costs one round at most.
No neighbourhood is gathered: each star takes a minimum (pre-aggregated) and a join to it, by merging:
tables of links and minima grow with the input, so none of them is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    joined = both.join(least.hint("merge"), "src").filter("dst > src")
    return joined.select(F.col("m").alias("src"), "dst").filter("src < dst")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges src < dst: each dst links its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("dst").agg(F.min("src").alias("m"))
    moved = edges.join(least.hint("merge"), "dst").filter("src <> m").select(F.col("m").alias("src"), F.col("src").alias("dst"))
    own = least.select(F.col("m").alias("src"), "dst")
    return moved.unionByName(own).filter("src < dst").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) for every node that has a link; src < dst on input."""
    edges, state = edges.select("src", "dst"), _state(edges)
    for k in range(rounds):
        if not state[0]:
            break
        edges = cut(_small_star(_large_star(edges)), f"{folder}/{k}")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
