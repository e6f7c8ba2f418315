"""Connected components by alternating large-star and small-star passes.

Each pass is one aggregation with map-side combining and one join on the same
key, so a vertex with very many edges is split by the adaptive skew join.
Every round is written to the shared folder; the number of rounds grows with
the logarithm of the number of vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label vertices with the smallest vertex they can reach.

    ``edges``: columns a, b (long).  Self-loops, repeated and reversed edges are
    fine; an edge with a null end is ignored.  Returns (node, component) for
    every vertex that has an edge to another one; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "cc")
    seen = _mark(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b")))
        after = materialize(small.where("a <> b").distinct(), "cc")
        mark = _mark(after)
        discard(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of an edge set."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), str(row["h"])
