"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.storage import materialize

#: Each round at least halves the height of the trees; this is far beyond any table's need.
MAX_ROUNDS = 60


def _seal(edges: DataFrame) -> tuple:
    """Equal for equal tables of distinct edges: their number and combined hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a written table: root is the least node of its component.

    Alternating large-star and small-star steps: each points a node's neighbours to
    the least of them, until the edges are stars. A step emits at most one row per
    edge, and a node's neighbours are never gathered, only their minimum.
    """
    n = edges.count()
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n)
    before = _seal(now)
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star", 2 * n)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        then = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        then = materialize(then.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star", 2 * n)
        before, last = _seal(then), before
        if before == last:
            return then.select(F.col("a").alias("node"), F.col("b").alias("root")).union(then.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = then
    raise RuntimeError("the components did not settle")
