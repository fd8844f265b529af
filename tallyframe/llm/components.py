"""Connected components of an edge table, by rounds of large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged

#: Parts into which the edges of a node are dealt.
SALTS = 8


def _mark(edges: DataFrame) -> tuple:
    """Tells edge tables apart: a round that changes nothing leaves it as it was."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def _met(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the minimum of their node."""
    parts = low.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(parts, ["u", "part"])


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Null ends are ignored, self-loops and repeated edges do no harm, an empty table gives an empty result.
    Each round is a grouped minimum (combined before the shuffle) and an equi-join in ``SALTS`` parts a node, so a node
    with very many neighbours is dealt to several tasks.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = staged(now, "cc")
    mark = _mark(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _met(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _met(large, low2).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        small = small.where("u != v").distinct()
        after = staged(small, "cc")
        discard(now)
        now, was, mark = after, mark, _mark(after)
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
