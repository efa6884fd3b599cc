"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import cut, uncut

#: Rounds are logarithmic in the longest path; this many means that something is wrong.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round; edges are (u, v) with u > v, the result too.

    The smallest neighbour is aggregated first and joined back, so a hub with
    very many neighbours is summed map-side and its join partition can be split.
    """
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    ``edges`` holds two columns of one ordered type.  Loops and repeated edges do
    no harm.  No step gathers a component in one task or on the driver; each
    round is cut in the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = cut(now, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        before, now = now, cut(_star(_star(now, True), False), "stars")
        uncut(before)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
