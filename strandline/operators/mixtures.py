"""Mixtures of expression profiles in which a cell may be two at once."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import cut


def mixture_with_doublets(
    counts: DataFrame, profiles: DataFrame, doublet: float = 0.1, rounds: int = 10, pseudo: float = 0.01
) -> tuple[DataFrame, DataFrame, list[float]]:
    """EM of a multinomial mixture whose components are profiles and the averages of two: counts (cell, gene, umis), start profiles (cluster, gene, p).

    Clusters are 0, 1, ... .  A cell is a doublet with the given share, of a pair of clusters
    in proportion to the product of their shares; half of a doublet belongs to each.
    Returns (cells (cell, best, other, p_doublet, z), profiles (cluster, gene, p), shares);
    other is null for singlets, z holds the posteriors of the clusters, then of the pairs
    (0, 1), (0, 2), (1, 2), ... .

    A gene's profiles are one row of columns, a cell's scores another: a round is a join
    and an aggregate over the counts each way, whatever the number of pairs; cells and
    pairs never form a table.  The shares, one number a cluster, meet on the driver.
    """
    counts, profiles = cut(counts), cut(profiles)
    k = profiles.select("cluster").distinct().count()
    pairs = sorted(combinations(range(k), 2), key=lambda ab: (ab[1], ab[0]))
    wide = cut(profiles.groupBy("gene").agg(*[F.sum(F.when(F.col("cluster") == i, F.col("p"))).alias(f"p{i}") for i in range(k)]))
    shares = [1.0 / k] * k
    posterior = None
    for _ in range(rounds):
        logs = [F.log(f"p{i}") for i in range(k)] + [F.log((F.col(f"p{a}") + F.col(f"p{b}")) / 2) for a, b in pairs]
        sums = [F.sum((F.col("umis") + pseudo) * x) for x in logs]
        scores = counts.join(wide, "gene").groupBy("cell").agg(F.array(*sums).alias("s"))
        both = sum(shares[a] * shares[b] for a, b in pairs)
        prior = [math.log((1 - doublet) * x) if x > 0 else -math.inf for x in shares]
        prior += [math.log(doublet * shares[a] * shares[b] / both) if doublet > 0 and shares[a] * shares[b] > 0 else -math.inf for a, b in pairs]
        scores = scores.withColumn("s", F.zip_with("s", F.array(*[F.lit(float(x)) for x in prior]), lambda a, b: a + b))
        top = F.array_max("s")
        odds = scores.withColumn("e", F.transform("s", lambda x: F.exp(x - top)))
        total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
        posterior = cut(odds.select("cell", F.transform("e", lambda x: x / total).alias("z")))
        own = [_own(F.col("z"), i, k, pairs) for i in range(k)]
        shares = list(posterior.agg(*[F.avg(x) for x in own]).first())
        weights = counts.join(posterior.select("cell", *[x.alias(f"w{i}") for i, x in enumerate(own)]), "cell")
        sums = weights.groupBy("gene").agg(*[F.sum((F.col("umis") + pseudo) * F.col(f"w{i}")).alias(f"p{i}") for i in range(k)])
        sums = cut(sums)
        whole = sums.agg(*[F.sum(f"p{i}") for i in range(k)]).first()
        wide = cut(sums.select("gene", *[(F.col(f"p{i}") / whole[i]).alias(f"p{i}") for i in range(k)]))
    at = F.array_position("z", F.array_max("z")).cast("int") - 1
    first = F.array(*[F.lit(i) for i in range(k)], *[F.lit(a) for a, _ in pairs])
    second = F.array(*[F.lit(None).cast("int") for _ in range(k)], *[F.lit(b) for _, b in pairs])
    twice = F.aggregate(F.slice("z", k + 1, max(len(pairs), 1)), F.lit(0.0), lambda a, x: a + x)
    cells = posterior.select("cell", F.get(first, at).alias("best"), F.get(second, at).alias("other"), twice.alias("p_doublet"), "z")
    out = wide.select("gene", F.explode(F.array(*[F.struct(F.lit(i).alias("cluster"), F.col(f"p{i}").alias("p")) for i in range(k)])).alias("x"))
    return cells, out.select("x.cluster", "gene", "x.p"), shares


def _own(z: Column, i: int, k: int, pairs: list[tuple[int, int]]) -> Column:
    """What of a cell belongs to a cluster: its posterior, and half of every pair with it."""
    out = F.get(z, F.lit(i))
    for n, pair in enumerate(pairs):
        if i in pair:
            out = out + F.get(z, F.lit(k + n)) / 2
    return out
