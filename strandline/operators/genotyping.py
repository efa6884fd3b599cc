"""Genotype likelihoods and site statistics from bases, gene hits, pair checks, normal forms of variants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import error_of
from strandline.operators.intervals import overlapped_names
from strandline.operators.pileup import pair_scores

MAX_QUALITY = 40
MAX_ERROR = 0.75


def contaminated_pl(bases: DataFrame, contamination: float | Column = 0.0) -> DataFrame:
    """PL of each (sample, snp) from (allele, bq), where a share of the bases, one for all or a column, comes from somebody else.

    A base's three factors are renormalised, then multiplied; alleles other than
    the two are left out.
    """
    return pls_of_sums(bases.filter("allele < 2").groupBy("sample", "snp").agg(*pl_sums(contamination)))


def pl_sums(contamination: float | Column) -> list[Column]:
    """Aggregates over the bases of a (sample, snp) from which :func:`pls_of_sums` makes its PL."""
    e = F.least(error_of(F.least(F.col("bq"), F.lit(MAX_QUALITY)).cast("double")), F.lit(MAX_ERROR))
    m, c = 1 - e, contamination
    own = [m * (1 - c) + e * c / 3, m / 2 + e / 6, m * c + e * (1 - c) / 3]
    total = own[0] + own[1] + own[2]
    ref = F.col("allele") == 0
    logs = [F.sum(F.log(F.when(ref, own[g] / total).otherwise(own[2 - g] / total))).alias(f"l{g}") for g in range(3)]
    return [F.count(F.lit(1)).alias("dp"), F.count_if(ref).alias("ad0"), F.count_if(~ref).alias("ad1"), *logs]


def pls_of_sums(sums: DataFrame) -> DataFrame:
    top = F.greatest("l0", "l1", "l2")
    scale = -10 / math.log(10)
    pl = [F.least(F.floor((F.col(f"l{g}") - top) * scale + 0.5), F.lit(255)).cast("int").alias(f"pl{g}") for g in range(3)]
    return sums.select("sample", "snp", "dp", "ad0", "ad1", *pl)


#: Statistics that correlate the allele with a column of the bases.
COVARIATES = {"bqz": "bq", "stz": "fwd"}


def _correlation(n, sx, sxx, sy, syy, sxy) -> Column:
    cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))


def sample_site_sums(bases: DataFrame, hets: DataFrame, covariates: dict[str, str] | None = None, mismatches: str | None = None) -> DataFrame:
    """Weighted sums of each variant over samples: allele balance of heterozygotes, and correlation of the allele with other columns.

    ``covariates`` name a statistic for each column (quality, strand, mapping
    quality, cycle ...); ``mismatches`` is the column whose means by allele give
    nm0 and nm1.  Two levels: bases to (sample, snp), then to snp; both are summed
    map-side.  ``hets`` are (sample, snp) called heterozygous.
    """
    covariates = covariates or COVARIATES
    per = bases.filter("allele < 2").groupBy("sample", "snp").agg(*covariate_sums(covariates, mismatches))
    return sums_over_samples(per, hets, covariates, mismatches)


def covariate_sums(covariates: dict[str, str], mismatches: str | None = None) -> list[Column]:
    """Aggregates over the bases of a (sample, snp), the first level of :func:`sample_site_sums`."""
    alt = (F.col("allele") == 1).cast("double")
    sums = []
    for name, column in covariates.items():
        x = F.col(column).cast("double")
        sums += [F.sum(x).alias(f"{name}_x"), F.sum(x * x).alias(f"{name}_xx"), F.sum(x * alt).alias(f"{name}_xa")]
    if mismatches:
        m = F.col(mismatches).cast("double")
        sums += [F.avg(F.when(alt == side, m)).alias(f"nm{side}") for side in (0, 1)]
    return [F.count(F.lit(1)).cast("double").alias("n"), F.sum(1 - alt).alias("ref"), F.sum(alt).alias("a"), *sums]


def sums_over_samples(per: DataFrame, hets: DataFrame, covariates: dict[str, str], mismatches: str | None = None) -> DataFrame:
    """The second level of :func:`sample_site_sums`: from (sample, snp) to snp."""
    per = per.join(hets.select("sample", "snp", F.lit(1.0).alias("het")), ["sample", "snp"], "left").fillna(0.0, ["het"])
    n, w, het, a = F.col("n"), F.log(F.col("n") + 1), F.col("het"), F.col("a")
    more = []
    for name in covariates:
        z = _correlation(n, F.col(f"{name}_x"), F.col(f"{name}_xx"), a, a, F.col(f"{name}_xa"))
        more.append(F.sum(F.sqrt(n) * z * w).alias(f"{name}_num"))
    if mismatches:
        for side in (0, 1):
            mean = F.col(f"nm{side}")
            more += [F.sum(w * mean).alias(f"nm{side}_num"), F.sum(F.when(mean.isNotNull(), w)).alias(f"nm{side}_den")]
    return per.groupBy("snp").agg(
        F.sum(het * w * (F.col("ref") + 0.05) / (n + 0.1)).alias("abe_num"), F.sum(het * w).alias("abe_den"),
        F.sum(het * w * (F.col("ref") - n / 2) / F.sqrt(n / 4 + 1e-3)).alias("abz_num"), F.sum(het * w * w).alias("abz_den"),
        F.sum(w * w).alias("w2"), F.count(F.lit(1)).cast("double").alias("n_samples"), F.sum("n").alias("dp"), *more,
    )


def merge_site_sums(*parts: DataFrame) -> DataFrame:
    """Sums of several sets of samples into those of all."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("snp").agg(*[F.sum(c).alias(c) for c in parts[0].columns if c != "snp"])


def site_statistics(sums: DataFrame) -> DataFrame:
    """Allele balance, one statistic for each covariate, and mean mismatches by allele where they were summed."""
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    root = lambda a, b: F.col(a) / F.sqrt(F.nullif(F.col(b), F.lit(0.0)))
    names = [c[:-4] for c in sums.columns if c.endswith("_num") and c[:-4] not in ("abe", "abz")]
    more = [(ratio(f"{n}_num", f"{n}_den") if f"{n}_den" in sums.columns else root(f"{n}_num", "w2")).alias(n) for n in names]
    return sums.select("snp", "n_samples", "dp", ratio("abe_num", "abe_den").alias("abe"), root("abz_num", "abz_den").alias("abz"), *more)


def gene_hits(fragments: DataFrame, elements: DataFrame, kind: str = "exon", width: int = 10_000) -> DataFrame:
    """Distinct (cell, umi, gene) of fragments (cell, umi, chrom, strand, beg, end) on elements of their strand.

    A fragment takes the names of its genes along as one array and is dealt by its
    molecule; pairs are formed only there, where equal ones meet in one task.
    """
    own = elements.filter(F.col("type") == kind).select("chrom", "strand", "beg", "end", F.col("gene_id").alias("gene"))
    met = overlapped_names(fragments.select("cell", "umi", "chrom", "strand", "beg", "end"), own, ["chrom", "strand"], ["gene"], width)
    dealt = met.select("cell", "umi", F.col("met.gene").alias("met")).repartition("cell", "umi")
    return dealt.select("cell", "umi", F.explode("met").alias("gene")).distinct()


def pair_likelihoods(collapsed: DataFrame, shares: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Log likelihood of each (cell, s1, s2, alpha): ``alpha`` of the bases come from the second sample.

    At alpha 0 only the first sample counts, at one half the order does not matter.
    """
    return pair_scores(collapsed, shares, alphas).select("cell", "s1", "s2", "alpha", "llk", "n_snps")


def verify_pairs(llks: DataFrame) -> DataFrame:
    """Best single sample, best pair and its share of each cell, and the gain of the pair."""
    single = F.col("alpha") == 0
    # ties go to the smaller samples, whatever their type, then to the larger share
    order = F.struct((-F.col("llk")).alias("l"), "s1", "s2", (-F.col("alpha")).alias("a"))
    pick = lambda cond: F.min_by(F.struct("llk", "s1", "s2", "alpha"), F.when(cond, order))
    best = llks.groupBy("cell").agg(pick(single).alias("one"), pick(~single).alias("two"), F.max("n_snps").alias("n_snps"))
    return best.select(
        "cell", "n_snps", F.col("one.s1").alias("sm_id"), F.col("one.llk").alias("llk1"), F.col("two.s1").alias("sm1_id"), F.col("two.s2").alias("sm2_id"),
        F.col("two.alpha").alias("alpha"), F.col("two.llk").alias("llk12"), (F.col("two.llk") - F.col("one.llk")).alias("gain"),
    )


def normal_form(pos: int, ref: str, alt: str, left: str) -> tuple[int, str, str]:
    """A variant trimmed at its right end, moved as far left as ``left`` (the bases before it) allows, trimmed at its left end."""
    while True:
        if ref and alt and ref[-1] == alt[-1] and ref != alt and (len(ref) > 1 and len(alt) > 1 or left):
            ref, alt = ref[:-1], alt[:-1]
        elif (not ref or not alt) and left:
            ref, alt, left, pos = left[-1] + ref, left[-1] + alt, left[:-1], pos - 1
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


def normalise(variants: DataFrame, bins: DataFrame, width: int, reach: int = 200) -> DataFrame:
    """``variants`` (chrom, pos, ref, alt) in normal form, from reference bins (chrom, bin, seq) of ``width`` bases.

    A variant meets its own bin and the one before it, so ``reach`` up to the
    bin width is exact.
    """
    at = F.floor((F.col("pos") - 1) / width)
    keyed = variants.withColumn("_bin", at)
    own = bins.select("chrom", F.col("bin").alias("_bin"), F.col("seq").alias("_own"))
    before = bins.select("chrom", (F.col("bin") + 1).alias("_bin"), F.col("seq").alias("_before"))
    keyed = keyed.join(own, ["chrom", "_bin"], "left").join(before, ["chrom", "_bin"], "left")
    inside = ((F.col("pos") - 1) % width).cast("int")
    left = F.concat(F.coalesce("_before", F.lit("")), F.left(F.coalesce("_own", F.lit("")), inside))
    keyed = keyed.withColumn("_left", F.right(left, F.lit(reach)))

    @F.pandas_udf("pos int, ref string, alt string")
    def moved(pos: pd.Series, ref: pd.Series, alt: pd.Series, left: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normal_form(*x) for x in zip(pos, ref, alt, left)], columns=["pos", "ref", "alt"])

    keyed = keyed.withColumn("_n", moved("pos", "ref", "alt", "_left"))
    return keyed.withColumns({c: F.col("_n")[c] for c in ("pos", "ref", "alt")}).drop("_n", "_left", "_own", "_before", "_bin")


def mixture_gibbs(counts: pd.DataFrame, n_clusters: int, rounds: int = 50, alpha: float = 1.0, beta: float = 0.1, seed: int = 1) -> pd.DataFrame:
    """Collapsed Gibbs sampling of a multinomial mixture over (cell, gene, umis); (cell, cluster) of the last sweep.

    Each draw depends on all before it, so this runs on one machine by nature:
    ``counts`` is what a caller chose to gather.
    """
    rng = np.random.default_rng(seed)
    cells, ci = np.unique(counts["cell"], return_inverse=True)
    genes, gi = np.unique(counts["gene"], return_inverse=True)
    x = np.zeros((len(cells), len(genes)))
    np.add.at(x, (ci, gi), counts["umis"].to_numpy())
    z = rng.integers(0, n_clusters, len(cells))
    size = np.bincount(z, minlength=n_clusters).astype(float)
    sums = np.stack([x[z == k].sum(axis=0) for k in range(n_clusters)])
    lgamma = np.vectorize(math.lgamma)
    for _ in range(rounds):
        for i in range(len(cells)):
            size[z[i]] -= 1
            sums[z[i]] -= x[i]
            nz = x[i] > 0
            total = sums.sum(axis=1) + beta * len(genes)
            score = np.log(size + alpha) + lgamma(total) - lgamma(total + x[i].sum())
            score += (lgamma(sums[:, nz] + beta + x[i, nz]) - lgamma(sums[:, nz] + beta)).sum(axis=1)
            p = np.exp(score - score.max())
            z[i] = rng.choice(n_clusters, p=p / p.sum())
            size[z[i]] += 1
            sums[z[i]] += x[i]
    return pd.DataFrame({"cell": cells, "cluster": z})
