"""Single-cell allele pileups: UMI collapse, likelihoods, scores, demultiplexing.

Bases come as (cell, snp, umi, allele 0/1/2, bq, ord).  Likelihoods are products
over bases, so they are sums of logarithms: aggregates with map-side partial sums
whose order does not matter; floors are applied once at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import error_of, hwe, log_sum_exp, string_hash
from strandline.operators.lineage import cut

FLOOR = 1e-6
#: A call needs this much more log likelihood than the next one.
MARGIN = 2.0


def umi_collapse(reads: DataFrame) -> DataFrame:
    """One row per (cell, snp, umi): allele and quality of the first base in read order, and the number of reads."""
    return reads.groupBy("cell", "snp", "umi").agg(
        F.min_by(F.struct("allele", "bq"), "ord").alias("first"), F.count(F.lit(1)).alias("n")
    ).select("cell", "snp", "umi", "first.allele", "first.bq", "n")


def base_filter(reads: DataFrame, min_bq: int = 13, cap_bq: int = 40) -> DataFrame:
    return reads.filter(F.col("bq") >= min_bq).withColumn("bq", F.least("bq", F.lit(cap_bq)))


def cell_thresholds(collapsed: DataFrame, min_reads: int, min_umis: int, min_snps: int) -> DataFrame:
    """Cells with enough reads, UMIs and variants."""
    out = collapsed.groupBy("cell").agg(
        F.sum("n").cast("long").alias("n_reads"), F.count(F.lit(1)).alias("n_umis"), F.count_distinct("snp").alias("n_snps")
    )
    return out.filter((F.col("n_reads") >= min_reads) & (F.col("n_umis") >= min_umis) & (F.col("n_snps") >= min_snps))


def _log_states(collapsed: DataFrame, factors: list[tuple[str, Column, Column]]) -> DataFrame:
    """Per cell and variant the sums of logs of each state's factor for reference and alternate bases."""
    ref = F.col("allele") == 0
    sums = [F.sum(F.log(F.when(ref, r).otherwise(a))).alias(name) for name, r, a in factors]
    counts = [F.sum("n").cast("long").alias("n_reads"), F.count_if(ref).alias("n_ref"), F.count_if(~ref).alias("n_alt")]
    return collapsed.filter("allele < 2").groupBy("cell", "snp").agg(*counts, *sums)


def _normalised(df: DataFrame, names: list[str]) -> DataFrame:
    """Logs to shares with a floor; ``log_denominator`` keeps what was divided out."""
    lse = log_sum_exp(F.array(*names))
    df = df.withColumn("log_denominator", lse)
    df = df.withColumns({n: F.greatest(F.exp(F.col(n) - F.col("log_denominator")), F.lit(FLOOR)) for n in names})
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return df.withColumn("_t", total).withColumns({n: F.col(n) / F.col("_t") for n in names}).drop("_t")


def three_state(collapsed: DataFrame) -> DataFrame:
    """Genotype likelihoods g0, g1, g2 of each cell and variant."""
    e = error_of(F.col("bq").cast("double"))
    m = 1 - e
    states = [("g0", m, e / 3), ("g1", 0.5 - e / 3, 0.5 - e / 3), ("g2", e / 3, m)]
    return _normalised(_log_states(collapsed, states), ["g0", "g1", "g2"])


LOG_SUMS = ("n_reads", "n_ref", "n_alt", "g0", "g1", "g2")


def log_pileup(collapsed: DataFrame) -> DataFrame:
    """Counts and log likelihoods of each cell and variant before they are normalised: these add up."""
    e = error_of(F.col("bq").cast("double"))
    m = 1 - e
    return _log_states(collapsed, [("g0", m, e / 3), ("g1", 0.5 - e / 3, 0.5 - e / 3), ("g2", e / 3, m)])


def merged_pileups(*parts: DataFrame) -> DataFrame:
    """Sums of several pileups; floors come once, at the end, so the order does not matter."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("cell", "snp").agg(*[F.sum(c).alias(c) for c in LOG_SUMS])


def removed_pileup(whole: DataFrame, part: DataFrame) -> DataFrame:
    """``whole`` without ``part``; what has no read left is dropped."""
    signed = part.select("cell", "snp", *[(-F.col(c)).alias(c) for c in LOG_SUMS])
    return merged_pileups(whole.select("cell", "snp", *LOG_SUMS), signed).filter("n_reads > 0")


def enough_counts(counts: DataFrame, per_cell: int, per_gene: int) -> DataFrame:
    """Counts (cell, gene, umis) of cells and genes with so many molecules in all."""
    cells = counts.groupBy("cell").agg(F.sum("umis").alias("_n")).filter(F.col("_n") >= per_cell).select("cell")
    genes = counts.groupBy("gene").agg(F.sum("umis").alias("_n")).filter(F.col("_n") >= per_gene).select("gene")
    return counts.join(cells, "cell", "left_semi").join(genes, "gene", "left_semi")


def collapse_genes(counts: DataFrame, n_groups: int) -> DataFrame:
    """Counts of cells over ``n_groups`` groups of genes, dealt by the hash of their names."""
    group = F.pmod(string_hash(F.col("gene").cast("string")), F.lit(n_groups)).cast("int")
    return counts.groupBy("cell", group.alias("gene_group")).agg(F.sum("umis").cast("long").alias("umis"))


def nine_state(collapsed: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Likelihoods of pairs of genotypes g_lm mixed with share ``alpha`` of the second."""
    e = error_of(F.col("bq").cast("double"))
    m = 1 - e
    states = []
    for l in range(3):
        for k in range(3):
            p = l / 2 + (k - l) * alpha / 2
            states.append((f"g{l}{k}", m * (1 - p) + e / 4, m * p + e / 4))
    return _normalised(_log_states(collapsed, states), [s[0] for s in states])


def _dot(names_weights: list[tuple[str, Column]]) -> Column:
    return sum((F.col(n) * w for n, w in names_weights[1:]), F.col(names_weights[0][0]) * names_weights[0][1])


def singlet_score(nine: DataFrame, snps: DataFrame) -> DataFrame:
    """Per cell the log likelihoods of one and of two genotypes, and their difference."""
    h = hwe(F.col("af"))
    one = _dot([(f"g{g}{g}", h[g]) for g in range(3)])
    two = _dot([(f"g{g}{k}", h[g] * h[k]) for g in range(3) for k in range(3)])
    joined = nine.join(snps.select("snp", "af"), "snp")
    return joined.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_snps"), F.sum("n_reads").cast("long").alias("n_reads"),
        F.sum(F.log(one)).alias("llk2"), F.sum(F.log(two)).alias("llk0"),
    ).withColumn("score", F.col("llk2") - F.col("llk0"))


#: Cells of one block of a pairwise comparison.
CELL_BLOCK = 256


def pair_bayes_factors(nine: DataFrame, snps: DataFrame) -> DataFrame:
    """Same-person against different-person log likelihoods of cell pairs over shared variants.

    Cells are dealt over blocks by a hash and meet block by block: a variant of a
    cell moves once for each block, and the pairs of two blocks are summed as
    matrices, variant by variant.
    """
    n = nine.select("cell").distinct().count()
    blocks = max(1, -(-n // CELL_BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in nine.schema}
    rows = nine.select("cell", "snp", *[F.col(f"g{g}{g}").alias(f"d{g}") for g in range(3)]).join(snps.select("snp", "af"), "snp")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.select("cell", "snp", "d0", "d1", "d2", "af", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        rows = rows.sort_values(["snp", "cell"])
        one, two = np.unique(rows["cell"][rows["b"] == p]), np.unique(rows["cell"][rows["b"] == q])
        hits, same, apart = (np.zeros((len(one), len(two))) for _ in range(3))
        cell, block, like, af = rows["cell"].to_numpy(), rows["b"].to_numpy(), rows[["d0", "d1", "d2"]].to_numpy(), rows["af"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], rows["snp"].to_numpy()[1:] != rows["snp"].to_numpy()[:-1], [True])))
        for begin, end in zip(edge[:-1], edge[1:]):
            own, other = block[begin:end] == p, block[begin:end] == q
            if not own.any() or not other.any():
                continue
            x, y = like[begin:end][own], like[begin:end][other]
            h = np.array([(1 - af[begin]) ** 2, 2 * af[begin] * (1 - af[begin]), af[begin] ** 2])
            at = np.ix_(np.searchsorted(one, cell[begin:end][own]), np.searchsorted(two, cell[begin:end][other]))
            hits[at] += 1
            same[at] += np.log((x * h) @ y.T)
            apart[at] += np.log(np.outer(x @ h, y @ h))
        i, j = np.nonzero(hits)
        if p == q:
            i, j = i[one[i] > two[j]], j[one[i] > two[j]]
        a, b = one[i], two[j]
        return pd.DataFrame({"id1": np.maximum(a, b), "id2": np.minimum(a, b), "n_snps": hits[i, j].astype(np.int64), "llk2": same[i, j], "llk0": apart[i, j]})

    out = met.groupBy("p", "q").applyInPandas(compare, f"id1 {kinds['cell']}, id2 {kinds['cell']}, n_snps long, llk2 double, llk0 double")
    return out.withColumn("ldiff", F.col("llk2") - F.col("llk0"))


def genotype_shares(panel: DataFrame, error: float = 0.1) -> DataFrame:
    """Genotype shares of a hard-call panel, blended with the site's mean by an error; missing takes the mean."""
    hard = [F.when(F.col("code") == g + 1, 1.0).otherwise(0.0) for g in range(3)]
    seen = F.col("code") > 0
    means = panel.filter(seen).groupBy("snp").agg(*[F.avg(hard[g]).alias(f"m{g}") for g in range(3)])
    joined = panel.join(means, "snp")
    blended = [
        F.when(seen, (1 - error) * hard[g] + error * F.col(f"m{g}")).otherwise(F.col(f"m{g}")).alias(f"p{g}") for g in range(3)
    ]
    return joined.select("sample", "snp", *blended)


#: Genotype shares of one block of samples in a cell's matrix products.
PAIR_ROWS = 2_000_000


def posterior_shares(pls: DataFrame, afs: DataFrame) -> DataFrame:
    """Genotype shares p0, p1, p2 from PL (sample, snp, pl0, pl1, pl2) and the frequency of each site."""
    joined = pls.join(afs.select("snp", "af"), "snp")
    weight = [F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0) * h for g, h in enumerate(hwe(F.col("af")))]
    total = weight[0] + weight[1] + weight[2]
    return joined.select("sample", "snp", *[(w / total).alias(f"p{g}") for g, w in enumerate(weight)])


def blended_shares(shares: DataFrame, error: float) -> DataFrame:
    """Genotype shares mixed with the mean of their site by an error."""
    means = shares.groupBy("snp").agg(*[F.avg(f"p{g}").alias(f"m{g}") for g in range(3)])
    return shares.join(means, "snp").select("sample", "snp", *[((1 - error) * F.col(f"p{g}") + error * F.col(f"m{g}")).alias(f"p{g}") for g in range(3)])


def pair_scores(collapsed: DataFrame, shares: DataFrame, alphas: tuple[float, ...], singles: bool = False) -> DataFrame:
    """(cell, s1, s2, alpha, llk, n_snps, n_reads): log likelihoods where a share ``alpha`` of a cell's bases comes from s2.

    At alpha 0 only s1 counts (s1 = s2), at one half the order does not matter
    (s1 < s2), else it does.  With ``singles`` the pairs of a sample with itself
    come too, scaled as the first alpha.  A variant's genotype shares of all samples are one
    row, so a cell meets a row for each of its variants, not one for each pair of
    samples; pairs arise inside the cell's group, as matrix products.
    """
    e = error_of(F.col("bq").cast("double"))
    m = 1 - e
    names, states = [], []
    for i, alpha in enumerate(alphas):
        for l in range(3):
            for k in range(3):
                p = l / 2 + (k - l) * alpha / 2
                names.append(f"g{i}_{l}{k}")
                states.append((names[-1], m * (1 - p) + e / 3 * p, e / 3 * (1 - p) + m * p))
    logs = _log_states(collapsed, states)
    cells = logs.select("cell", "snp", "n_reads", F.array(*names).alias("logs"))
    side = shares.groupBy("snp").agg(F.sort_array(F.collect_list(F.struct("sample", "p0", "p1", "p2"))).alias("own"))
    side = side.select("snp", F.transform("own", lambda x: x["sample"]).alias("who"), F.flatten(F.transform("own", lambda x: F.array(x["p0"], x["p1"], x["p2"]))).alias("shares"))
    kinds = {f.name: f.dataType.simpleString() for f in [*collapsed.schema, *shares.schema]}

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("snp")
        every = np.unique(np.concatenate(rows["who"].to_list()))
        n = len(every)
        single = np.zeros(n)
        llk, hits, read = np.zeros((len(alphas), n, n)), np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        step = max(1, PAIR_ROWS // (n * n))
        logs = np.stack(rows["logs"].to_numpy()).reshape(len(rows), len(alphas), 3, 3)
        top = logs.max(axis=(2, 3))
        scaled = np.exp(logs - top[:, :, None, None]) + 1e-10
        who, own, reads = rows["who"].to_list(), rows["shares"].to_list(), rows["n_reads"].to_numpy()
        for begin in range(0, len(rows), step):
            part = slice(begin, begin + step)
            size = len(who[part])
            g, there = np.zeros((size, n, 3)), np.zeros((size, n), np.int64)
            for i, (w, p) in enumerate(zip(who[part], own[part])):
                at = np.searchsorted(every, w)
                g[i, at], there[i, at] = np.reshape(p, (-1, 3)), 1
            both = there[:, :, None] * there[:, None, :]
            hits += both.sum(axis=0)
            read += (both * reads[part, None, None]).sum(axis=0)
            for a, alpha in enumerate(alphas):
                s = scaled[part, a]
                if alpha == 0 or (singles and a == 0):
                    one = np.einsum("vjg,vgg->vj", g, s)
                    own_value = np.log(np.where(there > 0, one, 1.0)) + there * top[part, a, None]
                    single += own_value.sum(axis=0)
                if alpha > 0:
                    mixed = np.einsum("vjl,vlm,vkm->vjk", g, s, g, optimize=True)
                    llk[a] += (np.log(np.where(both > 0, mixed, 1.0)) + both * top[part, a, None, None]).sum(axis=0)
        out = []
        if singles or 0.0 in alphas:
            own = np.flatnonzero(hits.diagonal())
            out.append(pd.DataFrame({"s1": every[own], "s2": every[own], "alpha": 0.0, "llk": single[own], "n_snps": hits.diagonal()[own], "n_reads": read.diagonal()[own]}))
        for a, alpha in enumerate(alphas):
            if alpha == 0:
                continue
            j, k = np.nonzero(hits)
            keep = j < k if alpha == 0.5 else j != k
            j, k = j[keep], k[keep]
            out.append(pd.DataFrame({"s1": every[j], "s2": every[k], "alpha": float(alpha), "llk": llk[a][j, k], "n_snps": hits[j, k], "n_reads": read[j, k]}))
        found = pd.concat(out)
        found.insert(0, "cell", rows["cell"].iloc[0])
        return found

    schema = f"cell {kinds['cell']}, s1 {kinds['sample']}, s2 {kinds['sample']}, alpha double, llk double, n_snps long, n_reads long"
    return cells.join(side, "snp").groupBy("cell").applyInPandas(score, schema)


def demultiplex(collapsed: DataFrame, shares: DataFrame, doublet_prior: float = 0.5, alphas: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Best singlet, second singlet and best doublet of each cell, its call and posteriors.

    ``shares`` are genotype shares (sample, snp, p0, p1, p2) from hard calls, PL
    or GP.  A singlet has all bases from one sample; a doublet a share of the grid
    ``alphas`` from a second one, of which the best for each pair counts.
    """
    scores = pair_scores(collapsed, shares, alphas, singles=True)
    best = F.max(F.struct("llk", (-F.col("alpha")).alias("_a")))
    llks = scores.groupBy("cell", "s1", "s2").agg(best.alias("_b"), F.max("n_snps").alias("n_snps"), F.max("n_reads").alias("n_reads"))
    llks = llks.select("cell", "s1", "s2", F.col("_b.llk").alias("llk"), (-F.col("_b._a")).alias("alpha"), "n_snps", "n_reads")
    return call_cells(llks, shares.select("sample").distinct().count(), doublet_prior)


def call_cells(llks: DataFrame, n_samples: int, doublet_prior: float) -> DataFrame:
    """Calls SNG, DBL or AMB from log likelihoods of (cell, s1, s2), s1 = s2 for singlets; ties to smaller samples."""
    n = n_samples
    single = F.col("s1") == F.col("s2")
    prior = F.when(single, math.log((1 - doublet_prior) / n)).otherwise(math.log(2 * doublet_prior / n / max(n - 1, 1)))
    rank = Window.partitionBy("cell", single).orderBy(F.desc("llk"), "s1", "s2")
    ranked = llks.withColumn("r", F.row_number().over(rank)).withColumn("post", F.col("llk") + prior)
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    best, second, pair = single & (F.col("r") == 1), single & (F.col("r") == 2), ~single & (F.col("r") == 1)
    out = ranked.groupBy("cell").agg(
        F.max("n_snps").alias("n_snps"), F.max("n_reads").alias("n_reads"),
        pick(best, "s1").alias("sng_best"), pick(best, "llk").alias("sng_llk"),
        pick(second, "s1").alias("sng_next"), pick(second, "llk").alias("sng_next_llk"),
        pick(pair, "s1").alias("dbl_1"), pick(pair, "s2").alias("dbl_2"), pick(pair, "llk").alias("dbl_llk"),
        F.sort_array(F.collect_list("post")).alias("_all"), F.sort_array(F.collect_list(F.when(single, F.col("post")))).alias("_sng"),
    )
    kind = (
        F.when(F.col("dbl_llk") > F.col("sng_llk") + MARGIN, "DBL")
        .when(F.col("sng_next_llk").isNull() | (F.col("sng_llk") > F.col("sng_next_llk") + MARGIN), "SNG")
        .otherwise("AMB")
    )
    out = out.withColumn("type", kind).withColumn("sng_posterior", F.exp(log_sum_exp(F.col("_sng")) - log_sum_exp(F.col("_all"))))
    return out.drop("_all", "_sng")


#: Width of the cells in which sums of exponentials are formed; exp of it is far from overflow.
LSE_STEP = 500.0


def grouped_log_sum_exp(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and ``lse``: ln of the sum of exponentials of each group.

    Values are summed map-side relative to the next multiple of ``LSE_STEP`` above
    them; the few sums of a group are then joined relative to the highest.
    """
    base = F.ceil(F.col(value) / LSE_STEP) * LSE_STEP
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*by, base.alias("_base")).agg(F.sum(F.exp(F.col(value) - base)).alias("_sum"))
    part = F.col("_base") + F.log("_sum")
    return sums.groupBy(*by).agg(log_sum_exp(F.collect_list(part)).alias("lse"))


def best_next(scores: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """Best and second best item of each group and the margin; ties to the smaller item."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), item)
    ranked = scores.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    return ranked.groupBy(*by).agg(
        pick(1, item).alias("best"), pick(1, score).alias("best_score"), pick(2, item).alias("next"), pick(2, score).alias("next_score")
    ).withColumn("margin", F.col("best_score") - F.col("next_score"))


def umi_counts(hits: DataFrame, max_nm: int | None = None) -> DataFrame:
    """UMIs, reads and fractional UMIs of each (cell, transcript) from (cell, umi, tx, read_id, nh[, nm]).

    A read counts at its hits of least mismatch; a UMI is shared by the fewest
    hits of its reads.
    """
    if max_nm is not None:
        w = Window.partitionBy("cell", "umi", "read_id")
        hits = hits.withColumn("_least", F.min("nm").over(w)).filter((F.col("_least") <= max_nm) & (F.col("nm") == F.col("_least")))
    per = hits.groupBy("cell", "tx", "umi").agg(F.count(F.lit(1)).alias("reads"), F.min("nh").alias("nh"))
    return per.groupBy("cell", "tx").agg(
        F.count(F.lit(1)).alias("umis"), F.sum("reads").cast("long").alias("reads"), F.sum(1 / F.col("nh")).alias("fumis")
    )


def counts_rollup(counts: DataFrame) -> DataFrame:
    """Counts per (cell, transcript) rolled up to cells and to the whole."""
    return counts.rollup("cell", "tx").agg(
        F.sum("umis").cast("long").alias("umis"), F.sum("reads").cast("long").alias("reads"), F.sum("fumis").alias("fumis"),
        F.count(F.lit(1)).alias("n"),
    )


def gene_umis(hits: DataFrame) -> DataFrame:
    """UMIs per (cell, gene); genes of one locus bin that a UMI hits count once, at the smallest gene."""
    one = hits.groupBy("cell", "umi", "bin").agg(F.min("gene").alias("gene"))
    return one.groupBy("cell", "gene").agg(F.count(F.lit(1)).alias("umis"))


def prefix_histogram(barcodes: DataFrame, lengths: tuple[int, ...], column: str = "barcode") -> DataFrame:
    """For each prefix length: how many barcodes have how many reads, with running totals from the top."""
    long = barcodes.select(F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len"), F.col(column).alias("_b")).filter(
        F.length("_b") >= F.col("len")
    )
    reads = long.groupBy("len", F.left("_b", F.col("len")).alias("prefix")).agg(F.count(F.lit(1)).alias("reads"))
    sizes = reads.groupBy("len", "reads").agg(F.count(F.lit(1)).alias("barcodes"))
    w = Window.partitionBy("len").orderBy(F.desc("reads")).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("cum_barcodes", F.sum("barcodes").over(w).cast("long")).withColumn(
        "cum_reads", F.sum(F.col("barcodes") * F.col("reads")).over(w).cast("long")
    )


def dge_sums(matrix: DataFrame, by: str) -> DataFrame:
    """Sum and non-zero entries of the rows or columns of a count matrix (gene, cell, umis)."""
    return matrix.groupBy(by).agg(F.sum("umis").cast("long").alias("umis"), F.count_if(F.col("umis") > 0).alias("nonzero"))


def mixture_em(counts: DataFrame, profiles: DataFrame, rounds: int = 10, pseudo: float = 0.01):
    """Multinomial mixture by EM: counts (cell, gene, umis), start profiles (cluster, gene, p).

    Returns (posteriors (cell, cluster, z), profiles, shares).  Rounds are
    aggregates; each is cut by a checkpoint, and so are the counts, which every round reads twice,
    and the start.
    """
    counts, profiles = cut(counts), cut(profiles)
    shares = profiles.select("cluster").distinct()
    k = shares.count()
    shares = shares.withColumn("pi", F.lit(1.0 / k))
    posterior = None
    for _ in range(rounds):
        score = counts.join(profiles, "gene").groupBy("cell", "cluster").agg(
            F.sum((F.col("umis") + pseudo) * F.log("p")).alias("ll")
        )
        score = score.join(shares, "cluster").withColumn("ll", F.col("ll") + F.log("pi"))
        w = Window.partitionBy("cell")
        posterior = score.withColumn("_m", F.max("ll").over(w)).withColumn("_e", F.exp(F.col("ll") - F.col("_m")))
        posterior = cut(posterior.withColumn("z", F.col("_e") / F.sum("_e").over(w)).select("cell", "cluster", "z"))
        shares = posterior.groupBy("cluster").agg(F.avg("z").alias("pi"))
        weight = counts.join(posterior, "cell").groupBy("cluster", "gene").agg(F.sum(F.col("z") * (F.col("umis") + pseudo)).alias("w"))
        profiles = cut(weight.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("cluster"))).select("cluster", "gene", "p"))
        shares = cut(shares.filter("pi > 0"))
    return posterior, profiles, shares
