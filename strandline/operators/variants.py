"""Operators over genotypes and variant sites.

Genotypes come as a long table (sample, snp, code); code 0 is missing, 1, 2 and 3
are no, one and two alternate alleles.  Every operator is one aggregation or an
equi-join on the variant, so partial sums are made before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.functions.scalar import hwe
from strandline.operators.lineage import cut

SNP_MASKS = {"ALL": (0, 1, 2, 3), "NREF": (2, 3), "REF": (1,), "HET": (2,), "ALT": (3,), "MISS": (0,)}


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def mask_low(panel: DataFrame, min_dp: int = 0, min_gq: int = 0) -> DataFrame:
    """Genotypes below a depth or quality become missing."""
    low = (F.col("dp") < min_dp) | (F.col("gq") < min_gq)
    return panel.withColumn("code", F.when(low, F.lit(0)).otherwise(F.col("code")))


def squeeze(panel: DataFrame, ploidy: Column, min_dp: int, min_dp_haploid: int, min_gq: int) -> DataFrame:
    """Masks that know the ploidy: none for no copies, own depth bound for one copy; missing ones lose dp and gq."""
    least = F.when(ploidy == 1, F.lit(min_dp_haploid)).otherwise(F.lit(min_dp))
    bad = (ploidy == 0) | (F.col("dp") < least) | (F.col("gq") < min_gq)
    return panel.withColumn("code", F.when(bad, F.lit(0)).otherwise(F.col("code"))).withColumn("masked", bad)


def sample_summary(panel: DataFrame, site_ac: DataFrame | None = None, ac_bins: tuple[int, ...] = ()) -> DataFrame:
    """Variants of each sample by genotype class; with ``site_ac`` also non-reference counts by allele-count bin."""
    aggs = [count_if(F.col("code").isin(*codes)).alias(name) for name, codes in SNP_MASKS.items()]
    if ac_bins:
        panel = panel.join(site_ac, "snp")
        low = 0
        for high in ac_bins:
            aggs.append(count_if(F.col("code").isin(2, 3) & (F.col("ac") > low) & (F.col("ac") <= high)).alias(f"AC_{high}"))
            low = high
    return panel.groupBy("sample").agg(*aggs)


def sample_summary_by_kind(panel: DataFrame, af_bins: tuple[float, ...] = ()) -> DataFrame:
    """Variants of each sample by genotype class, SNPs and others apart (``is_snp``); with bins also non-reference ones by the site's ``af``."""
    sides = (("SNP", F.col("is_snp")), ("OTH", ~F.col("is_snp")))
    aggs = [count_if(F.col("code").isin(*codes) & side).alias(f"{name}_{tag}") for name, codes in SNP_MASKS.items() for tag, side in sides]
    low = 0.0
    for high in af_bins:
        inside = F.col("code").isin(2, 3) & (F.col("af") > low) & (F.col("af") <= high)
        aggs += [count_if(inside & side).alias(f"AF_{int(high * 1000)}_{tag}") for tag, side in sides]
        low = high
    return panel.groupBy("sample").agg(*aggs)


def sample_field_sums(panel: DataFrame, fields: tuple[str, ...] = ("dp", "gq")) -> DataFrame:
    return panel.groupBy("sample").agg(*[F.sum(f).cast("long").alias(f"sum_{f}") for f in fields])


def site_counts(panel: DataFrame) -> DataFrame:
    """AC, AN, AF, genotype counts, missing share, MAC and MAF of each site."""
    code = F.col("code")
    out = panel.groupBy("snp").agg(
        F.sum(F.when(code > 0, code - 1).otherwise(0)).cast("long").alias("ac"),
        (2 * count_if(code > 0)).alias("an"),
        count_if(code == 1).alias("gc0"), count_if(code == 2).alias("gc1"), count_if(code == 3).alias("gc2"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        out.withColumn("af", F.col("ac") / F.nullif(F.col("an"), F.lit(0)))
        .withColumn("fmis", (F.col("n") - F.col("gc0") - F.col("gc1") - F.col("gc2")) / F.col("n"))
        .withColumn("mac", F.least("ac", F.col("an") - F.col("ac")))
        .withColumn("maf", F.col("mac") / F.nullif(F.col("an"), F.lit(0)))
    )


def site_filter(
    sites: DataFrame, min_call_rate: float = 0.0, min_mac: int = 0, min_maf: float = 0.0, max_maf: float = 0.5,
    min_ac: int = 0, max_ac: int | None = None,
) -> DataFrame:
    """Numeric site bounds; frequencies carry tiny pseudo-counts, so a site without calls has frequency one half."""
    af = (F.col("ac") + 5e-11) / (F.col("an") + 1e-10)
    maf = F.least(af, 1 - af)
    keep = (1 - F.col("fmis") >= min_call_rate) & (F.col("mac") >= min_mac) & (maf >= min_maf) & (maf <= max_maf)
    keep = keep & (F.col("ac") >= min_ac)
    return sites.filter(keep if max_ac is None else keep & (F.col("ac") <= max_ac))


def plain_site_filter(
    sites: DataFrame, min_qual: float | None = None, min_alleles: int = 0, max_alleles: int | None = None, snps_only: bool = False,
    filters: list[str] | None = None,
) -> DataFrame:
    """Bounds that need no genotypes: quality, numbers of alleles, SNPs only, and any of some FILTER names."""
    n = F.size("alts") + 1
    keep = n >= min_alleles
    if max_alleles is not None:
        keep = keep & (n <= max_alleles)
    if min_qual is not None:
        keep = keep & (F.col("qual") >= min_qual)
    if snps_only:
        keep = keep & (F.length("ref") == 1) & F.forall("alts", lambda a: a.rlike("^[ACGTNacgtn]$"))
    if filters:
        keep = keep & F.arrays_overlap("filters", F.array(*[F.lit(f) for f in filters]))
    return sites.filter(keep)


SITE_KEY = ["chrom", "pos", "ref", "alts"]


def update_info(sites: DataFrame, other: DataFrame | None = None, remove: list[str] | None = None, replace: list[str] | None = None, add: list[str] | None = None) -> DataFrame:
    """``sites`` with INFO fields removed, replaced where ``other`` has them at the same variant, and added from it."""
    out = sites.withColumn("info", F.map_filter("info", lambda k, _: ~k.isin(*(remove or [""]))))
    if other is None:
        return out
    side = other.select(*SITE_KEY, F.col("info").alias("_other"))
    joined = out.join(side, SITE_KEY, "left")
    none = F.create_map().cast("map<string,string>")
    taken = F.map_filter(F.coalesce("_other", none), lambda k, _: k.isin(*(replace or [""])) | k.isin(*(add or [""])))
    # fields to add give way to those that are there, fields to replace do not
    taken = F.map_filter(taken, lambda k, _: k.isin(*(replace or [""])) | ~F.map_contains_key(F.col("info"), k))
    own = F.map_filter("info", lambda k, _: ~F.map_contains_key(taken, k))
    return joined.withColumn("info", F.map_concat(own, taken)).select(*sites.columns)


def canonical_id(old: Column) -> Column:
    """A variant's name with colons and 1-based position, from one with underscores and 0-based position; others stay."""
    part = r"^(.+)_([0-9]+)_([^_]+)_([^_]+)$"
    pos = (F.regexp_extract(old, part, 2).try_cast("int") + 1).cast("string")
    new = F.concat_ws(":", F.regexp_extract(old, part, 1), pos, F.regexp_extract(old, part, 3), F.regexp_extract(old, part, 4))
    return F.when(old.rlike(part), new).otherwise(old)


def project_samples(panel: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotypes of the wanted samples."""
    return panel.join(samples.select("sample").distinct(), "sample", "left_semi")


def zip_sites(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables site by site; an error if a site of one is missing in the other."""
    both = left.join(right, keys, "inner")
    counts = [d.count() for d in (left, right, both)]
    if len(set(counts)) > 1:
        raise ValueError(f"the sites differ: {counts[0]} and {counts[1]} rows, {counts[2]} in common")
    return both


def thin(rows: DataFrame, share: float, *keys: str, seed: int = 1) -> DataFrame:
    """A random ``share`` of rows, decided by a hash of their keys, so that reruns and retries agree."""
    return rows.filter(F.conv(F.substring(_named_hash(seed, keys), 1, 8), 16, 10).cast("double") / (1 << 32) < share)


def _named_hash(seed: int, keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def one_per_cluster(rows: DataFrame, cluster: list[str], keys: list[str], seed: int = 1) -> DataFrame:
    """One row of each cluster, drawn by a seeded hash of its keys, with the cluster's size ``n``."""
    own = [c for c in rows.columns if c not in cluster]
    picked = rows.groupBy(*cluster).agg(F.min_by(F.struct(*own), _named_hash(seed, keys)).alias("_row"), F.count(F.lit(1)).alias("n"))
    return picked.select(*cluster, "_row.*", "n")


def rows_between(rows: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1) in an order, with their number ``n``.

    No more than ``last`` rows are sorted at the end: Spark keeps the least of each task.
    """
    head = rows.orderBy(*order).limit(last)
    return head.withColumn("n", F.row_number().over(Window.orderBy(*order))).filter(F.col("n") >= first)


def ibs_matrix(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Nine-cell genotype table and concordance of every query and reference sample that share sites."""
    q = queries.filter("code > 0").select(F.col("sample").alias("list_id"), "snp", F.col("code").alias("a"))
    r = references.filter("code > 0").select(F.col("sample").alias("ref_id"), "snp", F.col("code").alias("b"))
    names = ("REF", "HET", "HOM")
    cells = [
        count_if((F.col("a") == i + 1) & (F.col("b") == j + 1)).alias(f"{names[i]}_{names[j]}")
        for i in range(3) for j in range(3)
    ]
    out = q.join(r, "snp").groupBy("list_id", "ref_id").agg(*cells, F.count(F.lit(1)).alias("total"))
    same = F.col("HET_HET") + F.col("HOM_HOM")
    return out.withColumn("CONC_ALL", (same + F.col("REF_REF")) / F.col("total")).withColumn(
        "CONC_NREF", same / F.nullif(F.col("total") - F.col("REF_REF"), F.lit(0))
    )


#: Samples of one block of a pairwise comparison, and genotypes of one matrix product.
SAMPLE_BLOCK, PRODUCT_CELLS = 512, 1 << 24


def ibs0_free_pairs(panel: DataFrame, min_hom: int = 1) -> DataFrame:
    """Pairs (id1, id2) of samples without any site of opposite homozygotes.

    Sites need ``min_hom`` of either homozygote.  Samples are dealt over blocks by
    a hash and meet block by block: opposite homozygotes of all pairs of two
    blocks are counted by matrix products over stretches of sites.
    """
    homs = panel.groupBy("snp").agg(count_if(F.col("code") == 1).alias("h0"), count_if(F.col("code") == 3).alias("h2"))
    good = homs.filter((F.col("h0") >= min_hom) & (F.col("h2") >= min_hom)).select("snp")
    names = panel.select("sample").distinct()
    blocks = max(1, -(-names.count() // SAMPLE_BLOCK))
    block = F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int")
    told = panel.join(good, "snp", "left_semi").filter("code in (1, 3)").select("sample", F.xxhash64("snp").alias("snp"), (F.col("code") == 3).alias("alt"))
    # a row without a site for each sample, so that those without homozygotes meet the others too
    rows = told.unionByName(names.select("sample", F.lit(None).cast("long").alias("snp"), F.lit(False).alias("alt"))).withColumn("b", block)
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.select("sample", "snp", "alt", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    kind = panel.schema["sample"].dataType.simpleString()

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        one, two = np.unique(rows["sample"][rows["b"] == p]), np.unique(rows["sample"][rows["b"] == q])
        apart = np.zeros((len(one), len(two)), bool)
        rows = rows[rows["snp"].notna()]
        snp = rows["snp"].to_numpy(dtype=np.int64)
        sites, place = np.unique(snp, return_inverse=True)
        who, block, alt = rows["sample"].to_numpy(), rows["b"].to_numpy(), rows["alt"].to_numpy(dtype=bool)
        step = max(1, PRODUCT_CELLS // max(len(one) + len(two), 1))
        for begin in range(0, len(sites), step):
            inside = (place >= begin) & (place < begin + step)

            def homozygotes(ids: np.ndarray, of: int, is_alt: bool) -> np.ndarray:
                at = inside & (block == of) & (alt == is_alt)
                out = np.zeros((len(ids), min(step, len(sites) - begin)), np.float32)
                out[np.searchsorted(ids, who[at]), place[at] - begin] = 1
                return out

            apart |= homozygotes(one, p, False) @ homozygotes(two, q, True).T > 0
            apart |= homozygotes(one, p, True) @ homozygotes(two, q, False).T > 0
        i, j = np.nonzero(~apart)
        if p == q:
            i, j = i[one[i] < two[j]], j[one[i] < two[j]]
        a, b = one[i], two[j]
        return pd.DataFrame({"id1": np.minimum(a, b), "id2": np.maximum(a, b)})

    return met.groupBy("p", "q").applyInPandas(compare, f"id1 {kind}, id2 {kind}")


def trio_table(panel: DataFrame, trios: DataFrame) -> DataFrame:
    """64-cell table (dad, mom, kid codes) of each trio of (dad, mom, kid)."""
    g = panel.select("sample", "snp", "code")
    side = lambda who: g.select(F.col("sample").alias(who), "snp", F.col("code").alias(f"{who}_code"))
    joined = side("kid").join(trios, "kid").join(side("dad"), ["dad", "snp"]).join(side("mom"), ["mom", "snp"])
    cells = [
        count_if((F.col("dad_code") == i) & (F.col("mom_code") == j) & (F.col("kid_code") == k)).alias(f"N{i}{j}{k}")
        for i in range(4) for j in range(4) for k in range(4)
    ]
    return joined.groupBy("dad", "mom", "kid").agg(F.count(F.lit(1)).alias("total"), *cells)


def duplicate_table(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """16-cell table of each pair (id1, id2) of samples of one person."""
    g = panel.select("sample", "snp", "code")
    side = lambda who: g.select(F.col("sample").alias(who), "snp", F.col("code").alias(f"{who}_code"))
    joined = side("id1").join(pairs, "id1").join(side("id2"), ["id2", "snp"])
    cells = [count_if((F.col("id1_code") == i) & (F.col("id2_code") == j)).alias(f"N{i}{j}") for i in range(4) for j in range(4)]
    return joined.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("total"), *cells)


def mach_r2(dosages: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """AF, imputation r-squared and share of imperfect dosages of each site from (sample, snp, ds)."""
    d = F.col("ds")
    odd = ((d > tolerance) & (d < 1 - tolerance)) | ((d > 1 + tolerance) & (d < 2 - tolerance))
    out = dosages.groupBy("snp").agg(
        F.count(F.lit(1)).alias("n"), F.count(d).alias("k"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"), count_if(odd | d.isNull()).alias("odd")
    )
    s, ss, k = F.col("s"), F.col("ss"), F.nullif(F.col("k"), F.lit(0))
    return out.select(
        "snp", (s / (2 * k)).alias("af"),
        ((ss / k - s * s / (k * k)) / (s * (2 * k - s) / (2 * k * k) + 1e-20)).alias("r2"),
        (F.col("odd") / F.col("n")).alias("imperfect"),
    )


def pl_from_gt(panel: DataFrame, error_phred: int = 20) -> DataFrame:
    """PL of the three genotypes from a called one: error phred for each allele that differs; missing all zero."""
    dose = F.col("code") - 1
    pl = [F.when(F.col("code") == 0, F.lit(0)).otherwise(F.abs(dose - g) * error_phred).cast("int").alias(f"pl{g}") for g in range(3)]
    return panel.select("sample", "snp", *pl)


def _weights(af: Column) -> list[Column]:
    return [F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0) * p for g, p in enumerate(hwe(af))]


def pooled_af_em(pls: DataFrame, rounds: int = 10, ploidy: str | None = None, samples: int | None = None) -> DataFrame:
    """Allele frequency of each site by EM over genotype likelihoods (snp, sample, pl0, pl1, pl2), from one half.

    With a column of copies, samples of one copy count by the two homozygotes and
    once, those of none not at all.  Of ``samples`` in all (of two copies), those without
    a row have flat likelihoods.  Likelihoods of a site are gathered in sorted
    order as one array of small structs, so a round is an expression, not a shuffle.
    """
    copies = F.lit(2) if ploidy is None else F.col(ploidy)
    like = [F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0).alias(f"l{g}") for g in range(3)]
    own = pls.filter(copies > 0).groupBy("snp").agg(
        F.sort_array(F.collect_list(F.struct(*like, copies.cast("int").alias("c")))).alias("ls"), F.count(F.lit(1)).alias("n"), F.sum(copies).cast("long").alias("an")
    )
    if samples is not None:
        own = own.withColumns({"an": F.lit(2 * samples).cast("long"), "flat": F.lit(samples) - F.col("n"), "n": F.lit(samples).cast("long")})
    out = own.withColumn("af", F.lit(0.5))
    low = F.greatest(F.lit(1e-5), F.lit(0.5) / (2 * F.col("n") + 1))

    def share(x: Column, p: Column) -> Column:
        w0, w1, w2 = (x[f"l{g}"] * w for g, w in enumerate(hwe(p)))
        two = (w1 + 2 * w2) / (w0 + w1 + w2)
        if ploidy is None:
            return two
        return F.when(x["c"] == 1, x["l2"] * p / (x["l0"] * (1 - p) + x["l2"] * p)).otherwise(two)

    for _ in range(rounds):
        told = F.aggregate("ls", F.lit(0.0), lambda a, x: a + share(x, F.col("af")))
        new = (told if samples is None else told + 2 * F.col("flat") * F.col("af")) / F.col("an")
        out = out.withColumn("af", F.least(F.greatest(new, low), 1 - low))
    return out.select("snp", "n", "af")


def hwe_score(pls: DataFrame, afs: DataFrame, samples: int | None = None) -> DataFrame:
    """Score test against Hardy-Weinberg shares and inbreeding of each site; of ``samples`` in all, those without a row are flat."""
    a = F.col("af")
    joined = pls.join(afs.select("snp", "af"), "snp")
    like = [F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0) for g in range(3)]
    prior = hwe(a)
    total = like[0] * prior[0] + like[1] * prior[1] + like[2] * prior[2]
    u = a * (1 - a) * (like[0] - 2 * like[1] + like[2]) / total
    het = like[1] * prior[1] / total
    out = joined.groupBy("snp").agg(
        F.first("af").alias("af"), F.sum(u).alias("su"), F.sum(u * u).alias("suu"), F.sum(het).alias("het"), F.count(F.lit(1)).alias("n")
    )
    p0, p1, p2 = hwe(F.col("af"))
    if samples is not None:
        out = out.withColumn("het", F.col("het") + (F.lit(samples) - F.col("n")) * p1).withColumn("n", F.lit(samples).cast("long"))
    return out.select(
        "snp", "n", "af",
        (F.col("su") / F.sqrt(F.col("suu") + 1 / p0 + 4 / p1 + 1 / p2)).alias("z"),
        (1 - (F.col("het") + 1) / (2 * F.col("af") * (1 - F.col("af")) * F.col("n") + 1)).alias("f"),
    )


def best_guess(pls: DataFrame, afs: DataFrame) -> DataFrame:
    """Most likely genotype and its quality from PL and frequency; ties to fewer alternate alleles."""
    w = _weights(F.col("af"))
    joined = pls.join(afs.select("snp", "af"), "snp").select("sample", "snp", *[x.alias(f"w{g}") for g, x in enumerate(w)])
    total = F.col("w0") + F.col("w1") + F.col("w2")
    top = F.greatest("w0", "w1", "w2")
    guess = F.when(F.col("w0") == top, 0).when(F.col("w1") == top, 1).otherwise(2)
    wrong = F.greatest(1 - top / total, F.lit(1e-10))
    gq = F.least(F.floor(-10 * F.log10(wrong) + 1e-6), F.lit(255)).cast("int")
    return joined.select("sample", "snp", guess.cast("int").alias("gt"), gq.alias("gq"))


def join_sites(genotypes: DataFrame, sites: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Sites and genotypes by variant key; ``left`` keeps sites without a partner, ``left_semi`` selects."""
    return genotypes.join(sites, keys, how)


#: Positions are cut into bins of at least so many bases.
CHAIN_BIN = 1 << 16


def min_distance(sites: DataFrame, distance: int, order: str = "pos", bin_width: int = CHAIN_BIN) -> DataFrame:
    """Sites at least ``distance`` from the previous kept one of their chromosome, in order of position.

    Which sites are kept depends on all before them: they are a chain, from each the
    next one far enough away.  Bins of positions are walked apart: for every place at
    which a chain may come into a bin, the place at which it leaves to a later one.
    Steps from bin to bin are then doubled until the chains from the first sites
    are known at every bin (a number of joins that is logarithmic in the bins), and each
    bin is walked once more from where its chain comes in.  Sites without a chromosome
    or position are not kept.
    """
    kind = sites.schema["chrom"].dataType.simpleString()
    positions = sites.select("chrom", F.col(order).cast("long").alias("p")).dropna().distinct()
    if distance > 1:
        positions = _chained(positions, distance, max(bin_width, distance), kind)
    found = positions.select("chrom", F.col("p").cast(sites.schema[order].dataType).alias(order))
    return sites.join(found, ["chrom", order], "left_semi")


def _chained(positions: DataFrame, distance: int, width: int, kind: str) -> DataFrame:
    """(chrom, p) of the chains through distinct positions."""
    placed = cut(positions.withColumn("b", F.floor(F.col("p") / width)))
    # bins of a chromosome are bounded by its length, whatever the number of sites
    later = Window.partitionBy("chrom").orderBy("b")
    bins = placed.groupBy("chrom", "b").agg(F.min("p").alias("first"))
    bins = cut(bins.select("chrom", "b", "first", F.lead("first").over(later).alias("next"), F.lead("first", 2).over(later).alias("after")))
    # a bin's own sites, and as guests those of the next one, where a step from it may end
    guests = placed.select("chrom", "p", (F.col("b") - 1).alias("b"), F.lit(True).alias("guest"))
    both = placed.select("chrom", "p", "b", F.lit(False).alias("guest")).unionByName(guests.join(bins, ["chrom", "b"], "left_semi"))
    both = both.join(bins, ["chrom", "b"])

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows.loc[~rows["guest"], "p"].to_numpy())
        near = np.sort(rows.loc[rows["guest"], "p"].to_numpy())
        step = np.searchsorted(own, own + distance)
        last = np.where(step == len(own), np.arange(len(own)), np.minimum(step, len(own) - 1))
        while (last[last] != last).any():
            last = last[last]
        to = np.searchsorted(near, own[last] + distance)
        # beyond the next bin's sites: the first of the bin after it, or of the next one that has any
        far = rows["after"].iloc[0] if len(near) else rows["next"].iloc[0]
        ends = np.append(near, -1)[to].astype(float)
        ends[to == len(near)] = far
        out = pd.DataFrame({"chrom": rows["chrom"].iloc[0], "p": own, "to": pd.array(ends, "Float64").astype("Int64")})
        return out.dropna()

    leaves = cut(both.groupBy("chrom", "b").applyInPandas(leave, f"chrom {kind}, p long, to long"))
    starts = bins.groupBy("chrom").agg(F.min("first").alias("p"))
    entries = cut(leaves.select("chrom", F.col("to").alias("p")).unionAll(starts).distinct())
    jump = cut(leaves.join(entries, ["chrom", "p"], "left_semi"))  # only places where a chain may come in
    reached, n = cut(starts), -1
    while (now := reached.count()) != n:
        n = now
        onward = reached.join(jump, ["chrom", "p"]).select("chrom", F.col("to").alias("p"))
        reached = cut(reached.unionAll(onward).distinct())
        jump = cut(jump.join(jump.select("chrom", F.col("p").alias("to"), F.col("to").alias("_t")), ["chrom", "to"]).select("chrom", "p", F.col("_t").alias("to")))
    entered = reached.select("chrom", F.floor(F.col("p") / width).alias("b"), F.col("p").alias("entry"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows["p"].to_numpy())
        step = np.searchsorted(own, own + distance)
        keep, at = [], int(np.searchsorted(own, rows["entry"].iloc[0]))
        while at < len(own):
            keep.append(at)
            at = int(step[at])
        return pd.DataFrame({"chrom": rows["chrom"].iloc[0], "p": own[keep]})

    return placed.join(entered, ["chrom", "b"]).groupBy("chrom", "b").applyInPandas(walk, f"chrom {kind}, p long")


def gap_clusters(rows: DataFrame, gap: int, by: list[str], order: str) -> DataFrame:
    """``rows`` with ``cluster``: a new one starts where the step from the previous row is ``gap`` or more."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) >= gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn(
        "cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    ).drop("_new")


def likely_candidates(found: DataFrame, min_qual: float = 0.0, error: float = 0.01) -> DataFrame:
    """Candidates (qual, dp, ad) of enough quality whose alternate reads are no less likely at one half than at an error rate."""
    at = lambda p: scalar.log_binomial(F.col("dp"), F.col("ad"), p)
    return found.filter((F.col("qual") >= min_qual) & (F.col("ad") <= F.col("dp")) & (at(error) <= at(0.5)))


def merge_candidates(found: DataFrame, key: list[str], max_samples: int = 10) -> DataFrame:
    """Candidate variants over samples: best quality, support, a bounded sample of names, histograms of depth and, with ``ad``, of allele balance."""
    w = Window.partitionBy(*key).orderBy(F.xxhash64("sample"), "sample")
    ranked = found.withColumn("_r", F.row_number().over(w))
    bins = [count_if(F.least(F.floor(F.col("dp") / 5), F.lit(19)) == b).alias(f"dp_{b}") for b in range(20)]
    if "ad" in found.columns:
        balance = F.least(F.floor(F.col("ad") * 20 / F.greatest(F.col("dp"), F.lit(1))), F.lit(19))
        bins += [count_if(balance == b).alias(f"ab_{b}") for b in range(20)]
    out = ranked.groupBy(*key).agg(
        F.max("qual").alias("qual"), F.count(F.lit(1)).alias("n_samples"),
        F.sort_array(F.collect_list(F.when(F.col("_r") <= max_samples, F.col("sample")))).alias("samples"), *bins,
    )
    return out


def depth_ratio(sites: DataFrame, max_depth: int = 100) -> DataFrame:
    """Depth of X and Y relative to autosomes at the autosomes' GC make-up; sites are (kind, gc, dp)."""
    capped = sites.withColumn("dp", F.least("dp", F.lit(max_depth)))
    cells = capped.groupBy("kind", "gc").agg(F.sum("dp").cast("double").alias("dp"), F.count(F.lit(1)).cast("double").alias("n"))
    sums = capped.groupBy("kind").agg(F.count(F.lit(1)).cast("double").alias("total"), F.avg("dp").alias("mean"))
    shares = cells.join(sums, "kind").withColumn("share", F.col("n") / F.col("total"))
    auto = shares.filter("kind = 'A'").select("gc", F.col("share").alias("auto_share"), F.col("mean").alias("auto_mean"))
    return shares.filter("kind <> 'A'").join(auto, "gc").groupBy("kind").agg(
        F.sum(F.col("dp") / F.col("total") * F.col("auto_share") / F.col("share")).alias("depth"), F.first("auto_mean").alias("auto_depth"),
    ).withColumn("relative", F.col("depth") / F.col("auto_depth"))


#: Vectors of one block of a Gram matrix, at least and at most, and blocks up to which they are small.
GRAM_BLOCK, GRAM_LARGE, GRAM_BLOCKS = 512, 4096, 16
#: Pairs that a task holds at once.
GRAM_PAIRS = 1 << 18


def gram_matrix(vectors: DataFrame, by: str, value: str) -> DataFrame:
    """(i, j, dot): inner products of all pairs i <= j of rows (by, value array), in blocks.

    Rows are dealt over blocks by a hash and written down once, as they are stored; a
    pair of blocks reads what its two blocks left, so no copy for each partner is kept on disk.  A
    pair is multiplied in slices, so a task holds two blocks of vectors and ``GRAM_PAIRS`` pairs or so.
    """
    n = vectors.count()
    blocks = max(1, min(-(-n // GRAM_BLOCK), GRAM_BLOCKS), -(-n // GRAM_LARGE))
    block = F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int")
    rows = vectors.select(F.col(by).alias("id"), F.col(value).alias("v"), block.alias("b")).repartition(blocks, "b")
    held = rows.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("x"))
    one = held.select(F.col("b").alias("p"), F.col("x.id").alias("ids"), F.col("x.v").alias("left"))
    two = held.select(F.col("b").alias("q"), F.col("x.id").alias("others"), F.col("x.v").alias("right"))
    met = one.join(two.hint("shuffle_replicate_nl"), F.col("p") <= F.col("q"))
    kind = vectors.schema[by].dataType.simpleString()

    def matrix(x: pa.ListArray) -> np.ndarray:
        sizes = pc.list_value_length(x).unique()
        if len(sizes) != 1 or not sizes.is_valid().to_pylist()[0]:
            raise ValueError("vectors must have one length")
        return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, ids, left, q, others, right = (batch.column(c)[k] for c in ("p", "ids", "left", "q", "others", "right"))
                ids, others = (x.values.to_numpy(zero_copy_only=False) for x in (ids, others))
                left, right = matrix(left.values), matrix(right.values)
                step = max(1, GRAM_PAIRS // len(others))
                for at in range(0, len(ids), step):
                    dots = left[at : at + step] @ right.T
                    a, b = np.repeat(ids[at : at + step], len(others)), np.tile(others, len(dots))
                    keep = a <= b if p == q else np.ones(len(a), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.minimum(a, b), np.maximum(a, b), dots.ravel())], ["i", "j", "dot"])

    return met.mapInArrow(product, f"i {kind}, j {kind}, dot double")


def union_samples(*tables: DataFrame) -> DataFrame:
    """Samples of several files side by side: in the long form, their rows one after another."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def haplotype_blocks(genotypes: DataFrame, size: int = 8, common: float = 0.05) -> DataFrame:
    """(chrom, block, beg, end, haplotype, n, rare): haplotypes of blocks of ``size`` common variants, and their rare alternate alleles.

    ``genotypes`` are phased rows (chrom, pos, ref, alts, sample, a1, a2); a
    variant is common by the frequency of its alternate allele; ``rare`` counts
    alternate alleles of the others between a block's ends on such haplotypes.
    """
    sides = genotypes.filter(F.col("a1").isNotNull() & F.col("a2").isNotNull()).select(
        "chrom", "pos", "sample", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a1").alias("a")), F.struct(F.lit(1).alias("side"), F.col("a2").alias("a")))).alias("h")
    ).select("chrom", "pos", "sample", "h.side", (F.col("h.a") > 0).cast("int").alias("allele"))
    afs = sides.groupBy("chrom", "pos").agg(F.avg("allele").alias("af"))
    often = afs.filter(F.col("af").between(common, 1 - common))
    place = F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1
    often = often.withColumn("block", F.floor(place / size)).select("chrom", "pos", "block")
    ends = often.groupBy("chrom", "block").agg(F.min("pos").alias("beg"), F.max("pos").alias("end"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "allele")))
    words = sides.join(often, ["chrom", "pos"]).groupBy("chrom", "block", "sample", "side").agg(
        F.array_join(F.transform(rows, lambda x: x["allele"].cast("string")), "").alias("haplotype")
    )
    seldom = sides.filter("allele = 1").join(often, ["chrom", "pos"], "left_anti").join(ends, "chrom").filter(F.col("pos").between(F.col("beg"), F.col("end")))
    rare = seldom.groupBy("chrom", "block", "sample", "side").agg(F.count(F.lit(1)).alias("rare"))
    held = words.join(rare, ["chrom", "block", "sample", "side"], "left")
    out = held.groupBy("chrom", "block", "haplotype").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rare"), F.lit(0)).alias("rare"))
    return out.join(ends, ["chrom", "block"]).select("chrom", "block", "beg", "end", "haplotype", "n", "rare")
