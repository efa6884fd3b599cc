"""Phasing of whole chromosomes from genotypes: haplotypes of overlapping blocks by EM, joined along each sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Posteriors of haplotype pairs are compared to so many digits; ties go to the smaller haplotype.
TIE_DIGITS = 9
#: A block has at most so many sites: 3**8 patterns of genotypes, 2**8 haplotypes.
LONGEST_BLOCK = 8


def block_patterns(panel: DataFrame, size: int, overlap: int) -> DataFrame:
    """(sample, block, pattern, whole) of (sample, snp, code 1 to 3 by alternate alleles, else missing); snp counts sites from 0.

    Block b has the sites from b * (size - overlap) on.  A pattern has two bits a
    site; it is whole if the sample has a genotype at every site that any sample has.
    """
    if not 0 <= overlap <= size // 2 or not 1 <= size <= LONGEST_BLOCK:
        raise ValueError(f"blocks have 1 to {LONGEST_BLOCK} sites and overlap by half of them at most")
    step = size - overlap
    first = F.floor(F.col("snp") / step).cast("long")
    # the sites of an overlap lie in two blocks
    blocks = F.when((F.col("snp") % step < overlap) & (first > 0), F.array(first, first - 1)).otherwise(F.array(first))
    rows = panel.filter("code between 1 and 3").select("sample", "snp", "code", F.explode(blocks).alias("block"))
    place = (F.col("snp") - F.col("block") * step).cast("int")
    rows = rows.groupBy("sample", "block", place.alias("place")).agg(F.max("code").alias("code"))
    shifted = lambda value: F.expr(f"sum(shiftleft(cast({value} as long), 2 * place))")
    own = rows.groupBy("sample", "block").agg(shifted("code").alias("pattern"), shifted("1").alias("has"))
    sites = own.groupBy("block").agg(F.bit_or("has").alias("all"))
    return own.join(sites, "block").select("sample", "block", "pattern", (F.col("has") == F.col("all")).alias("whole"))


def _pairs(pattern: int) -> tuple[np.ndarray, np.ndarray]:
    """Haplotype pairs (one <= two) of a pattern of genotypes, each once."""
    base, hets = 0, []
    for place in range(LONGEST_BLOCK):
        code = pattern >> 2 * place & 3
        if code == 3:
            base |= 1 << place
        elif code == 2:
            hets.append(place)
    # the last heterozygous site is the alternate allele of the second haplotype
    free = hets[:-1]
    picks = np.arange(1 << len(free))
    one = np.full(len(picks), base)
    for i, place in enumerate(free):
        one |= (picks >> i & 1) << place
    every = sum(1 << place for place in hets)
    return one, one ^ every


def haplotype_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 20, enough: float = 1e-8) -> tuple[np.ndarray, pd.DataFrame]:
    """Haplotype frequencies of one block, and the best pair of each pattern with its posterior.

    Samples of equal genotypes are one row with their number.
    """
    parts = [_pairs(int(p)) for p in patterns]
    owner = np.repeat(np.arange(len(parts)), [len(a) for a, _ in parts])
    one, two = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    freq = np.full(1 << LONGEST_BLOCK, 1 / (1 << LONGEST_BLOCK))

    def posterior(freq: np.ndarray) -> np.ndarray:
        w = freq[one] * freq[two]
        total = np.bincount(owner, w, len(parts))[owner]
        even = 1 / np.bincount(owner, minlength=len(parts))[owner]
        return np.where(total > 0, w / np.where(total > 0, total, 1), even)

    for _ in range(rounds):
        w = posterior(freq) * counts[owner]
        new = np.bincount(one, w, len(freq)) + np.bincount(two, w, len(freq))
        new /= new.sum()
        moved, freq = np.abs(new - freq).sum(), new
        if moved < enough:
            break
    w = posterior(freq)
    table = pd.DataFrame({"owner": owner, "one": one, "two": two, "p": w, "order": -np.round(w, TIE_DIGITS)})
    best = table.sort_values(["owner", "order", "one"]).drop_duplicates("owner")
    return freq, pd.DataFrame({"pattern": patterns[best["owner"]], "one": best["one"].to_numpy(), "two": best["two"].to_numpy(), "p": best["p"].to_numpy()})


def block_haplotypes(patterns: DataFrame, rounds: int = 20, enough: float = 1e-8) -> DataFrame:
    """(sample, block, one, two, p): each sample's most likely haplotype pair in each block where it is whole.

    Samples are counted by pattern first, so a block is at most 3**size rows for
    its task, whatever the number of samples.
    """
    whole = patterns.filter("whole").select("sample", "block", "pattern")
    counted = whole.groupBy("block", "pattern").agg(F.count(F.lit(1)).alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pattern")
        _, best = haplotype_em(rows["pattern"].to_numpy(), rows["n"].to_numpy(np.float64), rounds, enough)
        return best.assign(block=rows["block"].iloc[0])[["block", "pattern", "one", "two", "p"]]

    best = counted.groupBy("block").applyInPandas(fit, "block long, pattern long, one int, two int, p double")
    return whole.join(best, ["block", "pattern"]).select("sample", "block", "one", "two", "p")


def joined_blocks(haplotypes: DataFrame, size: int, overlap: int) -> DataFrame:
    """(sample, block, one, two, p, phase_set), each pair turned so that it agrees with the block before it in its phase set.

    Two blocks agree or are turned by what most of the heterozygous sites say that
    both have; where none or as many say either, or a block is missing, a new phase
    set starts, named by its first block.  Turns along a chain multiply: running
    sums of signs in place of a walk.
    """
    step, shared = size - overlap, (1 << overlap) - 1
    along = Window.partitionBy("sample").orderBy("block")
    before = lambda c: F.lag(c).over(along)
    end = F.shiftright(before("one"), step).bitwiseAND(shared)
    het = F.col("one").bitwiseXOR(F.col("two")).bitwiseAND(shared)
    differ = F.bit_count(end.bitwiseXOR(F.col("one")).bitwiseAND(het))
    # above zero: agree; below: turned; zero or null: unknown
    vote = F.when(before("block") == F.col("block") - 1, F.bit_count(het) - 2 * differ)
    rows = haplotypes.withColumn("_v", F.coalesce(vote, F.lit(0)))
    rows = rows.withColumn("_start", F.last(F.when(F.col("_v") == 0, F.col("block")), True).over(along))
    turns = F.sum((F.col("_v") < 0).cast("int")).over(Window.partitionBy("sample", "_start").orderBy("block"))
    turned = turns % 2 == 1
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return rows.select("sample", "block", pick("one", "two").alias("one"), pick("two", "one").alias("two"), "p", F.col("_start").alias("phase_set"))


def phased(panel: DataFrame, size: int = 8, overlap: int = 4, rounds: int = 20, enough: float = 1e-8) -> DataFrame:
    """(sample, snp, code, a1, a2, phase_set) of every genotype: alleles by haplotype, comparable within a sample's phase set.

    Genotypes in blocks where the sample is not whole keep null alleles if
    heterozygous, and no phase set; missing genotypes (codes other than 1 to 3) are
    no rows.  Repeated genotypes of a sample at a site count as the largest.
    """
    step = size - overlap
    chains = joined_blocks(block_haplotypes(block_patterns(panel, size, overlap), rounds, enough), size, overlap)
    rows = panel.filter("code between 1 and 3").groupBy("sample", "snp").agg(F.max("code").alias("code"))
    rows = rows.withColumn("block", F.floor(F.col("snp") / step).cast("long")).join(chains, ["sample", "block"], "left")
    bit = lambda c: F.expr(f"cast(shiftright({c}, cast(snp - block * {step} as int)) & 1 as int)")
    same = F.when(F.col("code") != 2, F.when(F.col("code") == 3, 1).otherwise(0))
    return rows.select("sample", "snp", "code", F.coalesce(same, bit("one")).alias("a1"), F.coalesce(same, bit("two")).alias("a2"), "phase_set")
