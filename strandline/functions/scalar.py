"""Scalar functions as Columns: phred, genotype codes, hashes, regions, priors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash of strings: h = h * 101 + c modulo 2^32.
HASH_FACTOR = 101
HASH_MODULUS = 1 << 32
#: Below this quality a base is taken as one of four at random.
LEAST_PHRED = 1


def error_of(q: Column) -> Column:
    """Error probability of a phred score; 0.75 for scores of one or less."""
    return F.when(q <= LEAST_PHRED, F.lit(0.75)).otherwise(F.pow(F.lit(10.0), -q / F.lit(10.0)))


def phred_of(err: Column) -> Column:
    """Phred score of an error probability, rounded, 0 to 255."""
    safe = F.when(err <= 0, F.lit(255.0)).otherwise(-10 * F.log10(F.when(err > 0, err).otherwise(F.lit(1.0))))
    return F.least(F.greatest(F.floor(safe + 0.5), F.lit(0)), F.lit(255)).cast("int")


def genotype_index(a1: Column, a2: Column) -> Column:
    """Place of an unordered genotype in PL and GP vectors."""
    high, low = F.greatest(a1, a2), F.least(a1, a2)
    return (F.floor(high * (high + 1) / 2) + low).cast("int")


def hwe(af: Column) -> list[Column]:
    """Hardy-Weinberg shares of 0, 1 and 2 alternate alleles."""
    return [(1 - af) * (1 - af), 2 * af * (1 - af), af * af]


def string_hash(text: Column, seed: int = 0) -> Column:
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h * HASH_FACTOR + c) % HASH_MODULUS)


def unit_hash(text: Column, seed: int = 0) -> Column:
    """Deterministic number in (0, 1) of a string, for sampling by name."""
    return (string_hash(text, seed) % 65535 + 0.5) / 65535


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array; null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def parse_region(text: Column) -> Column:
    """struct(chrom, beg, end), 1-based and closed; a single position is one base, no position the whole chromosome."""
    pattern = r"^([^:]+)(?::([0-9,]+)(?:-([0-9,]+))?)?$"
    number = lambda g: F.expr("1") * F.nullif(F.replace(F.regexp_extract(text, pattern, g), F.lit(","), F.lit("")), F.lit("")).cast("int")
    beg, end = number(2), number(3)
    return F.struct(
        F.regexp_extract(text, pattern, 1).alias("chrom"),
        F.coalesce(beg, F.lit(1)).cast("int").alias("beg"),
        F.coalesce(end, beg, F.lit((1 << 29) - 1)).cast("int").alias("end"),
    )


def variant_id(chrom: Column, pos: Column, ref: Column, alts: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, F.array_join(alts, ","))


def parse_variant_id(text: Column) -> Column:
    part = F.split(text, ":")
    return F.struct(
        F.get(part, F.lit(0)).alias("chrom"), F.get(part, F.lit(1)).cast("int").alias("pos"),
        F.get(part, F.lit(2)).alias("ref"), F.split(F.get(part, F.lit(3)), ",").alias("alts"),
    )


def attribute(text: Column, name: str) -> Column:
    """Value of a GTF attribute, quoted or not; null if absent."""
    found = F.regexp_extract(text, rf'(?:^|;\s*){name}\s+"?([^";]*)"?', 1)
    return F.when(found != "", found)


def chrom_rank(chrom: Column) -> Column:
    """Sort key: numbered chromosomes by number, then names."""
    number = F.regexp_extract(chrom, r"^(?:chr)?([0-9]+)$", 1)
    return F.struct(F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(1 << 30)).alias("n"), chrom.alias("name"))


def clean_sequence(text: Column) -> Column:
    """Upper case; anything but A, C, G, T becomes A."""
    return F.regexp_replace(F.translate(text, "acgt", "ACGT"), "[^ACGT]", "A")


def reverse_complement(text: Column) -> Column:
    return F.reverse(F.translate(F.upper(text), "ACGT", "TGCA"))


def ploidy(chrom: Column, pos: Column, male: Column, x_start: int = 2699520, x_end: int = 154931044) -> Column:
    """Copies of a position in a sample: autosome 2; X outside the pseudo-autosomal ends, Y and MT by sex."""
    name = F.regexp_replace(chrom, "^chr", "")
    inner = (pos >= x_start) & (pos <= x_end)
    return (
        F.when((name == "X") & inner, F.when(male, 1).otherwise(2))
        .when(name == "Y", F.when(male, 1).otherwise(0))
        .when(name.isin("MT", "M"), F.lit(1))
        .otherwise(2)
    )


def chrom_kind(chrom: Column, pos: Column, x_start: int = 2699520, x_end: int = 154931044) -> Column:
    """A for numbered chromosomes, X inside its own part, Y; null for others and for the ends that X shares with Y."""
    name = F.regexp_replace(chrom, "^chr", "")
    return F.when(name.rlike("^[0-9]+$"), "A").when((name == "X") & (pos >= x_start) & (pos <= x_end), "X").when(name == "Y", "Y")


def log_factorial(n: Column, table: int) -> Column:
    """ln n!: from a table up to ``table``, beyond it by Stirling's series."""
    sums, values = 0.0, [0.0]
    for i in range(1, table + 1):
        sums += math.log(i)
        values.append(sums)
    x = n.cast("double")
    far = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= table, F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))).otherwise(far)


def log_binomial(n: Column, k: Column, p: float, table: int = 128) -> Column:
    """ln of the probability of ``k`` successes in ``n`` draws."""
    choose = log_factorial(n, table) - log_factorial(k, table) - log_factorial(n - k, table)
    return choose + k * math.log(p) + (n - k) * math.log(1 - p)


def classify_variant(ref: Column, alt: Column) -> Column:
    """SNP, MNP, INDEL, CLUMPED, VNTR or SV of one pair of alleles, after trimming shared ends.

    The longer allele keeps one shared leading base if trimming empties the other.
    """
    symbolic = alt.rlike("^<")
    tandem = alt.rlike("^<(VN|STR)")
    same = F.length(ref) == F.length(alt)
    trimmed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(ref), F.length(alt))),
        F.struct(ref.alias("r"), alt.alias("a")),
        lambda s, _: F.when(
            (F.length(s["r"]) > 1) & (F.length(s["a"]) > 1) & (F.right(s["r"], F.lit(1)) == F.right(s["a"], F.lit(1))),
            F.struct(F.left(s["r"], F.length(s["r"]) - 1).alias("r"), F.left(s["a"], F.length(s["a"]) - 1).alias("a")),
        )
        .when(
            (F.length(s["r"]) > 1) & (F.length(s["a"]) > 1) & (F.left(s["r"], F.lit(1)) == F.left(s["a"], F.lit(1))),
            F.struct(F.substring(s["r"], F.lit(2), F.length(s["r"])).alias("r"), F.substring(s["a"], F.lit(2), F.length(s["a"])).alias("a")),
        )
        .otherwise(s),
    )
    r, a = trimmed["r"], trimmed["a"]
    return (
        F.when(tandem, "VNTR").when(symbolic, "SV").when(ref == alt, "REF")
        .when(same & (F.length(r) == 1), "SNP").when(same, "MNP")
        .when((F.left(r, F.lit(1)) == F.left(a, F.lit(1))) & (F.least(F.length(r), F.length(a)) == 1), "INDEL")
        .otherwise("CLUMPED")
    )


#: Substitutions between bases of one chemical class.
TRANSITIONS = ("AG", "GA", "CT", "TC")


def change_kind(ref: Column, alt: Column) -> Column:
    """ts or tv of a SNP, ins or del of an INDEL; null for others."""
    kind = classify_variant(ref, alt)
    apart = F.filter(F.zip_with(F.split(ref, ""), F.split(alt, ""), lambda a, b: F.concat(a, b)), lambda x: (F.length(x) == 2) & (F.left(x, F.lit(1)) != F.right(x, F.lit(1))))
    return (
        F.when((kind == "SNP") & F.upper(F.get(apart, F.lit(0))).isin(*TRANSITIONS), "ts").when(kind == "SNP", "tv")
        .when((kind == "INDEL") & (F.length(alt) > F.length(ref)), "ins").when(kind == "INDEL", "del")
    )
