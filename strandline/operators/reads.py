"""Aligned reads: flags, CIGAR, barcodes, fragments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CIGAR_OP = "([0-9]+)([MIDNSHP=X])"


def read_filter(reads: DataFrame, exclude_flag: int = 0xF04, min_mapq: int = 0) -> DataFrame:
    keep = F.col("flag").bitwiseAND(exclude_flag) == 0
    return reads.filter(keep & (F.col("mapq") >= min_mapq) if "mapq" in reads.columns else keep)


def flag_lattice(reads: DataFrame) -> DataFrame:
    """Read counts by flag, and by flag OR mask for every mask over the bits that take both values.

    The counts by flag are at most 4096 rows; only these are spread over masks.
    """
    counts = reads.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    both, every = counts.agg(F.bit_or("flag"), F.bit_and("flag")).first() or (0, 0)
    varying = [b for b in range(12) if ((both or 0) & ~(every or 0)) >> b & 1]
    masks = [sum(1 << b for i, b in enumerate(varying) if m >> i & 1) for m in range(1 << len(varying))]
    spread = counts.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    return spread.groupBy("mask", F.col("flag").bitwiseOR(F.col("mask")).alias("masked")).agg(F.sum("n").cast("long").alias("reads"))


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op, read offset, reference offset) of a CIGAR string."""
    lengths, ops = F.regexp_extract_all(cigar, F.lit(CIGAR_OP), F.lit(1)), F.regexp_extract_all(cigar, F.lit(CIGAR_OP), F.lit(2))
    pairs = F.zip_with(lengths, ops, lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")))
    start = F.struct(
        F.lit(0).alias("q"), F.lit(0).alias("r"),
        F.array().cast("array<struct<n:int,op:string,q:int,r:int>>").alias("out"),
    )
    walk = F.aggregate(
        pairs, start,
        lambda s, p: F.struct(
            (s["q"] + F.when(p["op"].isin("M", "I", "S", "=", "X"), p["n"]).otherwise(0)).alias("q"),
            (s["r"] + F.when(p["op"].isin("M", "D", "N", "=", "X"), p["n"]).otherwise(0)).alias("r"),
            F.concat(s["out"], F.array(F.struct(p["n"].alias("n"), p["op"].alias("op"), s["q"].alias("q"), s["r"].alias("r")))).alias("out"),
        ),
    )
    return walk["out"]


def aligned_length(cigar: Column) -> Column:
    """Reference bases that an alignment spans."""
    return F.aggregate(
        cigar_ops(cigar), F.lit(0), lambda a, o: a + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(0)
    )


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """One row per stretch of aligned bases of each read: beg and end on the reference, closed."""
    spread = reads.withColumn("_o", F.explode(cigar_ops(F.col("cigar")))).filter(F.col("_o.op").isin("M", "=", "X"))
    return spread.withColumn("beg", F.col("pos") + F.col("_o.r")).withColumn("end", F.col("beg") + F.col("_o.n") - 1).drop("_o")


def base_at(reads: DataFrame, variants: DataFrame, width: int = 1000) -> DataFrame:
    """Bases and qualities of reads at variant positions inside their aligned blocks.

    Blocks are dealt into bins and joined by (chrom, bin); deleted and skipped
    bases give no row.
    """
    blocks = aligned_blocks_with_offset(reads)
    spans = blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end") / width))))
    sites = variants.withColumnRenamed("pos", "site").withColumn("_bin", F.floor(F.col("site") / width))
    hit = spans.join(sites, ["chrom", "_bin"]).filter((F.col("site") >= F.col("beg")) & (F.col("site") <= F.col("end")))
    at = (F.col("_q") + F.col("site") - F.col("beg") + 1).cast("int")
    hit = hit.withColumn("read_pos", at).withColumn("base", F.substring("seq", F.col("read_pos"), F.lit(1)))
    hit = hit.withColumn("bq", F.ascii(F.substring("qual", F.col("read_pos"), F.lit(1))) - 33)
    return hit.drop("_bin", "_q", "beg", "end")


def aligned_blocks_with_offset(reads: DataFrame) -> DataFrame:
    spread = reads.withColumn("_o", F.explode(cigar_ops(F.col("cigar")))).filter(F.col("_o.op").isin("M", "=", "X"))
    return (
        spread.withColumn("beg", F.col("pos") + F.col("_o.r")).withColumn("end", F.col("beg") + F.col("_o.n") - 1)
        .withColumn("_q", F.col("_o.q")).drop("_o")
    )


def usable_bases(bases: DataFrame, min_bq: int = 13, cap_bq: int = 40, min_from_end: int = 0) -> DataFrame:
    """Known bases of enough quality and distance from both ends of the read; qualities capped."""
    inner = (F.col("read_pos") > min_from_end) & (F.length("seq") - F.col("read_pos") >= min_from_end)
    good = (F.col("base") != "N") & (F.col("bq") >= min_bq) & inner
    return bases.filter(good).withColumn("bq", F.least("bq", F.lit(cap_bq)))


def sound_cigar(cigar: Column) -> Column:
    """M present, I and D between M, clips at the ends only."""
    return cigar.rlike(r"^(?:\d+H)?(?:\d+S)?(?:\d+[M=X](?:\d+[IDN](?=\d+[M=X]))?)+(?:\d+S)?(?:\d+H)?$")


def barcode_from_name(name: Column) -> tuple[Column, Column]:
    """Cell barcode and UMI: the last two fields of a read name between colons."""
    part = F.split(name, ":")
    return F.upper(F.try_element_at(part, F.lit(-2))), F.try_element_at(part, F.lit(-1))


def mix_barcodes(reads: DataFrame, pairs: DataFrame, unit: Column, drop_other: bool = False) -> DataFrame:
    """Artificial doublets: reads of paired barcodes go to ``min.max`` with the barcode's share by hashed UMI, else to ``max.min``."""
    both = pairs.select(F.col("barcode1").alias("barcode"), F.col("barcode2").alias("_o"), F.col("alpha").alias("_s")).unionAll(
        pairs.select("barcode2", "barcode1", "beta")
    )
    joined = reads.join(both, "barcode", "left").withColumn("_u", unit)
    low, high = F.least("barcode", "_o"), F.greatest("barcode", "_o")
    new = F.when(F.col("_o").isNull(), F.col("barcode")).when(F.col("_u") < F.col("_s"), F.concat_ws(".", low, high))
    if not drop_other:
        new = new.otherwise(F.concat_ws(".", high, low))
    return joined.withColumn("barcode", new).filter(F.col("barcode").isNotNull()).drop("_o", "_s", "_u")


def procap_ends(reads: DataFrame) -> DataFrame:
    """Distinct UMIs and reads at each 5' end by strand."""
    five = F.when(F.col("fwd"), F.col("beg")).otherwise(F.col("end"))
    return reads.withColumn("five", five).groupBy("chrom", "fwd", "five").agg(
        F.count_distinct("umi").alias("umis"), F.count(F.lit(1)).alias("reads")
    )


def local_peaks(ends: DataFrame, reach: int) -> DataFrame:
    """Ends (chrom, pos, n) that no other within ``reach`` exceeds, with ``w``: counts around weighted by nearness, reach + 1 - distance.

    Each end counts at every place around it, so an aggregate of the spread
    counts takes the place of a range join.
    """
    spread = ends.select("chrom", "n", "pos", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("at"))
    near = spread.groupBy("chrom", F.col("at").alias("pos")).agg(
        F.sum(F.col("n") * (reach + 1 - F.abs(F.col("pos") - F.col("at")))).cast("long").alias("w"), F.max("n").alias("top")
    )
    return ends.join(near, ["chrom", "pos"]).filter("n = top").select("chrom", "pos", "n", "w")


def pair_peaks(plus: DataFrame, minus: DataFrame, reach: int) -> DataFrame:
    """Pairs of peaks (chrom, pos, w) on opposite strands, minus before plus within ``reach``: each is the other's strongest partner.

    Ties go to the nearer, then to the smaller position.
    """
    a = plus.select("chrom", F.col("pos").alias("plus"), F.col("w").alias("plus_w"), F.explode(F.sequence(F.floor((F.col("pos") - reach) / reach), F.floor(F.col("pos") / reach))).alias("_bin"))
    b = minus.select("chrom", F.col("pos").alias("minus"), F.col("w").alias("minus_w"), F.floor(F.col("pos") / reach).alias("_bin"))
    met = a.join(b, ["chrom", "_bin"]).filter((F.col("minus") <= F.col("plus")) & (F.col("plus") - F.col("minus") <= reach)).drop("_bin")
    far = F.col("plus") - F.col("minus")
    of_plus = met.groupBy("chrom", "plus").agg(F.min_by("minus", F.struct((-F.col("minus_w")).alias("w"), far.alias("d"), "minus")).alias("minus"))
    of_minus = met.groupBy("chrom", "minus").agg(F.min_by("plus", F.struct((-F.col("plus_w")).alias("w"), far.alias("d"), "plus")).alias("plus"))
    return of_plus.join(of_minus, ["chrom", "plus", "minus"])


def merge_mates(one: DataFrame, two: DataFrame, order: list[str]) -> DataFrame:
    """Reads of two files in one order, with ``mate`` 1 or 2."""
    return one.withColumn("mate", F.lit(1)).unionByName(two.withColumn("mate", F.lit(2))).orderBy(*order, "mate")


def merge_read_groups(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Read groups renamed by (rg, keep); others stay.

    ``groups`` has a row for each read group of a header, so every task holds it: dealt
    by read group, a task would take all reads of one.
    """
    return reads.join(F.broadcast(groups), "rg", "left").withColumn("rg", F.coalesce("keep", "rg")).drop("keep")


def augmented_ops(cigar: str, md: str | None, seq: str, qual: str) -> list[tuple[int, str, str, str]]:
    """(length, op, reference, read) of an alignment with M cut into = and X by its MD text.

    Stretches of equal bases carry no reference text but that of the read.
    """
    steps: list[tuple[str, str]] = []  # (op, reference base) of every aligned or deleted base
    for number, gone, base in re.findall(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])", md or ""):
        if number:
            steps += [("=", "")] * int(number)
        elif gone:
            steps += [("D", b) for b in gone]
        else:
            steps.append(("X", base))
    out: list[tuple[int, str, str, str]] = []
    q = at = 0
    for n, op in ((int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            done = 0
            while done < n:
                kind = steps[at][0] if at < len(steps) else "="
                end = done
                while end < n and (steps[at + end - done][0] if at + end - done < len(steps) else "=") == kind:
                    end += 1
                read = seq[q : q + end - done]
                ref = "".join(steps[at + i][1] for i in range(end - done)) if kind == "X" else read
                out.append((end - done, kind, ref, read))
                q += end - done
                at += end - done
                done = end
        elif op == "D":
            out.append((n, "D", "".join(b for _, b in steps[at : at + n]), ""))
            at += n
        else:
            read = seq[q : q + n] if op in "IS" else ""
            out.append((n, op, "", read))
            q += n if op in "IS" else 0
    return out


def augmented(reads: DataFrame, min_bq: int = 20) -> DataFrame:
    """``reads`` with ``ops`` (length, op, reference, read) and ``mismatches``: differing bases of enough quality, each insertion and deletion one."""
    @F.pandas_udf("ops array<struct<len:int,op:string,ref:string,read:string>>, mismatches int")
    def walk(cigar: pd.Series, md: pd.Series, seq: pd.Series, qual: pd.Series) -> pd.DataFrame:
        rows = []
        for c, m, s, b in zip(cigar, md, seq, qual):
            ops, found, q = augmented_ops(c or "", m, s or "", b or ""), 0, 0
            for n, op, _, read in ops:
                if op == "X":
                    found += sum(ord(x) - 33 >= min_bq for x in (b or "")[q : q + n])
                found += op in "ID"
                q += len(read)
            rows.append(([{"len": n, "op": o, "ref": r, "read": t} for n, o, r, t in ops], found))
        return pd.DataFrame(rows, columns=["ops", "mismatches"])

    out = reads.withColumn("_w", walk("cigar", F.col("tags")["MD"], "seq", "qual"))
    return out.withColumn("ops", F.col("_w.ops")).withColumn("mismatches", F.col("_w.mismatches")).drop("_w")
