"""Molecules counted over gene models: exons, their transcripts, their genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import overlap_join, overlapped_names
from strandline.operators.lineage import cut

UNIQUE_BIN = 1_000_000_000
#: Numbers of transcripts met at all places that are sent to every task, at most.
MET_SMALL = 1 << 21


def element_umis(fragments: DataFrame, elements: DataFrame, unique_bin: int = UNIQUE_BIN, whole: bool = False, width: int = 10_000) -> DataFrame:
    """(level, element, cell, umis) of molecules (cell, umi, chrom, strand, beg, end; a row for each aligned stretch) on gene models.

    A molecule hits every exon of its strand that one of its stretches overlaps, the
    exons' transcripts, and their genes; each counts it once.  Of genes that it hits
    whose middles lie in one bin (``unique_bin`` over two bases), the smallest identifier counts.
    With ``whole``, a transcript counts only if each of the molecule's stretches overlaps an
    exon of it, and with it its exons and gene.

    The work does not grow with the pairs of stretches and exons.  Exons of a transcript
    and gene are merged, and a place finds the numbers of those it meets, as one array, once for all
    stretches that lie there.  A molecule is one row with the arrays of its stretches, never a row for each
    transcript; those that meet alike are counted before they are told apart by transcript and gene.  An exon counts a molecule at the first of its stretches that overlaps
    it, so stretches that lie alike, whatever their molecules, meet exons as one row with a count.
    """
    exons = elements.filter((F.col("type") == "exon") & F.col("transcript_id").isNotNull()).select(
        "chrom", "strand", "beg", "end", F.col("transcript_id").alias("tx"), F.col("gene_id").alias("gene"),
        F.concat_ws(":", "transcript_id", "chrom", F.concat_ws("-", "beg", "end")).alias("exon"),
    ).distinct()
    longest = exons.agg(F.max(F.col("end") - F.col("beg"))).first()[0] or 0
    near = max(1, min(width, longest + 1))
    # one row a transcript, or a gene, so one task numbers them; genes in the order of their names
    units = exons.select("tx", "gene").distinct()
    units = units.withColumn("u", F.row_number().over(Window.orderBy("tx", "gene"))).withColumn("t", F.min("u").over(Window.partitionBy("tx")))
    units = cut(units.withColumn("g", F.when(F.col("gene").isNotNull(), F.dense_rank().over(Window.orderBy(F.col("gene").asc_nulls_last())))))
    numbered = exons.join(units, exons["tx"].eqNullSafe(units["tx"]) & exons["gene"].eqNullSafe(units["gene"]))
    # transcript and gene as one number, so that no table of names need meet the pairs
    numbered = numbered.select("chrom", "strand", "beg", "end", (F.shiftleft(F.col("t").cast("long"), 32) + F.coalesce("g", F.lit(0))).alias("u"))
    place = ["chrom", "strand", "beg", "end"]
    none = F.array().cast("array<bigint>")
    tx_of = lambda us: F.array_distinct(F.transform(us, lambda u: F.shiftright(u, 32).cast("int")))
    met = overlapped_names(fragments.select(*place).distinct(), numbered, ["chrom", "strand"], ["u"], near)
    met = cut(met.groupBy(*place).agg(F.array_distinct(F.flatten(F.collect_list("met.u"))).alias("us")))
    # what a transcript's presence is told by: all its numbers, where it is of several genes
    told = "us"
    if whole and not (several := cut(units.groupBy("t").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1"))).isEmpty():
        told = "all"
        codes = units.select("t", (F.shiftleft(F.col("t").cast("long"), 32) + F.coalesce("g", F.lit(0))).alias("c"))
        more = met.select(*place, F.explode(tx_of(F.col("us"))).alias("t")).join(codes.join(several, "t", "left_semi"), "t")
        more = more.groupBy(*place).agg(F.collect_list("c").alias("more"))
        met = cut(met.join(more, place, "left").select(*place, "us", F.array_union("us", F.coalesce("more", none)).alias("all")))
    if (met.agg(F.sum(F.size(told))).first()[0] or 0) <= MET_SMALL:
        met = F.broadcast(met)
    # outer forms of explode below: for the others Spark works out the arrays twice, to see which are empty
    # dealt by molecule once: what follows up to the counts of like rows stays in its task
    stretches = fragments.select("cell", "umi", *place).repartition("cell", "umi").distinct()
    first = F.max("end").over(Window.partitionBy("cell", "umi", "chrom", "strand").orderBy("beg", "end").rowsBetween(Window.unboundedPreceding, -1))
    before = stretches.withColumn("_before", first)
    arrays = list({"us": 0, told: 0})
    held = before.join(met, place, "left").withColumns({x: F.coalesce(x, none) for x in arrays})
    held = held.groupBy("cell", "umi").agg(F.collect_list(F.struct(*place, "_before", *arrays)).alias("own"))
    found = F.array_distinct(F.flatten("own.us"))
    if whole:
        in_all = F.reduce(f"own.{told}", F.get(f"own.{told}", F.lit(0)), F.array_intersect)
        found = F.array_intersect(in_all, F.flatten("own.us")) if told == "all" else in_all
    held = held.withColumn("us", F.sort_array(found))
    alone, by = before, []
    if whole:
        spread = F.inline_outer(F.transform("own", lambda x: F.struct(*[x[c].alias(c) for c in (*place, "_before")])))
        alone, by = held.withColumn("ts", tx_of(F.col("us"))).select("cell", "umi", "ts", spread), ["t"]
    alone = alone.filter("_before IS NULL OR _before < end")
    # what ended too far before matters to no exon
    shape = alone.withColumn("_before", F.when(F.col("_before") >= F.col("beg") - longest, F.col("_before")))
    like = ["cell", *place, "_before"]
    alike = shape.groupBy(*like, *(["ts"] if whole else [])).agg(F.count(F.lit(1)).alias("_n"))
    if whole:
        # like stretches of molecules with like transcripts are one row before they are a row for each transcript
        alike = alike.withColumn("t", F.explode_outer("ts")).filter("t IS NOT NULL").groupBy("t", *like).agg(F.sum("_n").alias("_n"))
    names = exons.join(units.select("tx", "t").distinct(), "tx").select("t", *place, "exon").distinct()
    places = names.select(*by, *place).distinct()
    at = overlap_join(alike, places, [*by, "chrom", "strand"], near).filter("_before IS NULL OR _before < beg2")
    at = at.groupBy(*by, "chrom", "strand", F.col("beg2").alias("beg"), F.col("end2").alias("end"), "cell").agg(F.sum("_n").alias("umis"))
    # a name on both strands counts a molecule once: those few are counted by sets
    odd = names.groupBy("exon").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("exon")
    once = at.join(names.join(odd, "exon", "left_anti"), [*by, *place]).select(F.lit("exon").alias("level"), F.col("exon").alias("element"), "cell", "umis")
    twice = cut(names.join(odd, "exon", "left_semi"))
    # molecules that meet alike count as one row with a number
    sets = held.groupBy("cell", "us").agg(F.count(F.lit(1)).alias("_n"))
    tx = sets.select("cell", "_n", F.explode_outer(tx_of(F.col("us"))).alias("t")).filter("t IS NOT NULL").groupBy("t", "cell").agg(F.sum("_n").alias("umis"))
    tx = tx.join(units.select("tx", "t").distinct(), "t").select(F.lit("transcript").alias("level"), F.col("tx").alias("element"), "cell", "umis")
    middles = elements.filter(F.col("gene_id").isNotNull()).groupBy(F.col("gene_id").alias("gene"), F.col("chrom").alias("_c")).agg(
        ((F.min("beg") + F.max("end")) / max(unique_bin // 2, 1)).cast("long").alias("_bin")
    )
    genes = units.filter("g IS NOT NULL").select("gene", "g").distinct()
    # genes are few, as they were numbered in one task: the bins of gene g stand at g - 1 of one array
    spots = middles.select("_c", "_bin").distinct().withColumn("_k", F.row_number().over(Window.orderBy("_c", "_bin")))
    spots = middles.join(spots, middles["_c"].eqNullSafe(spots["_c"]) & middles["_bin"].eqNullSafe(spots["_bin"])).select("gene", "_k")
    spots = genes.join(spots, "gene", "left").groupBy("g").agg(F.collect_list("_k").alias("ks"))
    spots = cut(spots.agg(F.sort_array(F.collect_list(F.struct("g", "ks"))).alias("_of")).select(F.col("_of.ks").alias("_of")))
    own = F.array_distinct(F.filter(F.transform("us", lambda u: u.bitwiseAND((1 << 32) - 1).cast("int")), lambda g: g > 0))
    binned = sets.crossJoin(F.broadcast(spots)).withColumn(
        "at", F.sort_array(F.flatten(F.transform(own, lambda g: F.transform(F.get("_of", g - 1), lambda k: F.struct(k.alias("k"), g.alias("g"))))))
    ).select("cell", "_n", "at")
    smallest = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1)["k"] != x["k"]))
    unique = binned.select("cell", "_n", F.explode_outer(F.array_distinct(F.transform(smallest, lambda x: x["g"]))).alias("g")).filter("g IS NOT NULL")
    unique = unique.groupBy("g", "cell").agg(F.sum("_n").alias("umis"))
    unique = unique.join(genes, "g").select(F.lit("gene").alias("level"), F.col("gene").alias("element"), "cell", "umis")
    out = once.unionByName(tx).unionByName(unique)
    if not twice.isEmpty():
        both = overlap_join(alone if whole else stretches, twice, ["chrom", "strand"], near)
        both = both.filter(F.array_contains("ts", F.col("t"))) if whole else both
        both = both.select("exon", "cell", "umi").distinct().groupBy(F.lit("exon").alias("level"), F.col("exon").alias("element"), "cell").agg(F.count(F.lit(1)).alias("umis"))
        out = out.unionByName(both)
    return out
