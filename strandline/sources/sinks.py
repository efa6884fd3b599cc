"""Writers: VCF, SAM, tab-separated tables, matrices, pileups, gene predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import chrom_rank
from strandline.sources.text import PILEUP_HEADS


def _text(value, missing: str = "."):
    return F.coalesce(value.cast("string"), F.lit(missing))


def vcf_lines(variants: DataFrame, genotypes: DataFrame | None = None, samples: list[str] | None = None, fields: tuple[str, ...] = ("GT",)) -> DataFrame:
    """Body lines of a VCF with their sort key; genotypes are (chrom, pos, ref, alts, sample, fields map)."""
    flags = F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"])))
    info = F.when(F.size("info") > 0, F.array_join(flags, ";")).otherwise(F.lit("."))
    cols = [
        F.col("chrom"), F.col("pos").cast("string"), _text(F.col("id")), F.col("ref"),
        F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."), _text(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", "")),
        F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("."), info,
    ]
    if genotypes is not None:
        cell = F.concat_ws(":", *[F.coalesce(F.col("fields")[f], F.lit(".")) for f in fields])
        row = genotypes.withColumn("_cell", cell).groupBy("chrom", "pos", "ref", "alts").agg(
            F.map_from_entries(F.collect_list(F.struct("sample", "_cell"))).alias("_cells")
        )
        variants = variants.join(row, ["chrom", "pos", "ref", "alts"], "left")
        cols += [F.lit(":".join(fields)), *[F.coalesce(F.col("_cells")[s], F.lit(".")) for s in samples or []]]
    return variants.select(chrom_rank(F.col("chrom")).alias("rank"), "pos", F.concat_ws("\t", *cols).alias("value"))


def write_vcf(variants: DataFrame, path: str, header: list[str], genotypes: DataFrame | None = None, samples: list[str] | None = None, fields: tuple[str, ...] = ("GT",)) -> None:
    """Sorted body as text files (ranges of the genome in order), the header as the first of them."""
    spark = variants.sparkSession
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *(samples or [])] if genotypes is not None else [])
    head = spark.createDataFrame([(i, x) for i, x in enumerate(["##fileformat=VCFv4.2", *header, "\t".join(names)])], "pos int, value string")
    head = head.select(F.struct(F.lit(-1).alias("n"), F.lit("").alias("name")).alias("rank"), "pos", "value")
    body = vcf_lines(variants, genotypes, samples, fields)
    head.unionByName(body).orderBy("rank", "pos").select("value").write.mode("overwrite").text(path)


def write_tsv(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, compression=compression, nullValue="NA")


def sam_line(columns: list[str]):
    """A record as a line, from the columns of the text reader; mates and tag types are written where they are known."""
    has = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in columns else F.lit(other)
    kinds = F.col("tag_types") if "tag_types" in columns else F.create_map().cast("map<string,string>")
    guessed = lambda e: F.when(e["value"].rlike("^-?[0-9]+$"), "i").otherwise("Z")
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], F.coalesce(kinds[e["key"]], guessed(e)), e["value"]))
    fixed = [has("qname", "*"), has("flag", "0"), has("chrom", "*"), has("pos", "0"), has("mapq", "255"), has("cigar", "*"), has("rnext", "*"), has("pnext", "0"), has("tlen", "0")]
    return F.concat_ws("\t", *fixed, has("seq", "*"), has("qual", "*"), tags)


def write_sam(reads: DataFrame, path: str, header: list[str]) -> None:
    body = reads.select(chrom_rank(F.col("chrom")).alias("rank"), "pos", sam_line(reads.columns).alias("value"))
    head = reads.sparkSession.createDataFrame([(i, x) for i, x in enumerate(header)], "pos int, value string")
    head = head.select(F.struct(F.lit(-1).alias("n"), F.lit("").alias("name")).alias("rank"), "pos", "value")
    head.unionByName(body).orderBy("rank", "pos").select("value").write.mode("overwrite").text(path)


def write_matrix(counts: DataFrame, barcodes: DataFrame, genes: DataFrame, folder: str) -> None:
    """MatrixMarket triplets with side files; the size line precedes the entries."""
    spark = counts.sparkSession
    n = (genes.count(), barcodes.count(), counts.count())
    lines = [(0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 1, "%"), (0, 2, " ".join(map(str, n)))]
    head = spark.createDataFrame(lines, "cell int, gene int, value string")
    body = counts.select(F.col("cell"), F.col("gene"), F.concat_ws(" ", "gene", "cell", "umis").alias("value"))
    head.unionByName(body).orderBy("cell", "gene").select("value").write.mode("overwrite").text(f"{folder}/matrix.mtx")
    barcodes.orderBy("cell").select("barcode").write.mode("overwrite").text(f"{folder}/barcodes.tsv")
    genes.orderBy("gene").select(F.concat_ws("\t", "gene_id", "symbol").alias("value")).write.mode("overwrite").text(f"{folder}/genes.tsv")


def pileup_strings(collapsed: DataFrame) -> DataFrame:
    """cell, snp, alleles, baseqs: bases of each cell and variant as strings in UMI order."""
    rows = F.sort_array(F.collect_list(F.struct("umi", "allele", "bq")))
    out = collapsed.groupBy("cell", "snp").agg(rows.alias("b"))
    return out.select(
        "cell", "snp", F.array_join(F.transform("b", lambda x: x["allele"].cast("string")), "").alias("alleles"),
        F.array_join(F.transform("b", lambda x: F.chr((x["bq"] + 33).cast("long"))), "").alias("baseqs"),
    )


def write_pileup(cells: DataFrame, snps: DataFrame, collapsed: DataFrame, prefix: str) -> None:
    for kind, rows, order in (("cel", cells, ["cell"]), ("var", snps, ["snp"]), ("plp", pileup_strings(collapsed), ["cell", "snp"])):
        spark = rows.sparkSession
        line = rows.select(*order, F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
        head = spark.createDataFrame([(-1, PILEUP_HEADS[kind])], "_o int, value string")
        for c in order:
            head = head.withColumn(c, F.lit(-1))
        head.select(*order, "value").unionByName(line).coalesce(1).sortWithinPartitions(*order).select("value").write.mode("overwrite").option("compression", "gzip").text(f"{prefix}.{kind}.gz")


def gene_predictions(elements: DataFrame) -> DataFrame:
    """One row per transcript: span, coding span, exon starts and ends (0-based starts, comma-ended lists)."""
    exon = F.when(F.col("type") == "exon", F.struct("beg", "end"))
    cds = F.col("type") == "CDS"
    out = elements.filter(F.col("transcript_id").isNotNull()).groupBy("transcript_id", "chrom", "strand").agg(
        (F.min("beg") - 1).alias("tx_start"), F.max("end").alias("tx_end"), (F.min(F.when(cds, F.col("beg"))) - 1).alias("cds_start"),
        F.max(F.when(cds, F.col("end"))).alias("cds_end"), F.sort_array(F.collect_list(exon)).alias("exons"), F.first("gene_name", ignorenulls=True).alias("gene_name"),
    )
    joined = lambda f: F.concat(F.array_join(F.transform("exons", f), ","), F.lit(","))
    return out.select(
        F.col("transcript_id").alias("name"), "chrom", "strand", "tx_start", "tx_end", F.coalesce("cds_start", "tx_end").alias("cds_start"),
        F.coalesce("cds_end", "tx_end").alias("cds_end"), F.size("exons").alias("exon_count"),
        joined(lambda e: (e["beg"] - 1).cast("string")).alias("exon_starts"), joined(lambda e: e["end"].cast("string")).alias("exon_ends"), "gene_name",
    )
