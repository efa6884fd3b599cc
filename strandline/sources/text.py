"""Text formats as DataFrames: VCF, SAM, BED, GTF, PED, sex maps, pileups, matrices, FASTA, FASTQ.

Every reader is a Spark text scan followed by column expressions, so files split,
filters reach the scan's rows early, and gzip is handled by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import attribute
from strandline.operators.intervals import merge_intervals


def _lines(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """Lines of files; a table of lines, as of :func:`strandline.sources.bgzf.read_lines`, may stand for a path."""
    return path if isinstance(path, DataFrame) else spark.read.text(path)


def _missing(c: Column) -> Column:
    return F.when((c != ".") & (c != ""), c)


def first_entries(entries: Column) -> Column:
    """Map of an array of (key, value) structs; of a repeated key the first counts."""
    keys = F.transform(entries, lambda e: e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1))


def vcf_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(kind, id, number, type, description) of the declared fields."""
    meta = _lines(spark, path).filter(F.col("value").startswith("##") & F.contains("value", F.lit("=<ID=")))
    pick = lambda p: F.regexp_extract("value", p, 1)
    return meta.select(
        pick("^##([A-Za-z]+)=<").alias("kind"), pick("ID=([^,>]+)").alias("id"), _missing(pick("Number=([^,>]+)")).alias("number"),
        _missing(pick("Type=([^,>]+)")).alias("type"), _missing(pick('Description="([^"]*)"')).alias("description"),
    ).distinct()


def vcf_samples(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Sample names of the heading line (one line per file; files of one set agree)."""
    row = _lines(spark, path).filter(F.col("value").startswith("#CHROM")).first()
    return row[0].rstrip("\r").split("\t")[9:] if row else []


def _vcf_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    body = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    return body.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c"))


def _info(text: Column) -> Column:
    pairs = F.transform(F.filter(F.split(text, ";"), lambda x: (x != "") & (x != ".")), lambda x: F.split(x, "=", 2))
    return first_entries(
        F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("v")))
    )


def read_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filters, info map; flags of INFO have the empty string."""
    c = lambda i: F.get("c", F.lit(i))
    return _vcf_rows(spark, path).select(
        c(0).alias("chrom"), c(1).try_cast("int").alias("pos"), _missing(c(2)).alias("id"), c(3).alias("ref"),
        F.filter(F.split(c(4), ","), lambda a: a != ".").alias("alts"), _missing(c(5)).try_cast("float").alias("qual"),
        F.when(c(6) != ".", F.split(c(6), ";")).otherwise(F.array().cast("array<string>")).alias("filters"), _info(c(7)).alias("info"),
    )


def read_genotypes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per variant and sample: a1, a2 (null if missing), phased, dp, gq, ad, pl, gp, ds, and all fields as a map."""
    names = F.array(*[F.lit(s) for s in vcf_samples(spark, path)])
    c = lambda i: F.get("c", F.lit(i))
    rows = _vcf_rows(spark, path).filter(F.size("c") > 9).select(
        c(0).alias("chrom"), c(1).try_cast("int").alias("pos"), c(3).alias("ref"), F.split(c(4), ",").alias("alts"),
        F.split(c(8), ":").alias("_k"), F.posexplode(F.slice("c", 10, F.size("c"))).alias("_i", "_v"),
    )
    values = F.split("_v", ":")
    keyed = F.map_from_entries(F.filter(F.arrays_zip(F.col("_k").alias("k"), values.alias("v")), lambda e: e["v"].isNotNull()))
    rows = rows.withColumn("fields", keyed).withColumn("sample", F.get(names, F.col("_i")))
    gt = F.col("fields")["GT"]
    part = F.split(gt, "[/|]")
    number = lambda k: _missing(F.col("fields")[k])
    numbers = lambda k, t: F.transform(F.split(number(k), ","), lambda x: _missing(x).try_cast(t))
    a1, a2 = _missing(F.get(part, F.lit(0))).try_cast("int"), _missing(F.get(part, F.lit(1))).try_cast("int")
    return rows.select(
        "chrom", "pos", "ref", "alts", "sample", a1.alias("a1"), a2.alias("a2"), F.contains(gt, F.lit("|")).alias("phased"),
        number("DP").try_cast("int").alias("dp"), number("GQ").try_cast("int").alias("gq"), numbers("AD", "int").alias("ad"),
        numbers("PL", "int").alias("pl"), numbers("GP", "float").alias("gp"), number("DS").try_cast("float").alias("ds"), "fields",
    )


def read_reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SAM records: all eleven columns, and the tags as maps of name to value and of name to type."""
    body = _lines(spark, path).filter(~F.col("value").rlike("^@[A-Z]{2}\t") & (F.length("value") > 0)).select(F.split("value", "\t").alias("c"))
    c = lambda i: F.get("c", F.lit(i))
    tags = F.transform(F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.split(t, ":", 3))
    return body.filter(F.size("c") >= 11).select(
        c(0).alias("qname"), c(1).try_cast("int").alias("flag"), _missing_star(c(2)).alias("chrom"), c(3).try_cast("int").alias("pos"),
        c(4).try_cast("int").alias("mapq"), _missing_star(c(5)).alias("cigar"), _missing_star(c(6)).alias("rnext"), c(7).try_cast("int").alias("pnext"),
        c(8).try_cast("int").alias("tlen"), _missing_star(c(9)).alias("seq"), _missing_star(c(10)).alias("qual"),
        *[
            first_entries(F.transform(tags, lambda t: F.struct(F.get(t, F.lit(0)).alias("k"), F.get(t, F.lit(i)).alias("v")))).alias(name)
            for name, i in (("tags", 2), ("tag_types", 1))
        ],
    )


def _missing_star(c: Column) -> Column:
    return F.when(c != "*", c)


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, beg, end: 1-based and closed (the file is 0-based and half-open), further columns as an array."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).filter(~F.col("value").rlike("^(#|track|browser|$)"))
    return rows.select(
        F.get(c, F.lit(0)).alias("chrom"), (F.get(c, F.lit(1)).try_cast("int") + 1).alias("beg"), F.get(c, F.lit(2)).try_cast("int").alias("end"),
        F.slice(c, 4, F.greatest(F.size(c) - 3, F.lit(0))).alias("rest"),
    )


UTR_NAMES = ("five_prime_utr", "three_prime_utr", "5UTR", "3UTR", "UTR")


def read_gtf(spark: SparkSession, path: str | list[str], gene_types: list[str] | None = None, chr_prefix: bool | None = None) -> DataFrame:
    """Elements of gene models; both UTR names become UTR; ``chr_prefix`` adds (True) or removes (False) "chr"."""
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    rows = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.size(c) == 9))
    chrom = at(0)
    if chr_prefix is True:
        chrom = F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
    elif chr_prefix is False:
        chrom = F.regexp_replace(chrom, "^chr", "")
    out = rows.select(
        chrom.alias("chrom"), F.when(at(2).isin(*UTR_NAMES), "UTR").otherwise(at(2)).alias("type"), at(3).try_cast("int").alias("beg"),
        at(4).try_cast("int").alias("end"), at(6).alias("strand"), at(7).alias("frame"), attribute(at(8), "gene_id").alias("gene_id"),
        attribute(at(8), "gene_name").alias("gene_name"), F.coalesce(attribute(at(8), "gene_type"), attribute(at(8), "gene_biotype")).alias("gene_type"),
        attribute(at(8), "transcript_id").alias("transcript_id"),
    )
    return out if gene_types is None else out.filter(F.col("gene_type").isin(*gene_types))


def with_missing_parents(elements: DataFrame) -> DataFrame:
    """Adds gene and transcript rows that a file lacks, spanning their exons."""
    exons = elements.filter("type = 'exon'")
    for kind, key in (("transcript", "transcript_id"), ("gene", "gene_id")):
        have = elements.filter(F.col("type") == kind).select(key).distinct()
        keep = [F.first(c, ignorenulls=True).alias(c) for c in ("chrom", "strand", "gene_id", "gene_name", "gene_type") if c != key]
        made = exons.join(have, key, "left_anti").groupBy(key).agg(F.min("beg").alias("beg"), F.max("end").alias("end"), *keep)
        made = made.withColumn("type", F.lit(kind)).withColumn("frame", F.lit("."))
        elements = elements.unionByName(made, allowMissingColumns=True)
    return elements


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """fam, sample (one row for each of a person's samples), person, dad, mom, sex; 0 means absent."""
    c = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    absent = lambda x: F.when(x != "0", x)
    rows = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    rows = rows.select(
        at(0).alias("fam"), F.split(at(1), ",").alias("samples"), absent(at(2)).alias("dad"), absent(at(3)).alias("mom"), at(4).try_cast("int").alias("sex")
    )
    return rows.withColumn("person", F.get("samples", F.lit(0))).withColumn("sample", F.explode("samples"))


def trios(ped: DataFrame) -> DataFrame:
    """(dad, mom, kid) of persons with both parents, by first sample."""
    return ped.filter("sample = person and dad is not null and mom is not null").select("dad", "mom", F.col("sample").alias("kid"))


def duplicates(ped: DataFrame) -> DataFrame:
    """(id1, id2): pairs of samples of one person."""
    return ped.select("person", F.col("sample").alias("id1")).join(ped.select("person", F.col("sample").alias("id2")), "person").filter("id1 < id2").select("id1", "id2")


def read_sex_map(spark: SparkSession, path: str) -> DataFrame:
    """sample, male: two columns, or a pedigree file with id in column 2 and sex in column 5; unknown counts as female."""
    c = F.split(F.trim("value"), r"\s+")
    wide = F.size(c) > 4
    at = lambda i: F.get(c, F.lit(i))
    rows = _lines(spark, path).filter(F.length(F.trim("value")) > 0)
    return rows.select(F.when(wide, at(1)).otherwise(at(0)).alias("sample"), (F.when(wide, at(4)).otherwise(at(1)) == "1").alias("male"))


PILEUP_HEADS = {
    "cel": "#DROPLET_ID\tBARCODE\tNUM.READ\tNUM.UMI\tNUM.UMIwSNP\tNUM.SNP",
    "var": "#SNP_ID\tCHROM\tPOS\tREF\tALT\tAF",
    "plp": "#DROPLET_ID\tSNP_ID\tALLELES\tBASEQS",
}
PILEUP_TYPES = {
    "cel": "cell int, barcode string, n_reads int, n_umis int, n_umis_snp int, n_snps int",
    "var": "snp int, chrom string, pos int, ref string, alt string, af double",
    "plp": "cell int, snp int, alleles string, baseqs string",
}


def read_pileup_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the three pileup tables; the header must be exactly the known one."""
    head = spark.read.text(path).filter(F.col("value").startswith("#")).first()
    if head is None or head[0] != PILEUP_HEADS[kind]:
        raise ValueError(f"{path} is not a {kind} table: {head}")
    return spark.read.csv(path, sep="\t", schema=PILEUP_TYPES[kind], comment="#", quote="")


def read_pileup(spark: SparkSession, prefix: str, min_bq: int = 13, cap_bq: int = 40, barcodes: DataFrame | None = None):
    """(cells, snps, bases): each base of the strings is a UMI of its own; qualities are floored and capped."""
    cells, snps = read_pileup_table(spark, f"{prefix}.cel.gz", "cel"), read_pileup_table(spark, f"{prefix}.var.gz", "var")
    if barcodes is not None:
        cells = cells.join(barcodes, "barcode", "left_semi")
    plp = read_pileup_table(spark, f"{prefix}.plp.gz", "plp").join(cells.select("cell"), "cell", "left_semi")
    places = F.sequence(F.lit(1), F.length("alleles"))
    bases = plp.filter(F.length("alleles") > 0).select("cell", "snp", "alleles", "baseqs", F.explode(places).alias("umi"))
    bases = bases.select(
        "cell", "snp", "umi", F.substring("alleles", F.col("umi"), F.lit(1)).try_cast("int").alias("allele"),
        F.least(F.ascii(F.substring("baseqs", F.col("umi"), F.lit(1))) - 33, F.lit(cap_bq)).alias("bq"), F.lit(1).cast("long").alias("n"),
    )
    return cells, snps, bases.filter(F.col("bq") >= min_bq)


def attach_genotypes(snps: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Pileup variants with the genotypes of a VCF on chrom, pos, ref, alt; those without a partner stay with nulls."""
    side = genotypes.filter(F.size("alts") == 1).withColumn("alt", F.get("alts", F.lit(0))).drop("alts")
    return snps.join(side, ["chrom", "pos", "ref", "alt"], "left")


def read_matrix(spark: SparkSession, folder: str, matrix: str = "matrix.mtx", barcodes: str = "barcodes.tsv", genes: str = "genes.tsv"):
    """(counts (gene, cell, umis), barcodes (cell, barcode), genes (gene, gene_id, symbol)); indices from 1."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(f"{folder}/{matrix}").select("value", place.alias("place")).filter(~F.col("value").startswith("%"))
    c = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(c, F.lit(i)).try_cast("int")
    first = rows.agg(F.min("place")).first()[0]  # the size line comes before the entries
    if first is not None:
        rows = rows.filter((F.col("place.block") != first["block"]) | (F.col("place.line") != first["line"]))
    counts = rows.select(at(0).alias("gene"), at(1).alias("cell"), at(2).alias("umis"))
    return counts, numbered(spark, f"{folder}/{barcodes}", ["barcode"], "cell"), numbered(spark, f"{folder}/{genes}", ["gene_id", "symbol"], "gene")


def numbered(spark: SparkSession, path: str, names: list[str], index: str) -> DataFrame:
    """Lines of a side file with their number from 1 (the order of the file)."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select("value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("_o"))
    rows = rows.withColumn(index, F.row_number().over(Window.orderBy("_o")))
    return rows.select(index, *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq (upper case): one row per record; records are cut at the header marks."""
    rows = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)
    return rows.select(
        F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"),
        F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"),
    )


def sequence_bins(fasta: DataFrame, width: int) -> DataFrame:
    """chrom, bin, seq: sequences cut to ``width`` bases, for joins by bin."""
    last = F.greatest(F.floor((F.length("seq") - 1) / width), F.lit(0)).try_cast("int")
    return fasta.select("chrom", F.posexplode(F.sequence(F.lit(0), last)).alias("bin", "_k"), "seq").select(
        "chrom", "bin", F.substring("seq", F.col("bin") * width + 1, F.lit(width)).alias("seq")
    )


def read_fastq(spark: SparkSession, path: str, barcode_length: int | None = None) -> DataFrame:
    """id, seq, qual (and barcode): records are cut at line breaks before "@" that open a record."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"@([^\n]*\n[^\n]*\n\+[^\n]*\n[^\n]*)"), F.lit(1))).alias("r"))
    c = F.split("r", "\n")
    out = rows.select(*[F.get(c, F.lit(i)).alias(n) for i, n in ((0, "id"), (1, "seq"), (3, "qual"))])
    return out if barcode_length is None else out.filter(F.length("seq") >= barcode_length).withColumn("barcode", F.left("seq", F.lit(barcode_length)))


def read_loadings(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Rows of a model of principal components: first column as ``id``, the others as an array of doubles."""
    c = F.split("value", "\t")
    rows = spark.read.text(path)
    if header:
        first = rows.first()
        rows = rows.filter(F.col("value") != first[0]) if first else rows
    return rows.select(F.get(c, F.lit(0)).alias("id"), F.transform(F.slice(c, 2, F.size(c)), lambda x: x.try_cast("double")).alias("values"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.get(F.split("value", r"[\t ]"), F.lit(0)).alias("barcode"))


def chunk_paths(pattern: str, chunks: list[tuple[str, int, int]]) -> list[str]:
    """File names of a set cut by region: {chr}, {beg} and {end} in the pattern are filled in."""
    return [pattern.format(chr=c, beg=b, end=e) for c, b, e in chunks]


def in_regions(rows: DataFrame, regions: DataFrame, pos_only: bool = False, width: int = 100_000) -> DataFrame:
    """Rows (chrom, pos, ref) in any region; unless ``pos_only``, long alleles that reach into one count too.

    Regions are merged first.  A row that reaches over several is kept where it
    meets the first of them, in the bin where the two first touch: once.
    """
    order = Window.partitionBy("chrom").orderBy("beg")
    spans = merge_intervals(regions.select("chrom", "beg", "end")).withColumn("_before", F.lag("end").over(order))
    spans = spans.select("chrom", F.col("beg").alias("_b"), F.col("end").alias("_e"), "_before")
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_b") / width), F.floor(F.col("_e") / width))))
    reach = F.col("pos") if pos_only else F.col("pos") + F.length("ref") - 1
    keyed = rows.withColumn("_r", reach).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("_r") / width))))
    first = F.floor(F.greatest("pos", "_b") / width)
    hit = (F.col("pos") <= F.col("_e")) & (F.col("_b") <= F.col("_r")) & (F.col("_bin") == first)
    alone = F.col("_before").isNull() | (F.col("_before") < F.col("pos"))
    return keyed.join(spans, ["chrom", "_bin"]).filter(hit & alone).select(*[F.col(f"`{c}`") for c in rows.columns])
