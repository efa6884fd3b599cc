"""Queries through files: the harness tables are written in a format and read back, beside SQL over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import filter_expr, scalar
from strandline.operators import kernels
from strandline.operators import pileup as pl
from strandline.operators import reads as rd
from strandline.operators import sequence as sq
from strandline.operators import variants as vr
from strandline.operators.lineage import shared_dir
from strandline.plans import views
from strandline.plans.registry import query
from strandline.plans.views import PANEL_SQL, READS_SQL, SNPS_SQL
from strandline.sources import bgzf, binary, packed, profiles, sinks, text


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/formats-{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, rows: DataFrame, name: str, *columns) -> str:
    """Rows as lines of tab-separated columns; the folder that holds them."""
    path = _path(spark, name)
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("value")).write.text(path)
    return path


# ---------------------------------------------------------------- variants

SITE_SQL = (
    "site AS (SELECT p_partkey, CAST(p_partkey % 22 + 1 AS VARCHAR) chrom, CAST(p_partkey + 1 AS INT) pos, 'v' || p_partkey id, "
    "CASE WHEN p_size % 7 = 0 THEN 'AC' ELSE 'A' END ref, CASE WHEN p_size % 5 = 0 THEN 'G,T' ELSE 'G' END alt, p_size qual, "
    "CASE p_size % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'LOW' ELSE 'LOW;X' END flt, p_size * 3 idp, p_brand nm FROM part)"
)


def _sites(spark, d) -> DataFrame:
    """Variants as the readers give them, one for each part."""
    return spark.read.parquet(f"{d}/part.parquet").select(
        (F.col("p_partkey") % 22 + 1).cast("string").alias("chrom"), (F.col("p_partkey") + 1).cast("int").alias("pos"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 7 == 0, "AC").otherwise("A").alias("ref"),
        F.when(F.col("p_size") % 5 == 0, F.array(F.lit("G"), F.lit("T"))).otherwise(F.array(F.lit("G"))).alias("alts"), F.col("p_size").cast("float").alias("qual"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("PASS"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("LOW"))).otherwise(F.array(F.lit("LOW"), F.lit("X"))).alias("filters"),
        F.create_map(F.lit("IDP"), (F.col("p_size") * 3).cast("string"), F.lit("NM"), F.regexp_replace("p_brand", "#", "_")).alias("info"),
    )


def _genotypes(spark, d) -> DataFrame:
    """Genotypes of the panel as the readers give them."""
    gt = F.when(F.col("code") == 0, "./.").when(F.col("code") == 1, "0/0").when(F.col("code") == 2, "0/1").otherwise("1/1")
    return views.panel(spark, d).select(
        F.lit("1").alias("chrom"), (F.col("snp") + 1).alias("pos"), F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"),
        F.concat(F.lit("s"), F.col("sample").cast("string")).alias("sample"),
        F.create_map(F.lit("GT"), gt, F.lit("DP"), F.col("dp").cast("string"), F.lit("GQ"), F.col("gq").cast("string")).alias("fields"),
    )


HEADER = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="gt">', '##INFO=<ID=IDP,Number=1,Type=Integer,Description="depth">']
PANEL_SAMPLES = [f"s{i}" for i in range(8)]


@query(f"WITH {SITE_SQL} SELECT chrom, pos, id, ref, alt, CAST(qual AS DOUBLE) qual, flt, CAST(idp AS VARCHAR) idp, replace(nm, '#', '_') nm FROM site")
def vcf_sites_scan(spark, d):
    path = _path(spark, "sites")
    sinks.write_vcf(_sites(spark, d), path, HEADER)
    v = text.read_variants(spark, path)
    return v.select(
        "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), F.col("qual").cast("double").alias("qual"), F.array_join("filters", ";").alias("flt"),
        F.col("info")["IDP"].alias("idp"), F.col("info")["NM"].alias("nm"),
    )


@query(f"WITH {PANEL_SQL} SELECT 's' || sample AS sample, CAST(snp + 1 AS INT) pos, CASE WHEN code = 0 THEN -1 ELSE code - 1 END dose, dp, gq FROM panel")
def vcf_genotypes_scan(spark, d):
    path, g = _path(spark, "genotypes"), _genotypes(spark, d)
    sites = g.select("chrom", "pos", "ref", "alts").distinct().select(
        "*", F.lit(None).cast("string").alias("id"), F.lit(None).cast("float").alias("qual"), F.array(F.lit("PASS")).alias("filters"), F.create_map().cast("map<string,string>").alias("info")
    )
    sinks.write_vcf(sites, path, HEADER, g, PANEL_SAMPLES, ("GT", "DP", "GQ"))
    return text.read_genotypes(spark, path).filter("dp is not null").select("sample", "pos", F.coalesce(F.col("a1") + F.col("a2"), F.lit(-1)).alias("dose"), "dp", "gq")


@query(f"WITH {SITE_SQL} SELECT chrom, pos, id, ref, alt, CAST(qual AS DOUBLE) qual, flt, CAST(idp AS VARCHAR) idp FROM site")
def bcf_sites_scan(spark, d):
    none = F.array().cast("array<struct<sample: string, fields: map<string,string>>>")
    rows = _sites(spark, d).withColumn("samples", none)
    made = packed.packed_variants(rows, [str(i) for i in range(1, 23)], [], ["LOW", "X"], ["IDP", "NM"], [])
    v = packed.variants_of(made)
    return v.select(
        "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), F.col("qual").cast("double").alias("qual"), F.array_join("filters", ";").alias("flt"), F.col("info")["IDP"].alias("idp")
    )


@query(f"WITH {SITE_SQL} SELECT chrom, pos, id, ref, alt, CAST(qual AS DOUBLE) qual, flt, CAST(idp AS VARCHAR) idp FROM site")
def bcf_file_scan(spark, d):
    """Sorted, indexed BCF files written by tasks and read in byte ranges."""
    none = F.array().cast("array<struct<sample: string, fields: map<string,string>>>")
    path = _path(spark, "bcf")
    bgzf.write_variants(_sites(spark, d).withColumn("samples", none), path, [str(i) for i in range(1, 23)], [], ["LOW", "X"], ["IDP", "NM"], [])
    v = bgzf.read_variants(spark, path, split=1 << 16)
    return v.select(
        "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), F.col("qual").cast("double").alias("qual"), F.array_join("filters", ";").alias("flt"), F.col("info")["IDP"].alias("idp")
    )


@query(f"WITH {SITE_SQL} SELECT chrom, pos, id, ref, alt FROM site WHERE chrom IN ('3', '11') AND pos <= 5000 AND pos + length(ref) > 100")
def vcf_blocks_region_scan(spark, d):
    """Block-compressed, indexed VCF text; the lines of regions go through the text reader."""
    path = _path(spark, "vcf-blocks")
    lines = sinks.vcf_lines(_sites(spark, d))
    bgzf.write_lines(lines, path, ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])])
    v = text.read_variants(spark, bgzf.read_lines(spark, path, "3:100-5000;11:100-5000"))
    return v.select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"))


@query(f"WITH {PANEL_SQL} SELECT 's' || sample AS sample, CAST(snp + 1 AS INT) pos, CASE code WHEN 0 THEN './.' WHEN 1 THEN '0/0' WHEN 2 THEN '0/1' ELSE '1/1' END gt, CAST(dp AS VARCHAR) dp FROM panel")
def bcf_genotypes_scan(spark, d):
    g = _genotypes(spark, d).groupBy("chrom", "pos", "ref", "alts").agg(F.sort_array(F.collect_list(F.struct("sample", F.to_json("fields").alias("f")))).alias("c"))
    cells = F.transform("c", lambda x: F.struct(x["sample"].alias("sample"), F.from_json(x["f"], "map<string,string>").alias("fields")))
    rows = g.select(
        "chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", "alts", F.lit(None).cast("float").alias("qual"), F.array(F.lit("PASS")).alias("filters"),
        F.create_map().cast("map<string,string>").alias("info"), cells.alias("samples"),
    )
    v = packed.variants_of(packed.packed_variants(rows, ["1"], PANEL_SAMPLES, [], [], ["GT", "DP"]))
    v = v.select("pos", F.explode("samples").alias("s"))
    # a packed row has all samples; those without a call have no depth
    return v.select("s.sample", "pos", F.col("s.fields")["GT"].alias("gt"), F.col("s.fields")["DP"].alias("dp")).filter("dp <> '.'")


@query(f"WITH {SITE_SQL} SELECT chrom, pos FROM site WHERE qual >= 20 AND alt = 'G' AND ref = 'A' AND list_has_any(string_split(flt, ';'), ['PASS', 'X'])")
def filtered_sites_scan(spark, d):
    path = _path(spark, "filtered")
    sinks.write_vcf(_sites(spark, d), path, HEADER)
    return vr.plain_site_filter(text.read_variants(spark, path), min_qual=20, max_alleles=2, snps_only=True, filters=["PASS", "X"]).select("chrom", "pos")


@query(f"WITH {SITE_SQL} SELECT chrom, pos, id FROM site WHERE CAST(chrom AS INT) IN (3, 7) AND pos BETWEEN 1 AND 1000")
def chunked_sites_scan(spark, d):
    """One file for each chromosome, of which the pattern and the wanted chunks name two."""
    path = _path(spark, "chunks")
    sites = _sites(spark, d)
    for c in ("3", "7", "9"):
        sinks.write_vcf(sites.filter(F.col("chrom") == c), f"{path}/chr{c}_1_1000", HEADER)
    paths = text.chunk_paths(path + "/chr{chr}_{beg}_{end}", [("3", 1, 1000), ("7", 1, 1000)])
    regions = spark.createDataFrame([("3", 1, 1000), ("7", 1, 1000)], "chrom string, beg int, end int")
    return text.in_regions(text.read_variants(spark, paths), regions).select("chrom", "pos", "id")


@query(f"WITH {SITE_SQL} SELECT chrom, pos FROM site WHERE (chrom = '2' AND pos + length(ref) - 1 >= 100 AND pos <= 900) OR (chrom = '5' AND pos + length(ref) - 1 >= 300 AND pos <= 301)")
def region_filter(spark, d):
    regions = spark.createDataFrame([("2", 100, 900), ("5", 300, 301)], "chrom string, beg int, end int")
    return text.in_regions(_sites(spark, d), regions).select("chrom", "pos")


@query(f"WITH {SITE_SQL} SELECT chrom, pos, CAST(idp AS VARCHAR) idp, nm_new, CAST(NULL AS VARCHAR) nm FROM (SELECT *, 'n' || pos nm_new FROM site)")
def update_info_fields(spark, d):
    """INFO fields removed, replaced by and added from another table of sites."""
    sites = _sites(spark, d)
    other = sites.select("chrom", "pos", "ref", "alts", F.create_map(F.lit("NEW"), F.concat(F.lit("n"), F.col("pos").cast("string"))).alias("info"))
    out = vr.update_info(sites, other, remove=["NM"], add=["NEW"])
    return out.select("chrom", "pos", F.col("info")["IDP"].alias("idp"), F.col("info")["NEW"].alias("nm_new"), F.col("info")["NM"].alias("nm"))


@query(f"WITH {SITE_SQL} SELECT chrom, pos, chrom || ':' || pos || ':' || ref || ':' || alt AS id FROM site")
def update_variant_ids(spark, d):
    old = F.concat_ws("_", "chrom", (F.col("pos") - 1).cast("string"), "ref", F.array_join("alts", ","))
    return _sites(spark, d).withColumn("id", vr.canonical_id(old)).select("chrom", "pos", "id")


@query(f"WITH {PANEL_SQL} SELECT sample, snp, code FROM panel WHERE sample IN (1, 4, 6)")
def sample_projection(spark, d):
    wanted = spark.createDataFrame([(1,), (4,), (6,)], "sample int")
    return vr.project_samples(views.panel(spark, d), wanted).select("sample", "snp", "code")


@query(f"WITH {PANEL_SQL} SELECT sample, snp, CASE WHEN dp < 15 OR gq < 20 THEN 0 ELSE code END code FROM panel")
def genotype_masks(spark, d):
    return vr.mask_low(views.panel(spark, d), 15, 20).select("sample", "snp", "code")


@query(f"WITH {SITE_SQL} SELECT chrom, pos FROM site WHERE qual > 10 AND idp / 3 < 45 AND (list_contains(string_split(flt, ';'), 'PASS') OR length(ref) = 2)")
def expression_filter_sites(spark, d):
    rows = _sites(spark, d).withColumn("samples", F.array().cast("array<map<string,string>>"))
    kept = filter_expr.apply_filters(rows, 'QUAL > 10 && INFO/IDP / 3 < 45 && (FILTER = "PASS" || STRLEN(REF) = 2)')
    return kept.select("chrom", "pos")


def _with_samples(spark, d) -> DataFrame:
    g = _genotypes(spark, d).groupBy("pos").agg(F.collect_list("fields").alias("samples"))
    return g.select(
        F.lit("1").alias("chrom"), "pos", F.lit(None).cast("string").alias("id"), F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"), F.lit(None).cast("double").alias("qual"),
        F.array().cast("array<string>").alias("filters"), F.create_map().cast("map<string,string>").alias("info"), "samples",
    )


def _expression(name: str, include: str, having: str):
    """Register a filter over samples beside a HAVING over the panel."""

    def run(spark, d):
        return filter_expr.apply_filters(_with_samples(spark, d), include, formats={"DP", "GQ"}).select("pos")

    run.__name__ = name
    query(f"WITH {PANEL_SQL} SELECT CAST(snp + 1 AS INT) pos FROM panel GROUP BY snp HAVING {having}")(run)


_ALT = "sum(greatest(code - 1, 0))"
_AN = "2 * count(*) FILTER (WHERE code > 0)"
_expression("expression_within_sample", "FMT/DP > 22 & FMT/GQ > 30", "bool_or(dp > 22 AND gq > 30)")
_expression("expression_across_samples", "FMT/DP > 24 && FMT/GQ > 55", "bool_or(dp > 24) AND bool_or(gq > 55)")
_expression("expression_either", "FMT/DP > 26 | FMT/GQ > 57", "bool_or(dp > 26 OR gq > 57)")
_expression("expression_genotype_class", 'GT = "het" & FMT/GQ >= 40', "bool_or(code = 2 AND gq >= 40)")
_expression("expression_missing", 'N_MISSING >= 2 && GT = "mis"', "count(*) FILTER (WHERE code = 0) >= 2")
_expression("expression_counts", "AC >= 6 && AN > 8 && AF <= 0.7", f"{_ALT} >= 6 AND {_AN} > 8 AND {_ALT} / nullif({_AN}, 0)::DOUBLE <= 0.7")
_expression("expression_statistics", "MAX(FMT/DP) - MIN(FMT/DP) > 9 && AVG(FMT/GQ) < 33", "max(dp) - min(dp) > 9 AND avg(gq) < 33")
_expression("expression_sums", "SUM(FMT/DP) >= 150 && MEDIAN(FMT/GQ) >= 25", "sum(dp) >= 150 AND median(gq) >= 25")
_expression("expression_n_pass", "N_PASS(FMT/GQ > 40) >= 2 && F_PASS(FMT/DP > 18) > 0.5", "count(*) FILTER (WHERE gq > 40) >= 2 AND count(*) FILTER (WHERE dp > 18) / count(*)::DOUBLE > 0.5")
_expression("expression_phred", "MIN(PHRED(FMT/DP / 100)) < 6 && MAX(ABS(FMT/GQ - 30)) > 25", "max(dp) / 100.0 > pow(10, -0.6) AND max(abs(gq - 30)) > 25")


@query(f"WITH {PANEL_SQL} SELECT 'rs' || snp rsid, CAST(snp + 1 AS INT) pos, sample, CASE WHEN code = 0 THEN -1 ELSE CAST(code - 1 AS INT) END dose FROM panel")
def bgen_scan(spark, d):
    """Genotype shares packed, read, and taken as the likeliest genotype."""
    panel = views.panel(spark, d)
    g = panel.groupBy("snp").agg(F.map_from_entries(F.collect_list(F.struct("sample", "code"))).alias("c"))
    code = lambda i: F.col("c")[i]
    share = lambda i: F.when(code(i).isNotNull() & (code(i) > 0), F.array(*[(code(i) == k + 1).cast("float") for k in range(3)]))
    rows = g.select(
        F.concat(F.lit("v"), F.col("snp").cast("string")).alias("id"), F.concat(F.lit("rs"), F.col("snp").cast("string")).alias("rsid"), F.lit("1").alias("chrom"),
        (F.col("snp") + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.array(*[share(i) for i in range(8)]).alias("gp"),
    )
    back = binary.bgen_of(binary.packed_bgen(rows, 8)).select("rsid", "pos", F.posexplode("gp").alias("sample", "s"))
    best = F.when(F.col("s").isNull(), -1).otherwise(F.array_position(F.col("s").cast("array<double>"), F.lit(1.0)).cast("int") - 1)
    # a file has all samples; those without a row in the panel are missing there and are left out here
    return back.select("rsid", "pos", "sample", best.alias("dose")).join(panel.select("sample", (F.col("snp") + 1).alias("pos")), ["sample", "pos"], "left_semi")


@query(f"WITH {PANEL_SQL} SELECT chrom, pos, haplotype, allele FROM (SELECT DISTINCT CAST(snp % 3 AS VARCHAR) chrom, CAST(snp + 1 AS INT) pos, h.h AS haplotype, CAST((snp * 7 + h.h * h.h) % 5 % 2 AS INT) allele FROM panel, (VALUES (0), (1), (2), (3), (4), (5)) h(h))")
def haplotype_block_scan(spark, d):
    """Haplotypes written as blocks of representatives and read back."""
    sites = views.panel(spark, d).select("snp").distinct()
    alleles = sites.withColumn("haplotype", F.explode(F.array(*[F.lit(h) for h in range(6)]))).select(
        (F.col("snp") % 3).cast("string").alias("chrom"), (F.col("snp") + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), "haplotype",
        ((F.col("snp") * 7 + F.col("haplotype") * F.col("haplotype")) % 5 % 2).cast("int").alias("allele"),
    )
    path = _path(spark, "haplotypes")
    binary.write_haplotype_blocks(alleles, path, 10)
    return binary.haplotype_alleles(binary.read_haplotype_blocks(spark, path), list(range(6))).select("chrom", "pos", "haplotype", "allele")


# ---------------------------------------------------------------- reads

SAM_SQL = (
    "sam AS (SELECT 'q' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || ':c' || l_suppkey % 20 || ':u' || l_linenumber qname, "
    "CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END flag, CAST(l_suppkey % 5 + 1 AS VARCHAR) chrom, "
    "CAST(l_partkey % 3000 * 7 + 1 AS INT) pos, CAST(l_quantity AS INT) mapq, CASE l_linenumber % 3 WHEN 0 THEN '20M' WHEN 1 THEN '5S10M2D5M' ELSE '8M3I9M' END cigar, "
    "CAST(l_partkey % 3000 * 7 + 101 AS INT) pnext, 120 tlen FROM lineitem)"
)
SEQ = "ACGTACGTTGCAACGTNACG"


def _sam(spark, d) -> DataFrame:
    """Reads of twenty bases, one for each line item."""
    s = lambda c: F.col(c).cast("string")
    k = F.col("l_linenumber") % 3
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("q"), F.concat_ws(".", s("l_orderkey"), s("l_linenumber"), s("l_partkey")), F.lit(":c"), (F.col("l_suppkey") % 20).cast("string"), F.lit(":u"), s("l_linenumber")).alias("qname"),
        (F.when(F.col("l_returnflag") == "R", 1024).otherwise(0) + F.when(F.col("l_linestatus") == "O", 16).otherwise(0)).alias("flag"),
        (F.col("l_suppkey") % 5 + 1).cast("string").alias("chrom"), (F.col("l_partkey") % 3000 * 7 + 1).cast("int").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"),
        F.when(k == 0, "20M").when(k == 1, "5S10M2D5M").otherwise("8M3I9M").alias("cigar"), F.lit("=").alias("rnext"), (F.col("l_partkey") % 3000 * 7 + 101).cast("int").alias("pnext"),
        F.lit(120).alias("tlen"), F.lit(SEQ).alias("seq"), F.lit("I" * 20).alias("qual"),
        F.create_map(F.lit("NH"), s("l_linenumber"), F.lit("RG"), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")), F.lit("XA"), F.lit("7")).alias("tags"),
        F.create_map(F.lit("NH"), F.lit("i"), F.lit("RG"), F.lit("Z"), F.lit("XA"), F.lit("Z")).alias("tag_types"),
    )


_SAM_OUT = "qname, flag, chrom, pos, mapq, cigar, '=' rnext, pnext, tlen, 'Z' xa_type"


def _sam_out(r: DataFrame) -> DataFrame:
    return r.select("qname", "flag", "chrom", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", F.col("tag_types")["XA"].alias("xa_type"))


@query(f"WITH {SAM_SQL} SELECT {_SAM_OUT} FROM sam")
def sam_scan(spark, d):
    path = _path(spark, "sam")
    sinks.write_sam(_sam(spark, d), path, ["@HD\tVN:1.6"])
    return _sam_out(text.read_reads(spark, path))


@query(f"WITH {SAM_SQL} SELECT {_SAM_OUT} FROM sam")
def bam_scan(spark, d):
    return _sam_out(packed.alignments_of(packed.packed_alignments(_sam(spark, d), [str(i) for i in range(1, 6)])))


@query(f"WITH {SAM_SQL} SELECT {_SAM_OUT} FROM sam")
def bam_file_scan(spark, d):
    """Sorted, indexed BAM files written by tasks and read in byte ranges."""
    path = _path(spark, "bam")
    bgzf.write_alignments(_sam(spark, d), path, [str(i) for i in range(1, 6)])
    return _sam_out(bgzf.read_alignments(spark, path, split=1 << 18))


@query(
    f"WITH {SAM_SQL} SELECT qname, chrom, pos, cigar FROM sam WHERE chrom IN ('2', '4') AND pos <= 9000 AND pos + CASE cigar WHEN '20M' THEN 20 ELSE 17 END > 500 "
    "OR chrom = '5' AND pos <= 16385 AND pos + CASE cigar WHEN '20M' THEN 20 ELSE 17 END > 16384"
)
def bam_region_scan(spark, d):
    """What overlaps three regions, by the chunks that the files' indices name."""
    path = _path(spark, "bam")
    bgzf.write_alignments(_sam(spark, d), path, [str(i) for i in range(1, 6)])
    return bgzf.read_alignments(spark, path, "2:500-9000;4:500-9000;5:16384-16385").select("qname", "chrom", "pos", "cigar")


@query(f"WITH {SAM_SQL} SELECT qname, flag, pos FROM sam WHERE chrom = '3' AND pos >= 2000 AND pos < 12000")
def bam_pushed_filter(spark, d):
    """Conditions of a query that reach the index."""
    path = _path(spark, "bam")
    bgzf.write_alignments(_sam(spark, d), path, [str(i) for i in range(1, 6)])
    return bgzf.read_alignments(spark, path).filter("chrom = '3' AND pos >= 2000 AND pos < 12000").select("qname", "flag", "pos")


@query(f"WITH {SAM_SQL} SELECT qname, pos FROM sam WHERE flag & 3844 = 0 AND mapq >= 20 AND chrom IN ('2', '4') AND pos BETWEEN 500 AND 9000")
def interval_reads_scan(spark, d):
    """Unmarked reads of enough mapping quality that begin inside regions."""
    kept = rd.read_filter(_sam(spark, d), 0xF04, 20).withColumn("ref", F.lit("N"))
    regions = spark.createDataFrame([("2", 500, 9000), ("4", 500, 9000)], "chrom string, beg int, end int")
    return text.in_regions(kept, regions, pos_only=True).select("qname", "pos")


_BLOCKS = (
    "blk AS (SELECT qname, chrom, pos + r beg, pos + r + n - 1 \"end\", q FROM (SELECT qname, chrom, pos, unnest(CASE cigar WHEN '20M' THEN [{n: 20, q: 0, r: 0}] "
    "WHEN '5S10M2D5M' THEN [{n: 10, q: 5, r: 0}, {n: 5, q: 15, r: 12}] ELSE [{n: 8, q: 0, r: 0}, {n: 9, q: 11, r: 8}] END, recursive := true) FROM sam WHERE mapq >= 30))"
)


@query(f'WITH {SAM_SQL}, {_BLOCKS} SELECT qname, CAST(beg AS INT) beg, CAST("end" AS INT) "end" FROM blk')
def cigar_blocks(spark, d):
    return rd.aligned_blocks(_sam(spark, d).filter("mapq >= 30")).select("qname", "beg", "end")


VAR_SQL = "var AS (SELECT DISTINCT CAST(p_partkey % 5 + 1 AS VARCHAR) chrom, CAST(p_partkey % 3000 * 7 + 10 AS INT) site FROM part WHERE p_size > 25)"


def _variants(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").filter("p_size > 25").select(
        (F.col("p_partkey") % 5 + 1).cast("string").alias("chrom"), (F.col("p_partkey") % 3000 * 7 + 10).cast("int").alias("pos")
    ).distinct()


@query(
    f"WITH {SAM_SQL}, {_BLOCKS}, {VAR_SQL} SELECT qname, site, CAST(q + site - beg + 1 AS INT) read_pos, substring('{SEQ}', CAST(q + site - beg + 1 AS INT), 1) base "
    'FROM blk JOIN var USING (chrom) WHERE site BETWEEN beg AND "end"'
)
def reads_at_variants(spark, d):
    """Bases of reads at variants, through their CIGAR."""
    return rd.base_at(_sam(spark, d).filter("mapq >= 30"), _variants(spark, d), 64).select("qname", "site", "read_pos", "base")


@query(
    f"WITH {SAM_SQL}, {_BLOCKS}, {VAR_SQL}, b AS (SELECT site, q + site - beg + 1 p, substring('{SEQ}', CAST(q + site - beg + 1 AS INT), 1) base FROM blk JOIN var USING (chrom) "
    "WHERE site BETWEEN beg AND \"end\") SELECT site, base, CAST(count(*) AS BIGINT) n FROM b WHERE base <> 'N' AND p > 2 AND 20 - p >= 2 GROUP BY 1, 2"
)
def usable_bases_at_variants(spark, d):
    bases = rd.base_at(_sam(spark, d).filter("mapq >= 30"), _variants(spark, d), 64)
    return rd.usable_bases(bases, 13, 30, 2).groupBy("site", "base").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linenumber, CAST(count(*) AS BIGINT) n FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY 1")
def cigar_sanity(spark, d):
    """CIGARs with an insertion at the end are dropped."""
    k = F.col("l_linenumber") % 3
    cigar = F.when(k == 0, "20M").when(k == 1, "5S10M2D5M").otherwise("17M3I")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber", cigar.alias("cigar"))
    return rows.filter(rd.sound_cigar(F.col("cigar"))).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAM_SQL} SELECT upper(split_part(qname, ':', 2)) cell, split_part(qname, ':', 3) umi, CAST(count(*) AS BIGINT) n FROM sam GROUP BY 1, 2")
def barcodes_from_names(spark, d):
    cell, umi = rd.barcode_from_name(F.col("qname"))
    return _sam(spark, d).groupBy(cell.alias("cell"), umi.alias("umi")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAM_SQL} SELECT qname, 'k' rg FROM sam WHERE CAST(substr(split_part(qname, ':', 2), 2) AS INT) < 0 UNION ALL SELECT 'q' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || ':c' || l_suppkey % 20 || ':u' || l_linenumber, CASE WHEN l_suppkey % 3 < 2 THEN 'k' ELSE 'g2' END FROM lineitem")
def read_groups_renamed(spark, d):
    groups = spark.createDataFrame([("k", "g0"), ("k", "g1")], "keep string, rg string")
    return rd.merge_read_groups(_sam(spark, d).withColumn("rg", F.col("tags")["RG"]), groups).select("qname", "rg")


_FIVE = "CASE WHEN flag & 16 = 0 THEN pos ELSE pos + CASE cigar WHEN '20M' THEN 20 ELSE 17 END - 1 END"


@query(
    f"WITH {SAM_SQL} SELECT chrom, flag & 16 = 0 AS fwd, CAST({_FIVE} AS INT) five, CAST(count(DISTINCT split_part(qname, ':', 3)) AS BIGINT) umis, CAST(count(*) AS BIGINT) reads FROM sam GROUP BY 1, 2, 3"
)
def procap_ends(spark, d):
    r = _sam(spark, d)
    _, umi = rd.barcode_from_name(F.col("qname"))
    end = F.col("pos") + rd.aligned_length(F.col("cigar")) - 1
    rows = r.select("chrom", F.col("pos").alias("beg"), end.alias("end"), (F.col("flag").bitwiseAND(16) == 0).alias("fwd"), umi.alias("umi"))
    return rd.procap_ends(rows)


@query(
    f"WITH {SAM_SQL}, f AS (SELECT chrom, CAST({_FIVE} AS INT) pos, CAST(count(*) AS BIGINT) n FROM sam WHERE flag & 16 = 0 GROUP BY 1, 2), "
    "s AS (SELECT a.chrom, a.pos, any_value(a.n) n, CAST(sum(b.n * (21 - abs(a.pos - b.pos))) AS BIGINT) w, max(b.n) top FROM f a JOIN f b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos - 20 AND a.pos + 20 GROUP BY 1, 2) "
    "SELECT chrom, pos, n, w FROM s WHERE n = top"
)
def peaks(spark, d):
    ends = _sam(spark, d).filter(F.col("flag").bitwiseAND(16) == 0).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    return rd.local_peaks(ends, 20)


# ---------------------------------------------------------------- other formats


@query("SELECT CAST(o_custkey % 22 AS VARCHAR) chrom, CAST(o_orderkey % 900 + 1 AS INT) beg, CAST(o_orderkey % 900 + 1 + o_custkey % 50 AS INT) \"end\", 'o' || o_orderkey nm FROM orders")
def bed_scan(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "cast(o_custkey % 22 as string) c", "cast(o_orderkey % 900 as int) b", "cast(o_orderkey % 900 + 1 + o_custkey % 50 as int) e", "concat('o', o_orderkey) n"
    )
    return text.read_bed(spark, _lines(spark, rows, "bed", "c", "b", "e", "n")).select("chrom", "beg", "end", F.get("rest", F.lit(0)).alias("nm"))


GTF_SQL = (
    "el AS (SELECT CAST(o_custkey % 22 AS VARCHAR) chrom, CASE WHEN o_orderkey % 3 = 2 THEN 'CDS' ELSE 'exon' END kind, CAST(o_orderkey % 1000 * 10 + 1 AS INT) beg, CAST(o_orderkey % 1000 * 10 + 8 AS INT) \"end\", "
    "'g' || o_custkey gene, 't' || o_custkey tx, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END strand FROM orders)"
)


def _gtf(spark, d) -> str:
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "cast(o_custkey % 22 as string) c", "case when o_orderkey % 3 = 2 then 'CDS' else 'exon' end k", "cast(o_orderkey % 1000 * 10 + 1 as int) b",
        "cast(o_orderkey % 1000 * 10 + 8 as int) e", "case when o_custkey % 2 = 0 then '+' else '-' end s",
        "concat('gene_id \"g', o_custkey, '\"; transcript_id \"t', o_custkey, '\"; gene_name \"N', o_custkey, '\"; gene_type \"protein_coding\";') a",
    )
    return _lines(spark, o, "gtf", "c", F.lit("x"), "k", "b", "e", F.lit("."), "s", F.lit("."), "a")


@query(f'WITH {GTF_SQL} SELECT chrom, kind, beg, "end", strand, gene, tx, \'N\' || substr(gene, 2) nm FROM el')
def gtf_scan(spark, d):
    return text.read_gtf(spark, _gtf(spark, d)).select(
        "chrom", F.col("type").alias("kind"), "beg", "end", "strand", F.col("gene_id").alias("gene"), F.col("transcript_id").alias("tx"), F.col("gene_name").alias("nm")
    )


@query(
    f"WITH {GTF_SQL} SELECT tx AS name, chrom, strand, CAST(min(beg) - 1 AS INT) tx_start, max(\"end\") tx_end, CAST(coalesce(min(beg) FILTER (WHERE kind = 'CDS') - 1, max(\"end\")) AS INT) cds_start, "
    "coalesce(max(\"end\") FILTER (WHERE kind = 'CDS'), max(\"end\")) cds_end, CAST(count(*) FILTER (WHERE kind = 'exon') AS INT) exon_count, "
    "coalesce(string_agg(CAST(beg - 1 AS VARCHAR), ',' ORDER BY beg, \"end\") FILTER (WHERE kind = 'exon'), '') || ',' exon_starts FROM el GROUP BY 1, 2, 3"
)
def gene_predictions(spark, d):
    out = sinks.gene_predictions(text.read_gtf(spark, _gtf(spark, d)))
    return out.select("name", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exon_count", "exon_starts")


PED_SQL = (
    "ped AS (SELECT c_custkey k, 'p' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN ',d' || c_custkey ELSE '' END person, CASE WHEN c_custkey > 20 AND c_custkey % 3 = 0 THEN 'p' || (c_custkey - 20) ELSE '0' END dad, "
    "CASE WHEN c_custkey > 20 AND c_custkey % 3 = 0 THEN 'p' || (c_custkey - 19) ELSE '0' END mom, c_custkey % 2 + 1 sex FROM customer)"
)


def _ped(spark, d) -> str:
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "c_custkey % 7 f", "concat('p', c_custkey, case when c_custkey % 5 = 0 then concat(',d', c_custkey) else '' end) p",
        "case when c_custkey > 20 and c_custkey % 3 = 0 then concat('p', c_custkey - 20) else '0' end dd",
        "case when c_custkey > 20 and c_custkey % 3 = 0 then concat('p', c_custkey - 19) else '0' end mm", "c_custkey % 2 + 1 x",
    )
    return _lines(spark, rows, "ped", F.concat(F.lit("F"), F.col("f").cast("string")), "p", "dd", "mm", "x")


@query(f"WITH {PED_SQL} SELECT dad, mom, split_part(person, ',', 1) kid FROM ped WHERE dad <> '0' AND mom <> '0'")
def ped_trios(spark, d):
    return text.trios(text.read_ped(spark, _ped(spark, d)))


@query(f"WITH {PED_SQL} SELECT 'd' || k id1, 'p' || k id2 FROM ped WHERE k % 5 = 0")
def ped_duplicates(spark, d):
    return text.duplicates(text.read_ped(spark, _ped(spark, d)))


@query("SELECT 'p' || c_custkey AS sample, c_custkey % 3 = 1 AS male FROM customer")
def sex_map_scan(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('p', c_custkey) p", "c_custkey % 3 x")
    return text.read_sex_map(spark, _lines(spark, rows, "sex", "p", "x"))


@query("SELECT p_partkey k, round(p_retailprice, 4) price, CAST(p_size AS DOUBLE) size FROM part")
def tsv_scan(spark, d):
    path = _path(spark, "tsv")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice", "p_size", "p_name")
    sinks.write_tsv(rows, path)
    back = spark.read.csv(path, sep="\t", header=True)
    return back.select(F.col("p_partkey").try_cast("long").alias("k"), F.round(F.col("p_retailprice").try_cast("double"), 4).alias("price"), F.col("p_size").try_cast("double").alias("size"))


def _fasta(spark, d) -> str:
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("length(text) > 200")
    seq = scalar.clean_sequence(F.col("text"))
    path = _path(spark, "fasta")
    wrapped = F.regexp_replace(seq, "(.{60})", "$1\n")
    docs.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" text\n"), wrapped).alias("value")).write.text(path)
    return path


@query("SELECT 'd' || doc_id chrom, md5(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g')) seq FROM documents WHERE length(text) > 200")
def fasta_scan(spark, d):
    return text.read_fasta(spark, _fasta(spark, d)).select("chrom", F.md5("seq").alias("seq"))


_GCV = "CASE WHEN gc + at_ > 0 THEN CAST(floor(gc / (gc + at_)::DOUBLE * 100) AS INT) ELSE -1 END gc"
_GC_SQL = (
    "w AS (SELECT chrom, CAST(b AS INT) bin, substring(seq, CAST(greatest((b + 1) * 100 - 100, 0) AS INT) + 1, CAST(least((b + 1) * 100, length(seq)) - greatest((b + 1) * 100 - 100, 0) AS INT)) w "
    "FROM (SELECT chrom, seq, unnest(range(0, (length(seq) - 1) // 100 + 1)) b FROM sq)), "
    f"g AS (SELECT chrom, bin, {_GCV} FROM (SELECT chrom, bin, length(w) - length(regexp_replace(w, '[GC]', '', 'g')) gc, length(w) - length(regexp_replace(w, '[AT]', '', 'g')) at_ FROM w))"
)
_WHOLE_SEQ = "sq AS (SELECT 'd' || doc_id chrom, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g') seq FROM documents WHERE length(text) > 200)"


@query(f"WITH {_WHOLE_SEQ}, {_GC_SQL} SELECT chrom, bin, gc FROM g")
def gc_profile_scan(spark, d):
    """A GC profile is written, one row a sequence, and read back."""
    gc = sq.gc_windows(text.read_fasta(spark, _fasta(spark, d)), 100, 100, ["chrom"])
    path = _path(spark, "gc-profile")
    profiles.write_gc_profile(gc, path, 100, 100)
    return profiles.read_gc_profile(spark, path).select("chrom", "bin", F.coalesce("gc", F.lit(-1)).alias("gc"))


@query(f"WITH {_WHOLE_SEQ}, {_GC_SQL}, q AS (SELECT 'd' || doc_id chrom, CAST(doc_id * 37 % length(text) + 1 AS INT) pos FROM documents WHERE length(text) > 200) SELECT chrom, pos, gc FROM q JOIN g USING (chrom) WHERE bin = (pos - 1) // 100")
def gc_at_positions(spark, d):
    gc = sq.gc_windows(text.read_fasta(spark, _fasta(spark, d)), 100, 100, ["chrom"])
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("length(text) > 200")
    points = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), (F.col("doc_id") * 37 % F.length("text") + 1).cast("int").alias("pos"))
    return profiles.gc_at(points, gc, 100).select("chrom", "pos", F.coalesce("gc", F.lit(-1)).alias("gc"))


@query(
    f"WITH {READS_SQL}, c AS (SELECT cell, snp, umi, CAST(arg_min(allele, (o1,o2,o3,o4,o5,o6)) AS INT) allele, CAST(arg_min(bq, (o1,o2,o3,o4,o5,o6)) AS INT) bq FROM reads WHERE bq >= 13 GROUP BY 1, 2, 3) "
    "SELECT cell, snp, CAST(count(*) AS BIGINT) n, CAST(sum(bq) AS BIGINT) bq, CAST(count(*) FILTER (WHERE allele = 1) AS BIGINT) alt FROM c WHERE cell % 2 = 0 GROUP BY 1, 2"
)
def pileup_scan(spark, d):
    """Pileup tables are written and read for the cells of an allow-list."""
    collapsed = pl.umi_collapse(pl.base_filter(views.reads(spark, d)))
    cells = collapsed.groupBy("cell").agg(F.sum("n").cast("int").alias("n_reads"), F.count(F.lit(1)).cast("int").alias("n_umis")).select(
        "cell", F.concat(F.lit("b"), F.col("cell").cast("string")).alias("barcode"), "n_reads", "n_umis", F.col("n_umis").alias("n_umis_snp"), F.lit(1).alias("n_snps")
    )
    snps = views.snps(spark, d).select("snp", F.col("chrom").cast("string").alias("chrom"), "pos", F.lit("A").alias("ref"), F.lit("G").alias("alt"), "af")
    prefix = _path(spark, "pileup")
    sinks.write_pileup(cells, snps, collapsed, prefix)
    wanted = cells.filter("cell % 2 = 0").select("barcode")
    _, _, bases = text.read_pileup(spark, prefix, 13, 40, wanted)
    return bases.groupBy("cell", "snp").agg(F.count(F.lit(1)).alias("n"), F.sum("bq").cast("long").alias("bq"), F.count_if(F.col("allele") == 1).alias("alt"))


@query(
    f"WITH {SNPS_SQL}, {PANEL_SQL} SELECT snps.snp, sample, code FROM snps LEFT JOIN (SELECT * FROM panel WHERE snp % 3 = 0) p ON p.snp = snps.snp"
)
def pileup_genotypes_join(spark, d):
    """Pileup variants keep their place where the call set has none."""
    g = views.panel(spark, d).filter("snp % 3 = 0")
    side = g.join(views.snps(spark, d), "snp").select("chrom", "pos", F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"), "sample", "code")
    return text.attach_genotypes(views.snps(spark, d).select("snp", "chrom", "pos", F.lit("A").alias("ref"), F.lit("G").alias("alt")), side).select("snp", "sample", "code")


_M = f"WITH {READS_SQL}, m AS (SELECT CAST(snp + 1 AS INT) gene, CAST(cell + 1 AS INT) cell, CAST(count(*) AS INT) umis FROM reads GROUP BY 1, 2)"


def _counts(spark, d) -> DataFrame:
    return views.reads(spark, d).groupBy((F.col("snp") + 1).alias("gene"), (F.col("cell") + 1).alias("cell")).agg(F.count(F.lit(1)).cast("int").alias("umis"))


@query(f"{_M} SELECT gene, cell, umis, 'b' || cell barcode, 'y' || gene symbol FROM m")
def matrix_scan(spark, d):
    folder, counts = _path(spark, "matrix"), _counts(spark, d)
    barcodes = counts.select("cell").distinct().withColumn("barcode", F.concat(F.lit("b"), F.col("cell").cast("string")))
    genes = counts.select("gene").distinct().select("gene", F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene_id"), F.concat(F.lit("y"), F.col("gene").cast("string")).alias("symbol"))
    sinks.write_matrix(counts, barcodes, genes, folder)
    m, b, g = text.read_matrix(spark, folder)
    return m.join(b, "cell").join(g, "gene").select("gene", "cell", "umis", "barcode", "symbol")


@query(f"{_M} SELECT 'g' || gene gene, 'b' || cell cell, umis FROM m")
def dense_matrix_scan(spark, d):
    """A dense table of counts, one column a cell, read as triplets."""
    path, counts = _path(spark, "dense"), _counts(spark, d)
    cells = sorted(r.cell for r in counts.select("cell").distinct().collect())
    wide = counts.groupBy("gene").pivot("cell", cells).agg(F.first("umis")).fillna(0)
    named = wide.select(F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene"), *[F.col(str(c)).alias(f"b{c}") for c in cells])
    named.write.csv(path, sep="\t", header=True)
    return profiles.read_dense_matrix(spark, path)


@query("SELECT 'r' || c_custkey id, upper(regexp_replace(lower(c_name), '[^acgt]', 'a', 'g')) seq, left(upper(regexp_replace(lower(c_name), '[^acgt]', 'a', 'g')), 5) barcode FROM customer")
def fastq_scan(spark, d):
    seq = F.upper(F.regexp_replace(F.lower("c_name"), "[^acgt]", "a"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("i"), seq.alias("s"))
    path = _path(spark, "fastq")
    rows.select(F.concat(F.lit("@"), "i", F.lit("\n"), "s", F.lit("\n+\n"), F.regexp_replace("s", ".", "@")).alias("value")).write.text(path)
    return text.read_fastq(spark, path, 5).select("id", "seq", "barcode")


@query("SELECT 'v' || vec_id id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) > 0 AS positive, CAST(len(embedding) AS INT) n FROM embeddings")
def loadings_scan(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("i"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "\t").alias("e")
    )
    back = text.read_loadings(spark, _lines(spark, rows, "loadings", "i", "e"), False)
    return back.select("id", (F.aggregate("values", F.lit(0.0), lambda a, x: a + x) > 0).alias("positive"), F.size("values").alias("n"))


@query(f"WITH {READS_SQL}, u AS (SELECT cell, 'u' || umi umi, CAST(snp AS INT) snp, CAST(max(bq) AS INT) bq FROM reads GROUP BY 1, 2, 3) SELECT 'b' || cell barcode, umi, snp, bq FROM u")
def pileup_dump_scan(spark, d):
    """Dump chunks: one line a cell and UMI with its places and bases; cells are dealt over chunks by hash."""
    u = views.reads(spark, d).groupBy("cell", F.concat(F.lit("u"), F.col("umi").cast("string")).alias("umi"), "snp").agg(F.max("bq").alias("bq"))
    path = _path(spark, "dump")
    profiles.write_dump(u.withColumn("barcode", F.concat(F.lit("b"), F.col("cell").cast("string"))), path, 4)
    return profiles.read_dump(spark, path).select("barcode", "umi", "snp", "bq")


@query("SELECT CAST(vec_id AS INT) AS i, CAST(vec_id % 7 AS DOUBLE) / 8 w FROM embeddings")
def svm_model_scan(spark, d):
    """The support vectors of a model, saved as text by tasks and read as a table."""
    word = F.concat(*[F.substring(F.lit("ACGT"), F.shiftright(F.col("vec_id").cast("int"), 2 * k).bitwiseAND(3) + 1, F.lit(1)) for k in range(12)])
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(word.alias("sequence"), (F.col("vec_id") % 7 / F.lit(8.0)).alias("weight"))
    path, kernel = _path(spark, "model"), {"length": 8, "k": 5, "most": 3}
    kernels.save_vectors(rows, kernel, path)
    back, said = kernels.load_vectors(spark, path)
    assert said == kernel
    number = sum((F.instr(F.lit("ACGT"), F.substring("sequence", k + 1, 1)) - 1) * (1 << 2 * k) for k in range(12))
    return back.select(number.cast("int").alias("i"), F.col("weight").alias("w"))
