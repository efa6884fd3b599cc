"""``python -m strandline COMMAND --out FOLDER ...``: the commands over files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.filter_expr import apply_filters
from strandline.operators import clustering, dense, gapped, genes, genotyping, intervals, kernels, pileup, reads, sequence, variants
from strandline.operators.lineage import cut
from strandline.sources import bgzf, binary, profiles, sinks, text

COMMANDS: dict = {}


def command(name: str, *options: str):
    """Register a command with its options: ``name``, ``name=default``; all are strings on the line."""

    def add(f):
        COMMANDS[name] = (f, options)
        return f

    return add


def reads_of(spark: SparkSession, path: str, regions: str | None = None) -> DataFrame:
    """Reads of a SAM file, or of BAM files, whose index serves the regions."""
    if path.endswith(".bam") or bgzf.is_blocked(path, ".bam"):
        return bgzf.read_alignments(spark, path, regions)
    return text.read_reads(spark, path)


def sites_of(spark: SparkSession, path: str, regions: str | None = None) -> DataFrame:
    """Variants of a VCF, plain or in blocks, or of BCF files."""
    if path.endswith(".bcf") or bgzf.is_blocked(path, ".bcf"):
        return bgzf.read_variants(spark, path, regions).drop("samples")
    return text.read_variants(spark, lines_of(spark, path, regions))


def lines_of(spark: SparkSession, path: str, regions: str | None = None) -> str | DataFrame:
    """A VCF in blocks as a table of lines, any other as its path."""
    return bgzf.read_lines(spark, path, regions) if bgzf.is_blocked(path, ".gz") else path


def coded(spark: SparkSession, path: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Genotypes of a VCF in the long coded form: snp is the variant's name; half-missing calls are missing."""
    path = lines_of(spark, path)
    g = text.read_genotypes(spark, path)
    if include or exclude:
        sites = text.read_variants(spark, path)
        cells = g.groupBy("chrom", "pos", "ref", "alts").agg(F.collect_list("fields").alias("samples"))
        names = text.vcf_header(spark, path).select("kind", "id").collect()
        kept = apply_filters(
            sites.join(cells, ["chrom", "pos", "ref", "alts"], "left"), include, exclude,
            {r.id for r in names if r.kind == "INFO"}, {r.id for r in names if r.kind == "FORMAT"},
        )
        g = g.join(kept.select("chrom", "pos", "ref", "alts"), ["chrom", "pos", "ref", "alts"], "left_semi")
    dose = (F.col("a1") > 0).cast("int") + (F.col("a2") > 0).cast("int")
    snp = F.concat_ws(":", "chrom", "pos", "ref", F.array_join("alts", ","))
    return g.select("sample", snp.alias("snp"), F.coalesce(dose + 1, F.lit(0)).alias("code"), "chrom", "pos", "dp", "gq", "ds", "pl")


def likelihoods(spark: SparkSession, path: str) -> DataFrame:
    g = coded(spark, path)
    hard = variants.pl_from_gt(g)
    own = g.filter(F.size("pl") >= 3).select("sample", "snp", *[F.get("pl", F.lit(i)).alias(f"pl{i}") for i in range(3)])
    pls = own.unionByName(hard.join(own, ["sample", "snp"], "left_anti"))
    return pls.select("sample", "snp", *[F.pow(F.lit(10.0), -F.col(f"pl{i}") / 10.0).alias(f"l{i}") for i in range(3)], "pl0", "pl1", "pl2")


@command("vcf-sample-summary", "vcf", "include-expr=", "exclude-expr=", "min-dp=0", "min-gq=0")
def _sample_summary(spark, o):
    panel = coded(spark, o.vcf, o.include_expr, o.exclude_expr)
    return variants.sample_summary(variants.mask_low(panel.fillna(0, ["dp", "gq"]), int(o.min_dp), int(o.min_gq)))


@command("vcf-update-info", "vcf")
def _update_info(spark, o):
    return variants.site_counts(coded(spark, o.vcf))


@command("vcf-squeeze", "vcf", "sex-map", "min-dp=0", "min-dp-male-x=0", "min-gq=0")
def _squeeze(spark, o):
    from strandline.functions.scalar import ploidy

    panel = coded(spark, o.vcf).join(text.read_sex_map(spark, o.sex_map), "sample", "left")
    copies = ploidy(F.col("chrom"), F.col("pos"), F.coalesce("male", F.lit(False)))
    return variants.squeeze(panel, copies, int(o.min_dp), int(o.min_dp_male_x), int(o.min_gq)).select("sample", "snp", "code")


@command("vcf-ibs-matrix", "list", "ref")
def _ibs_matrix(spark, o):
    return variants.ibs_matrix(coded(spark, o.list), coded(spark, o.ref))


@command("vcf-ibs0-summary", "vcf", "min-hom-gts=1")
def _ibs0(spark, o):
    return variants.ibs0_free_pairs(coded(spark, o.vcf), int(o.min_hom_gts))


@command("mendel-dup-conc", "vcf", "ped", "kind=trio")
def _mendel(spark, o):
    ped, panel = text.read_ped(spark, o.ped), coded(spark, o.vcf)
    return variants.trio_table(panel, text.trios(ped)) if o.kind == "trio" else variants.duplicate_table(panel, text.duplicates(ped))


@command("vcf-extract", "vcf", "ids")
def _extract(spark, o):
    wanted = text.read_barcodes(spark, o.ids).withColumnRenamed("barcode", "id")
    return sites_of(spark, o.vcf).join(wanted, "id", "left_semi").withColumn("info", F.to_json("info")).withColumns(
        {c: F.array_join(c, ",") for c in ("alts", "filters")}
    )


@command("vcf-fill-plink2", "vcf")
def _fill(spark, o):
    return variants.mach_r2(coded(spark, o.vcf))


@command("vcf-svd", "vcf", "max-pc=4")
def _svd(spark, o):
    dosages = coded(spark, o.vcf).select("sample", "snp", F.when(F.col("code") > 0, F.col("code") - 1.0).alias("ds"))
    ud, _ = kernels.principal_components(dosages, int(o.max_pc))
    return ud.withColumn("ud", F.array_join(F.transform("ud", lambda x: x.cast("string")), ","))


@command("vcf-infer-ancestry", "vcf", "model-vcf", "max-pc=2")
def _ancestry(spark, o):
    dosages = coded(spark, o.model_vcf).select("sample", "snp", F.when(F.col("code") > 0, F.col("code") - 1.0).alias("ds"))
    ud, _ = kernels.principal_components(dosages, int(o.max_pc))
    return kernels.infer_ancestry(likelihoods(spark, o.vcf), ud, int(o.max_pc))


@command("vcf-infer-isaf", "vcf", "max-pc=2")
def _isaf(spark, o):
    dosages = coded(spark, o.vcf).select("sample", "snp", F.when(F.col("code") > 0, F.col("code") - 1.0).alias("ds"))
    _, v = kernels.principal_components(dosages, int(o.max_pc))
    return kernels.individual_frequencies(likelihoods(spark, o.vcf), v)


@command("vcf-ibs0-phase", "vcf", "chrom=")
def _phase(spark, o):
    panel = coded(spark, o.vcf)
    panel = panel.filter(F.col("chrom") == o.chrom) if o.chrom else panel
    order = panel.select("chrom", "pos", "snp").distinct().withColumn("n", F.expr("row_number() over (partition by chrom order by pos, snp) - 1"))
    return kernels.phase_blocks(panel.join(order.select("snp", "n"), "snp").select("sample", F.col("n").alias("snp"), "code"))


@command("cram-flagstat-all", "sam")
def _flagstat(spark, o):
    return reads.flag_lattice(reads_of(spark, o.sam))


@command("cram-update-rg", "sam", "rg-map")
def _update_rg(spark, o):
    c = F.split("value", r"\s+")
    groups = spark.read.text(o.rg_map).select(F.get(c, F.lit(0)).alias("keep"), F.explode(F.slice(c, 2, F.size(c))).alias("rg"))
    r = reads.merge_read_groups(reads_of(spark, o.sam).withColumn("rg", F.col("tags")["RG"]), groups)
    # the record with its group renamed; all other columns and tags as they are
    own = F.map_filter("tags", lambda k, _: k != "RG")
    renamed = r.withColumn("tags", F.when(F.col("rg").isNull(), own).otherwise(F.map_concat(own, F.create_map(F.lit("RG"), F.col("rg")))))
    return renamed.select("qname", "flag", "chrom", "pos", "rg", sinks.sam_line(renamed.columns).alias("line"))


def bases_of(spark, o, cell_tag: str = "CB") -> tuple[DataFrame, DataFrame]:
    """(collapsed bases, variants) of a SAM file at the SNPs of a VCF, by a cell tag and UB."""
    sites = sites_of(spark, o.vcf).filter((F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(F.get("alts", F.lit(0))) == 1))
    sites = sites.select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.coalesce(F.col("info")["AF"].cast("double"), F.lit(0.5)).alias("af"))
    sites = sites.withColumn("snp", F.concat_ws(":", "chrom", "pos", "ref", "alt"))
    r = reads.read_filter(reads_of(spark, o.sam), 0xF04, int(o.min_mq)).select(
        "chrom", "pos", "cigar", "seq", "qual", F.col("tags")[cell_tag].alias("cell"), F.col("tags")["UB"].alias("umi"), "qname"
    )
    b = reads.usable_bases(reads.base_at(r.filter("cell is not null"), sites), int(o.min_bq))
    allele = F.when(F.col("base") == F.col("ref"), 0).when(F.col("base") == F.col("alt"), 1).otherwise(2)
    b = b.select("cell", "snp", F.coalesce("umi", "qname").alias("umi"), allele.alias("allele"), "bq", F.struct("pos", "qname").alias("ord"))
    return pileup.umi_collapse(b), sites


@command("dsc-pileup", "sam", "vcf", "min-mq=20", "min-bq=13")
def _pileup(spark, o):
    collapsed, _ = bases_of(spark, o)
    return sinks.pileup_strings(collapsed)


@command("demultiplex", "sam", "vcf", "min-mq=20", "min-bq=13", "geno-error=0.1")
def _demultiplex(spark, o):
    collapsed, _ = bases_of(spark, o)
    return pileup.demultiplex(collapsed, pileup.genotype_shares(coded(spark, o.vcf), float(o.geno_error)))


@command("cluster-cells", "plp", "nsample", "rounds=10")
def _cluster_cells(spark, o):
    _, snps, bases = text.read_pileup(spark, o.plp)
    nine = cut(pileup.nine_state(bases))
    start = clustering.seed_clusters(nine, snps, pileup.singlet_score(nine, snps), int(o.nsample))
    return clustering.cluster_cells(nine, snps, start, rounds=int(o.rounds))[0]


@command("sc-map-stamps", "fastq", "length=12")
def _stamps(spark, o):
    return pileup.prefix_histogram(text.read_fastq(spark, o.fastq, int(o.length)), tuple(range(9, int(o.length) + 1)))


@command("dge-barcode-summary", "mtx")
def _dge(spark, o):
    counts, barcodes, _ = text.read_matrix(spark, o.mtx)
    return pileup.dge_sums(counts, "cell").join(barcodes, "cell")


@command("transcript-count", "sam", "max-nm=3")
def _transcripts(spark, o):
    r = reads_of(spark, o.sam)
    cell, umi = reads.barcode_from_name(F.col("qname"))
    hits = r.select(
        cell.alias("cell"), umi.alias("umi"), F.col("chrom").alias("tx"), F.col("qname").alias("read_id"),
        F.coalesce(F.col("tags")["NH"].cast("int"), F.lit(1)).alias("nh"), F.coalesce(F.col("tags")["NM"].cast("int"), F.lit(0)).alias("nm"),
    )
    return pileup.umi_counts(hits.filter("tx is not null"), int(o.max_nm))


@command("vcf-paste-calls", "vcfs")
def _paste(spark, o):
    """Samples of several call sets (paths between commas) side by side, in the long form."""
    parts = [coded(spark, p).select("sample", "snp", "code", "dp", "gq") for p in o.vcfs.split(",")]
    return variants.union_samples(*parts)


@command("vcf-merge-candidate-variants", "vcfs", "max-samples=10")
def _candidates(spark, o):
    """Variants seen in any of several call sets: best quality, support and a bounded sample of names."""
    parts = []
    for p in o.vcfs.split(","):
        sites = sites_of(spark, p).select(F.concat_ws(":", "chrom", "pos", "ref", F.array_join("alts", ",")).alias("snp"), "qual")
        parts.append(coded(spark, p).filter("code > 1").join(sites, "snp").select("sample", "snp", "qual", F.coalesce("dp", F.lit(0)).alias("dp")))
    out = variants.merge_candidates(variants.union_samples(*parts), ["snp"], int(o.max_samples))
    return out.withColumn("samples", F.array_join("samples", ","))


@command("vcf-site-filter", "vcf", "min-call-rate=0", "min-mac=0", "min-maf=0", "max-maf=0.5")
def _sites(spark, o):
    counts = variants.site_counts(coded(spark, o.vcf))
    return variants.site_filter(counts, float(o.min_call_rate), int(o.min_mac), float(o.min_maf), float(o.max_maf))


@command("mix-barcodes", "sam", "pairs", "drop-other=")
def _mix(spark, o):
    from strandline.functions.scalar import unit_hash

    c = F.split("value", "\t")
    alpha = F.coalesce(F.get(c, F.lit(2)).try_cast("double"), F.lit(0.5))
    pairs = spark.read.text(o.pairs).select(
        F.get(c, F.lit(0)).alias("barcode1"), F.get(c, F.lit(1)).alias("barcode2"), alpha.alias("alpha"),
        F.coalesce(F.get(c, F.lit(3)).try_cast("double"), 1 - alpha).alias("beta"),
    )
    r = reads_of(spark, o.sam).withColumn("barcode", F.col("tags")["CB"])
    return reads.mix_barcodes(r, pairs, unit_hash(F.col("tags")["UB"]), bool(o.drop_other)).select("qname", "chrom", "pos", "barcode")


@command("procap-ends", "sam", "min-mq=0")
def _procap(spark, o):
    r = reads.read_filter(reads_of(spark, o.sam), 0xF04, int(o.min_mq))
    end = F.col("pos") + reads.aligned_length(F.col("cigar")) - 1
    rows = r.select("chrom", F.col("pos").alias("beg"), end.alias("end"), (F.col("flag").bitwiseAND(16) == 0).alias("fwd"), F.coalesce(F.col("tags")["UB"], "qname").alias("umi"))
    return reads.procap_ends(rows)


@command("dense-genotype", "sams", "vcf", "regions=", "min-mq=0", "contamination=0.01")
def _dense_genotype(spark, o):
    """Genotypes of a VCF's variants in many samples (NAME=PATH between commas), of BAM files by their index."""
    parts = []
    for said in o.sams.split(","):
        name, _, path = said.partition("=")
        parts.append(reads_of(spark, path, o.regions or None).withColumn("sample", F.lit(name)))
    all_reads = parts[0]
    for p in parts[1:]:
        all_reads = all_reads.unionByName(p)
    sites = sites_of(spark, o.vcf, o.regions or None).filter(F.size("alts") == 1).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))
    sites = sites.withColumn("snp", F.concat_ws(":", "chrom", "pos", "ref", "alt"))
    samples = spark.createDataFrame([(s.partition("=")[0], float(o.contamination)) for s in o.sams.split(",")], "sample string, contamination double")
    return dense.dense_genotypes(all_reads, sites, samples, min_mapq=int(o.min_mq))[0]


@command("element-umis", "sam", "gtf", "uniq-bin=1000000000", "whole=")
def _element_umis(spark, o):
    """UMIs of each cell at exons, transcripts and genes."""
    r = reads.read_filter(reads_of(spark, o.sam)).select(
        "chrom", "pos", "cigar", F.col("tags")["CB"].alias("cell"), F.coalesce(F.col("tags")["UB"], "qname").alias("umi"),
        F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-").alias("strand"),
    )
    stretches = reads.aligned_blocks(r.filter("cell is not null")).select("cell", "umi", "chrom", "strand", "beg", "end")
    return genes.element_umis(stretches, text.read_gtf(spark, o.gtf), int(o.uniq_bin), bool(o.whole))


@command("make-dge", "sam", "gtf")
def _make_dge(spark, o):
    """UMIs of each cell and gene: aligned blocks of reads on exons of their strand."""
    r = reads.read_filter(reads_of(spark, o.sam)).select(
        "chrom", "pos", "cigar", F.col("tags")["CB"].alias("cell"), F.coalesce(F.col("tags")["UB"], "qname").alias("umi"),
        F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-").alias("strand"),
    )
    hits = genotyping.gene_hits(reads.aligned_blocks(r.filter("cell is not null")), text.read_gtf(spark, o.gtf))
    return hits.groupBy("cell", "gene").agg(F.count(F.lit(1)).alias("umis"))


@command("dge-shuffle", "mtx", "seed=1")
def _dge_shuffle(spark, o):
    """The matrix with its cells renamed at random: both orders are ranked and joined."""
    counts, barcodes, _ = text.read_matrix(spark, o.mtx)
    order = Window.orderBy(F.xxhash64(F.lit(int(o.seed)), "cell"), "cell")
    renamed = barcodes.withColumn("to", F.row_number().over(order)).select("cell", "to")
    return counts.join(renamed, "cell").select("gene", F.col("to").alias("cell"), "umis")


@command("vcf-normalize-depth", "vcf", "fasta", "width=200")
def _depth(spark, o):
    """Depth of X and Y relative to autosomes at equal GC, from the mean depth of each site."""
    width = int(o.width)
    sites = coded(spark, o.vcf).groupBy("chrom", "pos").agg(F.avg("dp").alias("dp"))
    name = F.regexp_replace("chrom", "^chr", "")
    kind = F.when(name.rlike("^[0-9]+$"), "A").when(name.isin("X", "Y"), name)
    gc = sequence.gc_windows(text.read_fasta(spark, o.fasta), width, width, ["chrom"])
    keyed = sites.filter("dp is not null").withColumn("kind", kind).withColumn("bin", F.floor((F.col("pos") - 1) / width))
    return variants.depth_ratio(keyed.filter("kind is not null").join(gc, ["chrom", "bin"]).select("kind", "gc", "dp"))


@command("vcf-normal-form", "vcf", "fasta")
def _normal(spark, o):
    bins = text.sequence_bins(text.read_fasta(spark, o.fasta), 1000)
    v = sites_of(spark, o.vcf).select("chrom", "pos", "ref", F.explode("alts").alias("alt"))
    return genotyping.normalise(v, bins, 1000)


@command("sam-genotype", "sam", "vcf", "min-mq=20", "min-bq=13", "contamination=0")
def _genotype(spark, o):
    """PL of each read group at the SNPs of a VCF."""
    bases, _ = bases_of(spark, o, "RG")
    return genotyping.contaminated_pl(bases.withColumnRenamed("cell", "sample"), float(o.contamination))


@command("bed-shuffle", "bed", "places", "seed=1")
def _shuffle(spark, o):
    a = text.read_bed(spark, o.bed).drop("rest").withColumn("stratum", F.lit(0))
    b = text.read_bed(spark, o.places).drop("rest").withColumn("stratum", F.lit(0))
    return intervals.shuffle_intervals(a, b, int(o.seed))


@command("fasta-gc-content", "fasta", "window=100", "step=50")
def _gc(spark, o):
    return sequence.gc_windows(text.read_fasta(spark, o.fasta), int(o.window), int(o.step), ["chrom"])


@command("gtf-util", "gtf")
def _gtf(spark, o):
    return sinks.gene_predictions(text.read_gtf(spark, o.gtf))


@command("bgen2vcf", "bgen", "from=0", "nsnp=")
def _bgen(spark, o):
    rows = binary.read_bgen(spark, o.bgen, int(getattr(o, "from")), int(o.nsnp) if o.nsnp else None)
    return rows.withColumn("gp", F.to_json("gp"))


@command("vcf-update-sites", "vcf", "site-vcf=", "dbsnp=", "remove=", "replace=", "add=")
def _update_sites(spark, o):
    """INFO fields removed, replaced and added from a site file; names from a table of known variants."""
    names = lambda x: x.split(",") if x else None
    sites = sites_of(spark, o.vcf)
    other = sites_of(spark, o.site_vcf) if o.site_vcf else None
    out = variants.update_info(sites, other, names(o.remove), names(o.replace), names(o.add))
    if o.dbsnp:
        known = sites_of(spark, o.dbsnp).select(*variants.SITE_KEY, F.col("id").alias("_known"))
        out = variants.join_sites(out, known, variants.SITE_KEY, "left").withColumn("id", F.coalesce("_known", "id")).drop("_known")
    return out.withColumn("info", F.to_json("info")).withColumns({c: F.array_join(c, ",") for c in ("alts", "filters")})


@command("vcf-delta-svm", "vcf", "fasta", "model", "flank=10")
def _delta(spark, o):
    """Change of a model's score by each alternate allele of SNPs, in the reference around it."""
    width, flank = 1000, int(o.flank)
    bins = text.sequence_bins(text.read_fasta(spark, o.fasta), width)
    near = lambda k, name: bins.select("chrom", (F.col("bin") + k).alias("bin"), F.col("seq").alias(name))
    v = sites_of(spark, o.vcf).filter(F.length("ref") == 1).select("chrom", "pos", "ref", F.explode("alts").alias("alt"))
    v = v.withColumn("bin", F.floor((F.col("pos") - 1) / width).cast("int"))
    for k, name in ((0, "own"), (1, "before"), (-1, "after")):
        v = v.join(near(k, name), ["chrom", "bin"], "inner" if k == 0 else "left")
    inside = ((F.col("pos") - 1) % width).cast("int")
    left = F.right(F.concat(F.coalesce("before", F.lit("")), F.left("own", inside)), F.lit(flank))
    right = F.left(F.concat(F.substring(F.col("own"), inside + 2, F.lit(width)), F.coalesce("after", F.lit(""))), F.lit(flank))
    rows = v.select("chrom", "pos", "ref", "alt", left.alias("left"), right.alias("right"))
    model, said = gapped.load_words(spark, o.model)
    weights = gapped.mismatch_weights(*[said[k] for k in ("kind", "length", "k", "most")])
    for allele in ("ref", "alt"):
        rows = rows.withColumn("_s", F.concat("left", allele, "right"))
        rows = gapped.sequence_scores(rows, model, weights, said["peak"], said["half"], "_s", f"_{allele}")
    return rows.select("chrom", "pos", "ref", "alt", (F.col("_alt") - F.col("_ref")).alias("delta"))


@command(
    "bed-delta-svm-train", "positive", "negative", "fasta", "model", "kind=est_trunc", "length=10", "k=6", "mismatches=3", "peak=0", "half=50", "c=1", "positive-weight=1", "epsilon=0.001",
    "rounds=60", "folds=0", "predictions=",
)
def _train(spark, o):
    """A classifier of two sets of regions of any size; with ``folds``, the scores of each fold by the others go to ``predictions``."""
    bins = text.sequence_bins(text.read_fasta(spark, o.fasta), 1000)
    found = None
    for path, label in ((o.positive, 1), (o.negative, 0)):
        spans = text.read_bed(spark, path).select("chrom", "beg", "end").distinct()
        spread = spans.withColumn("bin", F.explode(F.sequence(F.floor((F.col("beg") - 1) / 1000), F.floor((F.col("end") - 1) / 1000))))
        parts = spread.join(bins, ["chrom", "bin"]).groupBy("chrom", "beg", "end").agg(F.sort_array(F.collect_list(F.struct("bin", "seq"))).alias("p"))
        whole = F.array_join(F.transform("p", lambda x: x["seq"]), "")
        seq = F.substring(whole, ((F.col("beg") - 1) % 1000 + 1).cast("int"), (F.col("end") - F.col("beg") + 1).cast("int"))
        rows = parts.select("chrom", "beg", "end", seq.alias("sequence"), F.lit(label).alias("label"))
        found = rows if found is None else found.unionByName(rows)
    said = {"kind": o.kind, "length": int(o.length), "k": int(o.k), "most": int(o.mismatches), "peak": int(o.peak), "half": float(o.half)}
    weights = gapped.mismatch_weights(*[said[k] for k in ("kind", "length", "k", "most")])
    ready = gapped.cut(gapped.prepared(found, weights, said["peak"], said["half"]))
    training = {"c": float(o.c), "positive": float(o.positive_weight), "rounds": int(o.rounds), "epsilon": float(o.epsilon)}
    model = gapped.train_words(ready, weights, **training)
    gapped.save_words(spark, model, said, o.model)
    if int(o.folds) > 1 and o.predictions:
        place = F.concat_ws(":", "chrom", F.col("beg").cast("string"), F.col("end").cast("string"))
        scores = gapped.fold_scores(ready.withColumn("region", place), weights, "region", int(o.folds), **training)
        scores.write.mode("overwrite").csv(o.predictions, sep="\t", header=True)
    return ready.agg(F.count(F.lit(1)).alias("sequences")).withColumns({"objective": F.lit(model["objective"]), "gap": F.lit(model["gap"])})


@command("cram-verify-bam", "sam", "vcf", "model-vcf", "max-pc=2", "min-mq=20", "min-bq=13")
def _verify_bam(spark, o):
    """Contamination of each read group from its bases at the sites of a reference panel."""
    dosages = coded(spark, o.model_vcf).select("sample", "snp", F.when(F.col("code") > 0, F.col("code") - 1.0).alias("ds"))
    ud, _ = kernels.principal_components(dosages, int(o.max_pc))
    bases, _ = bases_of(spark, o, "RG")
    out = kernels.contamination(bases.withColumnRenamed("cell", "sample").filter("allele < 2").select("sample", "snp", "allele", "bq"), ud, int(o.max_pc))
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("pcs", "pcs_other")})


@command("verify-pair-id", "sam", "vcf", "min-mq=20", "min-bq=13", "geno-error=0.1", "alphas=0,0.1,0.2,0.3,0.4,0.5")
def _verify_pair(spark, o):
    collapsed, _ = bases_of(spark, o)
    shares = pileup.genotype_shares(coded(spark, o.vcf), float(o.geno_error))
    return genotyping.verify_pairs(genotyping.pair_likelihoods(collapsed, shares, tuple(float(a) for a in o.alphas.split(","))))


@command("freemux2", "plp", "nsample", "rounds=10")
def _freemux2(spark, o):
    """Clusters of cells by greedy assignment in the order of their singlet scores, then by EM."""
    _, snps, bases = text.read_pileup(spark, o.plp)
    nine = cut(pileup.nine_state(bases))
    start = clustering.greedy_clusters(nine, snps, pileup.singlet_score(nine, snps), int(o.nsample))
    return clustering.cluster_cells(nine, snps, start, rounds=int(o.rounds))[0]


@command("plp-find-mux-clust", "plp", "nsample")
def _mux_clusters(spark, o):
    _, snps, bases = text.read_pileup(spark, o.plp)
    nine = cut(pileup.nine_state(bases))
    return clustering.seed_clusters(nine, snps, pileup.singlet_score(nine, snps), int(o.nsample))


@command("mux-pileup", "sam", "vcf", "min-mq=20", "min-bq=13")
def _mux_pileup(spark, o):
    """Pileup strings with the frequency of each site from its genotypes."""
    collapsed, _ = bases_of(spark, o)
    afs = variants.site_counts(coded(spark, o.vcf)).select("snp", "af")
    return sinks.pileup_strings(collapsed).join(afs, "snp")


@command("digital-pileup", "sam")
def _digital(spark, o):
    """Merged fragments of each cell and UMI, without strand."""
    r = reads.read_filter(reads_of(spark, o.sam)).select("chrom", "pos", "cigar", F.col("tags")["CB"].alias("cell"), F.coalesce(F.col("tags")["UB"], "qname").alias("umi"))
    blocks = reads.aligned_blocks(r.filter("cell is not null")).select("cell", "umi", "chrom", "beg", "end")
    merged = intervals.merge_intervals(blocks, ["cell", "umi", "chrom"])
    return merged.select("cell", "umi", F.concat_ws("", "chrom", F.lit(":"), F.col("beg").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("fragment"))


@command("dsc-dump", "sam", "vcf", "dump", "chunks=16", "min-mq=20", "min-bq=13")
def _dump(spark, o):
    """Bases by chunk of cells; the sites of the dump are the result."""
    collapsed, sites = bases_of(spark, o)
    profiles.write_dump(collapsed.select(F.col("cell").alias("barcode"), "umi", "snp", "bq"), o.dump, int(o.chunks))
    return sites


@command("dsc-dump2plp", "dump")
def _undump(spark, o):
    rows = profiles.read_dump(spark, o.dump)
    return rows.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("umi").alias("umis"), F.count_distinct("snp").alias("snps"))


@command("sc-multinom-em", "matrix", "clusters", "rounds=10", "per-cell=0", "per-gene=0")
def _multinom(spark, o):
    """Clusters of cells by a multinomial mixture, from a dense table of counts."""
    counts = pileup.enough_counts(profiles.read_dense_matrix(spark, o.matrix), int(o.per_cell), int(o.per_gene))
    k = int(o.clusters)
    start = counts.select("gene").distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = start.withColumn("w", (F.pmod(F.xxhash64("gene", "cluster"), F.lit(100)) + 1).cast("double"))
    start = start.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("cluster"))).select("cluster", "gene", "p")
    return pileup.mixture_em(counts, start, int(o.rounds))[0]


@command("sc-multinom-gibbs", "matrix", "clusters", "rounds=50", "seed=1")
def _gibbs(spark, o):
    """The same by Gibbs sampling: one chain on one machine, so the matrix must fit it."""
    counts = profiles.read_dense_matrix(spark, o.matrix).toPandas()
    return spark.createDataFrame(genotyping.mixture_gibbs(counts, int(o.clusters), int(o.rounds), seed=int(o.seed)))


@command("bed-matched-shuffle", "bed", "places", "fasta", "width=100", "bins=20", "seed=1")
def _matched(spark, o):
    """Each interval moved to a place of its GC stratum, without replacement."""
    width = int(o.width)
    gc = sequence.gc_windows(text.read_fasta(spark, o.fasta), width, width, ["chrom"])
    stratum = F.floor(F.coalesce("gc", F.lit(0)) * int(o.bins) / width).alias("stratum")
    strata = lambda path: profiles.gc_at(text.read_bed(spark, path).drop("rest").withColumn("pos", F.col("beg")), gc, width).select("chrom", "beg", "end", stratum)
    return intervals.shuffle_intervals(strata(o.bed), strata(o.places), int(o.seed))


@command("m3vcf-subsample", "m3vcf", "haplotypes")
def _subsample(spark, o):
    """Alleles of some haplotypes (numbers from 0 between commas) of a file of haplotype blocks."""
    wanted = [int(h) for h in o.haplotypes.split(",")]
    return binary.haplotype_alleles(binary.read_haplotype_blocks(spark, o.m3vcf), wanted)


@command("vcf-ref-phase", "vcf", "size=8")
def _ref_phase(spark, o):
    """Haplotypes of blocks of common variants and the carriers of the rare ones between them."""
    return variants.haplotype_blocks(text.read_genotypes(spark, o.vcf), int(o.size))


@command("run-test", "tsv")
def _run_test(spark, o):
    return spark.read.text(o.tsv).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("characters"))


@command("tsv-util", "tsv")
def _tsv(spark, o):
    return spark.read.text(o.tsv).select(F.array_join(F.transform(F.split("value", r"\s+"), lambda x: x.try_cast("double").cast("string")), "\t", "NA").alias("value"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandline")
    under = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = under.add_parser(name)
        sub.add_argument("--out", required=True)
        for option in options:
            key, has, default = option.partition("=")
            sub.add_argument(f"--{key}", required=not has, default=default or None)
    o = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"strandline {o.command}").getOrCreate()
    sinks.write_tsv(COMMANDS[o.command][0](spark, o), o.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
