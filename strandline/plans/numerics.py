"""Queries of scalar functions, order-sensitive operators, iterations unrolled in SQL, and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import filter_expr, scalar
from strandline.operators import clustering, kernels
from strandline.operators import genotyping as gt
from strandline.operators import intervals as iv
from strandline.operators import pileup as pl
from strandline.operators import reads as rd
from strandline.operators import sequence as sq
from strandline.operators import variants as vr
from strandline.operators.lineage import cut
from strandline.plans import views
from strandline.plans.formats import _FIVE, _path, _sam, _sites, SAM_SQL, SITE_SQL
from strandline.plans.queries import (
    _COR, _CT, _DS, _E, _H, _ONE, _SHARE, _TWO, _collapsed, _em_sql, _hits, _read, CI, COLLAPSED_SQL, HITS_SQL, NINE_SQL, PLS_SQL, SITES_SQL,
)
from strandline.plans.registry import query, rounded
from strandline.plans.views import INTERVALS_SQL, PANEL_SQL, READS_SQL, SNPS_SQL
from strandline.streaming.events import earliest_of_key, not_late, sliding_sums

# ---------------------------------------------------------------- scalar functions


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(a, b) * (greatest(a, b) + 1) // 2 + least(a, b) AS INT) g FROM (SELECT *, CAST(l_partkey % 4 AS INT) a, CAST(l_suppkey % 4 AS INT) b FROM lineitem)")
def genotype_indices(spark, d):
    a, b = (F.col("l_partkey") % 4).cast("int"), (F.col("l_suppkey") % 4).cast("int")
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.genotype_index(a, b).alias("g"))


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: (a * 101 + b) % 4294967296)"


@query(f"SELECT c_custkey, round(({_HASH.format('c_name')} % 65535 + 0.5) / 65535, 9) u FROM customer")
def unit_hashes(spark, d):
    return _read(spark, d, "customer").select("c_custkey", F.round(scalar.unit_hash(F.col("c_name")), 9).alias("u"))


@query(
    "SELECT p_partkey, 'chr' || p_size AS chrom, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 ELSE p_partkey + 1 END AS INT) beg, "
    "CAST(CASE p_partkey % 3 WHEN 0 THEN 536870911 WHEN 1 THEN p_partkey + 1 ELSE p_partkey + 1001 END AS INT) \"end\" FROM part"
)
def parse_regions(spark, d):
    k, s = F.col("p_partkey") % 3, lambda c: c.cast("string")
    chrom = F.concat(F.lit("chr"), s(F.col("p_size")))
    one = F.concat(chrom, F.lit(":"), F.format_number(F.col("p_partkey") + 1, 0))
    said = F.when(k == 0, chrom).when(k == 1, one).otherwise(F.concat(one, F.lit("-"), s(F.col("p_partkey") + 1001)))
    r = scalar.parse_region(said)
    return _read(spark, d, "part").select("p_partkey", r["chrom"].alias("chrom"), r["beg"].alias("beg"), r["end"].alias("end"))


@query(f"WITH {SITE_SQL} SELECT p_partkey, chrom || ':' || pos || ':' || ref || ':' || alt AS id, chrom, pos, CAST(len(string_split(alt, ',')) AS INT) n FROM site")
def variant_names(spark, d):
    named = _sites(spark, d).select((F.col("pos") - 1).cast("long").alias("p_partkey"), scalar.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alts")).alias("id"))
    v = scalar.parse_variant_id(F.col("id"))
    return named.select("p_partkey", "id", v["chrom"].alias("chrom"), v["pos"].alias("pos"), F.size(v["alts"]).alias("n"))


@query("SELECT c_custkey, s, reverse(translate(s, 'ACGT', 'TGCA')) rc FROM (SELECT c_custkey, regexp_replace(translate(c_mktsegment || c_name, 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g') s FROM customer)")
def clean_sequences(spark, d):
    rows = _read(spark, d, "customer").select("c_custkey", scalar.clean_sequence(F.concat("c_mktsegment", "c_name")).alias("s"))
    return rows.withColumn("rc", scalar.reverse_complement(F.col("s")))


@query("SELECT c_custkey, k AS kmer, CAST(count(*) AS BIGINT) n FROM (SELECT c_custkey, substring(c_name, CAST(i AS INT), 4) k FROM (SELECT c_custkey, c_name, unnest(range(1, length(c_name) - 2)) i FROM customer)) GROUP BY 1, 2")
def kmer_counts(spark, d):
    return sq.kmer_counts(_read(spark, d, "customer"), 4, ["c_custkey"], "c_name")


_LOGB = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})"


@query(f"SELECT n, k, round({_LOGB.format(p='0.01::DOUBLE')}, 5) low, round({_LOGB.format(p='0.5::DOUBLE')}, 5) half FROM (SELECT DISTINCT CAST(l_quantity AS INT) n, CAST(l_partkey % (CAST(l_quantity AS INT) + 1) AS INT) k FROM lineitem)")
def log_binomials(spark, d):
    n = F.col("l_quantity").cast("int")
    rows = _read(spark, d, "lineitem").select(n.alias("n"), (F.col("l_partkey") % (n + 1)).cast("int").alias("k")).distinct()
    value = lambda p: F.round(scalar.log_binomial(F.col("n"), F.col("k"), p, 64), 5)
    return rows.select("n", "k", value(0.01).alias("low"), value(0.5).alias("half"))


@query("SELECT l_linenumber q, round(CASE WHEN l_linenumber <= 1 THEN 0.75 ELSE pow(10.0, -l_linenumber / 10.0) END, 9) e, CAST(count(*) AS BIGINT) n FROM lineitem GROUP BY 1")
def phred_errors(spark, d):
    rows = _read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("q", F.round(scalar.error_of(F.col("q")), 9).alias("e"), "n")


@query(
    "SELECT c, p, CASE WHEN c IN ('X', 'chrX') THEN CASE WHEN p BETWEEN 2699520 AND 154931044 THEN 'X' END WHEN c IN ('Y', 'chrY') THEN 'Y' WHEN regexp_matches(c, '^(chr)?[0-9]+$') THEN 'A' END kind "
    "FROM (SELECT CASE o_custkey % 5 WHEN 0 THEN 'chrX' WHEN 1 THEN '7' WHEN 2 THEN 'chrY' WHEN 3 THEN 'MT' ELSE 'chr21' END c, CAST(o_orderkey * 997 AS INT) p FROM orders)"
)
def chromosome_kinds(spark, d):
    k = F.col("o_custkey") % 5
    c = F.when(k == 0, "chrX").when(k == 1, "7").when(k == 2, "chrY").when(k == 3, "MT").otherwise("chr21")
    rows = _read(spark, d, "orders").select(c.alias("c"), (F.col("o_orderkey") * 997).cast("int").alias("p"))
    return rows.select("c", "p", scalar.chrom_kind(F.col("c"), F.col("p")).alias("kind"))


_RA = (
    "CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'A' WHEN 3 THEN 'C' WHEN 4 THEN 'GTT' ELSE 'CA' END r, "
    "CASE p_size % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'A' WHEN 2 THEN 'ACC' WHEN 3 THEN 'G' WHEN 4 THEN 'GTA' ELSE 'CG' END a"
)


@query(
    f"SELECT p_partkey, CASE WHEN length(a) > length(r) THEN 'ins' WHEN length(a) < length(r) THEN 'del' WHEN p_size % 6 IN (0, 5) THEN 'ts' ELSE 'tv' END change FROM (SELECT p_partkey, p_size, {_RA} FROM part)"
)
def variant_changes(spark, d):
    """Transitions, transversions, insertions and deletions."""
    k = F.col("p_size") % 6
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    ref, alt = pick("A", "AC", "A", "C", "GTT", "CA"), pick("G", "A", "ACC", "G", "GTA", "CG")
    return _read(spark, d, "part").select("p_partkey", scalar.change_kind(ref, alt).alias("change"))


# ---------------------------------------------------------------- filters that need names, files or functions


@query(f"WITH {SITE_SQL} SELECT chrom, pos FROM site WHERE (regexp_matches(nm, '^Brand#1') AND list_contains(string_split(alt, ','), 'T')) OR qual * 2 + 1 > 97")
def expression_user_functions(spark, d):
    """Text fields, an index into a vector, and a caller's own function."""
    rows = _sites(spark, d).withColumn("samples", F.array().cast("array<map<string,string>>"))
    said = '(NM ~ "^Brand_1" && ALT[1-] = "T") || DOUBLED(QUAL) > 97'
    return filter_expr.apply_filters(rows, said, strings={"NM"}, info={"NM"}, functions={"DOUBLED": lambda x: 2 * x + 1}).select("chrom", "pos")


@query(f"WITH {SITE_SQL} SELECT chrom, pos FROM site WHERE p_partkey % 100 = 7")
def expression_file_list(spark, d):
    """Names in a file, which meet the rows in a join."""
    rows = _sites(spark, d).withColumn("samples", F.array().cast("array<map<string,string>>"))
    path = _path(spark, "names")
    rows.filter("(pos - 1) % 100 = 7").select("id").write.text(path)
    return filter_expr.apply_filters(rows, "ID = @names", lists={"names": ("id", spark.read.text(path))}).select("chrom", "pos")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CAST('0x' || substr(md5('1:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 8) AS BIGINT) / 4294967296 < 0.1")
def thinned_reads(spark, d):
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return vr.thin(rows, 0.1, "l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {SITE_SQL} SELECT chrom, pos, alt FROM site WHERE alt NOT LIKE '%,%'")
def biallelic_sites(spark, d):
    return vr.plain_site_filter(_sites(spark, d), max_alleles=2).filter(~F.exists("alts", lambda a: a.rlike("^<VNTR"))).select("chrom", "pos", F.get("alts", F.lit(0)).alias("alt"))


# ---------------------------------------------------------------- joins and set operations


@query(f"WITH {PANEL_SQL} SELECT sample, snp, code, dp * 2 dp2 FROM panel")
def positional_zip(spark, d):
    panel = views.panel(spark, d)
    return vr.zip_sites(panel.select("sample", "snp", "code"), panel.select("sample", "snp", (F.col("dp") * 2).alias("dp2")), ["sample", "snp"])


@query(f"WITH {PANEL_SQL} SELECT sample, snp, code FROM panel WHERE sample < 4 UNION ALL SELECT sample + 100, snp, code FROM panel WHERE sample >= 4")
def pasted_call_sets(spark, d):
    panel = views.panel(spark, d).select("sample", "snp", "code")
    return vr.union_samples(panel.filter("sample < 4"), panel.filter("sample >= 4").withColumn("sample", F.col("sample") + 100))


@query(f"WITH {PANEL_SQL} SELECT sex, snp, CAST(sum(greatest(code - 1, 0)) AS BIGINT) ac FROM (SELECT *, CASE WHEN sample % 2 = 0 THEN 'male' ELSE 'female' END sex FROM panel) GROUP BY 1, 2")
def allele_counts_by_sex(spark, d):
    """Genotypes joined with a table of samples."""
    panel = views.panel(spark, d)
    sexes = panel.select("sample").distinct().withColumn("sex", F.when(F.col("sample") % 2 == 0, "male").otherwise("female"))
    return panel.join(sexes, "sample").groupBy("sex", "snp").agg(F.sum(F.greatest(F.col("code") - 1, F.lit(0))).cast("long").alias("ac"))


@query(f"WITH {SAM_SQL} SELECT qname, chrom, pos, CASE WHEN flag & 16 = 0 THEN 1 ELSE 2 END mate FROM sam")
def merged_mates(spark, d):
    r = _sam(spark, d).select("qname", "chrom", "pos", "flag")
    ahead = F.col("flag").bitwiseAND(16) == 0
    return rd.merge_mates(r.filter(ahead), r.filter(~ahead), ["chrom", "pos", "qname"]).select("qname", "chrom", "pos", "mate")


@query(f"WITH {SITE_SQL}, a AS (SELECT chrom, pos FROM site WHERE qual > 15), b AS (SELECT chrom, pos FROM site WHERE qual < 30) SELECT chrom, pos, 'both' k FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT chrom, pos, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def site_set_operations(spark, d):
    s = _sites(spark, d)
    a, b = s.filter("qual > 15").select("chrom", "pos"), s.filter("qual < 30").select("chrom", "pos")
    return a.intersect(b).withColumn("k", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("k", F.lit("first")))


@query(f"WITH {SITE_SQL}, o AS (SELECT chrom, pos, row_number() OVER (ORDER BY CAST(chrom AS INT), pos) n FROM site) SELECT chrom, pos, CAST(n AS INT) n FROM o WHERE n BETWEEN 101 AND 150")
def variants_in_order(spark, d):
    """The variants from the 101st on in genomic order, fifty of them."""
    keyed = _sites(spark, d).select(scalar.chrom_rank(F.col("chrom")).alias("rank"), "chrom", "pos")
    return vr.rows_between(keyed, ["rank", "pos"], 101, 150).select("chrom", "pos", "n")


@query(f'WITH {INTERVALS_SQL}, m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM ivl) SELECT chrom, CAST(sum(greatest("end" - greatest(beg, coalesce(r + 1, beg)) + 1, 0)) AS BIGINT) length FROM m GROUP BY chrom')
def merged_length(spark, d):
    return iv.total_length(iv.merge_intervals(views.intervals(spark, d).drop("target")))


@query(f'WITH {INTERVALS_SQL}, p AS (SELECT DISTINCT CAST(o_custkey % 22 AS INT) chrom, CAST(o_orderkey % 2500 AS INT) pos FROM orders) SELECT p.chrom, p.pos, CAST(count(*) AS BIGINT) n FROM p JOIN ivl ON ivl.chrom = p.chrom AND p.pos BETWEEN beg AND "end" GROUP BY 1, 2')
def points_in_intervals(spark, d):
    points = _read(spark, d, "orders").select((F.col("o_custkey") % 22).cast("int").alias("chrom"), (F.col("o_orderkey") % 2500).cast("int").alias("pos")).distinct()
    return iv.point_join(points, views.intervals(spark, d), ["chrom"], "pos", 32).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {INTERVALS_SQL} SELECT a.id, b.id id2 FROM ivl a JOIN ivl b ON a.chrom = b.chrom AND a.beg >= b.beg AND a."end" <= b."end" AND a.id <> b.id')
def contained_intervals(spark, d):
    v = views.intervals(spark, d).drop("target")
    return iv.overlap_join(v, v.withColumnRenamed("id", "id2"), ["chrom"], 32, "contained", alike=True).filter("id <> id2").select("id", "id2")


# ---------------------------------------------------------------- order-sensitive operators


@query(f"WITH {READS_SQL}, {SNPS_SQL}, {COLLAPSED_SQL}, {NINE_SQL}, s AS (SELECT cell, round(sum(ln({_ONE})) - sum(ln({_TWO})), 5) score FROM gl JOIN snps USING (snp) GROUP BY cell) SELECT cell, CAST(row_number() OVER (ORDER BY score DESC, cell DESC) AS INT) AS rank FROM s")
def singlet_ranks(spark, d):
    scores = rounded(pl.singlet_score(pl.nine_state(_collapsed(spark, d)), views.snps(spark, d)), "score", digits=5)
    return clustering.ranked_cells(scores)


@query("WITH c AS (SELECT c_custkey k, md5('1:' || c_custkey) h FROM customer), a AS (SELECT k, row_number() OVER (ORDER BY k) r FROM c), b AS (SELECT k AS shuffled, row_number() OVER (ORDER BY h, k) r FROM c) SELECT k, shuffled FROM a JOIN b USING (r)")
def permuted_names(spark, d):
    return clustering.permuted(_read(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", 1).withColumnRenamed("to", "shuffled")


_CLUSTERS = (
    "s AS (SELECT DISTINCT CAST(o_custkey % 22 AS INT) chrom, CAST(o_orderkey % 5000 AS INT) pos FROM orders), "
    "g AS (SELECT *, coalesce(CAST(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) >= 4 AS INT), 0) nw FROM s), k AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY pos) c FROM g)"
)


@query(f"WITH {_CLUSTERS} SELECT chrom, arg_min(pos, md5('1:' || chrom || ':' || pos)) pos, CAST(count(*) AS BIGINT) n FROM k GROUP BY chrom, c")
def cluster_representatives(spark, d):
    """One site of each cluster of near ones, drawn by a seeded hash."""
    sites = _read(spark, d, "orders").selectExpr("cast(o_custkey % 22 as int) as chrom", "cast(o_orderkey % 5000 as int) as pos").distinct()
    return vr.one_per_cluster(vr.gap_clusters(sites, 4, ["chrom"], "pos"), ["chrom", "cluster"], ["chrom", "pos"], 1).select("chrom", "pos", "n")


_PAIRS = (
    f"e AS (SELECT chrom, CAST({_FIVE} AS INT) pos, flag & 16 = 0 fwd, CAST(count(*) AS BIGINT) w FROM sam GROUP BY 1, 2, 3), "
    "m AS (SELECT a.chrom, a.pos plus, b.pos minus, a.w pw, b.w mw, a.pos - b.pos far FROM e a JOIN e b ON a.chrom = b.chrom AND a.fwd AND NOT b.fwd AND b.pos BETWEEN a.pos - 40 AND a.pos), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY chrom, plus ORDER BY mw DESC, far, minus) x, row_number() OVER (PARTITION BY chrom, minus ORDER BY pw DESC, far, plus) y FROM m)"
)


@query(f"WITH {SAM_SQL}, {_PAIRS} SELECT chrom, plus, minus FROM p WHERE x = 1 AND y = 1")
def peak_pairs(spark, d):
    r = _sam(spark, d)
    end = F.col("pos") + rd.aligned_length(F.col("cigar")) - 1
    fwd = F.col("flag").bitwiseAND(16) == 0
    ends = r.select("chrom", F.when(fwd, F.col("pos")).otherwise(end).alias("pos"), fwd.alias("fwd")).groupBy("chrom", "pos", "fwd").agg(F.count(F.lit(1)).alias("w"))
    return rd.pair_peaks(ends.filter("fwd"), ends.filter("not fwd"), 40)


# ---------------------------------------------------------------- samples and candidates

_AFB = (0.25, 0.5, 1.0)
_KINDS = (("SNP", "snp % 4 > 0"), ("OTH", "snp % 4 = 0"))
_BY_KIND = ", ".join(f"{CI.format('code IN (' + ','.join(map(str, c)) + f') AND {w}')} \"{n}_{t}\"" for n, c in vr.SNP_MASKS.items() for t, w in _KINDS)
_BY_AF = ", ".join(f"{CI.format(f'code IN (2,3) AND af > {lo} AND af <= {hi} AND {w}')} AF_{int(hi * 1000)}_{t}" for lo, hi in zip((0.0, *_AFB), _AFB) for t, w in _KINDS)


@query(f"WITH {PANEL_SQL}, {SITES_SQL} SELECT sample, {_BY_KIND}, {_BY_AF} FROM panel JOIN sites USING (snp) GROUP BY sample")
def sample_summary_by_kind(spark, d):
    panel = views.panel(spark, d)
    joined = panel.join(vr.site_counts(panel).select("snp", "af"), "snp").withColumn("is_snp", F.col("snp") % 4 > 0)
    return vr.sample_summary_by_kind(joined, _AFB)


@query(
    f"WITH {READS_SQL}, p AS (SELECT cell, snp, count(*)::DOUBLE n, sum(allele)::DOUBLE a, sum(umi)::DOUBLE q, sum(umi*umi)::DOUBLE qq, sum(umi*allele)::DOUBLE qa, sum(bq*7%11)::DOUBLE s, "
    "sum((bq*7%11)*(bq*7%11))::DOUBLE ss, sum((bq*7%11)*allele)::DOUBLE sa, avg(bq % 5) FILTER (WHERE allele = 0) m0, avg(bq % 5) FILTER (WHERE allele = 1) m1 FROM reads WHERE allele < 2 GROUP BY 1, 2), "
    "w AS (SELECT *, ln(n + 1) w FROM p) SELECT snp, "
    f"round(sum(sqrt(n)*w*({_COR.format(x='q', xx='qq', xa='qa')})) / sqrt(sum(w*w)), 6) mqz, round(sum(sqrt(n)*w*({_COR.format(x='s', xx='ss', xa='sa')})) / sqrt(sum(w*w)), 6) cyz, "
    "round(sum(w*m0) / sum(w) FILTER (WHERE m0 IS NOT NULL), 6) nm0, round(sum(w*m1) / sum(w) FILTER (WHERE m1 IS NOT NULL), 6) nm1 FROM w GROUP BY snp"
)
def site_statistics_of_reads(spark, d):
    """Correlation of the allele with mapping quality and cycle, and mean mismatches of reads by allele."""
    bases = views.reads(spark, d).withColumnRenamed("cell", "sample").withColumn("cycle", F.col("bq") * 7 % 11).withColumn("nm", F.col("bq") % 5)
    hets = bases.filter("allele < 2").groupBy("sample", "snp").agg(F.count_distinct("allele").alias("k")).filter("k = 2")
    sums = gt.sample_site_sums(bases, hets, {"mqz": "umi", "cyz": "cycle"}, "nm")
    return rounded(gt.site_statistics(sums).select("snp", "mqz", "cyz", "nm0", "nm1"), "mqz", "cyz", "nm0", "nm1")


_LB = "lgamma(dp + 1) - lgamma(ad + 1) - lgamma(dp - ad + 1) + ad * ln({p}) + (dp - ad) * ln(1 - {p})"
_ABB = ", ".join(f"{CI.format(f'least(floor(ad * 20 / greatest(dp, 1)::DOUBLE), 19) = {b}')} ab_{b}" for b in range(20))


@query(
    f"WITH {PANEL_SQL}, f AS (SELECT snp, gq qual, dp, CAST(gq % (dp + 1) AS INT) ad FROM panel WHERE code > 1) SELECT snp, max(qual) qual, CAST(count(*) AS BIGINT) n_samples, {_ABB} FROM f "
    f"WHERE qual >= 5 AND {_LB.format(p='0.01::DOUBLE')} <= {_LB.format(p='0.5::DOUBLE')} GROUP BY snp"
)
def candidate_variants(spark, d):
    """Candidates that pass the test of balance, merged over samples."""
    found = views.panel(spark, d).filter("code > 1").select("sample", "snp", F.col("gq").alias("qual"), "dp", (F.col("gq") % (F.col("dp") + 1)).cast("int").alias("ad"))
    return vr.merge_candidates(vr.likely_candidates(found, 5), ["snp"]).select("snp", "qual", "n_samples", *[f"ab_{b}" for b in range(20)])


# ---------------------------------------------------------------- iterations, unrolled in SQL


def _ploidy_sql(rounds: int) -> str:
    out = f"{PLS_SQL}, lik AS (SELECT snp, c, pow(10.0, -pl0/10.0) l0, pow(10.0, -pl1/10.0) l1, pow(10.0, -pl2/10.0) l2 FROM (SELECT *, CASE WHEN snp % 22 <> 20 OR sample % 2 = 1 THEN 2 WHEN sample % 4 = 0 THEN 0 ELSE 1 END c FROM pls) WHERE c > 0), "
    out += "em0 AS (SELECT DISTINCT snp, 0.5::DOUBLE af FROM lik)"
    for r in range(1, rounds + 1):
        out += (
            f", em{r} AS (SELECT snp, least(greatest(sum(CASE WHEN c = 1 THEN l2*af/(l0*(1-af) + l2*af) ELSE (2*af*(1-af)*l1 + 2*af*af*l2) / ((1-af)*(1-af)*l0 + 2*af*(1-af)*l1 + af*af*l2) END) / sum(c), "
            f"greatest(1e-5, 0.5/(2*count(*)+1))), 1 - greatest(1e-5, 0.5/(2*count(*)+1))) af, CAST(count(*) AS BIGINT) n FROM lik JOIN em{r - 1} USING (snp) GROUP BY snp)"
        )
    return out


@query(f"WITH {PANEL_SQL}, {_ploidy_sql(10)} SELECT snp, n, round(af, 6) af FROM em10")
def pooled_af_em_by_ploidy(spark, d):
    """Samples of two, one and no copies at the sites of one chromosome."""
    pls = vr.pl_from_gt(views.panel(spark, d))
    copies = F.when((F.col("snp") % 22 != 20) | (F.col("sample") % 2 == 1), 2).when(F.col("sample") % 4 == 0, 0).otherwise(1)
    return rounded(vr.pooled_af_em(pls.withColumn("copies", copies), ploidy="copies"), "af")


def _gf_sql(rounds: int) -> str:
    out = f"{PLS_SQL}, lik AS (SELECT snp, pow(10.0, -pl0/10.0) l0, pow(10.0, -pl1/10.0) l1, pow(10.0, -pl2/10.0) l2 FROM pls), "
    out += "f0 AS (SELECT DISTINCT snp, 1/3.0::DOUBLE g0, 1/3.0::DOUBLE g1, 1/3.0::DOUBLE g2, 0.5::DOUBLE p FROM lik)"
    free, own = "(l0*g0 + l1*g1 + l2*g2)", "(l0*(1-p)*(1-p) + l1*2*p*(1-p) + l2*p*p)"
    for r in range(1, rounds + 1):
        out += f", f{r} AS (SELECT snp, avg(l0*g0/{free}) g0, avg(l1*g1/{free}) g1, avg(l2*g2/{free}) g2, avg((l1*2*p*(1-p) + 2*l2*p*p)/{own})/2 p FROM lik JOIN f{r - 1} USING (snp) GROUP BY snp)"
    return out


_OWN = "(l0*(1-p)*(1-p) + l1*2*p*(1-p) + l2*p*p)"
_FREE = "(l0*g0 + l1*g1 + l2*g2)"


@query(
    f"WITH {PANEL_SQL}, {_gf_sql(12)} SELECT snp, round(p, 6) af, round(g0, 6) gf0, round(g1, 6) gf1, round(g2, 6) gf2, round(-2 * (sum(ln({_OWN})) - sum(ln({_FREE}))), 5) lrt, "
    f"round(1 - sum(l1*g1/{_FREE}) / sum(l1*2*p*(1-p)/{_OWN}), 5) f FROM lik JOIN f12 USING (snp) GROUP BY snp, p, g0, g1, g2"
)
def genotype_em_rounds(spark, d):
    """Twelve rounds of the frequencies with and without Hardy-Weinberg, their likelihood ratio and inbreeding."""
    pls = vr.pl_from_gt(views.panel(spark, d))
    like = pls.select("sample", "snp", *[F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0).alias(f"l{g}") for g in range(3)])
    out = kernels.genotype_em(like, rounds=12, enough=-1.0)
    return rounded(rounded(out, "af", "gf0", "gf1", "gf2"), "lrt", "f", digits=5)


_START = "start AS (SELECT gene, k cluster, (gene * 7 + k * 13) % 50 + 1.0::DOUBLE w FROM (SELECT DISTINCT tx gene FROM ct), (VALUES (0), (1)) t(k)), p0 AS (SELECT cluster, gene, w / sum(w) OVER (PARTITION BY cluster) p FROM start), s0 AS (SELECT DISTINCT cluster, 0.5::DOUBLE pi FROM start)"


def _mixture_sql(rounds: int) -> str:
    out = _START
    for r in range(1, rounds + 1):
        out += (
            f", l{r} AS (SELECT cell, cluster, sum((umis + 0.01) * ln(p)) + ln(any_value(pi)) ll FROM ct JOIN p{r - 1} ON gene = tx JOIN s{r - 1} USING (cluster) GROUP BY 1, 2), "
            f"z{r} AS (SELECT cell, cluster, exp(ll - m) / sum(exp(ll - m)) OVER (PARTITION BY cell) z FROM (SELECT *, max(ll) OVER (PARTITION BY cell) m FROM l{r})), "
            f"w{r} AS (SELECT cluster, tx gene, sum(z * (umis + 0.01)) w FROM ct JOIN z{r} USING (cell) GROUP BY 1, 2), "
            f"p{r} AS (SELECT cluster, gene, w / sum(w) OVER (PARTITION BY cluster) p FROM w{r}), s{r} AS (SELECT cluster, avg(z) pi FROM z{r} GROUP BY 1)"
        )
    return out


@query(f"WITH {READS_SQL}, {HITS_SQL}, {_CT}, {_mixture_sql(3)} SELECT cell, cluster, round(z, 5) z FROM z3")
def mixture_em(spark, d):
    counts = cut(pl.umi_counts(_hits(spark, d), 3).select("cell", F.col("tx").alias("gene"), "umis"))
    start = counts.select("gene").distinct().withColumn("cluster", F.explode(F.array(F.lit(0), F.lit(1))))
    start = start.withColumn("w", ((F.col("gene") * 7 + F.col("cluster") * 13) % 50 + 1).cast("double"))
    start = start.join(start.groupBy("cluster").agg(F.sum("w").alias("t")), "cluster").select("cluster", "gene", (F.col("w") / F.col("t")).alias("p"))
    return rounded(pl.mixture_em(counts, start, 3)[0], "z", digits=5)


_POST = [f"pow(10.0, -pl{g}/10.0)*{_H[g]}" for g in range(3)]


@query(
    f"WITH {PANEL_SQL}, {_em_sql(10)} SELECT sample, snp, " + ", ".join(f"round({_POST[g]} / ({' + '.join(_POST)}), 6) p{g}" for g in range(3)) + " FROM pls JOIN em10 USING (snp)"
)
def posterior_shares(spark, d):
    """Genotype shares from PL and the pooled frequency after ten rounds."""
    pls = vr.pl_from_gt(views.panel(spark, d))
    return rounded(pl.posterior_shares(pls, vr.pooled_af_em(pls)), "p0", "p1", "p2")


def _pair_sql(alpha: float, where: str) -> str:
    """Likelihoods of (cell, s1, s2) where a share of the bases comes from the second sample."""
    states = [(f"g{l}{k}", l / 2 + (k - l) * alpha / 2) for l in range(3) for k in range(3)]
    sums = ", ".join(f"sum(ln(CASE WHEN allele = 0 THEN m*(1-{p}) + e/3*{p} ELSE e/3*(1-{p}) + m*{p} END)) {n}" for n, p in states)
    top = "greatest(" + ", ".join(n for n, _ in states) + ")"
    scaled = ", ".join(f"exp({n} - {top}) + 1e-10 {n}" for n, _ in states)
    mixed = " + ".join(f"a.p{l}*b.p{k}*g{l}{k}" for l in range(3) for k in range(3))
    if alpha == 0:
        mixed = " + ".join(f"a.p{g}*g{g}{g}" for g in range(3))
    tag = str(alpha).replace(".", "_")
    return (
        f"lg{tag} AS (SELECT cell, snp, {sums} FROM b GROUP BY 1, 2), sc{tag} AS (SELECT cell, snp, {top} tp, {scaled} FROM lg{tag}), "
        f"ll{tag} AS (SELECT cell, a.sample s1, b.sample s2, {alpha}::DOUBLE alpha, sum(ln({mixed}) + tp) llk, CAST(count(*) AS BIGINT) n_snps FROM sc{tag} JOIN sh a USING (snp) JOIN sh b USING (snp) WHERE {where} GROUP BY 1, 2, 3)"
    )


_ALPHAS = ((0.0, "a.sample = b.sample"), (0.1, "a.sample <> b.sample"), (0.3, "a.sample <> b.sample"), (0.5, "a.sample < b.sample"))
_PAIR_PARTS = ", ".join(_pair_sql(a, w) for a, w in _ALPHAS)
_PAIR_ALL = " UNION ALL ".join(f"SELECT * FROM ll{str(a).replace('.', '_')}" for a, _ in _ALPHAS)


@query(
    f"WITH {READS_SQL}, {PANEL_SQL}, {COLLAPSED_SQL}, mean AS (SELECT snp, {', '.join(f'avg({_DS[g]}) m{g}' for g in range(3))} FROM panel WHERE code > 0 GROUP BY snp), "
    f"sh AS (SELECT sample, snp, {_SHARE} FROM panel JOIN mean USING (snp)), b AS (SELECT *, {_E} e, 1 - {_E} m FROM col WHERE allele < 2), {_PAIR_PARTS}, w AS ({_PAIR_ALL}), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY cell, alpha = 0 ORDER BY llk DESC, s1, s2, alpha DESC) r FROM w) "
    "SELECT cell, max(n_snps) n_snps, max(s1) FILTER (WHERE alpha = 0 AND r = 1) sm_id, round(max(llk) FILTER (WHERE alpha = 0 AND r = 1), 4) llk1, max(s1) FILTER (WHERE alpha > 0 AND r = 1) sm1_id, "
    "max(s2) FILTER (WHERE alpha > 0 AND r = 1) sm2_id, max(alpha) FILTER (WHERE alpha > 0 AND r = 1) alpha, round(max(llk) FILTER (WHERE alpha > 0 AND r = 1), 4) llk12, "
    "round(max(llk) FILTER (WHERE alpha > 0 AND r = 1) - max(llk) FILTER (WHERE alpha = 0 AND r = 1), 4) gain FROM r GROUP BY cell"
)
def verify_pairs(spark, d):
    llks = gt.pair_likelihoods(_collapsed(spark, d), pl.genotype_shares(views.panel(spark, d)), (0.0, 0.1, 0.3, 0.5))
    return rounded(gt.verify_pairs(llks), "llk1", "llk12", "gain", digits=4)


_L = ", ".join(f"sum(ln(g{g}{g})) l{g}" for g in range(3))
_CG = (
    f"fed AS (SELECT cell % 3 AS cluster, snp, any_value(af) af, CAST(sum(n_reads) AS BIGINT) dp, {_L} FROM gl JOIN snps USING (snp) GROUP BY 1, 2), "
    f"wt AS (SELECT *, {', '.join(f'{_H[g]} * exp(l{g} - greatest(l0, l1, l2)) w{g}' for g in range(3))} FROM fed), pr AS (SELECT *, {', '.join(f'w{g} / (w0 + w1 + w2) p{g}' for g in range(3))} FROM wt)"
)


@query(
    f"WITH {READS_SQL}, {SNPS_SQL}, {COLLAPSED_SQL}, {NINE_SQL}, {_CG} SELECT cluster, snp, dp, {', '.join(f'CAST(floor(-10 * (l{g} - greatest(l0, l1, l2)) / ln(10.0)) AS INT) pl{g}' for g in range(3))}, "
    "CASE greatest(p0, p1, p2) WHEN p0 THEN 0 WHEN p1 THEN 1 ELSE 2 END gt, CAST(least(255, floor(-10 * log10(1 - greatest(p0, p1, p2) + 1e-100))) AS INT) gq FROM pr"
)
def cluster_genotypes(spark, d):
    """Genotypes of three groups of cells from their pooled likelihoods."""
    nine, snps = pl.nine_state(_collapsed(spark, d)), views.snps(spark, d)
    groups = nine.select("cell").distinct().withColumn("cluster", F.col("cell") % 3)
    return clustering.cluster_calls(clustering.pooled_genotypes(nine, snps, groups))


_STATES = (("g0", "m", "e/3"), ("g1", "0.5 - e/3", "0.5 - e/3"), ("g2", "e/3", "m"))
_LOG_SUMS = ", ".join(f"round(sum(ln(CASE WHEN allele = 0 THEN {r} ELSE {a} END)), 6) {n}" for n, r, a in _STATES)


@query(
    f"WITH {READS_SQL}, {COLLAPSED_SQL}, b AS (SELECT *, {_E} e, 1 - {_E} m FROM col WHERE allele < 2 AND umi <> 3) SELECT cell, snp, CAST(sum(n) AS BIGINT) n_reads, "
    f"count(*) FILTER (WHERE allele = 0) n_ref, count(*) FILTER (WHERE allele <> 0) n_alt, {_LOG_SUMS} FROM b GROUP BY 1, 2"
)
def pileup_merge_and_remove(spark, d):
    """Pileups of odd and even molecules merged, and those of the third molecule taken out again."""
    c = _collapsed(spark, d)
    odd, even, third = (pl.log_pileup(c.filter(x)) for x in ("umi % 2 = 1", "umi % 2 = 0", "umi = 3"))
    return rounded(pl.removed_pileup(pl.merged_pileups(odd, even), third), "g0", "g1", "g2")


@query(
    f"WITH {READS_SQL}, {HITS_SQL}, {_CT}, c AS (SELECT cell FROM ct GROUP BY cell HAVING sum(umis) >= 40), g AS (SELECT tx FROM ct GROUP BY tx HAVING sum(umis) >= 30) "
    f"SELECT cell, CAST({_HASH.format('CAST(tx AS VARCHAR)')} % 8 AS INT) grp, CAST(sum(umis) AS BIGINT) umis FROM ct WHERE cell IN (SELECT cell FROM c) AND tx IN (SELECT tx FROM g) GROUP BY 1, 2"
)
def collapsed_genes(spark, d):
    """Cells and genes with enough counts, genes in eight groups."""
    counts = pl.umi_counts(_hits(spark, d), 3).select("cell", F.col("tx").alias("gene"), "umis")
    return pl.collapse_genes(pl.enough_counts(counts, 40, 30), 8).select("cell", F.col("gene_group").alias("grp"), "umis")


# ---------------------------------------------------------------- events


@query(
    "WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 300000000, epoch_us(ts) // 300000000 - 1]) k FROM events) SELECT event_type, CAST(k * 300000000 AS BIGINT) beg_us, CAST(count(*) AS BIGINT) n, round(sum(value), 4) total FROM w GROUP BY 1, 2"
)
def event_sliding_windows(spark, d):
    rows = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sliding_sums(rows, "ts", "value", "10 minutes", "5 minutes", "1 hour", ["event_type"])
    return rounded(out.select("event_type", F.unix_micros("window.start").alias("beg_us"), "n", "total"), "total", digits=4)


@query("SELECT user_id, event_type, CAST(min(epoch_us(ts)) AS BIGINT) first_us FROM events GROUP BY 1, 2")
def event_dedup(spark, d):
    """One row of each user and kind of event: a batch is one watermark, its first row in time stays."""
    rows = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return earliest_of_key(rows, "ts", ["user_id", "event_type"]).select("user_id", "event_type", F.unix_micros("ts").alias("first_us"))


@query("WITH e AS (SELECT *, max(ts) OVER (ORDER BY xor(event_id, 1023) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen FROM events) SELECT event_id FROM e WHERE seen IS NULL OR ts >= seen - INTERVAL 1 HOUR")
def events_not_late(spark, d):
    """Events no more than an hour behind the latest that came before them, in an order that is shuffled in blocks."""
    rows = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return not_late(rows.withColumn("came", F.col("event_id").bitwiseXOR(F.lit(1023))), "ts", "came", 3600).select("event_id")
