"""Registered queries: the operators over the harness tables, and DuckDB SQL for each.

Doubles are rounded and integers cast on both sides, so that results compare by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.operators import genotyping as gt
from strandline.operators import clustering, kernels
from strandline.operators import intervals as iv
from strandline.operators import pileup as pl
from strandline.operators import reads as rd
from strandline.operators import sequence as sq
from strandline.operators import variants as vr
from strandline.plans import views
from strandline.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from strandline.plans.views import INTERVALS_SQL, PANEL_SQL, READS_SQL, SNPS_SQL

def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- genotypes

CI = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)"
_MASKS = ", ".join(f"{CI.format('code IN (' + ','.join(map(str, c)) + ')')} \"{n}\"" for n, c in vr.SNP_MASKS.items())
SITES_SQL = """sites AS (SELECT *, ac / nullif(an, 0)::DOUBLE af, (n - gc0 - gc1 - gc2) / n::DOUBLE fmis, least(ac, an - ac) mac,
 least(ac, an - ac) / nullif(an, 0)::DOUBLE maf FROM (SELECT snp, CAST(sum(greatest(code - 1, 0)) AS BIGINT) ac,
 2 * CAST(count(*) FILTER (WHERE code > 0) AS BIGINT) an, CAST(count(*) FILTER (WHERE code = 1) AS BIGINT) gc0,
 CAST(count(*) FILTER (WHERE code = 2) AS BIGINT) gc1, CAST(count(*) FILTER (WHERE code = 3) AS BIGINT) gc2,
 CAST(count(*) AS BIGINT) n FROM panel GROUP BY snp))"""
_BINS = (2, 4, 8, 16)
_BIN_SQL = ", ".join(
    f"{CI.format(f'code IN (2,3) AND ac > {lo} AND ac <= {hi}')} AC_{hi}" for lo, hi in zip((0, *_BINS), _BINS)
)


@query(f"WITH {PANEL_SQL}, {SITES_SQL} SELECT sample, {_MASKS}, {_BIN_SQL} FROM panel JOIN sites USING (snp) GROUP BY sample")
def sample_summary(spark, d):
    panel = views.panel(spark, d)
    return vr.sample_summary(panel, vr.site_counts(panel).select("snp", "ac"), _BINS)


@query(f"WITH {PANEL_SQL} SELECT sample, CAST(sum(dp) AS BIGINT) sum_dp, CAST(sum(gq) AS BIGINT) sum_gq FROM panel GROUP BY sample")
def sample_field_sums(spark, d):
    return vr.sample_field_sums(views.panel(spark, d))


@query(f"WITH {PANEL_SQL}, {SITES_SQL} SELECT snp, ac, an, gc0, gc1, gc2, n, round(af, 6) af, round(fmis, 6) fmis, mac, round(maf, 6) maf FROM sites")
def site_counts(spark, d):
    return rounded(vr.site_counts(views.panel(spark, d)), "af", "fmis", "maf")


@query(
    f"WITH {PANEL_SQL}, {SITES_SQL} SELECT snp, ac, an FROM sites WHERE 1 - fmis >= 0.5 AND mac >= 2 "
    "AND least((ac + 5e-11) / (an + 1e-10), 1 - (ac + 5e-11) / (an + 1e-10)) BETWEEN 0.05 AND 0.5"
)
def site_filter(spark, d):
    sites = vr.site_counts(views.panel(spark, d))
    return vr.site_filter(sites, min_call_rate=0.5, min_mac=2, min_maf=0.05).select("snp", "ac", "an")


@query(
    f"WITH {PANEL_SQL} SELECT sample, snp, CASE WHEN p = 0 OR dp < CASE WHEN p = 1 THEN 8 ELSE 15 END OR gq < 10 THEN 0 ELSE code END code, "
    "(p = 0 OR dp < CASE WHEN p = 1 THEN 8 ELSE 15 END OR gq < 10) masked FROM (SELECT *, CASE WHEN snp % 22 + 1 = 22 THEN "
    "CASE WHEN sample % 2 = 0 THEN 1 ELSE 0 END WHEN snp % 22 + 1 = 21 AND sample % 2 = 0 THEN 1 ELSE 2 END p FROM panel)"
)
def squeeze_masks(spark, d):
    panel = views.panel(spark, d)
    chrom, male = F.col("snp") % 22 + 1, F.col("sample") % 2 == 0
    copies = F.when(chrom == 22, F.when(male, 1).otherwise(0)).when((chrom == 21) & male, 1).otherwise(2)
    return vr.squeeze(panel, copies, 15, 8, 10).select("sample", "snp", "code", "masked")


_G = ("REF", "HET", "HOM")
_IBS = ", ".join(f"{CI.format(f'a.code = {i + 1} AND b.code = {j + 1}')} {_G[i]}_{_G[j]}" for i in range(3) for j in range(3))


@query(
    f"WITH {PANEL_SQL}, t AS (SELECT a.sample list_id, b.sample ref_id, {_IBS}, CAST(count(*) AS BIGINT) total FROM panel a JOIN panel b "
    "USING (snp) WHERE a.code > 0 AND b.code > 0 AND a.sample < 4 AND b.sample >= 4 GROUP BY 1, 2) SELECT *, "
    "round((REF_REF + HET_HET + HOM_HOM) / total, 6) CONC_ALL, round((HET_HET + HOM_HOM) / nullif(total - REF_REF, 0), 6) CONC_NREF FROM t"
)
def ibs_matrix(spark, d):
    panel = views.panel(spark, d)
    return rounded(vr.ibs_matrix(panel.filter("sample < 4"), panel.filter("sample >= 4")), "CONC_ALL", "CONC_NREF")


@query(
    f"WITH {PANEL_SQL}, p AS (SELECT * FROM panel), g AS (SELECT snp FROM p GROUP BY snp HAVING count(*) FILTER (WHERE code = 1) >= 1 "
    "AND count(*) FILTER (WHERE code = 3) >= 1), s AS (SELECT DISTINCT sample FROM p) SELECT a.sample id1, b.sample id2 FROM s a JOIN s b "
    "ON a.sample < b.sample WHERE NOT EXISTS (SELECT 1 FROM p x JOIN p y USING (snp) JOIN g USING (snp) WHERE x.sample = a.sample AND "
    "y.sample = b.sample AND ((x.code = 1 AND y.code = 3) OR (x.code = 3 AND y.code = 1)))"
)
def ibs0_free_pairs(spark, d):
    return vr.ibs0_free_pairs(views.panel(spark, d))


_TRIO = ", ".join(
    f"{CI.format(f'x.code = {i} AND y.code = {j} AND z.code = {k}')} N{i}{j}{k}" for i in range(4) for j in range(4) for k in range(4)
)


@query(
    f"WITH {PANEL_SQL} SELECT x.sample dad, y.sample mom, z.sample kid, CAST(count(*) AS BIGINT) total, {_TRIO} FROM panel z JOIN panel x "
    "ON x.snp = z.snp AND x.sample = 0 JOIN panel y ON y.snp = z.snp AND y.sample = 1 WHERE z.sample IN (2, 3) GROUP BY 1, 2, 3"
)
def mendel_trio_table(spark, d):
    trios = spark.createDataFrame([(0, 1, 2), (0, 1, 3)], "dad int, mom int, kid int")
    return vr.trio_table(views.panel(spark, d), trios)


_DUP = ", ".join(f"{CI.format(f'x.code = {i} AND y.code = {j}')} N{i}{j}" for i in range(4) for j in range(4))


@query(
    f"WITH {PANEL_SQL} SELECT x.sample id1, y.sample id2, CAST(count(*) AS BIGINT) total, {_DUP} FROM panel x JOIN panel y USING (snp) "
    "WHERE x.sample = 4 AND y.sample = 5 GROUP BY 1, 2"
)
def duplicate_table(spark, d):
    return vr.duplicate_table(views.panel(spark, d), spark.createDataFrame([(4, 5)], "id1 int, id2 int"))


@query(
    f"WITH {PANEL_SQL}, x AS (SELECT snp, CASE WHEN code > 0 THEN least(code - 1 + gq / 100.0::DOUBLE, 2) END ds FROM panel), "
    "t AS (SELECT snp, count(*) n, count(ds) k, sum(ds) s, sum(ds * ds) ss, count(*) FILTER (WHERE ds IS NULL OR (ds > 0.1 AND ds < 0.9) "
    "OR (ds > 1.1 AND ds < 1.9)) odd FROM x GROUP BY snp) SELECT snp, round(s / nullif(2 * k, 0), 6) af, round((ss / nullif(k, 0) - s * s / nullif(k * k, 0)) / "
    "(s * (2 * k - s) / nullif(2 * k * k, 0) + 1e-20), 6) r2, round(odd / n, 6) imperfect FROM t"
)
def mach_r2(spark, d):
    ds = F.when(F.col("code") > 0, F.least(F.col("code") - 1 + F.col("gq") / F.lit(100.0), F.lit(2.0)))
    return rounded(vr.mach_r2(views.panel(spark, d).select("sample", "snp", ds.alias("ds"))), "af", "r2", "imperfect")


PL_SQL = ", ".join(f"CAST(CASE WHEN code = 0 THEN 0 ELSE abs(code - 1 - {g}) * 20 END AS INT) pl{g}" for g in range(3))
PLS_SQL = f"pls AS (SELECT sample, snp, {PL_SQL} FROM panel)"


@query(f"WITH {PANEL_SQL}, {PLS_SQL} SELECT * FROM pls")
def pl_from_gt(spark, d):
    return vr.pl_from_gt(views.panel(spark, d))


def _em_sql(rounds: int) -> str:
    out = f"{PLS_SQL}, lik AS (SELECT snp, pow(10.0, -pl0/10.0) l0, pow(10.0, -pl1/10.0) l1, pow(10.0, -pl2/10.0) l2 FROM pls), "
    out += "em0 AS (SELECT DISTINCT snp, 0.5::DOUBLE af FROM lik)"
    for r in range(1, rounds + 1):
        out += (
            f", em{r} AS (SELECT snp, least(greatest(sum((2*af*(1-af)*l1 + 2*af*af*l2) / ((1-af)*(1-af)*l0 + 2*af*(1-af)*l1 + af*af*l2)) / (2*count(*)), "
            f"greatest(1e-5, 0.5/(2*count(*)+1))), 1 - greatest(1e-5, 0.5/(2*count(*)+1))) af, CAST(count(*) AS BIGINT) n FROM lik JOIN em{r - 1} USING (snp) GROUP BY snp)"
        )
    return out


@query(f"WITH {PANEL_SQL}, {_em_sql(10)} SELECT snp, n, round(af, 6) af FROM em10")
def pooled_af_em(spark, d):
    return rounded(vr.pooled_af_em(vr.pl_from_gt(views.panel(spark, d))), "af")


_PRIOR = "(1-af)*(1-af)*l0 + 2*af*(1-af)*l1 + af*af*l2"


@query(
    f"WITH {PANEL_SQL}, {_em_sql(10)}, u AS (SELECT snp, af, af*(1-af)*(l0-2*l1+l2)/({_PRIOR}) u, 2*af*(1-af)*l1/({_PRIOR}) h FROM lik JOIN em10 USING (snp)) "
    "SELECT snp, CAST(count(*) AS BIGINT) n, round(af, 6) af, round(sum(u)/sqrt(sum(u*u) + 1/((1-af)*(1-af)) + 4/(2*af*(1-af)) + 1/(af*af)), 6) z, "
    "round(1 - (sum(h)+1)/(2*af*(1-af)*count(*)+1), 6) f FROM u GROUP BY snp, af"
)
def hwe_score(spark, d):
    pls = vr.pl_from_gt(views.panel(spark, d))
    return rounded(vr.hwe_score(pls, vr.pooled_af_em(pls)), "af", "z", "f")


@query(
    f"WITH {PANEL_SQL}, {PLS_SQL}, w AS (SELECT sample, snp, (1-a)*(1-a)*pow(10.0,-pl0/10.0) w0, 2*a*(1-a)*pow(10.0,-pl1/10.0) w1, a*a*pow(10.0,-pl2/10.0) w2 "
    "FROM (SELECT *, (snp % 49 + 1)/50.0::DOUBLE a FROM pls)) SELECT sample, snp, CAST(CASE greatest(w0,w1,w2) WHEN w0 THEN 0 WHEN w1 THEN 1 ELSE 2 END AS INT) gt, "
    "CAST(least(floor(-10*log10(greatest(1 - greatest(w0,w1,w2)/(w0+w1+w2), 1e-10)) + 1e-6), 255) AS INT) gq FROM w"
)
def best_guess_gt(spark, d):
    pls = vr.pl_from_gt(views.panel(spark, d))
    afs = pls.select("snp").distinct().withColumn("af", (F.col("snp") % 49 + 1) / F.lit(50.0))
    return vr.best_guess(pls, afs)


@query(
    "SELECT p_partkey, CASE WHEN r = a THEN 'REF' WHEN length(r) = 1 AND length(a) = 1 THEN 'SNP' WHEN length(r) = length(a) THEN 'MNP' "
    "WHEN (r[1] = a[1] AND length(r) = 1) OR (r[1] = a[1] AND length(a) = 1) THEN 'INDEL' ELSE 'CLUMPED' END kind FROM (SELECT p_partkey, "
    "CASE p_size % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'A' WHEN 3 THEN 'GT' ELSE 'C' END r, "
    "CASE p_size % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'GT' WHEN 2 THEN 'AC' WHEN 3 THEN 'CAA' ELSE 'C' END a FROM part)"
)
def variant_classify(spark, d):
    k = F.col("p_size") % 5
    ref = F.when(k == 0, "A").when(k == 1, "AC").when(k == 2, "A").when(k == 3, "GT").otherwise("C")
    alt = F.when(k == 0, "G").when(k == 1, "GT").when(k == 2, "AC").when(k == 3, "CAA").otherwise("C")
    return _read(spark, d, "part").select("p_partkey", scalar.classify_variant(ref, alt).alias("kind"))


@query(f"WITH {PANEL_SQL}, {SNPS_SQL} SELECT sample, snp, code, chrom, pos FROM panel JOIN snps USING (snp)")
def update_sites_join(spark, d):
    return vr.join_sites(views.panel(spark, d).select("sample", "snp", "code"), views.snps(spark, d).select("snp", "chrom", "pos"), ["snp"])


@query(
    f"WITH {SNPS_SQL} SELECT snp, chrom, pos, p_name AS name FROM snps LEFT JOIN (SELECT CAST(p_partkey AS INT) snp, p_name FROM part WHERE p_size < 25) USING (snp)"
)
def dbsnp_left_join(spark, d):
    names = _read(spark, d, "part").filter("p_size < 25").selectExpr("cast(p_partkey as int) as snp", "p_name as name")
    return vr.join_sites(views.snps(spark, d).select("snp", "chrom", "pos"), names, ["snp"], "left")


@query(f"WITH {PANEL_SQL} SELECT sample, snp, code FROM panel WHERE snp IN (SELECT CAST(p_partkey AS INT) FROM part WHERE p_size < 10)")
def extract_semi(spark, d):
    wanted = _read(spark, d, "part").filter("p_size < 10").selectExpr("cast(p_partkey as int) as snp")
    return vr.join_sites(views.panel(spark, d).select("sample", "snp", "code"), wanted, ["snp"], "left_semi")


@query(
    "WITH RECURSIVE s AS (SELECT DISTINCT CAST(o_custkey % 22 AS INT) chrom, CAST(o_orderkey % 5000 AS INT) pos FROM orders), "
    "k AS (SELECT chrom, min(pos) pos FROM s GROUP BY chrom UNION ALL SELECT k.chrom, (SELECT min(s.pos) FROM s WHERE s.chrom = k.chrom AND "
    "s.pos >= k.pos + 50) FROM k WHERE k.pos IS NOT NULL) SELECT chrom, pos FROM k WHERE pos IS NOT NULL"
)
def min_distance_filter(spark, d):
    sites = _read(spark, d, "orders").selectExpr("cast(o_custkey % 22 as int) as chrom", "cast(o_orderkey % 5000 as int) as pos").distinct()
    return vr.min_distance(sites, 50)


@query(
    "WITH s AS (SELECT DISTINCT CAST(o_custkey % 22 AS INT) chrom, CAST(o_orderkey % 5000 AS INT) pos FROM orders), "
    "g AS (SELECT *, coalesce(CAST(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) >= 40 AS INT), 0) nw FROM s) "
    "SELECT chrom, pos, CAST(sum(nw) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS cluster FROM g"
)
def cluster_sessions(spark, d):
    sites = _read(spark, d, "orders").selectExpr("cast(o_custkey % 22 as int) as chrom", "cast(o_orderkey % 5000 as int) as pos").distinct()
    return vr.gap_clusters(sites, 40, ["chrom"], "pos")


_DPB = ", ".join(f"{CI.format(f'least(floor(dp / 5.0), 19) = {b}')} dp_{b}" for b in range(20))


@query(f"WITH {PANEL_SQL} SELECT snp, max(gq) qual, CAST(count(*) AS BIGINT) n_samples, {_DPB} FROM panel WHERE code > 1 GROUP BY snp")
def merge_candidates(spark, d):
    found = views.panel(spark, d).filter("code > 1").withColumnRenamed("gq", "qual")
    return vr.merge_candidates(found, ["snp"]).drop("samples")


_KIND = "CASE o_custkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'A' END kind, CAST(o_orderkey % 8 AS INT) gc, CAST(o_totalprice % 140 AS INT) dp"


@query(
    "WITH s AS (SELECT kind, gc, least(dp, 100) dp FROM (SELECT CASE o_custkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'A' END kind, "
    "CAST(o_orderkey % 8 AS INT) gc, CAST(o_orderkey % 140 AS INT) dp FROM orders)), c AS (SELECT kind, gc, sum(dp)::DOUBLE dp, count(*)::DOUBLE n FROM s GROUP BY 1, 2), "
    "t AS (SELECT kind, count(*)::DOUBLE total, avg(dp) mean FROM s GROUP BY 1), h AS (SELECT *, n / total share FROM c JOIN t USING (kind)) "
    "SELECT h.kind, round(sum(h.dp / h.total * a.share / h.share), 6) depth, round(any_value(a.mean), 6) auto_depth, "
    "round(sum(h.dp / h.total * a.share / h.share) / any_value(a.mean), 6) relative FROM h JOIN h a ON a.kind = 'A' AND a.gc = h.gc WHERE h.kind <> 'A' GROUP BY 1"
)
def gc_depth_norm(spark, d):
    kind = F.when(F.col("o_custkey") % 4 == 0, "X").when(F.col("o_custkey") % 4 == 1, "Y").otherwise("A")
    sites = _read(spark, d, "orders").select(kind.alias("kind"), (F.col("o_orderkey") % 8).cast("int").alias("gc"), (F.col("o_orderkey") % 140).cast("int").alias("dp"))
    return rounded(vr.depth_ratio(sites), "depth", "auto_depth", "relative")


@query(
    "SELECT a.vec_id i, b.vec_id j, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) dot FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id"
)
def gram_matrix(spark, d):
    return rounded(vr.gram_matrix(_read(spark, d, "embeddings"), "vec_id", "embedding"), "dot")


# ---------------------------------------------------------------- intervals


@query(
    f'WITH {INTERVALS_SQL}, m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM ivl), '
    'g AS (SELECT *, sum(CASE WHEN r IS NULL OR beg > r THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) k FROM m) '
    'SELECT chrom, min(beg) beg, max("end") "end" FROM g GROUP BY chrom, k'
)
def interval_merge(spark, d):
    return iv.merge_intervals(views.intervals(spark, d).drop("target"))


@query(
    f'WITH {INTERVALS_SQL} SELECT chrom, CAST(sum("end" - beg + 1) AS BIGINT) length FROM ivl GROUP BY chrom'
)
def interval_total_length(spark, d):
    return iv.total_length(views.intervals(spark, d))


@query(
    f'WITH {INTERVALS_SQL} SELECT a.id, b.id id2, CAST(least(a."end", b."end") - greatest(a.beg, b.beg) + 1 AS INT) bases FROM ivl a JOIN ivl b '
    'ON a.chrom = b.chrom AND a.beg <= b."end" AND b.beg <= a."end" WHERE NOT a.target AND b.target'
)
def interval_overlap_join(spark, d):
    v = views.intervals(spark, d)
    own, targets = v.filter("not target").drop("target"), v.filter("target").drop("target").withColumnRenamed("id", "id2")
    pairs = iv.overlap_join(own, targets, ["chrom"], 32, alike=True)
    return pairs.select("id", "id2", iv.overlap_bases(F.col("beg"), F.col("end"), F.col("beg2"), F.col("end2")).alias("bases"))


@query(
    f'WITH {INTERVALS_SQL} SELECT id, chrom, beg, "end" FROM ivl a WHERE NOT target AND EXISTS (SELECT 1 FROM ivl b WHERE b.chrom = a.chrom AND '
    'b.target AND a.beg <= b."end" AND b.beg <= a."end")'
)
def interval_semi_join(spark, d):
    v = views.intervals(spark, d)
    return iv.overlapping(v.filter("not target").drop("target"), v.filter("target"), ["chrom"], 32)


# ---------------------------------------------------------------- reads and cells

COLLAPSED_SQL = (
    "col AS (SELECT cell, snp, umi, arg_min(allele, (o1,o2,o3,o4,o5,o6)) allele, arg_min(bq, (o1,o2,o3,o4,o5,o6)) bq, "
    "CAST(count(*) AS BIGINT) n FROM reads WHERE bq >= 13 GROUP BY 1, 2, 3)"
)


def _collapsed(spark, d):
    return pl.umi_collapse(pl.base_filter(views.reads(spark, d)))


@query(f"WITH {READS_SQL} SELECT cell, snp, umi, allele, bq, flag FROM reads WHERE flag & 18 = 0")
def read_filter_flags(spark, d):
    return rd.read_filter(views.reads(spark, d), 18).select("cell", "snp", "umi", "allele", "bq", "flag")


@query(
    f"WITH {READS_SQL}, c AS (SELECT flag, count(*) n FROM reads GROUP BY 1), b AS (SELECT bit_or(flag) & ~bit_and(flag) v FROM reads), "
    "m AS (SELECT CAST(range AS INT) mask FROM range(4096), b WHERE CAST(range AS INT) & ~v = 0) "
    "SELECT mask, flag | mask masked, CAST(sum(n) AS BIGINT) reads FROM c, m GROUP BY 1, 2"
)
def flagstat_lattice(spark, d):
    return rd.flag_lattice(views.reads(spark, d))


@query(f"WITH {READS_SQL}, {COLLAPSED_SQL} SELECT * FROM col")
def umi_collapse(spark, d):
    return _collapsed(spark, d)


@query(
    f"WITH {READS_SQL}, {COLLAPSED_SQL} SELECT cell, CAST(sum(n) AS BIGINT) n_reads, CAST(count(*) AS BIGINT) n_umis, count(DISTINCT snp) n_snps FROM col "
    "GROUP BY cell HAVING sum(n) >= 20 AND count(*) >= 20 AND count(DISTINCT snp) >= 10"
)
def cell_thresholds(spark, d):
    return pl.cell_thresholds(_collapsed(spark, d), 20, 20, 10)


@query(f"WITH {READS_SQL} SELECT dp, CAST(count(*) AS BIGINT) n FROM (SELECT snp, least(CAST(count(*) AS INT), 700) dp FROM reads GROUP BY snp) GROUP BY dp")
def depth_distribution(spark, d):
    depth = views.reads(spark, d).groupBy("snp").agg(F.least(F.count(F.lit(1)).cast("int"), F.lit(700)).alias("dp"))
    return depth.groupBy("dp").agg(F.count(F.lit(1)).alias("n"))


_E = "CASE WHEN bq <= 1 THEN 0.75 ELSE pow(10.0, -bq/10.0) END"


def _states_sql(states: list[tuple[str, str, str]]) -> str:
    sums = ", ".join(f"sum(ln(CASE WHEN allele = 0 THEN {r} ELSE {a} END)) {n}" for n, r, a in states)
    names = [s[0] for s in states]
    top = "greatest(" + ", ".join(names) + ")"
    total = " + ".join(f"exp({n} - m)" for n in names)
    floored = ", ".join(f"greatest(exp({n} - ld), 1e-6) {n}" for n in names)
    t = " + ".join(names)
    return (
        f"b AS (SELECT *, {_E} e, 1 - {_E} m FROM col WHERE allele < 2), l0 AS (SELECT cell, snp, CAST(sum(n) AS BIGINT) n_reads, "
        f"count(*) FILTER (WHERE allele = 0) n_ref, count(*) FILTER (WHERE allele <> 0) n_alt, {sums} FROM b GROUP BY 1, 2), "
        f"l1 AS (SELECT *, {top} m FROM l0), l2 AS (SELECT *, m + ln({total}) ld FROM l1), "
        f"l3 AS (SELECT cell, snp, n_reads, n_ref, n_alt, ld log_denominator, {floored} FROM l2), "
        f"gl AS (SELECT cell, snp, n_reads, n_ref, n_alt, log_denominator, {', '.join(f'{n} / ({t}) {n}' for n in names)} FROM l3)"
    )


THREE_SQL = _states_sql([("g0", "m", "e/3"), ("g1", "0.5 - e/3", "0.5 - e/3"), ("g2", "e/3", "m")])
NINE = [(l, k, l / 2 + (k - l) * 0.25) for l in range(3) for k in range(3)]
NINE_SQL = _states_sql([(f"g{l}{k}", f"(m * (1 - {p}) + e/4)", f"(m * {p} + e/4)") for l, k, p in NINE])


@query(f"WITH {READS_SQL}, {COLLAPSED_SQL}, {THREE_SQL} SELECT cell, snp, n_reads, n_ref, n_alt, round(log_denominator, 6) log_denominator, round(g0, 6) g0, round(g1, 6) g1, round(g2, 6) g2 FROM gl")
def pileup_gl_sum(spark, d):
    return rounded(pl.three_state(_collapsed(spark, d)), "log_denominator", "g0", "g1", "g2")


_H = ("(1-af)*(1-af)", "2*af*(1-af)", "af*af")
_ONE = " + ".join(f"g{g}{g}*{_H[g]}" for g in range(3))
_TWO = " + ".join(f"g{g}{k}*{_H[g]}*{_H[k]}" for g in range(3) for k in range(3))


@query(
    f"WITH {READS_SQL}, {SNPS_SQL}, {COLLAPSED_SQL}, {NINE_SQL} SELECT cell, CAST(count(*) AS BIGINT) n_snps, CAST(sum(n_reads) AS BIGINT) n_reads, "
    f"round(sum(ln({_ONE})), 5) llk2, round(sum(ln({_TWO})), 5) llk0, round(sum(ln({_ONE})) - sum(ln({_TWO})), 5) score FROM gl JOIN snps USING (snp) GROUP BY cell"
)
def singlet_score(spark, d):
    out = pl.singlet_score(pl.nine_state(_collapsed(spark, d)), views.snps(spark, d))
    return rounded(out, "llk2", "llk0", "score", digits=5)


_SAME = " + ".join(f"a.g{g}{g}*b.g{g}{g}*{_H[g]}" for g in range(3))
_LEFT, _RIGHT = (" + ".join(f"{t}.g{g}{g}*{_H[g]}" for g in range(3)) for t in "ab")


@query(
    f"WITH {READS_SQL}, {SNPS_SQL}, {COLLAPSED_SQL}, {NINE_SQL} SELECT a.cell id1, b.cell id2, CAST(count(*) AS BIGINT) n_snps, "
    f"round(sum(ln({_SAME})), 5) llk2, round(sum(ln(({_LEFT}) * ({_RIGHT}))), 5) llk0, round(sum(ln({_SAME})) - sum(ln(({_LEFT}) * ({_RIGHT}))), 5) ldiff "
    "FROM gl a JOIN gl b ON a.snp = b.snp AND a.cell > b.cell JOIN snps ON snps.snp = a.snp GROUP BY 1, 2"
)
def pairwise_cell_bf(spark, d):
    out = pl.pair_bayes_factors(pl.nine_state(_collapsed(spark, d)), views.snps(spark, d))
    return rounded(out, "llk2", "llk0", "ldiff", digits=5)


@query(
    f"WITH {READS_SQL}, s AS (SELECT cell, snp, CAST(sum(bq) AS BIGINT) score FROM reads GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, snp) k FROM s) "
    "SELECT cell, max(snp) FILTER (WHERE k = 1) best, max(score) FILTER (WHERE k = 1) best_score, max(snp) FILTER (WHERE k = 2) \"next\", max(score) FILTER (WHERE k = 2) next_score, "
    "max(score) FILTER (WHERE k = 1) - max(score) FILTER (WHERE k = 2) margin FROM r WHERE k <= 2 GROUP BY cell"
)
def topk_best_next(spark, d):
    scores = views.reads(spark, d).groupBy("cell", "snp").agg(F.sum("bq").cast("long").alias("score"))
    return pl.best_next(scores, ["cell"], "snp", "score")


@query(f"WITH {READS_SQL} SELECT cell, round(ln(sum(exp(-bq/10.0))), 6) lse FROM reads GROUP BY cell")
def log_sum_exp(spark, d):
    return rounded(pl.grouped_log_sum_exp(views.reads(spark, d).withColumn("x", -F.col("bq") / F.lit(10.0)), ["cell"], "x"), "lse")


_DS = [f"CASE WHEN code = {g + 1} THEN 1.0 ELSE 0.0 END" for g in range(3)]
_SHARE = ", ".join(f"CASE WHEN code > 0 THEN 0.9::DOUBLE * ({_DS[g]}) + 0.1::DOUBLE * m{g} ELSE m{g} END p{g}" for g in range(3))
_DEMUX = [(f"g{l}{k}", p) for l, k, p in NINE]
_DSUM = ", ".join(f"sum(ln(CASE WHEN allele = 0 THEN m*(1-{p}) + e/3*{p} ELSE e/3*(1-{p}) + m*{p} END)) {n}" for n, p in _DEMUX)
_DTOP = "greatest(" + ", ".join(n for n, _ in _DEMUX) + ")"
_DSCALE = ", ".join(f"exp({n} - {_DTOP}) + 1e-10 {n}" for n, _ in _DEMUX)
_DBL = " + ".join(f"a.p{l}*b.p{k}*g{l}{k}" for l in range(3) for k in range(3))
_SNG = " + ".join(f"a.p{g}*g{g}{g}" for g in range(3))


@query(
    f"WITH {READS_SQL}, {PANEL_SQL}, {COLLAPSED_SQL}, mean AS (SELECT snp, {', '.join(f'avg({_DS[g]}) m{g}' for g in range(3))} FROM panel WHERE code > 0 GROUP BY snp), "
    f"sh AS (SELECT sample, snp, {_SHARE} FROM panel JOIN mean USING (snp)), b AS (SELECT *, {_E} e, 1 - {_E} m FROM col WHERE allele < 2), "
    f"lg AS (SELECT cell, snp, CAST(sum(n) AS BIGINT) n_reads, {_DSUM} FROM b GROUP BY 1, 2), sc AS (SELECT cell, snp, n_reads, {_DTOP} tp, {_DSCALE} FROM lg), "
    f"ll AS (SELECT cell, a.sample s1, b.sample s2, sum(ln(CASE WHEN a.sample = b.sample THEN {_SNG} ELSE {_DBL} END) + tp) llk, CAST(count(*) AS BIGINT) n_snps, "
    "CAST(sum(n_reads) AS BIGINT) n_reads FROM sc JOIN sh a USING (snp) JOIN sh b USING (snp) WHERE a.sample <= b.sample GROUP BY 1, 2, 3), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY cell, s1 = s2 ORDER BY llk DESC, s1, s2) r FROM ll) "
    "SELECT cell, max(n_snps) n_snps, max(n_reads) n_reads, max(s1) FILTER (WHERE s1 = s2 AND r = 1) sng_best, round(max(llk) FILTER (WHERE s1 = s2 AND r = 1), 4) sng_llk, "
    "max(s1) FILTER (WHERE s1 <> s2 AND r = 1) dbl_1, max(s2) FILTER (WHERE s1 <> s2 AND r = 1) dbl_2, round(max(llk) FILTER (WHERE s1 <> s2 AND r = 1), 4) dbl_llk, "
    "CASE WHEN max(llk) FILTER (WHERE s1 <> s2 AND r = 1) > max(llk) FILTER (WHERE s1 = s2 AND r = 1) + 2 THEN 'DBL' WHEN max(llk) FILTER (WHERE s1 = s2 AND r = 1) > "
    "max(llk) FILTER (WHERE s1 = s2 AND r = 2) + 2 THEN 'SNG' ELSE 'AMB' END \"type\" FROM rk GROUP BY cell"
)
def demultiplex(spark, d):
    out = pl.demultiplex(_collapsed(spark, d), pl.genotype_shares(views.panel(spark, d)))
    out = out.select("cell", "n_snps", "n_reads", "sng_best", "sng_llk", "dbl_1", "dbl_2", "dbl_llk", "type")
    return rounded(out, "sng_llk", "dbl_llk", digits=4)


HITS_SQL = "hits AS (SELECT cell, umi, snp tx, read_id, snp % 4 + 1 nh, bq % 5 nm FROM reads)"


def _hits(spark, d):
    return views.reads(spark, d).selectExpr("cell", "umi", "snp as tx", "read_id", "snp % 4 + 1 as nh", "bq % 5 as nm")


_CT = (
    "lst AS (SELECT *, min(nm) OVER (PARTITION BY cell, umi, read_id) l FROM hits), per AS (SELECT cell, tx, umi, count(*) reads, min(nh) nh FROM lst "
    "WHERE l <= 3 AND nm = l GROUP BY 1, 2, 3), ct AS (SELECT cell, tx, CAST(count(*) AS BIGINT) umis, CAST(sum(reads) AS BIGINT) reads, sum(1.0::DOUBLE / nh) fumis FROM per GROUP BY 1, 2)"
)


@query(f"WITH {READS_SQL}, {HITS_SQL}, {_CT} SELECT cell, tx, umis, reads, round(fumis, 6) fumis FROM ct")
def cell_tx_counts(spark, d):
    return rounded(pl.umi_counts(_hits(spark, d), 3), "fumis")


@query(
    f"WITH {READS_SQL}, {HITS_SQL}, {_CT} SELECT coalesce(cell, -1) cell, coalesce(tx, -1) tx, CAST(sum(umis) AS BIGINT) umis, CAST(sum(reads) AS BIGINT) reads, round(sum(fumis), 5) fumis, CAST(count(*) AS BIGINT) n "
    "FROM ct GROUP BY ROLLUP (cell, tx)"
)
def cell_counts_rollup(spark, d):
    out = rounded(pl.counts_rollup(pl.umi_counts(_hits(spark, d), 3)), "fumis", digits=5)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("cell", "tx")})


@query(f"WITH {READS_SQL}, o AS (SELECT cell, umi, snp // 10 b, min(snp) gene FROM reads GROUP BY 1, 2, 3) SELECT cell, gene, CAST(count(*) AS BIGINT) umis FROM o GROUP BY 1, 2")
def gene_umi_dedup(spark, d):
    hits = views.reads(spark, d).selectExpr("cell", "umi", "snp as gene", "snp div 10 as bin")
    return pl.gene_umis(hits)


@query(
    f"WITH {READS_SQL}, {HITS_SQL}, {_CT} SELECT cell, CAST(sum(umis) AS BIGINT) umis, CAST(count(*) FILTER (WHERE umis > 0) AS BIGINT) nonzero FROM ct GROUP BY cell"
)
def dge_row_col_sums(spark, d):
    return pl.dge_sums(pl.umi_counts(_hits(spark, d), 3), "cell")


@query(
    "WITH x AS (SELECT len, left(s, len) p, count(*) reads FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') s FROM orders), (VALUES (2), (3), (4)) t(len) GROUP BY 1, 2), "
    "h AS (SELECT len, reads, CAST(count(*) AS BIGINT) barcodes FROM x GROUP BY 1, 2) SELECT CAST(len AS INT) len, reads, barcodes, "
    "CAST(sum(barcodes) OVER (PARTITION BY len ORDER BY reads DESC) AS BIGINT) cum_barcodes, CAST(sum(barcodes * reads) OVER (PARTITION BY len ORDER BY reads DESC) AS BIGINT) cum_reads FROM h"
)
def barcode_prefix_hist(spark, d):
    barcodes = _read(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("barcode"))
    return pl.prefix_histogram(barcodes, (2, 3, 4))


@query(
    "SELECT c_custkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda a, b: (a * 101 + b) % 4294967296) AS BIGINT) h FROM customer"
)
def hash_route_umi(spark, d):
    return _read(spark, d, "customer").select("c_custkey", scalar.string_hash(F.col("c_name")).alias("h"))


# ---------------------------------------------------------------- genotyping

_C = 0.02
_EC = "CASE WHEN least(bq, 40) <= 1 THEN 0.75 ELSE pow(10.0, -least(bq, 40)/10.0) END"
_F = (f"((1-e)*(1-{_C}) + e*{_C}/3)", "((1-e)/2 + e/6)", f"((1-e)*{_C} + e*(1-{_C})/3)")
_FT = f"({_F[0]} + {_F[1]} + {_F[2]})"
_FS = ", ".join(f"sum(ln(CASE WHEN allele = 0 THEN {_F[g]} ELSE {_F[2 - g]} END / {_FT})) l{g}" for g in range(3))
_FP = ", ".join(f"CAST(least(floor((l{g} - greatest(l0,l1,l2)) * -10 / ln(10.0) + 0.5), 255) AS INT) pl{g}" for g in range(3))


def _sample_bases(spark, d):
    return views.reads(spark, d).withColumnRenamed("cell", "sample")


@query(
    f"WITH {READS_SQL}, b AS (SELECT *, {_EC} e FROM reads WHERE allele < 2), l AS (SELECT cell AS sample, snp, CAST(count(*) AS BIGINT) dp, "
    f"CAST(count(*) FILTER (WHERE allele = 0) AS BIGINT) ad0, CAST(count(*) FILTER (WHERE allele = 1) AS BIGINT) ad1, {_FS} FROM b GROUP BY 1, 2) "
    f"SELECT sample, snp, dp, ad0, ad1, {_FP} FROM l"
)
def contaminated_pl(spark, d):
    return gt.contaminated_pl(_sample_bases(spark, d), _C)


_COR = "CASE WHEN n*{xx} - {x}*{x} > 0 AND n*a - a*a > 0 THEN (n*{xa} - {x}*a) / sqrt((n*{xx} - {x}*{x}) * (n*a - a*a)) ELSE 0 END"


@query(
    f"WITH {READS_SQL}, p AS (SELECT cell, snp, count(*)::DOUBLE n, sum(1 - allele)::DOUBLE r, sum(allele)::DOUBLE a, sum(bq)::DOUBLE q, sum(bq*bq)::DOUBLE qq, sum(bq*allele)::DOUBLE qa, "
    "sum(CAST(fwd AS INT))::DOUBLE s, sum(CAST(fwd AS INT)*allele)::DOUBLE sa FROM reads WHERE allele < 2 GROUP BY 1, 2), "
    "w AS (SELECT *, ln(n + 1) w, CASE WHEN a > 0 AND r > 0 THEN 1.0 ELSE 0.0 END het FROM p) SELECT snp, count(*)::DOUBLE n_samples, sum(n) dp, "
    "round(sum(het*w*(r+0.05)/(n+0.1)) / nullif(sum(het*w), 0), 6) abe, round(sum(het*w*(r-n/2)/sqrt(n/4+1e-3)) / sqrt(nullif(sum(het*w*w), 0)), 6) abz, "
    f"round(sum(sqrt(n)*w*({_COR.format(x='q', xx='qq', xa='qa')})) / sqrt(sum(w*w)), 6) bqz, round(sum(sqrt(n)*w*({_COR.format(x='s', xx='s', xa='sa')})) / sqrt(sum(w*w)), 6) stz FROM w GROUP BY snp"
)
def site_statistics(spark, d):
    bases = _sample_bases(spark, d)
    hets = bases.filter("allele < 2").groupBy("sample", "snp").agg(F.count_distinct("allele").alias("k")).filter("k = 2")
    # odd and even samples apart, as from two files, then merged
    parts = [gt.sample_site_sums(bases.filter(F.col("sample") % 2 == k), hets) for k in (0, 1)]
    return rounded(gt.site_statistics(gt.merge_site_sums(*parts)), "abe", "abz", "bqz", "stz")


@query(
    f'WITH {INTERVALS_SQL} SELECT DISTINCT CAST(a.id % 50 AS INT) cell, CAST(a.id % 997 AS INT) umi, CAST(b.id % 200 AS INT) gene FROM ivl a JOIN ivl b ON a.chrom = b.chrom '
    'AND a.id % 2 = b.id // 3 % 2 AND a.beg <= b."end" AND b.beg <= a."end"'
)
def gene_hits(spark, d):
    v = views.intervals(spark, d)
    frag = v.selectExpr("cast(id % 50 as int) as cell", "cast(id % 997 as int) as umi", "chrom", "id % 2 as strand", "beg", "end")
    genes = v.selectExpr("'exon' as type", "chrom", "id div 3 % 2 as strand", "beg", "end", "cast(id % 200 as int) as gene_id")
    return gt.gene_hits(frag, genes, "exon", 32)


# ---------------------------------------------------------------- sequences

_W, _S = 100, 50


@query(
    f"WITH s AS (SELECT doc_id, translate(text, 'acgt', 'ACGT') t, unnest(range(0, (length(text) - 1) // {_S} + 1)) b FROM documents WHERE length(text) > 0), "
    f"p AS (SELECT doc_id, CAST(b AS INT) bin, substring(t, CAST(greatest((b + 1) * {_S} - {_W}, 0) AS INT) + 1, CAST(least((b + 1) * {_S}, length(t)) - greatest((b + 1) * {_S} - {_W}, 0) AS INT)) w FROM s), "
    "c AS (SELECT doc_id, bin, length(w) - length(regexp_replace(w, '[GC]', '', 'g')) gc, length(w) - length(regexp_replace(w, '[AT]', '', 'g')) at_ FROM p) "
    f"SELECT doc_id, bin, CASE WHEN gc + at_ > 0 THEN CAST(floor(gc / (gc + at_)::DOUBLE * {_W}) AS INT) ELSE -1 END gc FROM c"
)
def gc_sliding(spark, d):
    out = sq.gc_windows(_read(spark, d, "documents").select("doc_id", "text"), _W, _S, ["doc_id"], "text")
    return out.withColumn("gc", F.coalesce("gc", F.lit(-1)))


# ---------------------------------------------------------------- event streams (batch side)


@query(
    "WITH g AS (SELECT user_id, ts, value, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 86400000000 AS INT), 0) nw FROM events), "
    "k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) s FROM g) SELECT user_id, epoch_us(min(ts)) AS beg_us, CAST(count(*) AS BIGINT) n, round(sum(value), 4) total FROM k GROUP BY user_id, s"
)
def event_sessions(spark, d):
    events = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.groupBy("user_id", F.session_window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out.select("user_id", F.unix_micros("session_window.start").alias("beg_us"), "n", "total"), "total", digits=4)


@query(
    "SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) n, round(sum(value), 4) total FROM events GROUP BY 1, 2"
)
def event_windows(spark, d):
    events = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    hour = F.floor(F.unix_micros("window.start") / 3600000000).cast("long")
    return rounded(out.select("event_type", hour.alias("hour"), "n", "total"), "total", digits=4)


# ---------------------------------------------------------------- iterative kernels (no SQL: tests compare with known answers)


def _dosages(spark, d):
    return views.panel(spark, d).select("sample", "snp", F.when(F.col("code") > 0, F.col("code") - 1.0).alias("ds"))


def _likelihoods(spark, d):
    pls = vr.pl_from_gt(views.panel(spark, d))
    return pls.select("sample", "snp", *[F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0).alias(f"l{g}") for g in range(3)])


@query()
def principal_components(spark, d):
    ud, _ = kernels.principal_components(_dosages(spark, d), 2)
    return ud.select("snp", F.round("af", 6).alias("af"), *[F.round(F.col("ud")[k], 6).alias(f"ud{k + 1}") for k in range(2)])


@query()
def infer_ancestry(spark, d):
    ud, _ = kernels.principal_components(_dosages(spark, d), 2)
    return kernels.infer_ancestry(_likelihoods(spark, d), ud, 2)


@query()
def individual_frequencies(spark, d):
    _, v = kernels.principal_components(_dosages(spark, d), 2)
    return kernels.individual_frequencies(_likelihoods(spark, d), v)


@query()
def genotype_em(spark, d):
    return kernels.genotype_em(_likelihoods(spark, d))


@query()
def phase_blocks(spark, d):
    return kernels.phase_blocks(views.panel(spark, d).select("sample", "snp", "code"), 4)


@query()
def contamination(spark, d):
    ud, _ = kernels.principal_components(_dosages(spark, d), 1)
    bases = _sample_bases(spark, d).filter("allele < 2").select("sample", "snp", "allele", "bq")
    return kernels.contamination(bases, ud, 1)


@query()
def cluster_cells(spark, d):
    nine, snps = clustering.cut(pl.nine_state(_collapsed(spark, d))), views.snps(spark, d)
    start = clustering.seed_clusters(nine, snps, pl.singlet_score(nine, snps), 3)
    return clustering.cluster_cells(nine, snps, start, rounds=3)[0]


@query()
def delta_scores(spark, d):
    """Change of a small model's score by base G at every place of every document."""
    train = ["TTGACGTCAATTGACGTCAA", "ATTGACGTCAACTGACGTCA", "CCCGGGTTTCCCGGGTTTCC", "GGGCCCTTTGGGCCCTTTGG"]
    model = kernels.train_svm(train, [1, 1, 0, 0], length=8, k=5, most=3)
    return kernels.scan_texts(_read(spark, d, "documents"), model)


# ---------------------------------------------------------------- more, by subject; they register themselves

from strandline.plans import cohort, formats, numerics  # noqa: E402, F401
