"""Queries of whole cohorts: genotyping from reads to calls, frequencies with inbreeding, mixtures with doublets, gene models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandline.operators import clustering, dense, gapped, genes, inbreeding, kernels, mixtures, phasing
from strandline.operators import pileup as pl
from strandline.operators import variants as vr
from strandline.operators.lineage import cut
from strandline.plans import views
from strandline.plans.formats import SAM_SQL, SEQ, _sam
from strandline.plans.queries import _CT, _hits, HITS_SQL
from strandline.plans.registry import query, rounded
from strandline.plans.views import PANEL_SQL, READS_SQL

# ---------------------------------------------------------------- inbreeding

_SAMPLES, _ROUNDS, _LAMBDA = 8, 3, 0.5
_LOW = max(1e-5, 0.5 / (2 * _SAMPLES + 1))
_V = f"((CASE sample % 2 WHEN 0 THEN 1 ELSE -1 END) / sqrt({_SAMPLES}.0))"
#: All samples of every variant; those without a genotype have flat likelihoods.
_FULL_SQL = (
    f"f AS (SELECT t.snp, CAST(s.s AS INT) sample, coalesce(p.code, 0) code FROM (SELECT DISTINCT snp FROM panel) t CROSS JOIN range({_SAMPLES}) s(s) "
    "LEFT JOIN panel p ON p.snp = t.snp AND p.sample = s.s), "
    "lik AS (SELECT snp, sample, " + ", ".join(f"CASE code WHEN 0 THEN 1.0::DOUBLE ELSE pow(10.0, -2.0 * abs(code - 1 - {g})) END l{g}" for g in range(3)) + " FROM f)"
)


def _inbred_sql(q: str, theta: str) -> str:
    """Shares of three genotypes as one struct, of a frequency and theta."""
    e = [f"(1 - {q}) * (1 - {q})", f"2 * {q} * (1 - {q})", f"{q} * {q}"]
    mg = _LOW * _LOW
    gain = f"(CASE WHEN {e[0]} + 0.5 * {theta} * {e[1]} < {mg} THEN {mg} - {e[0]} WHEN {e[2]} + 0.5 * {theta} * {e[1]} < {mg} THEN {mg} - {e[2]} ELSE 0.5 * {theta} * {e[1]} END)"
    return f"{{a: {e[0]} + {gain}, b: {e[1]} - 2 * {gain}, c: {e[2]} + {gain}}}"


def _fit_sql(k: str) -> str:
    """Ridge projection on the ones and one orthogonal unit vector, halved."""
    root = math.sqrt(_SAMPLES)
    return (
        f"({_SAMPLES} / (({root} + lam) * ({root} + lam)) * sum(y{k}) OVER w / {_SAMPLES} + 1 / ((1 + lam) * (1 + lam)) * {_V} * sum({_V} * y{k}) OVER w) / 2 f{k}"
    )


def _inbreeding_sql() -> str:
    out = f"{_FULL_SQL}, p0 AS (SELECT DISTINCT snp, 0.5::DOUBLE p FROM lik)"
    for r in range(1, 11):
        out += (
            f", p{r} AS (SELECT snp, least(greatest(sum((2*p*(1-p)*l1 + 2*p*p*l2) / ((1-p)*(1-p)*l0 + 2*p*(1-p)*l1 + p*p*l2)) / {2 * _SAMPLES}, {_LOW}), {1 - _LOW}) p "
            f"FROM lik JOIN p{r - 1} USING (snp) GROUP BY snp)"
        )
    out += ", s0 AS (SELECT l.*, p, p qe, p qd, 0.0::DOUBLE th, p > 0.5 + 1e-9 flip, least(p, 1 - p) maf FROM lik l JOIN p10 USING (snp))"
    for r in range(1, _ROUNDS + 1):
        homo = "CASE WHEN flip THEN l0 * {0}.a ELSE l2 * {0}.c END"
        y = "(l1 * {0}.b + 2 * " + homo + ") / (l0 * {0}.a + l1 * {0}.b + l2 * {0}.c)"
        out += (
            f", e{r} AS (SELECT *, {_inbred_sql('qe', '0')} ge, {_inbred_sql('qd', 'th')} gd, {_LAMBDA} * (1 - maf) / (2 * maf * {_SAMPLES}) lam FROM s{r - 1}), "
            f"y{r} AS (SELECT *, {y.format('ge')} ye, {y.format('gd')} yd, l1 * gd.b / (l0 * gd.a + l1 * gd.b + l2 * gd.c) het FROM e{r}), "
            f"f{r} AS (SELECT *, {', '.join(_fit_sql(k) for k in 'ed')}, 1 - sum(het) OVER w / sum(ge.b) OVER w nth FROM y{r} WINDOW w AS (PARTITION BY snp)), "
            f"s{r} AS (SELECT snp, sample, l0, l1, l2, p, {', '.join(f'least(greatest(CASE WHEN flip THEN 1 - f{k} ELSE f{k} END, {_LOW}), {1 - _LOW}) q{k}' for k in 'ed')}, nth th, flip, maf FROM f{r})"
        )
    models = {"00": ("p", "0"), "01": ("p", "th"), "10": ("qe", "0"), "11": ("qd", "th")}
    out += f", g AS (SELECT *, {', '.join(f'{_inbred_sql(*m)} g{k}' for k, m in models.items())} FROM s{_ROUNDS})"
    llk = ", ".join(f"sum(ln(l0 * g{k}.a + l1 * g{k}.b + l2 * g{k}.c)) llk{k}" for k in models)
    return out + f", m AS (SELECT snp, any_value(p) af, any_value(th) theta, {llk} FROM g GROUP BY snp)"


_ROOT = "CASE WHEN llk{1} < llk{0} THEN 0.0 ELSE (CASE WHEN theta < 0 THEN -1 ELSE 1 END) * sqrt(2 * greatest(llk{1} - llk{0}, 0)) END"


def _full_likelihoods(spark, d):
    panel = views.panel(spark, d).select("sample", "snp", "code")
    every = panel.select("snp").distinct().select("snp", F.explode(F.array(*[F.lit(i) for i in range(_SAMPLES)])).alias("sample"))
    full = every.join(panel, ["snp", "sample"], "left").fillna(0, ["code"])
    like = [F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10.0).alias(f"l{g}") for g in range(3)]
    likelihoods = vr.pl_from_gt(full).select("snp", "sample", *like)
    sign = F.when(F.col("sample") % 2 == 0, 1.0).otherwise(-1.0) / math.sqrt(_SAMPLES)
    return likelihoods, likelihoods.select("sample").distinct().select("sample", F.array(sign).alias("v"))


@query(
    f"WITH {PANEL_SQL}, {_inbreeding_sql()} SELECT snp, round(af, 6) af, round(theta, 6) theta, {', '.join(f'round(llk{k}, 6) llk{k}' for k in ('00', '01', '10', '11'))}, "
    f"round({_ROOT.format('00', '01')}, 4) z_pooled, round({_ROOT.format('10', '11')}, 4) z_own FROM m"
)
def inbreeding_em_rounds(spark, d):
    """Three rounds of frequencies and inbreeding together, and the four models' likelihoods."""
    likelihoods, vectors = _full_likelihoods(spark, d)
    out = rounded(inbreeding.inbreeding_em(likelihoods, vectors, _LAMBDA, _ROUNDS), "af", "theta", "llk00", "llk01", "llk10", "llk11")
    return out.select("snp", "af", "theta", "llk00", "llk01", "llk10", "llk11", F.round("z_pooled", 4).alias("z_pooled"), F.round("z_own", 4).alias("z_own"))


@query(f"WITH {PANEL_SQL}, {_inbreeding_sql()} SELECT snp, sample, round(qd, 6) p FROM s{_ROUNDS}")
def inbred_individual_frequencies(spark, d):
    likelihoods, vectors = _full_likelihoods(spark, d)
    own = inbreeding.inbreeding_em(likelihoods, vectors, _LAMBDA, _ROUNDS).select("snp", F.explode("isaf").alias("x"))
    return rounded(own.select("snp", "x.sample", "x.p"), "p")


@query(None)
def inbreeding_search(spark, d):
    """By simplex search; tested by known answers."""
    likelihoods, vectors = _full_likelihoods(spark, d)
    return inbreeding.inbreeding_search(likelihoods, vectors)


def _ridge_sql(rounds: int) -> str:
    """Frequencies of each sample's own, from one half: expected genotypes, projected on the vector with a ridge of their mean."""
    low, root = 0.5 / (2 * _SAMPLES + 1), math.sqrt(_SAMPLES)
    out = f"{_FULL_SQL}, r0 AS (SELECT *, 0.5::DOUBLE p FROM lik)"
    for r in range(1, rounds + 1):
        out += (
            f", a{r} AS (SELECT *, (l1*2*p*(1-p) + 2*l2*p*p) / (l0*(1-p)*(1-p) + l1*2*p*(1-p) + l2*p*p) y FROM r{r - 1}), "
            f"b{r} AS (SELECT *, avg(y) OVER (PARTITION BY snp) / 2 mean FROM a{r}), "
            f"c{r} AS (SELECT *, mean > 0.5 + 1e-9 flip, CASE WHEN mean > 0.5 + 1e-9 THEN 2 - y ELSE y END t, CASE WHEN mean > 0.5 + 1e-9 THEN 1 - mean ELSE mean END minor FROM b{r}), "
            f"d{r} AS (SELECT *, (1 - minor) / greatest(2 * minor * {_SAMPLES}, 1e-10) lam FROM c{r}), "
            f"e{r} AS (SELECT *, ({_SAMPLES} / (({root} + lam) * ({root} + lam)) * sum(t) OVER w / {_SAMPLES} + 1 / ((1 + lam) * (1 + lam)) * {_V} * sum({_V} * t) OVER w) / 2 q FROM d{r} WINDOW w AS (PARTITION BY snp)), "
            f"r{r} AS (SELECT snp, sample, l0, l1, l2, least(greatest(CASE WHEN flip THEN 1 - q ELSE q END, {low}), {1 - low}) p FROM e{r})"
        )
    return out


@query(f"WITH {PANEL_SQL}, {_ridge_sql(2)} SELECT snp, sample, round(p, 6) isaf FROM r2")
def individual_frequency_rounds(spark, d):
    """Two rounds of frequencies that differ from sample to sample."""
    likelihoods, vectors = _full_likelihoods(spark, d)
    return rounded(kernels.individual_frequencies(likelihoods, vectors, 1.0, 2), "isaf")


# ---------------------------------------------------------------- dense genotyping

_KINDS = "CASE p_size % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
_DENSE_SITES = (
    f"site AS (SELECT DISTINCT chrom, pos, ref, alt, chrom || ':' || pos || ':' || ref || ':' || alt snp FROM (SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) chrom, "
    f"CAST(p_partkey % 3000 * 7 + {_KINDS.format(10, 10, 8)} AS INT) pos, {_KINDS.format(chr(39) + 'A' + chr(39), chr(39) + 'ACC' + chr(39), chr(39) + 'A' + chr(39))} ref, "
    f"{_KINDS.format(chr(39) + 'G' + chr(39), chr(39) + 'A' + chr(39), chr(39) + 'ATGC' + chr(39))} alt FROM part))"
)
_SPAN = "CASE cigar WHEN '20M' THEN 20 ELSE 17 END"
#: Offset of a site in a read's bases, none where it has no base there.
_AT = "CASE cigar WHEN '20M' THEN g WHEN '5S10M2D5M' THEN CASE WHEN g < 10 THEN g + 5 WHEN g >= 12 THEN g + 3 END ELSE CASE WHEN g < 8 THEN g ELSE g + 3 END END"
_SEEN = (
    f"r AS (SELECT s.*, CAST(substr(md5(qname), 1, 1) AS VARCHAR) AS sm, {_SPAN} size FROM sam s WHERE flag & 1796 = 0), "
    f"met AS (SELECT sm, snp, ref, alt, cigar, (flag & 16) = 0 fwd, mapq, site.pos - r.pos g, r.pos + size - 1 >= site.pos + length(ref) - 1 whole, length(alt) - length(ref) d FROM r JOIN site USING (chrom) "
    "WHERE site.pos BETWEEN r.pos AND r.pos + size - 1), "
    f"base AS (SELECT *, {_AT} o, substring('{SEQ}', CAST({_AT} + 1 AS INT), 1) b, cigar = '5S10M2D5M' AND g = 9 del, cigar = '8M3I9M' AND g = 7 ins FROM met), "
    "seen AS (SELECT sm, snp, fwd, mapq, coalesce(o, 0) + 1 cyc, CASE WHEN d = 0 THEN CASE b WHEN ref THEN 0 WHEN alt THEN 1 ELSE 2 END WHEN NOT whole THEN 2 "
    "WHEN d < 0 THEN CASE WHEN del THEN CASE WHEN d = -2 THEN 1 ELSE 2 END WHEN ins THEN 2 ELSE 0 END "
    f"ELSE CASE WHEN ins THEN CASE WHEN substr(alt, 2) = substring('{SEQ}', 9, 3) THEN 1 ELSE 2 END WHEN del THEN 2 ELSE 0 END END allele, "
    "CASE WHEN d = 0 THEN 40 ELSE 30 * abs(d) END bq FROM base WHERE d <> 0 OR o IS NOT NULL)"
)
_E = "pow(10.0, -least(bq, 40) / 10.0)"
_OWN = [f"((1 - {_E}) * (1 - c) + {_E} * c / 3)", f"((1 - {_E}) / 2 + {_E} / 6)", f"((1 - {_E}) * c + {_E} * (1 - c) / 3)"]
_TOTAL = "(" + " + ".join(_OWN) + ")"
_DENSE_SQL = (
    f"{SAM_SQL}, {_DENSE_SITES}, {_SEEN}, "
    "lg AS (SELECT sm, snp, count(*) dp, count(*) FILTER (WHERE allele = 0) ad0, count(*) FILTER (WHERE allele = 1) ad1, "
    + ", ".join(f"sum(ln(CASE allele WHEN 0 THEN {_OWN[g]} / {_TOTAL} ELSE {_OWN[2 - g]} / {_TOTAL} END)) l{g}" for g in range(3))
    + " FROM (SELECT *, greatest(CASE WHEN sm < '8' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 0.01::DOUBLE) c FROM seen WHERE allele < 2) GROUP BY sm, snp), "
    "pls AS (SELECT sm, snp, dp, ad0, ad1, " + ", ".join(f"CAST(least(floor((l{g} - greatest(l0, l1, l2)) * -10 / ln(10.0) + 0.5), 255) AS INT) pl{g}" for g in range(3)) + " FROM lg), "
    "lik AS (SELECT *, " + ", ".join(f"pow(10.0, -pl{g} / 10.0) l{g}" for g in range(3)) + " FROM pls), em0 AS (SELECT DISTINCT snp, 0.5::DOUBLE af FROM lik)"
    + "".join(
        f", em{r} AS (SELECT snp, least(greatest((sum((2*af*(1-af)*l1 + 2*af*af*l2) / ((1-af)*(1-af)*l0 + 2*af*(1-af)*l1 + af*af*l2)) + 2 * (16 - count(*)) * any_value(af)) / 32, 0.5/33), 1 - 0.5/33) af "
        f"FROM lik JOIN em{r - 1} USING (snp) GROUP BY snp)"
        for r in range(1, 11)
    )
)


def _dense(spark, d):
    k = F.col("p_size") % 3
    pick = lambda *x: F.when(k == 0, x[0]).when(k == 1, x[1]).otherwise(x[2])
    sites = spark.read.parquet(f"{d}/part.parquet").select(
        (F.col("p_partkey") % 5 + 1).cast("string").alias("chrom"), (F.col("p_partkey") % 3000 * 7 + pick(10, 10, 8)).cast("int").alias("pos"),
        pick("A", "ACC", "A").alias("ref"), pick("G", "A", "ATGC").alias("alt"),
    ).distinct()
    sites = sites.withColumn("snp", F.concat_ws(":", "chrom", "pos", "ref", "alt"))
    reads = _sam(spark, d).withColumn("sample", F.substring(F.md5("qname"), 1, 1))
    samples = reads.select("sample").distinct().withColumn("contamination", F.when(F.col("sample") < "8", 0.05))
    return dense.dense_genotypes(reads, sites, samples, width=64)


@query(
    f"WITH {_DENSE_SQL}, w AS (SELECT sm, snp, dp, ad0, ad1, pl0, pl1, pl2, l0*(1-af)*(1-af) w0, l1*2*af*(1-af) w1, l2*af*af w2 FROM lik JOIN em10 USING (snp)) "
    "SELECT sm sample, snp, dp, ad0, ad1, pl0, pl1, pl2, CASE greatest(w0, w1, w2) WHEN w0 THEN 0 WHEN w1 THEN 1 ELSE 2 END gt, "
    "CAST(least(floor(-10 * log10(greatest(1 - greatest(w0, w1, w2) / (w0 + w1 + w2), 1e-10)) + 1e-6), 255) AS INT) gq FROM w"
)
def dense_genotype_calls(spark, d):
    """From reads to genotypes of single bases, deletions and insertions in sixteen samples."""
    return _dense(spark, d)[0].select("sample", "snp", "dp", "ad0", "ad1", "pl0", "pl1", "pl2", "gt", "gq")


_COR = "CASE WHEN n*{xx} - {x}*{x} > 0 AND n*a - a*a > 0 THEN (n*{xa} - {x}*a) / sqrt((n*{xx} - {x}*{x}) * (n*a - a*a)) ELSE 0 END"
_COVARIATES = {"bqz": "bq", "stz": "CAST(fwd AS INT)", "mqz": "mapq", "cyz": "cyc"}


@query(
    f"WITH {_DENSE_SQL}, w AS (SELECT sm, snp, l0*(1-af)*(1-af) w0, l1*2*af*(1-af) w1, l2*af*af w2, af, l0, l1, l2 FROM lik JOIN em10 USING (snp)), "
    "t AS (SELECT snp, any_value(af) af, sum(af*(1-af)*(l0-2*l1+l2)/(w0+w1+w2)) su, sum(pow(af*(1-af)*(l0-2*l1+l2)/(w0+w1+w2), 2)) suu, sum(w1/(w0+w1+w2)) + (16 - count(*)) * 2*any_value(af)*(1-any_value(af)) het FROM w GROUP BY snp), "
    "q AS (SELECT sm, snp, count(*)::DOUBLE n, sum(1 - allele)::DOUBLE r, sum(allele)::DOUBLE a, "
    + ", ".join(f"sum({x})::DOUBLE {k}x, sum({x}*{x})::DOUBLE {k}xx, sum({x}*allele)::DOUBLE {k}xa" for k, x in _COVARIATES.items())
    + " FROM seen WHERE allele < 2 GROUP BY sm, snp), "
    "v AS (SELECT q.*, ln(n + 1) lw, CASE WHEN w1 > w0 AND w1 >= w2 THEN 1.0 ELSE 0.0 END h FROM q JOIN w USING (sm, snp)), "
    "s AS (SELECT snp, count(*)::DOUBLE n_with_reads, sum(n) dp, sum(h*lw*(r+0.05)/(n+0.1)) / nullif(sum(h*lw), 0) abe, sum(h*lw*(r-n/2)/sqrt(n/4+1e-3)) / sqrt(nullif(sum(h*lw*lw), 0)) abz, "
    + ", ".join(f"sum(sqrt(n)*lw*({_COR.format(x=k + 'x', xx=k + 'xx', xa=k + 'xa')})) / sqrt(sum(lw*lw)) {k}" for k in _COVARIATES)
    + " FROM v GROUP BY snp) SELECT snp, n_with_reads, dp, round(af, 6) af, round(su / sqrt(suu + 1/((1-af)*(1-af)) + 2/(af*(1-af)) + 1/(af*af)), 5) z, "
    "round(1 - (het + 1) / (2*af*(1-af)*16 + 1), 6) f, round(abe, 6) abe, round(abz, 5) abz, " + ", ".join(f"round({k}, 5) {k}" for k in _COVARIATES) + " FROM t JOIN s USING (snp)"
)
def dense_genotype_sites(spark, d):
    """Statistics of the same variants over all samples."""
    out = _dense(spark, d)[1]
    fine = {"z": 5, "abz": 5, "bqz": 5, "stz": 5, "mqz": 5, "cyz": 5, "af": 6, "f": 6, "abe": 6}
    return out.select("snp", "n_with_reads", "dp", *[F.round(c, n).alias(c) for c, n in fine.items()])


# ---------------------------------------------------------------- mixtures with doublets

_CLUSTERS, _DOUBLET = 3, 0.2


def _doublet_sql(rounds: int) -> str:
    out = (
        f"start AS (SELECT gene, k cluster, (gene * 7 + k * 13) % 50 + 1.0::DOUBLE w FROM (SELECT DISTINCT tx gene FROM ct), range({_CLUSTERS}) t(k)), "
        f"p0 AS (SELECT cluster, gene, w / sum(w) OVER (PARTITION BY cluster) p FROM start), s0 AS (SELECT DISTINCT cluster, 1.0::DOUBLE / {_CLUSTERS} pi FROM start)"
    )
    for r in range(1, rounds + 1):
        out += (
            f", o{r} AS (SELECT a.cluster a, b.cluster b, CASE WHEN a.cluster = b.cluster THEN ln({1 - _DOUBLET} * a.pi) ELSE ln({_DOUBLET} * a.pi * b.pi / sum(CASE WHEN a.cluster < b.cluster THEN a.pi * b.pi END) OVER ()) END prior "
            f"FROM s{r - 1} a, s{r - 1} b WHERE a.cluster <= b.cluster), "
            f"l{r} AS (SELECT cell, a, b, sum((umis + 0.01) * ln((x.p + y.p) / 2)) + any_value(prior) ll FROM ct JOIN p{r - 1} x ON x.gene = tx JOIN p{r - 1} y ON y.gene = tx JOIN o{r} ON a = x.cluster AND b = y.cluster GROUP BY 1, 2, 3), "
            f"z{r} AS (SELECT cell, a, b, exp(ll - m) / sum(exp(ll - m)) OVER (PARTITION BY cell) z FROM (SELECT *, max(ll) OVER (PARTITION BY cell) m FROM l{r})), "
            f"w{r} AS (SELECT cell, cluster, sum(z) w FROM (SELECT cell, a cluster, CASE WHEN a = b THEN z ELSE z / 2 END z FROM z{r} UNION ALL SELECT cell, b, z / 2 FROM z{r} WHERE a < b) GROUP BY 1, 2), "
            f"s{r} AS (SELECT cluster, avg(w) pi FROM w{r} GROUP BY 1), "
            f"p{r} AS (SELECT cluster, gene, w / sum(w) OVER (PARTITION BY cluster) p FROM (SELECT cluster, tx gene, sum(w * (umis + 0.01)) w FROM ct JOIN w{r} USING (cell) GROUP BY 1, 2))"
        )
    return out


def _mixture(spark, d):
    counts = cut(pl.umi_counts(_hits(spark, d), 3).select("cell", F.col("tx").alias("gene"), "umis"))
    start = counts.select("gene").distinct().withColumn("cluster", F.explode(F.array(*[F.lit(i) for i in range(_CLUSTERS)])))
    start = start.withColumn("w", ((F.col("gene") * 7 + F.col("cluster") * 13) % 50 + 1).cast("double"))
    start = start.join(start.groupBy("cluster").agg(F.sum("w").alias("t")), "cluster").select("cluster", "gene", (F.col("w") / F.col("t")).alias("p"))
    return mixtures.mixture_with_doublets(counts, start, _DOUBLET, 3)


@query(
    f"WITH {READS_SQL}, {HITS_SQL}, {_CT}, {_doublet_sql(3)} SELECT cell, CAST(arg_max(a, z) AS INT) best, CAST(CASE WHEN arg_max(a, z) < arg_max(b, z) THEN arg_max(b, z) END AS INT) other, "
    "round(coalesce(sum(z) FILTER (WHERE a < b), 0), 5) p_doublet FROM z3 GROUP BY cell"
)
def mixture_doublets(spark, d):
    """Cells of one profile or of two."""
    return _mixture(spark, d)[0].select("cell", "best", "other", F.round("p_doublet", 5).alias("p_doublet"))


@query(f"WITH {READS_SQL}, {HITS_SQL}, {_CT}, {_doublet_sql(3)} SELECT CAST(cluster AS INT) cluster, gene, round(p, 7) p FROM p3")
def mixture_doublet_profiles(spark, d):
    return rounded(_mixture(spark, d)[1], "p", digits=7)


# ---------------------------------------------------------------- gene models

_MODELS = (
    "e AS (SELECT DISTINCT CAST(p_partkey % 3 AS VARCHAR) chrom, CASE p_partkey % 2 WHEN 0 THEN '+' ELSE '-' END strand, CAST(p_partkey * 37 % 5000 AS INT) beg, "
    "CAST(p_partkey * 37 % 5000 + p_size AS INT) \"end\", 't' || p_partkey % 180 tx, 'g' || p_partkey % 60 gene FROM part), "
    "f AS (SELECT DISTINCT CAST(l_orderkey % 20 AS INT) cell, l_orderkey umi, CAST(l_orderkey % 3 AS VARCHAR) chrom, CASE l_orderkey % 2 WHEN 0 THEN '+' ELSE '-' END strand, "
    "CAST(l_partkey % 5000 AS INT) beg, CAST(l_partkey % 5000 + 20 AS INT) \"end\" FROM lineitem), "
    "h0 AS (SELECT DISTINCT cell, umi, f.beg b, f.\"end\" z, tx, gene, tx || ':' || chrom || ':' || e.beg || '-' || e.\"end\" exon FROM f JOIN e USING (chrom, strand) WHERE f.beg <= e.\"end\" AND e.beg <= f.\"end\")"
)
_GENES = (
    "k AS (SELECT gene, chrom, CAST(floor((min(beg) + max(\"end\")) / 500.0) AS BIGINT) bin FROM e GROUP BY gene, chrom), "
    "m AS (SELECT DISTINCT cell, umi, min(gene) OVER (PARTITION BY cell, umi, chrom, bin) element FROM (SELECT DISTINCT cell, umi, gene FROM h) JOIN k USING (gene)) "
    "SELECT level, element, cell, CAST(count(*) AS BIGINT) umis FROM (SELECT DISTINCT 'exon' AS level, exon element, cell, umi FROM h UNION ALL SELECT DISTINCT 'transcript', tx, cell, umi FROM h "
    "UNION ALL SELECT 'gene', element, cell, umi FROM m) GROUP BY ALL"
)


def _models(spark, d):
    """Molecules of several stretches, and exons of transcripts of genes."""
    n = F.col("l_orderkey")
    side = lambda c: F.when(c % 2 == 0, "+").otherwise("-").alias("strand")
    fragments = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (n % 20).cast("int").alias("cell"), n.alias("umi"), (n % 3).cast("string").alias("chrom"), side(n), (F.col("l_partkey") % 5000).cast("int").alias("beg"),
        (F.col("l_partkey") % 5000 + 20).cast("int").alias("end"),
    )
    k = F.col("p_partkey")
    elements = spark.read.parquet(f"{d}/part.parquet").select(
        (k % 3).cast("string").alias("chrom"), side(k), (k * 37 % 5000).cast("int").alias("beg"), (k * 37 % 5000 + F.col("p_size")).cast("int").alias("end"), F.lit("exon").alias("type"),
        F.concat(F.lit("t"), (k % 180).cast("string")).alias("transcript_id"), F.concat(F.lit("g"), (k % 60).cast("string")).alias("gene_id"),
    ).distinct()
    return fragments, elements


@query(f"WITH {_MODELS}, h AS (SELECT * FROM h0), {_GENES}")
def element_umis(spark, d):
    """Molecules of each cell at exons, transcripts and genes."""
    return genes.element_umis(*_models(spark, d), unique_bin=1000, width=500)


@query(
    f"WITH {_MODELS}, n AS (SELECT cell, umi, count(*) c FROM f GROUP BY 1, 2), t AS (SELECT cell, umi, tx FROM (SELECT DISTINCT cell, umi, tx, b, z FROM h0) JOIN n USING (cell, umi) GROUP BY 1, 2, 3 HAVING count(*) = any_value(c)), "
    f"h AS (SELECT h0.* FROM h0 SEMI JOIN t USING (cell, umi, tx)), {_GENES}"
)
def compatible_element_umis(spark, d):
    """The same where a transcript must hold all of a molecule's stretches."""
    return genes.element_umis(*_models(spark, d), unique_bin=1000, whole=True, width=500)


# ---------------------------------------------------------------- gapped k-mer classifiers

_GAPPED = gapped.mismatch_weights("est_trunc", 4, 3, 2)
_GAPPED_SQL = (
    "t AS (SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^CGT]', 'A', 'g') s FROM documents), "
    "v AS (SELECT vec_id, list_reduce(list_transform(range(0, 12), lambda k: substr('ACGT', CAST((vec_id >> CAST(2 * k AS INT)) & 3 AS INT) + 1, 1)), lambda a, b: a || b) s FROM embeddings), "
    "l AS (SELECT unnest(['A', 'C', 'G', 'T']) x), w AS (SELECT a.x || b.x || c.x || d.x u FROM l a, l b, l c, l d), "
    f"m AS (SELECT p.u, q.u z, CASE hamming(p.u, q.u) {' '.join(f'WHEN {m} THEN {float(x)!r}::DOUBLE' for m, x in enumerate(_GAPPED) if x)} END y FROM w p, w q WHERE hamming(p.u, q.u) <= 2), "
    + ", ".join(
        f"{n}f AS (SELECT {k}, substr(s, CAST(p AS INT), 4) u FROM (SELECT {k}, s, unnest(range(1, length(s) - 2)) p FROM {n} WHERE length(s) > 3)), "
        f"{n}b AS (SELECT {k}, u, count(*)::DOUBLE n FROM (SELECT * FROM {n}f UNION ALL SELECT {k}, reverse(translate(u, 'ACGT', 'TGCA')) FROM {n}f) GROUP BY 1, 2), "
        f"{n}n AS (SELECT a.{k}, sqrt(sum(a.n * m.y * b.n)) r FROM {n}b a JOIN m ON a.u = m.u JOIN {n}b b ON b.{k} = a.{k} AND b.u = m.z GROUP BY 1)"
        for n, k in (("t", "doc_id"), ("v", "vec_id"))
    )
    + ", c AS (SELECT u, sum((vec_id % 7 - 3) / 8.0::DOUBLE * n / r) c FROM vb JOIN vn USING (vec_id) GROUP BY 1), g AS (SELECT m.u, sum(m.y * c.c) g FROM m JOIN c ON c.u = m.z GROUP BY 1), "
    "o AS (SELECT doc_id, sum(n * g.g) / any_value(r) s FROM tb JOIN tn USING (doc_id) JOIN g USING (u) GROUP BY 1)"
)


@query(f"WITH {_GAPPED_SQL} SELECT doc_id, round(coalesce(o.s, 0), 4) score FROM documents LEFT JOIN o USING (doc_id)")
def gapped_document_scores(spark, d):
    """Every document, read as bases, by a classifier given as a table of support vectors."""
    base = lambda k: F.substring(F.lit("ACGT"), F.shiftright(F.col("vec_id").cast("int"), 2 * k).bitwiseAND(3) + 1, F.lit(1))
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(*[base(k) for k in range(12)]).alias("sequence"), ((F.col("vec_id") % 7 - 3) / F.lit(8.0)).alias("weight"))
    model = gapped.vector_model(gapped.prepared(vectors, _GAPPED), _GAPPED)
    out = gapped.sequence_scores(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), model, _GAPPED, seq="text")
    return rounded(out.select("doc_id", "score"), "score", digits=4)


@query()
def gapped_fold_scores(spark, d):
    """Customers of one segment told from the others by segment and name spelled in bases: scores of each fold by a classifier of the other."""
    weights = gapped.mismatch_weights("est_trunc", 6, 4, 2)
    spelled = F.translate(F.concat(F.md5("c_mktsegment"), F.md5("c_name")), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", spelled.alias("sequence"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    out = gapped.fold_scores(gapped.prepared(rows, weights, peak=20, half=20.0), weights, "c_custkey", folds=2, rounds=6)
    return rounded(out.select("c_custkey", "label", "fold", "score"), "score", digits=4)


# ---------------------------------------------------------------- phasing of joined blocks, communities at all levels


@query()
def phased_panel(spark, d):
    """Every genotype of the panel with its alleles by haplotype, in blocks of four sites that share two."""
    return phasing.phased(views.panel(spark, d).select("sample", "snp", "code"), 4, 2)


_SUPPLIES_SQL = "supplies AS (SELECT 2 * l_suppkey a, 2 * l_partkey + 1 b, count(*)::DOUBLE w FROM lineitem GROUP BY 1, 2)"


def _supplies(spark, d):
    """Suppliers and the parts they delivered, as one graph."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy((2 * F.col("l_suppkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))


@query(
    f"WITH {_SUPPLIES_SQL}, e AS (SELECT a, b, w FROM supplies UNION ALL SELECT b, a, w FROM supplies), s AS (SELECT a // 2 % 10 x, sum(w) tot, sum(CASE WHEN a // 2 % 10 = b // 2 % 10 THEN w ELSE 0 END) o FROM e GROUP BY 1) "
    "SELECT CAST(count(*) AS BIGINT) n_groups, sum(tot) / 2 weight, round(sum(o) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 8) modularity FROM s"
)
def grouping_modularity(spark, d):
    """Modularity of suppliers and parts grouped by their last digit."""
    edges = _supplies(spark, d)
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    return rounded(clustering.modularity(edges, nodes.withColumn("community", F.expr("node div 2 % 10"))), "modularity", digits=8)


@query()
def graph_community_levels(spark, d):
    """Communities of suppliers and parts at all levels, from three rounds of moves each."""
    return clustering.community_levels(_supplies(spark, d), rounds=3)
