"""The harness tables read as genomic ones, so that operators run on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of reads at variants: cell, snp, umi, allele, bq, fwd, flag, read order."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 20 as int) as cell",
        "cast(l_partkey % 100 as int) as snp",
        "l_linenumber as umi",
        "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as allele",
        "least(cast(floor(l_quantity) as int), 40) as bq",
        "l_linestatus = 'O' as fwd",
        "cast(l_linenumber + 8 * int(l_linestatus = 'O') + 16 * int(l_returnflag = 'R') as int) as flag",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as ord",
        "l_orderkey as read_id",
    )


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the reads: snp, chrom, pos, af."""
    return _table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 100 as int) as snp").distinct().selectExpr(
        "snp", "snp % 22 + 1 as chrom", "snp * 1000 + 1 as pos", "(snp % 49 + 1) / 50.0D as af"
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes: sample, snp, code (0 missing, 1 hom-ref, 2 het, 3 hom-alt), dp, gq."""
    return (
        _table(spark, sf_dir, "orders")
        .selectExpr("cast(o_custkey % 8 as int) as sample", "cast(o_orderkey % 100 as int) as snp", "o_custkey div 8 as c", "o_orderkey as o")
        .groupBy("sample", "snp")
        .agg(_expr("cast(sum(c) % 4 as int)", "code"), _expr("cast(count(1) as int)", "dp"), _expr("cast(sum(o) % 60 as int)", "gq"))
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals: id, chrom, beg, end, and whether they are targets."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "cast(o_custkey % 22 as int) as chrom",
        "datediff(date(o_orderdate), date'1995-01-01') as beg",
        "cast(datediff(date(o_orderdate), date'1995-01-01') + o_orderkey % 30 as int) as end",
        "o_orderpriority = '1-URGENT' as target",
    )


def _expr(sql: str, name: str):
    from pyspark.sql import functions as F

    return F.expr(sql).alias(name)


READS_SQL = """reads AS (SELECT CAST(l_suppkey % 20 AS INT) cell, CAST(l_partkey % 100 AS INT) snp, l_linenumber umi,
 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END allele,
 least(CAST(floor(l_quantity) AS INT), 40) bq, l_linestatus = 'O' fwd,
 CAST(l_linenumber + 8 * CAST(l_linestatus = 'O' AS INT) + 16 * CAST(l_returnflag = 'R' AS INT) AS INT) flag,
 l_orderkey read_id, l_orderkey o1, l_linenumber o2, l_partkey o3, l_suppkey o4, l_extendedprice o5, l_shipdate o6 FROM lineitem)"""
SNPS_SQL = """snps AS (SELECT DISTINCT CAST(l_partkey % 100 AS INT) snp, CAST(l_partkey % 100 % 22 + 1 AS INT) chrom,
 CAST(l_partkey % 100 * 1000 + 1 AS INT) pos, (l_partkey % 100 % 49 + 1) / 50.0::DOUBLE af FROM lineitem)"""
PANEL_SQL = """panel AS (SELECT CAST(o_custkey % 8 AS INT) sample, CAST(o_orderkey % 100 AS INT) snp,
 CAST(sum(o_custkey // 8) % 4 AS INT) code, CAST(count(*) AS INT) dp, CAST(sum(o_orderkey) % 60 AS INT) gq FROM orders GROUP BY ALL)"""
INTERVALS_SQL = """ivl AS (SELECT o_orderkey id, CAST(o_custkey % 22 AS INT) chrom,
 CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) beg,
 CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS INT) "end", o_orderpriority = '1-URGENT' target FROM orders)"""
