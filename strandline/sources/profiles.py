"""Tables that tools leave for one another: GC profiles, dense count matrices, dumps of pileups by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of one row of a profile, so that a long sequence is several rows.
PROFILE_BINS = 1 << 16


def write_gc_profile(gc: DataFrame, path: str, window: int, step: int) -> None:
    """(chrom, bin, gc) as dense arrays of small integers, null where a window has no known base."""
    block = F.floor(F.col("bin") / PROFILE_BINS)
    own = gc.groupBy("chrom", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("bin", F.col("gc").cast("short").alias("gc")))).alias("b"))
    rows = own.select("chrom", F.lit(window).alias("window"), F.lit(step).alias("step"), F.get("b", F.lit(0))["bin"].alias("first"), F.transform("b", lambda x: x["gc"]).alias("gc"))
    rows.write.mode("overwrite").parquet(path)


def read_gc_profile(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, window, step, bin, gc) of a profile."""
    rows = spark.read.parquet(path).select("chrom", "window", "step", "first", F.posexplode("gc").alias("n", "gc"))
    return rows.select("chrom", "window", "step", (F.col("first") + F.col("n")).cast("int").alias("bin"), F.col("gc").cast("int").alias("gc"))


def gc_at(points: DataFrame, gc: DataFrame, step: int, how: str = "inner") -> DataFrame:
    """Points (chrom, pos from 1) with the GC value of the bin that holds them."""
    keyed = points.withColumn("bin", F.floor((F.col("pos") - 1) / step).cast("int"))
    return keyed.join(gc, ["chrom", "bin"], how)


def read_dense_matrix(spark: SparkSession, path: str, keep: float = 1.0, seed: int = 1) -> DataFrame:
    """(gene, cell, umis) of a table with genes in its first column and a column for each cell; zeros are left out.

    With ``keep`` under one each molecule stays with that probability, by a normal
    approximation of the binomial draw from a hash of gene and cell.
    """
    wide = spark.read.csv(path, sep="\t", header=True)
    gene, cells = wide.columns[0], wide.columns[1:]
    long = wide.select(F.col(f"`{gene}`").alias("gene"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cells]), F.array(*[F.col(f"`{c}`") for c in cells]))).alias("cell", "v"))
    out = long.select("gene", "cell", F.col("v").try_cast("int").alias("umis")).filter("umis > 0")
    if keep >= 1:
        return out
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "gene", "cell"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))
    drawn = F.round(F.col("umis") * keep + normal * F.sqrt(F.col("umis") * keep * (1 - keep)))
    return out.withColumn("umis", F.least(F.greatest(drawn, F.lit(0)), F.col("umis")).cast("int")).filter("umis > 0")


def write_dump(bases: DataFrame, path: str, n_chunks: int) -> None:
    """(barcode, umi, snp, bq): one line a cell and UMI, the number of its places before them; cells are dealt over chunks by hash."""
    places = F.sort_array(F.collect_list(F.struct("snp", "bq")))
    rows = bases.groupBy("barcode", "umi").agg(places.alias("p"))
    pairs = F.flatten(F.transform("p", lambda x: F.array(x["snp"].cast("string"), x["bq"].cast("string"))))
    line = F.concat_ws("\t", "barcode", "umi", F.size("p").cast("string"), F.array_join(pairs, "\t"))
    chunk = F.pmod(F.xxhash64("barcode"), F.lit(n_chunks))
    rows.select(chunk.alias("chunk"), line.alias("value")).write.mode("overwrite").partitionBy("chunk").option("compression", "gzip").text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, barcode, umi, snp, bq) of all chunks; lines whose number of places is wrong are left out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select("chunk", c.alias("c"), F.get(c, F.lit(2)).try_cast("int").alias("n"))
    rows = rows.filter(F.size("c") == 3 + 2 * F.col("n"))
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.get("c", 3 + 2 * i).try_cast("int").alias("snp"), F.get("c", 4 + 2 * i).try_cast("int").alias("bq")))
    out = rows.filter("n > 0").select("chunk", F.get("c", F.lit(0)).alias("barcode"), F.get("c", F.lit(1)).alias("umi"), F.explode(places).alias("p"))
    return out.select("chunk", "barcode", "umi", "p.snp", "p.bq")
