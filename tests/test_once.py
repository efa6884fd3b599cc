"""What iterative operators read once, and joins that leave rows where they are."""

from pyspark.sql import functions as F

from strandline.operators import mixtures, pileup
from strandline.operators import reads as rd


def test_mixtures_read_their_counts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def told(x):
        seen.add(1)
        return x

    raw = [(c, g, 1 + (c + g) % 3) for c in range(4) for g in range(5)]
    start = spark.createDataFrame([(k, g, 0.1 + 0.05 * ((g + k) % 5)) for k in range(2) for g in range(5)], "cluster int, gene int, p double")
    for run in (pileup.mixture_em, mixtures.mixture_with_doublets):
        seen.value = 0
        counts = spark.createDataFrame(raw, "cell int, gene int, n int").select("cell", "gene", told.asNondeterministic()("n").alias("umis"))
        assert run(counts, start, rounds=3)[0].count() > 0
        assert seen.value == len(raw)


def test_renamed_reads_stay_where_they_are(spark):
    reads = spark.createDataFrame([(i, "g0") for i in range(40)] + [(40, "g9"), (41, None)], "qname int, rg string").repartition(4, "qname")
    groups = spark.createDataFrame([("k", "g0")], "keep string, rg string")
    out = rd.merge_read_groups(reads, groups)
    assert {r.qname: r.rg for r in out.select("qname", "rg").collect()} == {i: "k" for i in range(40)} | {40: "g9", 41: None}
    assert out.filter("rg = 'k'").select(F.spark_partition_id()).distinct().count() > 1
