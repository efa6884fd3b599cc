"""Words are dealt by their sequence, and counted only there."""

import re

from strandline.operators.sequence import kmer_counts


def test_no_table_of_words_before_the_exchange(spark):
    rows = spark.createDataFrame([(1, "ACACAC"), (1, "ACA"), (2, "AC"), (3, None)], "id int, seq string")
    got = kmer_counts(rows, 3, ["id"])
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("kmer" in x for x in dealt)
    assert sorted(map(tuple, got.collect())) == [(1, "ACA", 3), (1, "CAC", 2)]
