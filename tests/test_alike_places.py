import datetime

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals as iv
from strandline.plans.queries import QUERIES
import strandline.plans.numerics  # noqa: F401


def joined_rows(df):
    """Rows that the joins of an executed plan gave."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in name:
            out.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("name", ["interval_overlap_join", "contained_intervals"])
def test_places_meet_in_place_of_rows(spark, tmp_path, name):
    # 300 orders of one chromosome and day with two lengths, a fifth of them targets
    rows = [(30 * i + i % 2, 22 * i, datetime.datetime(1995, 3, 1), "1-URGENT" if i % 5 == 0 else "5-LOW") for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    got = df.collect()
    assert len(set(got)) == len(got) == (240 * 60 if name == "interval_overlap_join" else 2 * 150 * 149 + 150 * 150)
    (met,) = joined_rows(df)
    assert met <= 4


def test_alike_rows_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(iv, "ALIKE", 7)
    spans = [(1, 5), (1, 5), (3, 40), (33, 33), (5, 1), (None, 3)]
    left = spark.createDataFrame([(c, *spans[i % 6], i if i % 4 else None, "x" * (i % 3)) for i in range(90) for c in ("a", "b", None)], "chrom string, beg int, end int, id int, tag string")
    right = left.filter("chrom = 'a'").select("chrom", "beg", "end", F.col("id").alias("id2"))
    for how in ("overlap", "contained"):
        plain, alike = (iv.overlap_join(left, right, ["chrom"], 8, how, alike=a) for a in (False, True))
        assert plain.columns == alike.columns
        assert plain.count() > 1000 and plain.exceptAll(alike).count() == alike.exceptAll(plain).count() == 0
