"""Molecules travel as one row, whatever the number of transcripts that they fit."""

from strandline.operators import genes


def written(df):
    """Rows that the shuffles of an executed plan wrote."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.metrics().contains("shuffleRecordsWritten"):
            out += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_no_row_for_each_transcript_of_a_molecule(spark):
    fragments = spark.range(1200).selectExpr("1 as cell", "id div 3 as umi", "'1' as chrom", "'+' as strand", "cast(100 * (id % 3) as int) as beg", "cast(100 * (id % 3) + 20 as int) as end")
    elements = spark.range(120).selectExpr(
        "'1' as chrom", "'+' as strand", "cast(100 * (id % 3) + 5 as int) as beg", "cast(100 * (id % 3) + 9 as int) as end", "'exon' as type",
        "concat('t', id div 3) as transcript_id", "concat('g', id div 12) as gene_id",
    )
    got = genes.element_umis(fragments, elements, whole=True)
    rows = got.collect()
    assert {r.umis for r in rows} == {400}
    assert sorted(r.level for r in rows) == ["exon"] * 120 + ["gene"] + ["transcript"] * 40
    # 400 molecules times 40 transcripts would be 16,000 rows
    assert written(got) < 12_000
