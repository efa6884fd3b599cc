import random

from pyspark.sql import functions as F

from strandline.operators import kernels

MODEL = kernels.train_svm(["TTGACGTCAATTGACGTCAA", "ATTGACGTCAACTGACGTCA", "CCCGGGTTTCCCGGGTTTCC"], [1, 1, 0], length=8, k=5, most=3)


def brute(text, flank=20):
    clean = "".join(c if c in "ACGT" else "A" for c in ("".join(x.upper() if x < "\x80" else "A" for x in text or "")))
    rows = []
    for p, ref in enumerate(clean):
        left, right = clean[max(0, p - flank) : p], clean[p + 1 : p + 1 + flank]
        rows.append((p + 1, ref, "G", kernels.svm_score(MODEL, left + "G" + right) - kernels.svm_score(MODEL, left + ref + right)))
    return rows


def test_every_place_of_every_text_is_scored(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ACGTacgtn é") for _ in range(n)) for n in (1, 7, 8, 15, 40, 41, 150)] + ["", None]
    rows = list(enumerate(texts))
    got = {}
    for r in kernels.scan_texts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.ref, r.alt, r.delta))
    for i, text in rows:
        mine, want = sorted(got.get(i, [])), brute(text)
        assert [r[:3] for r in mine] == [r[:3] for r in want]
        assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(mine, want))
        assert all(r[3] == 0 for r in mine if r[1] == "G")


def test_blocks_of_a_long_text_meet(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("ACGT") for _ in range(16500))
    got = sorted((r.pos, r.delta) for r in kernels.scan_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).collect())
    assert len(got) == len(text)
    for pos, delta in got[16340:16430] + got[-30:]:
        around = text[max(0, pos - 21) : pos + 20]
        want = brute(around)[min(pos - 1, 20)][3]
        assert abs(delta - want) < 1e-9


def test_query_reads_whole_documents(spark):
    from strandline.plans.queries import delta_scores

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r["count"] for r in delta_scores(spark, d).groupBy("doc_id").count().collect()}
    want = {r.doc_id: len(r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_texts_of_one_file_part_are_dealt_out(spark):
    text = "".join(random.Random(6).choice("ACGT") for _ in range(30))
    rows = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").coalesce(1)
    out = kernels.scan_texts(rows, MODEL)
    assert out.count() == 1200
    assert len({r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}) > 1
