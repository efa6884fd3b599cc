"""A pipe as a stream: nothing lost and nothing twice over restarts, broken copies and small parts."""

import io
import os

from strandline.functions import filter_expr
from strandline.operators import kernels, mixtures
from strandline.sources import piped


def run(spark, path, out, mark, part_bytes=64):
    q = piped.read_spooled(spark, path, part_bytes).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    path, out, mark = str(tmp_path / "spool"), str(tmp_path / "out"), str(tmp_path / "mark")
    lines = [f"line {i} é {'x' * (i % 50)}" for i in range(400)]
    text = "\n".join(lines) + "\n"
    data = text.encode()
    piped.spool(io.BytesIO(data[: data.index(b"line 100 ")]), path)
    run(spark, path, out, mark)
    with open(path, "ab") as f:  # a copy that broke in the middle of a line
        f.write(b"line 100 is bro")
    run(spark, path, out, mark)
    assert spark.read.parquet(out).count() == 100
    piped.spool(io.BytesIO(data[data.index(b"line 100 ") :].rstrip(b"\n")), path, 37)
    run(spark, path, out, mark)
    run(spark, path, out, mark)
    got = spark.read.parquet(out).orderBy("offset").collect()
    assert [r.value for r in got] == lines and open(path, "rb").read() == data
    assert [r.offset for r in got] == [len("".join(x + "\n" for x in lines[:i]).encode()) for i in range(400)]


def test_parts_of_a_line_longer_than_they_are(tmp_path):
    path = str(tmp_path / "spool")
    piped.spool(io.BytesIO(b"a\n" + b"b" * 100 + b"\n\nc\n"), path)
    reader = piped.LineReader(path, 7)
    parts = reader.partitions({"bytes": 0}, reader.latestOffset())
    got = [v for p in parts for b in reader.read(p) for v in b.column(1).to_pylist()]
    assert got == ["a", "b" * 100, "", "c"] and len(parts) > 10
    assert piped.LineReader(str(tmp_path / "none"), 7).latestOffset() == {"bytes": 0}


def test_a_pipe(tmp_path):
    r, w = os.pipe()
    os.write(w, b"one\ntwo\nthr")
    os.close(w)
    with os.fdopen(r, "rb") as pipe:
        assert piped.spool(pipe, str(tmp_path / "s")) == 12
    assert open(tmp_path / "s").read() == "one\ntwo\nthr\n"


def test_long_lists_meet_in_a_join(spark):
    rows = spark.createDataFrame([("a", 1, []), ("b", 2, []), (None, 3, []), ("b", 4, [])], "id string, pos int, samples array<map<string,string>>")
    names = spark.createDataFrame([("b",), ("b",), (None,), ("z",)], "n string")
    keep = filter_expr.apply_filters(rows, "ID = @wanted && POS < 4", lists={"wanted": ("id", names)})
    assert keep.columns == rows.columns and [r.pos for r in keep.collect()] == [2]
    drop = filter_expr.apply_filters(rows, None, "ID = @wanted", lists={"wanted": ("id", names)})
    assert sorted(r.pos for r in drop.collect()) == [1, 3]


def test_vectors_of_a_model(spark, tmp_path):
    rows = spark.createDataFrame([(f"ACGT{i}", i / 7) for i in range(50)], "sequence string, weight double")
    kernels.save_vectors(rows.repartition(4), {"k": 5, "length": 8}, str(tmp_path / "m"))
    back, kernel = kernels.load_vectors(spark, str(tmp_path / "m"))
    assert kernel == {"k": 5, "length": 8} and sorted(map(tuple, back.select("sequence", "weight").collect())) == sorted(map(tuple, rows.collect()))


def test_doublets_are_found(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    profiles = rnd.dirichlet(np.full(40, 0.2), 3) * 0.98 + 0.02 / 40
    truth = [(0,), (1,), (2,)] * 12 + [(0, 1), (0, 2), (1, 2)] * 3
    counts = [(c, g, int(n)) for c, t in enumerate(truth) for g, n in enumerate(rnd.multinomial(400, profiles[list(t)].mean(axis=0))) if n]
    start = [(k, g, float(0.6 * profiles[k, g] + 0.4 / 40)) for k in range(3) for g in range(40)]
    cells, found, shares = mixtures.mixture_with_doublets(
        spark.createDataFrame(counts, "cell int, gene int, umis int"), spark.createDataFrame(start, "cluster int, gene int, p double"), 0.2, 8
    )
    for r in cells.collect():
        assert (r.best, *([] if r.other is None else [r.other])) == truth[r.cell]
        assert abs(sum(r.z) - 1) < 1e-9 and (r.p_doublet > 0.5) == (len(truth[r.cell]) == 2)
    assert abs(sum(shares) - 1) < 1e-9
    sums = {}
    for r in found.collect():
        sums[r.cluster] = sums.get(r.cluster, 0) + r.p
    assert all(abs(x - 1) < 1e-9 for x in sums.values()) and len(sums) == 3
    alone, _, _ = mixtures.mixture_with_doublets(
        spark.createDataFrame(counts, "cell int, gene int, umis int"), spark.createDataFrame(start, "cluster int, gene int, p double"), 0.0, 2
    )
    assert alone.filter("other IS NOT NULL OR p_doublet > 0").count() == 0
