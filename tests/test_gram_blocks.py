import numpy as np

from strandline.operators import variants as vr


def test_vectors_move_as_stored_and_pairs_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(vr, "GRAM_BLOCK", 8)
    monkeypatch.setattr(vr, "GRAM_PAIRS", 50, raising=False)
    x = np.random.default_rng(1).normal(size=(90, 3)).astype("float32")
    df = vr.gram_matrix(spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "k long, v array<float>"), "k", "v")
    assert "as array<double>" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.dot for r in df.collect()}
    y = x.astype(float) @ x.astype(float).T
    assert len(got) == df.count() == 90 * 91 // 2
    assert all(i <= j and abs(d - y[i, j]) < 1e-9 for (i, j), d in got.items())
    monkeypatch.setattr(vr, "GRAM_LARGE", 2, raising=False)
    assert df.sparkSession.createDataFrame([(1, [1.0]), (2, [2.0])], "k long, v array<float>").transform(lambda d: vr.gram_matrix(d, "k", "v")).count() == 3
