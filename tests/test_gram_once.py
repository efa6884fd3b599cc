"""Vectors of a Gram matrix are written down once, whatever the number of blocks."""

import numpy as np

from strandline.operators import variants as vr
from tests.test_molecule_sets import written


def test_a_vector_is_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(vr, "GRAM_BLOCK", 8)
    x = np.random.default_rng(2).normal(size=(90, 3))
    df = vr.gram_matrix(spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "k long, v array<double>"), "k", "v")
    assert len({(r.i, r.j) for r in df.collect()}) == 90 * 91 // 2
    # twelve blocks: a row for each would be 1,080; the plan may name the one shuffle on both sides
    assert written(df) <= 180
