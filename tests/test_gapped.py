"""Gapped k-mer classifiers against brute force and the bounded trainer."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import gapped, kernels

SCHEMA = "id int, sequence string, label int"


def plain_words(seq, length):
    back = "".join({"A": "T", "C": "G", "G": "C"}.get(c, "A") if c != "A" else "T" for c in reversed(seq))
    return [[s[i : i + length] for i in range(len(s) - length + 1)] for s in (seq, back)]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_filters_are_projections(k):
    """The estimate from gapped counts is the least-squares one, formed here with all gapped words of four places."""
    length = 4
    words = list(itertools.product(range(4), repeat=length))
    gaps = [(c, v) for c in itertools.combinations(range(length), k) for v in itertools.product(range(4), repeat=k)]
    a = np.array([[all(w[i] == x for i, x in zip(c, v)) for w in words] for c, v in gaps], float)
    keep = np.linalg.pinv(a) @ a
    apart = np.array([sum(x != y for x, y in zip(words[0], w)) for w in words])
    full = gapped.mismatch_weights("est_full", length, k, length)
    assert np.allclose(keep[0], full[apart])
    assert np.allclose((a.T @ a)[0], gapped.mismatch_weights("gkm", length, k, length)[apart])
    distance = np.array([[sum(x != y for x, y in zip(v, w)) for w in words] for v in words])
    values = np.array([full[m] for m in range(length + 1)])
    end = next((m for m, x in enumerate(values) if x < 1e-12), length + 1)
    cut = np.where(distance < end, values[distance], 0.0)
    assert np.allclose((cut @ cut)[0], gapped.mismatch_weights("est_trunc", length, k, length)[apart])
    assert gapped.mismatch_weights("est_trunc", length, k, 1)[2:].tolist() == [0.0] * 3


def test_weights_ask_for_known_settings():
    for bad in (("other", 8, 5), ("gkm", 13, 5), ("gkm", 5, 6)):
        with pytest.raises(ValueError):
            gapped.mismatch_weights(*bad)


@pytest.mark.parametrize("kind,peak", [("gkm", 0), ("est_full", 0), ("est_trunc", 0), ("est_trunc", 20)])
def test_kernel_against_pairs(kind, peak):
    rng = np.random.default_rng(3)
    weights = gapped.mismatch_weights(kind, 6, 4, 3)
    a, b = ("".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in (30, 41))
    half = 7.0

    def raw(x, y):
        total = 0.0
        places = [[(w, i) for i, w in enumerate(plain_words(s, 6)[0])] for s in (x, y)]
        turned = plain_words(y, 6)[1]
        n, m = len(places[0]), len(places[1])
        weigh = lambda i, n: min(math.floor(peak * 2 ** (-abs(n // 2 - i) / half) + 1), peak) if peak else 1
        as_a = lambda w: w.replace("N", "A")
        for u, i in places[0]:
            for v, j in [*places[1], *((w, m - 1 - j) for j, w in enumerate(turned))]:
                total += weigh(i, n) * weigh(j, m) * weights[sum(p != q for p, q in zip(as_a(u), v if v in turned else as_a(v)))]
        return total

    a, b = a.replace("N", "A"), b.replace("N", "A")
    want = raw(a, b) / math.sqrt(raw(a, a) * raw(b, b))
    assert abs(gapped.kernel_value(a, b, weights, peak, half) - want) < 1e-9
    assert abs(gapped.kernel_value(a, b.lower(), weights, peak, half, gamma=2.0) - math.exp(2 * (want - 1))) < 1e-9
    if kind == "gkm":
        assert abs(want - kernels.gkm_kernel(a, b, 6, 4, 3)) < 1e-9
    assert gapped.kernel_value(a, "ACG", weights) == 0 and gapped.kernel_value(None, None, weights) == 0
    assert gapped.kernel_value("ANNNNNNNNG", "AAAAAAAAAG", weights) == pytest.approx(1)


def test_neighbour_sums_and_both_forms():
    rng = np.random.default_rng(5)
    weights = gapped.mismatch_weights("gkm", 4, 2, 2)
    values = rng.normal(size=256)
    codes = np.arange(256)
    apart = np.array([[sum((x ^ y) >> 2 * o & 3 > 0 for o in range(4)) for y in codes] for x in codes])
    assert np.allclose(gapped.neighbour_sums(values, weights), weights[apart] @ values)
    # a long sequence goes through the table, a short one through pairs
    seq = "".join(rng.choice(list("ACGT"), 400))
    x, v = gapped.sequence_words(seq, 4)
    assert len(x) ** 2 > 4 * 4 * 4**4
    assert gapped._form(x, v, x, v, weights) == pytest.approx(v @ weights[apart[np.ix_(x, x)]] @ v)


def sequences(n, seed=1, motif="TTGACGTCAA"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        seq = "".join(rng.choice(list("ACGT"), 40))
        label = i % 2
        if label and rng.random() < 0.8:
            at = rng.integers(0, 30)
            seq = seq[:at] + motif + seq[at + 10 :]
        rows.append((i, seq, label))
    return rows


@pytest.mark.parametrize("c", [0.1, 1.0])
def test_training_reaches_the_bounded_trainer(spark, c):
    rows = sequences(60)
    weights = gapped.mismatch_weights("gkm", 6, 4, 2)
    ready = gapped.cut(gapped.prepared(spark.createDataFrame(rows, SCHEMA).repartition(5), weights))
    model = gapped.train_words(ready, weights, c=c, epsilon=1e-3)
    assert model["gap"] <= 1e-3
    dual = kernels.train_svm([s for _, s, _ in rows], [y for _, _, y in rows], c=c, rounds=3000, length=6, k=4, most=2)
    y = {s: (1 if y else -1) for _, s, y in rows}
    score = {s: kernels.svm_score(dual, s) for s in y}
    norm = sum(w * score[s] for w, s in zip(dual["weights"], dual["sequences"]))
    best = norm / 2 + c * sum(max(0, 1 - y[s] * f) for s, f in score.items())
    assert best * (1 - 2e-3) <= model["objective"] <= best * (1 + 2e-3)
    got = {r.id: r.score for r in gapped.word_scores(ready, model).collect()}
    # the objective that training states is that of its scores
    coef, table = model["coefficients"], model["scores"]
    own = (coef @ table + model["bias"] ** 2) / 2 + c * sum(max(0, 1 - (1 if l else -1) * got[i]) for i, _, l in rows)
    assert own == pytest.approx(model["objective"], rel=1e-6)
    assert max(abs(got[i] - score[s]) for i, s, _ in rows) < 0.1


def test_positive_rows_cost_more(spark):
    rows = sequences(40)
    weights = gapped.mismatch_weights("est_trunc", 6, 4, 2)
    ready = gapped.cut(gapped.prepared(spark.createDataFrame(rows, SCHEMA), weights, peak=10, half=8.0))
    bias = [np.mean([r.score for r in gapped.word_scores(ready, gapped.train_words(ready, weights, c=0.05, positive=p)).collect()]) for p in (0.2, 5.0)]
    assert bias[0] < bias[1]


def test_folds_find_the_motif(spark):
    rows = sequences(160)
    weights = gapped.mismatch_weights("est_trunc", 6, 4, 2)
    ready = gapped.prepared(spark.createDataFrame(rows, SCHEMA), weights)
    scores = gapped.cut(gapped.fold_scores(ready, weights, "id", folds=3, rounds=25))
    assert scores.count() == 160 and scores.select("fold").distinct().count() == 3
    quality = gapped.ranking_quality(scores).first()
    assert (quality.n_positive, quality.n_negative) == (80, 80) and quality.auc > 0.75


def test_ranking_quality_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 9, 300))]
    up, down = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
    assert gapped.ranking_quality(spark.createDataFrame(rows, "label int, score double").repartition(4)).first().auc == pytest.approx(want)
    only = gapped.ranking_quality(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()
    assert tuple(only) == (1, 0, None)
    assert tuple(gapped.ranking_quality(spark.createDataFrame([], "label int, score double")).first()) == (0, 0, None)


def test_awkward_tables(spark):
    weights = gapped.mismatch_weights("gkm", 6, 4, 2)
    rows = [(1, None, 1), (2, "", 0), (3, "ACG", 1), (4, "ACGTACGTAC", None), (5, "ACGTACGTAC", 1), (5, "ACGTACGTAC", 1)]
    ready = gapped.prepared(spark.createDataFrame(rows, SCHEMA), weights)
    model = gapped.train_words(ready.fillna(0, ["label"]), weights)
    got = {(r.id, round(r.score, 9)) for r in gapped.word_scores(ready, model).collect()}
    assert len(got) == 5 and len({s for i, s in got if i in (1, 2, 3)}) == 1  # without words the bias alone
    empty = gapped.prepared(spark.createDataFrame([], SCHEMA), weights)
    none = gapped.train_words(empty, weights)
    assert none["objective"] == 0 and none["bias"] == 0 and gapped.word_scores(empty, none).count() == 0


def test_saved_words_and_vectors(spark, tmp_path):
    rows = sequences(30)
    said = {"kind": "est_trunc", "length": 6, "k": 4, "most": 2, "peak": 10, "half": 9.0}
    weights = gapped.mismatch_weights("est_trunc", 6, 4, 2)
    table = spark.createDataFrame(rows, SCHEMA)
    ready = gapped.cut(gapped.prepared(table, weights, 10, 9.0))
    model = gapped.train_words(ready, weights, rounds=5)
    gapped.save_words(spark, model, said, str(tmp_path / "m"))
    back, settings = gapped.load_words(spark, str(tmp_path / "m"))
    assert settings == said and np.allclose(back["scores"], model["scores"]) and back["bias"] == model["bias"]
    want = {r.id: r.score for r in gapped.word_scores(ready, model).collect()}
    got = {r.id: r.score for r in gapped.sequence_scores(table, back, weights, 10, 9.0).collect()}
    assert got == pytest.approx(want)
    # a table of vectors scores as the sum of kernel values does
    vectors = [(s, (-1.0) ** i) for i, s, _ in rows[:7]]
    sums = gapped.vector_model(gapped.prepared(spark.createDataFrame(vectors, "sequence string, weight double"), weights, 10, 9.0), weights, 0.25)
    got = gapped.sequence_scores(table, sums, weights, 10, 9.0).filter("id = 20").first().score
    assert got == pytest.approx(0.25 + sum(w * gapped.kernel_value(s, rows[20][1], weights, 10, 9.0) for s, w in vectors))


def test_sequences_of_one_file_part_are_dealt_out(spark):
    weights = gapped.mismatch_weights("est_trunc", 4, 3, 2)
    rows = spark.createDataFrame([(i, "ACGTTGCA") for i in range(40)], "k int, sequence string").coalesce(1)
    model = {"scores": np.ones(4**4), "bias": 0.0}
    for out in (gapped.prepared(rows, weights), gapped.sequence_scores(rows, model, weights)):
        assert out.count() == 40
        assert len(out.select(F.spark_partition_id()).distinct().collect()) > 1


def test_form_by_table_and_by_count_agree():
    rng = np.random.default_rng(3)
    for length in (gapped.TABLED, gapped.TABLED + 1):
        weights = gapped.mismatch_weights("gkm", length, 4, 3)
        x, y = rng.integers(0, 4**length, 30), rng.integers(0, 4**length, 20)
        want = sum(weights[sum((int(p) >> 2 * i & 3) != (int(q) >> 2 * i & 3) for i in range(length))] for p in x for q in y)
        assert abs(gapped._form(x, np.ones(30), y, np.ones(20), weights) - want) < 1e-6
