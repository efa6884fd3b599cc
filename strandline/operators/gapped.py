"""Gapped k-mer classifiers of sequences: weights of mismatches, kernels, linear training over any number of sequences.

A kernel value of two sequences is a sum over pairs of their words (both strands)
of a weight that depends on the number of mismatches alone.  Such a sum is a
bilinear form over the 4**length words, so a classifier is one coefficient a word,
and all its scores come from one table of that size.  The table is bounded by the
alphabet, not by the data: 8 MB for words of ten bases, 32 MB for eleven.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut

KINDS = ("gkm", "est_full", "est_trunc")
#: Words are at most so long; a table of scores then takes 128 MB.
LONGEST = 12
#: The weights of all pairs of so long words are one table of 512 kB, by the XOR of their codes.
TABLED = 8
#: Steps along the line from the best classifier to the next one at which the loss is known.
STEPS = np.linspace(0.0, 1.0, 21)
#: A cutting plane that has had no weight for so many rounds is dropped.
IDLE = 12


def _krawtchouk(length: int) -> list[list[int]]:
    """[j][m]: sum of the characters of order j over words at m mismatches, for four letters."""
    return [
        [sum((-1) ** i * 3 ** (j - i) * math.comb(m, i) * math.comb(length - m, j - i) for i in range(min(j, m) + 1)) for m in range(length + 1)] for j in range(length + 1)
    ]


def mismatch_weights(kind: str = "est_trunc", length: int = 11, k: int = 7, most: int = 3) -> np.ndarray:
    """Weight of two words by their mismatches, zero beyond ``most``.

    ``gkm`` counts the k-subsets of places that agree.  The ``est`` kinds compare
    word counts as they are estimated from gapped k-mer counts: the estimate keeps
    the part of the counts that interactions of up to k places explain, a filter of
    the number of mismatches.  ``est_full`` takes the filter as it is, ``est_trunc``
    ends it before its first value that is not positive.  Characters of the words
    turn the filter's product with itself into squares.
    """
    if kind not in KINDS or not 1 <= k <= length <= LONGEST:
        raise ValueError(f"kind is one of {KINDS}, and 1 <= k <= length <= {LONGEST}")
    if kind == "gkm":
        out = [Fraction(math.comb(length - m, k)) for m in range(length + 1)]
    else:
        table, size = _krawtchouk(length), 4**length
        kept = [Fraction(sum(table[j][m] for j in range(k + 1)), size) for m in range(length + 1)]
        if kind == "est_trunc":
            end = next((m for m, x in enumerate(kept) if x <= 0), length + 1)
            kept = [x if m < end else Fraction(0) for m, x in enumerate(kept)]
        gain = [sum(table[m][j] * kept[m] for m in range(length + 1)) ** 2 for j in range(length + 1)]
        out = [sum(table[j][m] * gain[j] for j in range(length + 1)) / size for m in range(length + 1)]
    return np.array([float(x) if m <= most else 0.0 for m, x in enumerate(out)])


def place_weights(n: int, peak: int, half: float) -> np.ndarray:
    """Whole weights of n successive words: ``peak`` at the centre, half of it ``half`` places away, at least 1."""
    away = np.abs(n // 2 - np.arange(n))
    return np.minimum(np.floor(peak * np.exp2(-away / half) + 1), peak)


_CODE = np.zeros(256, np.int64)
for _code, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_letters)] = _code


def sequence_words(seq: str | None, length: int, peak: int = 0, half: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of both strands, two bits a base, and their summed weights; letters other than A, C, G and T count as A.

    ``peak`` 0 weighs all places alike.  Null and short sequences have no words.
    """
    base = _CODE[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
    n = len(base) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    forth, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(length):
        forth |= base[o : o + n] << 2 * (length - 1 - o)
        back |= (3 - base[o : o + n]) << 2 * o
    w = place_weights(n, peak, half) if peak else np.ones(n)
    words, at = np.unique(np.concatenate([forth, back]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([w, w]))


def neighbour_sums(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every word the sum of all words' ``values``, each by the weight of its mismatches.

    Place by place: a sum over words at m mismatches so far grows by the same letter
    at m and the three other letters at m - 1.  No pair of words is formed.
    """
    length = len(weights) - 1
    most = int(np.flatnonzero(weights).max(initial=0))
    sums = [values.astype(np.float64)] + [np.zeros(4**length) for _ in range(most)]
    for place in range(length):
        shape = (4**place, 4, -1)
        for m in range(min(most, place + 1), 0, -1):
            less = sums[m - 1].reshape(shape)
            sums[m].reshape(shape)[...] += less.sum(axis=1, keepdims=True) - less
    return sum(w * s for w, s in zip(weights, sums))


def _form(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Weighted pairs of the words x and y; by the table of all words where that is less work."""
    length = len(weights) - 1
    if len(x) * len(y) > 4 * length * 4**length:
        table = np.zeros(4**length)
        table[y] = b
        return float(a @ neighbour_sums(table, weights)[x])
    total, rows = 0.0, max(1, (1 << 20) // max(len(y), 1))
    known = _weights_apart(weights.tobytes()) if length <= TABLED else None
    for begin in range(0, len(x), rows):
        apart = x[begin : begin + rows, None] ^ y
        total += float(a[begin : begin + rows] @ ((_weight_apart(apart, weights) if known is None else np.take(known, apart)) @ b))
    return total


def _weight_apart(apart: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of two words by the XOR of their codes."""
    return weights[np.bitwise_count((apart | apart >> 1) & (4 ** (len(weights) - 1) - 1) // 3)]


@lru_cache(maxsize=8)
def _weights_apart(weights: bytes) -> np.ndarray:
    """The same of every XOR."""
    held = np.frombuffer(weights)
    return _weight_apart(np.arange(4 ** (len(held) - 1)), held)


def _dealt(sequences: DataFrame) -> DataFrame:
    """Rows dealt anew: kernels take far longer than reading, and a file of short sequences is few tasks."""
    return sequences.repartition(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def kernel_value(a: str | None, b: str | None, weights: np.ndarray, peak: int = 0, half: float = 50.0, gamma: float | None = None) -> float:
    """Normalised kernel of two sequences; with ``gamma`` exp(gamma * (K - 1)).  Sequences without words agree with nothing."""
    length = len(weights) - 1
    (x, v), (y, w) = sequence_words(a, length, peak, half), sequence_words(b, length, peak, half)
    norm = math.sqrt(max(_form(x, v, x, v, weights), 0.0) * max(_form(y, w, y, w, weights), 0.0))
    value = _form(x, v, y, w, weights) / norm if norm > 0 else 0.0
    return value if gamma is None else math.exp(gamma * (value - 1))


def prepared(sequences: DataFrame, weights: np.ndarray, peak: int = 0, half: float = 50.0, seq: str = "sequence") -> DataFrame:
    """``sequences`` with ``words`` and their ``shares``, the weights over the norm, in place of ``seq``."""
    length = len(weights) - 1

    @F.pandas_udf("words array<int>, shares array<double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        words, shares = [], []
        for t in texts:
            x, v = sequence_words(t, length, peak, half)
            norm = math.sqrt(max(_form(x, v, x, v, weights), 0.0))
            words.append(x.astype(np.int32) if norm > 0 else x[:0].astype(np.int32))
            shares.append(v / norm if norm > 0 else v[:0])
        return pd.DataFrame({"words": words, "shares": shares})

    return _dealt(sequences).withColumn("_of", of(F.col(seq))).select(*[c for c in sequences.columns if c != seq], "_of.words", "_of.shares")


def _row_sums(table: np.ndarray, words: pd.Series, shares: pd.Series) -> np.ndarray:
    """Sum over each row's words of the table's value by the word's share."""
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.zeros(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(owner, table[np.concatenate(words.to_numpy())] * np.concatenate(shares.to_numpy()), len(sizes))


def _simplex(gram: np.ndarray, offset: np.ndarray, start: np.ndarray, enough: float = 1e-9) -> np.ndarray:
    """Weights on a simplex that maximise offset' x - x' gram x / 2, by the pair that gains most."""
    x = start.copy()
    slope = offset - gram @ x
    for _ in range(100 * len(x) + 20000):
        i = int(np.argmax(slope))
        j = int(np.argmin(np.where(x > 0, slope, np.inf)))
        if slope[i] - slope[j] <= enough * (1 + abs(float(offset @ x))):
            break
        bend = gram[i, i] + gram[j, j] - 2 * gram[i, j]
        step = x[j] if bend <= 0 else min(x[j], (slope[i] - slope[j]) / bend)
        x[i] += step
        x[j] = x[j] - step if step < x[j] else 0.0
        slope -= step * (gram[:, i] - gram[:, j])
    return x


def _pass(rows: DataFrame, best: tuple[np.ndarray, float], trial: tuple[np.ndarray, float], c: float, positive: float) -> tuple[np.ndarray, list]:
    """One reading of the training set: the loss at each step from best to trial, and the planes at the trial and half way to it."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((best, trial))
    size = len(best[0])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (from_, b0), (to, b1) = sent.value
        loss, bias, offset, sums = np.zeros(len(STEPS)), np.zeros(2), np.zeros(2), np.zeros((2, size))
        for batch in batches:
            y = np.where(batch["label"].to_numpy() > 0, 1.0, -1.0)
            cost = np.where(y > 0, c * positive, c)
            one = _row_sums(from_, batch["words"], batch["shares"]) + b0
            two = _row_sums(to, batch["words"], batch["shares"]) + b1
            loss += (cost[:, None] * np.maximum(0, 1 - y[:, None] * (one[:, None] + (two - one)[:, None] * STEPS))).sum(axis=0)
            for p, f in enumerate((two, (one + two) / 2)):
                on = y * f < 1
                pull = np.where(on, cost * y, 0.0)
                bias[p] += pull.sum()
                offset[p] += cost[on].sum()
                sizes = np.array([len(w) for w in batch["words"]], np.int64)
                if sizes.sum():
                    value = np.repeat(pull, sizes) * np.concatenate(batch["shares"].to_numpy())
                    sums[p] += np.bincount(np.concatenate(batch["words"].to_numpy()), value, size)
        yield pd.DataFrame({"part": -1, "at": np.arange(len(loss)), "value": loss})
        for p in range(2):
            at = np.flatnonzero(sums[p])
            yield pd.DataFrame({"part": p, "at": np.concatenate([[-2, -1], at]), "value": np.concatenate([[offset[p], bias[p]], sums[p][at]])})

    # what comes back is bounded by the number of words, whatever the number of sequences
    out = rows.select("label", "words", "shares").mapInPandas(gather, "part int, at int, value double").groupBy("part", "at").agg(F.sum("value").alias("value")).toPandas()
    sent.unpersist()
    loss, planes = np.zeros(len(STEPS)), []
    own = out[out["part"] == -1]
    loss[own["at"]] = own["value"]
    for p in range(2):
        own = out[out["part"] == p]
        # a place for the offset and one for the bias lead the words
        plane = np.zeros(size + 2)
        plane[own["at"].to_numpy() + 2] = own["value"]
        planes.append((plane[2:], float(plane[1]), float(plane[0])))
    return loss, planes


def train_words(rows: DataFrame, weights: np.ndarray, c: float = 1.0, positive: float = 1.0, rounds: int = 60, epsilon: float = 1e-3) -> dict:
    """A classifier with hinge loss from rows of :func:`prepared` with ``label`` (positive or not), by cutting planes.

    A round reads the training set once; the driver holds only planes of one number
    a word, and weighs them by a small quadratic problem.  ``gap`` of the result is
    the proven distance to the best objective, relative to it; rounds end at
    ``epsilon``.  The bias is a constant feature.  A class of one label only, or no
    row at all, is learned as it is.
    """
    size = 4 ** (len(weights) - 1)
    # the loss is never negative: one plane of zeros
    planes = [(np.zeros(size), 0.0, 0.0)]
    images, gram, x, idle = [np.zeros(size)], np.zeros((1, 1)), np.ones(1), [0]
    best = trial = (np.zeros(size), np.zeros(size), 0.0)  # coefficients, their scores of words, bias
    upper, gap = math.inf, math.inf
    for _ in range(rounds):
        loss, found = _pass(rows, best[1:], trial[1:], c, positive)
        cross = float(best[0] @ trial[1]) + best[2] * trial[2]
        norms = [float(m[0] @ m[1]) + m[2] ** 2 for m in (best, trial)]
        whole = loss + ((1 - STEPS) ** 2 * norms[0] + 2 * STEPS * (1 - STEPS) * cross + STEPS**2 * norms[1]) / 2
        s = float(STEPS[int(np.argmin(whole))])
        upper = float(whole.min())
        best = tuple((1 - s) * a + s * b for a, b in zip(best, trial))
        for plane in found:
            image = neighbour_sums(plane[0], weights)
            row = np.array([float(q @ plane[0]) for q in images] + [float(image @ plane[0])]) + plane[1] * np.array([p[1] for p in planes] + [plane[1]])
            gram = np.block([[gram, row[:-1, None]], [row[None, :-1], row[None, -1:]]])
            planes.append(plane)
            images.append(image)
            idle.append(0)
        offset = np.array([p[2] for p in planes])
        x = _simplex(gram, offset, np.concatenate([x, np.zeros(len(planes) - len(x))]))
        lower = float(offset @ x - x @ gram @ x / 2)
        gap = (upper - lower) / upper if upper > 0 else 0.0
        if gap <= epsilon:
            break
        trial = tuple(sum(w * part for w, part in zip(x, parts) if w) for parts in ([p[0] for p in planes], images, [p[1] for p in planes]))
        idle = [0 if w > 0 else i + 1 for w, i in zip(x, idle)]
        keep = [n for n, i in enumerate(idle) if i < IDLE or n == 0]
        planes, images, idle = [planes[n] for n in keep], [images[n] for n in keep], [idle[n] for n in keep]
        gram, x = gram[np.ix_(keep, keep)], x[keep]
    return {"coefficients": best[0], "scores": best[1], "bias": best[2], "objective": upper, "gap": gap}


def word_scores(rows: DataFrame, model: dict) -> DataFrame:
    """Rows of :func:`prepared` with the classifier's ``score`` in place of words and shares."""
    sent = rows.sparkSession.sparkContext.broadcast((model["scores"], model["bias"]))

    @F.pandas_udf("double")
    def of(words: pd.Series, shares: pd.Series) -> pd.Series:
        table, bias = sent.value
        return pd.Series(_row_sums(table, words, shares) + bias)

    return rows.withColumn("score", of("words", "shares")).drop("words", "shares")


def vector_model(vectors: DataFrame, weights: np.ndarray, bias: float = 0.0) -> dict:
    """A classifier from a table of support vectors: rows of :func:`prepared` with ``weight``; summed by word before the driver takes one number a word."""
    part = F.explode(F.arrays_zip("words", "shares"))
    sums = vectors.select("weight", part.alias("w")).groupBy(F.col("w.words").alias("at")).agg(F.sum(F.col("weight") * F.col("w.shares")).alias("value")).toPandas()
    out = np.zeros(4 ** (len(weights) - 1))
    out[sums["at"].to_numpy(np.int64)] = sums["value"]
    return {"coefficients": out, "scores": neighbour_sums(out, weights), "bias": bias}


def sequence_scores(rows: DataFrame, model: dict, weights: np.ndarray, peak: int = 0, half: float = 50.0, seq: str = "sequence", name: str = "score") -> DataFrame:
    """``rows`` with the score of their sequences; the words of a sequence do not leave its row."""
    length = len(weights) - 1
    sent = rows.sparkSession.sparkContext.broadcast((model["scores"], model["bias"]))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        table, bias = sent.value
        out = np.full(len(texts), bias)
        for n, t in enumerate(texts):
            x, v = sequence_words(t, length, peak, half)
            norm = _form(x, v, x, v, weights)
            if norm > 0:
                out[n] += float(table[x] @ v) / math.sqrt(norm)
        return pd.Series(out)

    return _dealt(rows).withColumn(name, of(F.col(seq)))


def save_words(spark: SparkSession, model: dict, settings: dict, path: str) -> None:
    """A classifier as text: a folder of its settings with the bias, and one of words and their coefficients."""
    at = np.flatnonzero(model["coefficients"])
    words = spark.createDataFrame(pd.DataFrame({"at": at, "c": model["coefficients"][at]}), "at int, c double")
    words.select(F.concat_ws("\t", F.col("at").cast("string"), F.col("c").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/words")
    head = [(f"{k}\t{v}",) for k, v in sorted((settings | {"bias": model["bias"]}).items())]
    spark.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_words(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(classifier, settings) of :func:`save_words`."""
    said = dict(r.value.split("\t") for r in spark.read.text(f"{path}/settings").collect())
    settings = {k: v if k == "kind" else float(v) if k in ("half", "bias") else int(v) for k, v in said.items()}
    bias = settings.pop("bias")
    part = F.split("value", "\t")
    words = spark.read.text(f"{path}/words").select(part[0].cast("int").alias("at"), part[1].cast("double").alias("c")).toPandas()
    out = np.zeros(4 ** settings["length"])
    out[words["at"].to_numpy(np.int64)] = words["c"]
    weights = mismatch_weights(*[settings[k] for k in ("kind", "length", "k", "most")])
    return {"coefficients": out, "scores": neighbour_sums(out, weights), "bias": bias}, settings


def fold_scores(rows: DataFrame, weights: np.ndarray, by: str, folds: int = 5, **training) -> DataFrame:
    """Each row's ``fold``, by a hash of ``by``, and its ``score`` by a classifier of the other folds."""
    held = cut(rows.withColumn("fold", F.pmod(F.xxhash64(by), F.lit(folds)).cast("int")))
    parts = [word_scores(held.filter(F.col("fold") == f), train_words(held.filter(F.col("fold") != f), weights, **training)) for f in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranking_quality(scores: DataFrame) -> DataFrame:
    """(n_positive, n_negative, auc) of rows (label, score): pairs ordered rightly, ties counted half; null where a class is missing.

    Equal scores are counted before they are put in order, and running counts go
    over ranges of scores first, so no task sees all rows.
    """
    on = (F.col("label") > 0).cast("long")
    counts = scores.groupBy("score").agg(F.sum(on).alias("p"), F.sum(1 - on).alias("q"))
    parts = cut(counts.repartitionByRange("score").select(F.spark_partition_id().alias("part"), "score", "p", "q"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part").agg(F.sum("q").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.sum("q").over(inner), F.lit(0))
    right = parts.join(sums, "part").select("p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("right"))
    out = right.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_positive"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_negative"), F.sum("right").alias("_r"))
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    return out.select("n_positive", "n_negative", F.when(pairs > 0, F.col("_r") / pairs).alias("auc"))
