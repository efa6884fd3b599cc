"""Inbreeding beside allele frequencies that differ from person to person.

A variant's frequency in each sample is a ridge projection of expected genotypes on
sample vectors; one coefficient, theta, takes from or adds to the heterozygotes of all.
Both are fitted together, by EM for whole batches of variants at once, or by simplex
search variant by variant; four nested models (frequencies pooled or of one's own,
with and without theta) give likelihoods and signed roots of likelihood ratios.

A variant's likelihoods are one row of arrays, as many entries as samples; batches of
such rows that share their samples share a singular value decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.kernels import signed_log10_p, simplex

LOWEST = 1e-5
TINY = 1e-100
#: Above it the reference is the rarer allele; a little over one half, so that rounding does not decide.
HALF = 0.5 + 1e-9


def hwe(p: np.ndarray) -> np.ndarray:
    """Shares of 0, 1 and 2 alternate alleles along a new last axis."""
    return np.stack(((1 - p) ** 2, 2 * p * (1 - p), p * p), axis=-1)


def inbred(p: np.ndarray, theta: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Genotype shares with inbreeding ``theta``; no homozygote's share falls below ``low``, the others make up for it."""
    e = hwe(p)
    theta, low = np.broadcast_to(theta, p.shape), np.broadcast_to(low, p.shape)
    gain = 0.5 * theta * e[..., 1]
    # what both homozygotes gain and heterozygotes lose twice; held where one would get too small
    gain = np.where(e[..., 0] + gain < low, low - e[..., 0], np.where(e[..., 2] + gain < low, low - e[..., 2], gain))
    return np.stack((e[..., 0] + gain, e[..., 1] - 2 * gain, e[..., 2] + gain), axis=-1)


def _single(p: np.ndarray) -> np.ndarray:
    """Shares of no and one alternate allele where there is one copy."""
    return np.stack((1 - p, np.zeros_like(p), p), axis=-1)


def pooled(like: np.ndarray, copies: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Allele frequency of each variant (row) by EM from one half."""
    n = like.shape[1]
    low = max(LOWEST, 0.5 / (2 * n + 1))
    p = np.full(len(like), 0.5)
    for _ in range(rounds):
        two, one = like * hwe(p)[:, None, :], like * _single(p)[:, None, :]
        share = np.where(copies == 2, (two[..., 1] + 2 * two[..., 2]) / two.sum(-1), np.where(copies == 1, one[..., 2] / np.maximum(one[..., 0] + one[..., 2], TINY), 0.0))
        p = np.clip(share.sum(1) / np.maximum(copies.sum(1), 1), low, 1 - low)
    return p


def fit(like: np.ndarray, copies: np.ndarray, vectors: np.ndarray, max_lambda: float, rounds: int) -> dict[str, np.ndarray]:
    """Frequencies of every variant (row) and sample (column), theta, and log likelihoods of the four models."""
    n = like.shape[1]
    design = np.column_stack((np.ones(n), vectors))
    u, d, _ = np.linalg.svd(design, full_matrices=False)
    p = pooled(like, copies)
    flip = (p > HALF)[:, None]
    minor = np.minimum(p, 1 - p)
    ridge = max_lambda * (1 - minor) / (2 * minor * n)
    shrink = d**2 / (d + ridge[:, None]) ** 2
    low = max(LOWEST, 0.5 / (2 * n + 1))
    own = {False: np.broadcast_to(p[:, None], (len(p), n)), True: np.broadcast_to(p[:, None], (len(p), n))}  # without and with theta
    theta = np.zeros((len(p), 1))
    for _ in range(rounds):
        next_own = {}
        for with_theta, q in own.items():
            two = like * (inbred(q, theta, low * low) if with_theta else hwe(q))
            one = like * _single(q)
            total_two, total_one = two.sum(-1), one[..., 0] + one[..., 2]
            other = np.where(flip, 0, 2)  # the homozygote of the rarer allele
            y2 = (two[..., 1] + 2 * np.take_along_axis(two, np.broadcast_to(other[..., None], (*two.shape[:2], 1)), -1)[..., 0] + TINY) / (total_two + TINY)
            y1 = (2 * np.take_along_axis(one, np.broadcast_to(other[..., None], (*one.shape[:2], 1)), -1)[..., 0] + TINY) / (total_one + TINY)
            y = np.where(copies == 2, y2, np.where(copies == 1, y1, 2 * np.where(flip, 1 - q, q)))
            if with_theta:
                seen = np.where(copies == 2, two[..., 1] / np.maximum(total_two, TINY), 0).sum(1)
            fitted = ((y @ u) * shrink) @ u.T / 2
            next_own[with_theta] = np.clip(np.where(flip, 1 - fitted, fitted), low, 1 - low)
        expected = np.where(copies == 2, hwe(own[False])[..., 1], 0).sum(1)
        theta = (1 - (seen + TINY) / (expected + TINY))[:, None]
        own = next_own
    whole = np.broadcast_to(p[:, None], own[True].shape)

    def llk(q: np.ndarray, with_theta: bool) -> np.ndarray:
        two = (like * (inbred(q, theta, low * low) if with_theta else hwe(q))).sum(-1)
        one = (like * _single(q)).sum(-1)
        return np.log(np.where(copies == 2, two, np.where(copies == 1, one, 1.0))).sum(1)

    return {
        "af": p, "theta": theta[:, 0], "isaf": own[True], "llk00": llk(whole, False), "llk01": llk(whole, True), "llk10": llk(own[False], False),
        "llk11": llk(own[True], True),
    }


def signed_root(low: float, high: float, sign: float) -> float:
    """Root of twice a gain in log likelihood, with a sign; 0 if there is none."""
    return 0.0 if high < low else float(np.copysign(np.sqrt(2 * (high - low)), -1.0 if sign < 0 else 1.0))


def search(like: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> dict[str, float]:
    """One variant by simplex search: coefficients of the vectors first, then with theta; the score test of the pooled frequency beside."""
    n = len(like)
    design = np.column_stack((np.ones(n), vectors))
    (p,) = pooled(like[None], copies[None])
    flip = p > HALF
    low = max(LOWEST, 0.5 / (2 * n + 1))

    def frequencies(v: np.ndarray) -> np.ndarray:
        q = design @ v
        return np.clip(1 - q if flip else q, low, 1 - low)

    def cost(v: np.ndarray, theta: float) -> float:
        q = frequencies(v)
        two = (like * inbred(q, np.array(theta), np.array(low * low))).sum(-1)
        one = (like * _single(q)).sum(-1)
        return -np.log(np.maximum(np.where(copies == 2, two, np.where(copies == 1, one, 1.0)), TINY)).sum()

    k = design.shape[1]
    start = np.zeros(k)
    start[0] = 1 - p if flip else p
    without, value, _ = simplex(lambda v: cost(v, 0.0), start)
    best, more, _ = simplex(lambda v: cost(v[:k], np.tanh(v[k])), np.append(without, 0.0))
    q = frequencies(best[:k])
    two = copies == 2
    prior = hwe(np.array(p))
    total = (like[two] * prior).sum(-1) + TINY
    score = p * (1 - p) * (like[two, 0] - 2 * like[two, 1] + like[two, 2]) / total
    het = (like[two, 1] * prior[1] / total).sum()
    own = like[two] * hwe(q[two])
    het_own, want_own = (own[:, 1] / (own.sum(-1) + TINY)).sum(), hwe(q[two])[:, 1].sum()
    f_own = 1 - (het_own + 1) / (want_own + 1)
    # as if every genotype had been seen as often as the frequency tells: 1 - 2 + 1 sums to nothing
    z = score.sum() / np.sqrt((score**2).sum() + 1 / prior[0] + 4 / prior[1] + 1 / prior[2])
    return {
        "af": p, "theta": float(np.tanh(best[k])), "llk0": -value, "llk1": -more, "f_pooled": 1 - (het + 1) / (prior[1] * two.sum() + 1), "f_own": f_own,
        "z_pooled": z, "z_own": signed_root(-value, -more, f_own),
    }


def _gathered(likelihoods: DataFrame, vectors: DataFrame, copies: str | None) -> DataFrame:
    """(snp, rows): each variant's samples in order, with likelihoods, copies and vectors."""
    c = F.lit(2) if copies is None else F.col(copies)
    joined = likelihoods.select("snp", "sample", "l0", "l1", "l2", c.cast("int").alias("c")).join(vectors.select("sample", "v"), "sample")
    return joined.groupBy("snp").agg(F.sort_array(F.collect_list(F.struct("sample", "l0", "l1", "l2", "c", F.col("v").cast("array<double>").alias("v")))).alias("rows"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, samples, likelihoods, copies, vectors) of the variants of a batch that share their samples."""
    column = batch.column(1)
    offsets = column.offsets.to_numpy()
    sample, l0, l1, l2, c, v = column.values.flatten()
    like = np.column_stack([x.to_numpy(zero_copy_only=False) for x in (l0, l1, l2)])
    copies = c.to_numpy(zero_copy_only=False)
    codes = sample.dictionary_encode().indices.to_numpy()
    same: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        same.setdefault(codes[a:b].tobytes(), []).append(i)
    begins, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    for rows in same.values():
        a, b = offsets[rows[0]], offsets[rows[0] + 1]
        own = offsets[rows][:, None] + np.arange(b - a)
        yield np.array(rows), sample[a:b], like[own], copies[own], flat[begins[a] : begins[b]].reshape(b - a, -1)


def inbreeding_em(likelihoods: DataFrame, vectors: DataFrame, max_lambda: float = 1.0, rounds: int = 30, copies: str | None = None) -> DataFrame:
    """Per variant: n, af, theta, log likelihoods of the four models, signed roots and log10 p of the two tests, and isaf (sample, p).

    ``likelihoods`` are (snp, sample, l0, l1, l2[, copies]), ``vectors`` (sample, v array);
    samples without copies have no say.
    """
    kinds = {f.name: f.dataType.simpleString() for f in likelihoods.schema}
    numbers = ["af", "theta", "llk00", "llk01", "llk10", "llk11", "z_pooled", "z_own", "slp_pooled", "slp_own"]
    schema = f"snp {kinds['snp']}, n long, " + ", ".join(f"{x} double" for x in numbers) + f", isaf array<struct<sample:{kinds['sample']},p:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sample, like, c, v in _matrices(batch):
                got = fit(like, c, v, max_lambda, rounds)
                for test, a, b in (("pooled", "llk00", "llk01"), ("own", "llk10", "llk11")):
                    got[f"z_{test}"] = np.array([signed_root(*x) for x in zip(got[a], got[b], got["theta"])])
                    got[f"slp_{test}"] = np.array([signed_log10_p(z) for z in got[f"z_{test}"]])
                m, n = got["isaf"].shape
                pairs = pa.StructArray.from_arrays([pa.concat_arrays([sample] * m), pa.array(got["isaf"].ravel())], ["sample", "p"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * n), pairs)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(m, n)), *[pa.array(got[x]) for x in numbers], lists]
                yield pa.RecordBatch.from_arrays(columns, ["snp", "n", *numbers, "isaf"])

    return _gathered(likelihoods, vectors, copies).mapInArrow(run, schema)


def inbreeding_search(likelihoods: DataFrame, vectors: DataFrame, copies: str | None = None) -> DataFrame:
    """Per variant, by simplex search: af, theta, log likelihoods without and with it, inbreeding and tests by pooled and own frequencies."""
    kind = likelihoods.schema["snp"].dataType.simpleString()
    numbers = ["af", "theta", "llk0", "llk1", "f_pooled", "f_own", "z_pooled", "z_own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, like, c, v in _matrices(batch):
                got = [search(x, y, v) for x, y in zip(like, c)]
                columns = [batch.column(0).take(pa.array(rows)), *[pa.array([float(g[x]) for g in got]) for x in numbers]]
                yield pa.RecordBatch.from_arrays(columns, ["snp", *numbers])

    return _gathered(likelihoods, vectors, copies).mapInArrow(run, f"snp {kind}, " + ", ".join(f"{x} double" for x in numbers))
