"""Operator 12 against a plain sort, and its parts against the standard library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import importance_resampling as ir

SCHEMA = "doc_id long, text string, id string, score int, rank int, run int, range int, t string"


def corpus(n=400):
    rnd = random.Random(9)
    words = ["alpha", "BETA", "γάμμα", "d4", "é", "x" * 70, "ÀB", "end"] + [f"w{i}" for i in range(50)]
    rows = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(n)]
    rows += [(1000, "copy " * 25)] * 60 + [(2000 + i, "same words again " * 9) for i in range(60)]
    rows += [(None, "nobody " * 30)] * 40 + [(None, f"w{i} " * 21) for i in range(9)] + [(3000, None), (3001, ""), (3002, "!?"), (None, None), (3003, "y" * 100_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, 2, 3, 4, "b") for i, t in rows], SCHEMA)


def runs_of_words(text, max_n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, max_n=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, runs_of_words(text, max_n)[1]))
    for text in target:
        t.update(map(bucket, runs_of_words(text, max_n)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, can = [], []
    for i, text in rows:
        words, feats = runs_of_words(text, max_n)
        weight = sum(gain(bucket(f)) for f in feats)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(feats), weight, score, None])
        if len(words) >= 20:
            can.append(out[-1])
    can.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(can[: 10 * len(can) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("max_n, buckets", [(1, 10_000), (3, 97)])
def test_resample(spark, max_n, buckets):
    rows, target = corpus(), ["w1 w2 Alpha beta", None, "", "end end γάμμα w3"]
    got = ir.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, max_n, buckets)


@pytest.mark.parametrize("block_rows, stride", [(1, 1), (3, 2), (64, 1), (5000, 8)])
@pytest.mark.parametrize("draw", [0, 1, 57, 1000, 10_000])
def test_ranks_over_many_ranges(spark, block_rows, stride, draw):
    if draw == 1000 and block_rows == 1:
        draw = 999
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(300)]), 5, 7, rnd.choice([0, 0, 0, 1, 2, -5, rnd.randint(-99, 99)])) for _ in range(1500)]
    scores = spark.createDataFrame(rows, "id long, n_features long, weight long, score long").repartition(7)
    got = ir.draw_ranks(scores, draw, block_rows, stride).collect()
    want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    assert [(r.id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [(w[0], w[3]) for w in want[:draw]]
    assert sorted(((r.id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(rows, key=str)


def test_tournament_is_a_merge():
    rnd = random.Random(1)
    runs = [sorted((rnd.randint(0, 50), k, i) for i in range(rnd.randint(1, 30))) for k in range(23)]
    tree, at = ir.Tournament(), {}
    for k, run in enumerate(runs):
        at[tree.enter(run[0])] = [k, 0]
    out = []
    while True:
        leaf, key = tree.best()
        if key is None:
            break
        out.append(key)
        at[leaf][1] += 1
        k, i = at[leaf]
        tree.replace(leaf, runs[k][i] if i < len(runs[k]) else None)
    assert out == sorted(x for run in runs for x in run)


def test_pieces_are_held_only_where_they_overlap():
    """A merge of a thousand pieces in sequence holds one or two at a time and stops at the draw count."""
    asked = 0

    def pieces():
        nonlocal asked
        for k in range(1000):
            asked += 1
            yield ir._key(-10 * k, False, k, 0, k), False, 0, k, [-10 * k], [k], [1], [1]

    merge = ir.merged(pieces(), 0, 300)
    first = [next(merge) for _ in range(300)]
    assert [r[4] for r in first] == list(range(1, 301)) and asked <= 302
    assert [r[4] for r in merge] == [None] * 700


def test_crc_of_words():
    texts = ["Alpha b", "", "x" * 1000 + " é", "a-b_c 9", "no", "x" * 64 + " " + "y" * 65]
    row, bucket, words = ir.features(pa.array(["skipped", *texts])[1:], 2, 1 << 31)
    want = [(k, zlib.crc32(f.encode()) % (1 << 31)) for k, t in enumerate(texts) for f in runs_of_words(t, 2)[1]]
    assert sorted(zip(row.tolist(), bucket.tolist())) == sorted(want)
    assert words.tolist() == [len(runs_of_words(t, 1)[0]) for t in texts]
    assert ir.STEPS.dtype == np.uint32


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert ir.resample(frame(spark, []), none).count() == 0
    assert ir.resample(frame(spark, corpus(20)), none).filter("rank IS NOT NULL").count() == 10 * sum(len(runs_of_words(t, 1)[0]) >= 20 for _, t in corpus(20)) // 100
