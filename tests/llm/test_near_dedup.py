"""The near-duplicate stage where keys are frequent, names are shared and tables are few: no link is lost."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import simhash_pigeonring as sp

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def around_a_passage(n=260):
    """Texts of many sizes around one passage: its shingles are keys of them all, few are alike."""
    rnd = random.Random(21)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(n):
        more = [f"x{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 1, 3, 5, 6, 7, 8, 9, 12, 40]))]
        now = list(passage)
        if k % 5 == 0:
            now[rnd.randrange(30)] = "other"
        texts.append(" ".join([*more[: len(more) // 2], *now, *more[len(more) // 2 :]]))
    return texts


def found(spark, texts, **settings):
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r.component_id for r in sp.similar(rows, **settings).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("meeting, tables", [(512, 40), (16, 1), (3, 1)])
def test_frequent_keys_in_cells(spark, monkeypatch, meeting, tables):
    monkeypatch.setattr(sp, "MEETING_ROWS", meeting)
    texts = around_a_passage()
    want = classes(texts)
    assert found(spark, texts, tables=tables) == want and 20 < len(set(want)) < 250


def test_cells_bring_every_pair_together_once(spark, monkeypatch):
    monkeypatch.setattr(sp, "MEETING_ROWS", 7)
    sizes = {h: 5 + h % 60 for h in range(150)}
    rows = spark.createDataFrame([(h, 0, 9, n, 0) for h, n in sizes.items()], "h long, root long, key long, n long, place long")
    dealt = {}
    for r in sp.cells(rows, 0.8).collect():
        dealt.setdefault(r.key, []).append((r.h, 0, r.n, r.place, r.part, r.home))
    met = []
    for own in dealt.values():
        table = np.array(sorted(own), np.int64)
        may, _ = sp._may(table, 0.8, True)
        for i in range(len(table)):
            j = np.arange(i + 1, len(table))
            met += [tuple(sorted((int(table[i, 0]), int(table[k, 0])))) for k in j[may(np.full(len(j), i), j)]]
    want = [(a, b) for a in sizes for b in sizes if a < b and min(sizes[a], sizes[b]) * 1.8 >= 0.8 * (sizes[a] + sizes[b]) - 1e-9]
    assert sorted(met) == sorted(want)
    assert max(map(len, dealt.values())) < 40


def test_sets_that_share_a_name(spark, monkeypatch):
    """With names of five bits most sets share one; all are told apart."""
    monkeypatch.setattr(sp, "set_name", lambda members: sum(members) % 32)
    texts = around_a_passage(80) + ["", "one", "two words"] * 2
    assert found(spark, texts) == classes([t or f"empty" for t in texts])
    rows = spark.createDataFrame([(None, t) for t in texts], SCHEMA)
    kept = sorted(r.text for r in sp.keep_one(rows).collect())
    root = classes([t or "empty" for t in texts])
    assert len(kept) == len(set(root)) and len({root[texts.index(t)] for t in kept}) == len(kept)


def test_long_runs_pass_in_pieces(monkeypatch):
    monkeypatch.setattr(sp, "HELD_ROWS", 10)
    keys = np.array([1, 1, 2] + [3] * 47 + [4, 4] + [5] * 11 + [6], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))[s : s + 4]), pa.array(keys[s : s + 4])], ["fp", "key"]) for s in range(0, len(keys), 4)]
    whole, pieces = [], []

    def found(k, rows):
        whole.append((k.tolist(), rows.tolist()))
        yield from ()

    def beyond(k, rows):
        pieces.append((k.tolist(), rows.tolist()))
        yield from ()

    list(sp._in_runs(iter(batches), lambda c: c.to_numpy(), found, beyond))
    assert {k for ks, _ in pieces for k in ks} == {3} and all(len(k) <= 16 for k, _ in pieces)
    assert sorted(x for _, r in whole + pieces for x in r) == list(range(len(keys)))
    list(sp._in_runs(iter(batches), lambda c: c.to_numpy(), found))


def test_what_moves_does_not_depend_on_the_number_of_texts():
    assert sp.sample_bits(1) == 16 and sp.sample_bits(1 << 20) == 20 and sp.sample_bits(1 << 70) == 60
