import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import source_mixing


def test_short_sources_take_their_targets_beside_a_long_one(spark):
    long = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("long").alias("source"), F.repeat(F.lit("w "), 100_000).alias("text"))
    tiny = [(1000 + i, f"s{i}", "w " * n) for i, n in enumerate((1, 2, 5, 11, 40, 200, 1300))]
    docs = long.unionByName(spark.createDataFrame(tiny, "doc_id long, source string, text string"))
    got = source_mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    assert total > 10 * source_mixing.MAX_SLOTS  # blocks of many words
    for r in got:
        if r.doc_id >= 1000:
            assert r.target == 3 * r.size and r.taken == r.target
    huge = [r for r in got if r.doc_id < 1000]
    assert abs(sum(r.taken for r in huge) - huge[0].target) <= 0.5
    assert all(0 <= r.taken <= 3 * r.size for r in got)


@pytest.mark.parametrize("slots", [1 << 18, 3000, 97, 5, 1])
def test_one_rule_at_every_size_of_block(spark, monkeypatch, slots):
    """What documents give does not depend on the number of slots; the slots of a source's documents follow its stream."""
    monkeypatch.setattr(source_mixing, "MAX_SLOTS", slots)
    rows = [(i, f"s{i % 7 * (i % 3)}", "w " * (i * i % 41)) for i in range(900)]
    got = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {}
    for r in got:
        name = rows[r.doc_id][1]
        by.setdefault((name, r.target, r.source_size), []).append(r)
    total = sum(r.size for r in got)
    block = max(1, -(-total // slots))
    for (_, target, size), own in by.items():
        limit = int(target + 0.5)
        assert sum(r.taken for r in own) == limit
        # in the order of the keys each document gives what is left of the target, epoch after epoch
        at = 0
        for r in sorted((r for r in own), key=lambda r: hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()):
            assert r.taken == sum(max(0, min(limit, e * size + at + r.size) - (e * size + at)) for e in range(3))
            assert (r.first_slot is None) == (r.size == 0 or at >= limit)
            at += r.size
    taken = sorted((r.first_slot, r.doc_id) for r in got if r.first_slot is not None)
    assert taken[-1][0] <= -(-total // block) + len(by) + 8


def test_the_schedule_mixes_from_its_start(spark):
    """After any number of slots each source has had its share, up to a few blocks."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("one two three").alias("text"))
    sized = source_mixing.sizes(docs)
    sources = source_mixing.targets(sized, 12_000)
    share = {r.skey: r.target / 12_000 for r in sources.collect()}
    plan = sorted((r.slot, r.skey) for r in source_mixing.schedule(sources, 12_000).collect())
    had = dict.fromkeys(share, 0)
    for n, (_, s) in enumerate(plan, 1):
        had[s] += 1
        assert all(abs(had[k] - n * share[k]) <= 6 for k in share)
