"""Operator 12: importance resampling of a corpus towards a target distribution.

Features are the runs of 1 to ``max_n`` words of a text, hashed to buckets by
CRC-32.  A bucket's gain is the logarithm of its smoothed share in the target over
its share in the corpus; gains are an array, a text's weight is the sum of the
array's entries at its buckets.  Keyed Gumbel noise turns the weights into a draw
without replacement: the highest scores win.

Counts and weights are kernels over the Arrow buffers of whole batches: words of
all rows are found by byte classes, their CRCs are advanced together, byte by
byte.  A task sends one count for each bucket, so what moves does not grow with
the texts but with the tasks.

The draw.  Each partition sorts its eligible rows and writes them, a sorted run in
blocks of at most ``BLOCK_ROWS`` rows, to the shared folder.  Every so many heads
of the sorted blocks are splitters: they cut all runs into ranges of the order,
whose exact sizes give each range's first rank.  Ranges beyond the draw count are
not moved.  Of every other range one task merges the pieces of all runs: they
come in the order of their heads, and an external tournament tree, which holds
only pieces whose heads have been reached, emits rows with their ranks and stops
at the draw count.  At most ``MAX_SPLITTERS`` splitters meet on the driver.

Order: score, descending, then the smaller id, rows without an id last, then run
and place, so that repeated rows, whose keys are equal, can be split too.

Defined cases: a null or empty text has no features, weight 0 and no eligibility;
rows without an id draw the noise of ``null``; repeated rows are rows of their
own, with ranks of their own; an empty table gives an empty result, an empty target
is smoothed like any other; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import cut, map_arrow, spread
from strandline.llm.fill_in_middle import buffers

BUCKETS = 10_000
MAX_N = 1
SEED = 2024
#: Only texts of so many words are drawn; of these, so many in a hundred.
MIN_WORDS = 20
DRAW_PERCENT = 10
BLOCK_ROWS = 1024
MAX_SPLITTERS = 1 << 16
#: Blocks between two splitters, at least.
MIN_STRIDE = 8
#: Words longer than this are hashed one by one, others byte after byte together.
LONG_WORD = 64
NO_ID = np.iinfo(np.int64).max

#: Bytes of words, and ASCII capitals as small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def crc_steps() -> np.ndarray:
    """CRC-32 register change for each low byte, from the polynomial of the checksum."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    return step


STEPS = crc_steps()


def advance(register: np.ndarray, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after the words at ``starts``, all advanced together."""
    out = register.copy()
    for i in np.flatnonzero(lengths > LONG_WORD):
        word = text[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    active = np.flatnonzero(lengths <= LONG_WORD)
    for k in range(LONG_WORD):
        active = active[lengths[active] > k]
        if not len(active):
            break
        now = out[active]
        out[active] = STEPS[(now ^ text[starts[active] + k]) & 0xFF] ^ (now >> np.uint32(8))
    return out


def features(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature and the number of words of each row."""
    offsets, raw = buffers(column)
    text = LOWER[raw]
    inside = WORD[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[head] = inside[head]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tail = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tail] = inside[tail]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    row = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(row, minlength=len(column))
    register = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), text, starts, lengths)
    rows, found = [row], [register]
    for n in range(2, max_n + 1):  # a run of n words: the run of n - 1, a space and one word more
        whole = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        register = np.concatenate([register, np.zeros(max(0, len(starts) - len(register)), np.uint32)])
        now = register[whole]
        now = STEPS[(now ^ 32) & 0xFF] ^ (now >> np.uint32(8))
        register = np.zeros(len(starts), np.uint32)
        register[whole] = advance(now, text, starts[whole + n - 1], lengths[whole + n - 1])
        rows.append(row[whole])
        found.append(register[whole])
    bucket = (np.concatenate(found) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    return np.concatenate(rows), bucket.astype(np.int64), words


def _texts(df: DataFrame, text: str, *others: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *others)


def bucket_counts(df: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0), max_n, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    return map_arrow(_texts(spread(df.select(F.col(text))), text), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def counts_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets, a table of as many rows at most."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: a thousand times the logarithm of its share in the target over that in the corpus, rounded down."""
    k = len(corpus)
    s_all, t_all = float(corpus.sum()) + k, float(target.sum()) + k
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def scored(
    docs: DataFrame, gain: np.ndarray, text: str = "text", id_col: str = "doc_id", max_n: int = MAX_N, seed: int = SEED
) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").alias("h")
    source = _texts(spread(docs.select(F.col(id_col), F.col(text))), text, F.col(id_col).cast("long").alias("id"), h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, words = features(batch.column(0), max_n, len(gain))
            n = np.bincount(row, minlength=len(batch))
            weight = np.bincount(row, gain[bucket], len(batch)).astype(np.int64)  # exact up to 2^53
            noise = [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in batch.column(2).to_pylist()]
            score = weight + np.array(noise, np.int64)
            columns = [batch.column(1), *[pa.array(x, pa.int64()) for x in (words, n, weight, score)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight", "score"])

    return map_arrow(source, run, "id long, n_words long, n_features long, weight long, score long")


#: A sorted stretch of a run: the key of its first row (score, no id, id, run, place) and its rows.
PIECE = "score long, no_id boolean, id long, run long, place long, size long, scores array<long>, ids array<long>, features array<long>, weights array<long>"
HEADS = ("score", "no_id", "id", "run", "place")


def _by_head() -> list[Column]:
    return [F.col(c).desc() if c == "score" else F.col(c) for c in HEADS]


def _column(values: np.ndarray, ends: list[int], mask: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64(), mask=mask))


def _pieces(rows: tuple, cuts: list[tuple[int, int]], extra: list | None = None) -> pa.RecordBatch:
    """Pieces [a, b) of rows given as (scores, ids with NO_ID, nulls, run, places, features, weights)."""
    score, ident, null, run, place, feature, weight = rows
    take = np.concatenate([np.arange(a, b) for a, b in cuts])
    ends = np.concatenate(([0], np.cumsum([b - a for a, b in cuts]))).tolist()
    head = np.array([a for a, _ in cuts])
    columns = [
        pa.array(score[head]), pa.array(null[head]), pa.array(ident[head]), pa.array(run[head]), pa.array(place[head]),
        pa.array([b - a for a, b in cuts], pa.int64()),
        _column(score[take], ends), _column(ident[take], ends, null[take]), _column(feature[take], ends), _column(weight[take], ends),
    ]
    names = [f.split()[0] for f in PIECE.split(", ")]
    if extra is not None:
        columns.append(pa.array(extra, pa.int64()))
        names.append("range")
    return pa.RecordBatch.from_arrays(columns, names)


def sorted_runs(eligible: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each partition's rows (id, n_features, weight, score) as a sorted run in blocks."""
    ordered = eligible.select("id", "n_features", "weight", "score", F.spark_partition_id().cast("long").alias("run"))
    ordered = ordered.sortWithinPartitions(F.col("score").desc(), F.col("id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = 0
        for batch in batches:
            ids = batch.column(0)
            null = np.array(ids.is_null())
            ident = np.where(null, NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
            feature, weight, score, runs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            rows = (score, ident, null, runs, gone + np.arange(len(batch)), feature, weight)
            gone += len(batch)
            if len(batch):
                yield _pieces(rows, [(a, min(a + block_rows, len(batch))) for a in range(0, len(batch), block_rows)])

    return map_arrow(ordered, run, PIECE)


def splitters(blocks: DataFrame, max_splitters: int = MAX_SPLITTERS, min_stride: int = MIN_STRIDE) -> list[tuple]:
    """Keys that cut the order into ranges: every so many heads of the sorted blocks."""
    stride = max(min_stride, -(-blocks.count() // max_splitters))
    heads = blocks.select(*HEADS).orderBy(*_by_head())
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chosen = heads.withColumn("nth", within).filter(F.col("nth") % stride == 0).select(*HEADS)
    return sorted(_key(*row) for row in chosen.collect())


def _key(score: int, no_id: bool, ident: int, run: int, place: int) -> tuple:
    """Ascending key of the order."""
    return (-score, no_id, ident, run, place)


class Tournament:
    """A tree of matches: the winner is the least of the keys at its leaves; leaves without a key lose to all."""

    def __init__(self) -> None:
        self.size = 1
        self.keys: list = [None]
        self.winners: list[int] = [0, 0]
        self.free = [0]

    def _play(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or (x is not None and x <= y) else b

    def enter(self, key: tuple) -> int:
        """A free leaf with this key; the tree doubles if there is none."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.keys += [None] * self.size
            self.size *= 2
            self.winners = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self.winners[node] = self._play(self.winners[2 * node], self.winners[2 * node + 1])
        leaf = self.free.pop()
        self.replace(leaf, key)
        return leaf

    def replace(self, leaf: int, key: tuple | None) -> None:
        """The next key of a leaf, None to leave; its matches up to the root are played again."""
        self.keys[leaf] = key
        if key is None:
            self.free.append(leaf)
        node = (leaf + self.size) // 2
        while node:
            self.winners[node] = self._play(self.winners[2 * node], self.winners[2 * node + 1])
            node //= 2

    def best(self) -> tuple[int, tuple | None]:
        leaf = self.winners[1]
        return leaf, self.keys[leaf]


def merged(pieces: Iterator[tuple], base: int, draw: int) -> Iterator[tuple]:
    """(id, n_features, weight, score, rank) of one range's pieces, which come in the order of their heads.

    A piece enters the tree when the merge reaches its head, so only pieces that
    overlap at that place are held.  The merge stops at ``draw``; what is left
    follows in any order, without ranks.
    """
    tree = Tournament()
    held: dict[int, list] = {}
    rank = base
    waiting = next(pieces, None)
    while True:
        leaf, key = tree.best()
        while waiting is not None and (key is None or waiting[0] <= key):
            new = tree.enter(waiting[0])
            held[new] = [0, *waiting]
            waiting = next(pieces, None)
            leaf, key = tree.best()
        if key is None:
            return
        if rank == draw:
            for at, _, _, _, _, *rest in held.values():
                yield from zip(rest[1][at:], rest[2][at:], rest[3][at:], rest[0][at:], repeat(None))
            while waiting is not None:
                yield from zip(*waiting[5:8], waiting[4], repeat(None))
                waiting = next(pieces, None)
            return
        own = held[leaf]
        at, _, no_id, run, place, scores, ids, feature, weight = own
        rank += 1
        yield ids[at], feature[at], weight[at], scores[at], rank
        at += 1
        if at == len(scores):
            tree.replace(leaf, None)
            del held[leaf]
        else:
            own[0] = at
            null = ids[at] is None
            tree.replace(leaf, _key(scores[at], null, NO_ID if null else ids[at], run, place + at))


def draw_ranks(scores: DataFrame, draw: int, block_rows: int = BLOCK_ROWS, min_stride: int = MIN_STRIDE) -> DataFrame:
    """(id, n_features, weight, score, rank) of eligible rows; rank is null beyond the draw count."""
    columns = "id long, n_features long, weight long, score long, rank long"
    blocks = cut(sorted_runs(scores, block_rows), "runs")
    marks = splitters(blocks, min_stride=min_stride)
    low_keys = blocks.sparkSession.sparkContext.broadcast(marks)  # MAX_SPLITTERS keys of five numbers, or twice as many, at most

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks cut where ranges begin."""
        marks = low_keys.value
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                ids = row["ids"].values
                null = np.array(ids.is_null())
                ident = np.where(null, NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
                score = row["scores"].values.to_numpy()
                run, place = row["run"].as_py(), row["place"].as_py()
                size = len(score)
                places = place + np.arange(size)
                key = lambda i: _key(int(score[i]), bool(null[i]), int(ident[i]), run, int(places[i]))  # noqa: E731, B023
                # splitters between the first and the last key of the block cut it
                inner = marks[bisect_right(marks, key(0)) : bisect_right(marks, key(size - 1))]
                at = [0, *[bisect_left(range(size), m, key=key) for m in inner], size]
                at = sorted(set(at))
                cuts = list(zip(at, at[1:]))
                ranges = [bisect_right(marks, key(a)) for a, _ in cuts]
                feature, weight = (row[c].values.to_numpy() for c in ("features", "weights"))
                yield _pieces((score, ident, null, np.full(size, run), places, feature, weight), cuts, ranges)

    pieces = map_arrow(blocks, divide, PIECE + ", range long")
    sizes = dict(pieces.groupBy("range").agg(F.sum("size")).collect())
    base, gone = {}, 0
    for r in sorted(sizes):
        base[r] = gone
        gone += sizes[r]
    drawn = [r for r in base if base[r] < draw]
    bound = max(drawn, default=-1)  # ranges are numbered in order
    first = blocks.sparkSession.sparkContext.broadcast({r: base[r] for r in drawn})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = columns.split(", ")
        out: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            values = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], [n.split()[0] for n in names])

        for number, own in by_range(batches):
            for row in merged(own, first.value[number], draw):
                out.append(row)
                if len(out) == 8192:
                    yield emit(out)
                    out = []
        if out:
            yield emit(out)

    near = pieces.filter(F.col("range") <= bound).repartition("range").sortWithinPartitions("range", *_by_head())
    won = map_arrow(near, merge, columns)
    zipped = F.explode(F.arrays_zip("ids", "features", "weights", "scores"))
    rest = pieces.filter(F.col("range") > bound).select(zipped.alias("z")).select(
        F.col("z.ids").alias("id"), F.col("z.features").alias("n_features"), F.col("z.weights").alias("weight"),
        F.col("z.scores").alias("score"), F.lit(None).cast("long").alias("rank"),
    )
    return won.unionByName(rest)


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(range, its pieces) of batches in the order of ranges and heads, as a stream."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(batch.schema.names))]
            for k in range(len(batch)):
                score, no_id, ident, run, place, _, scores, ids, feature, weight, number = (c[k].as_py() for c in columns)
                yield number, (_key(score, no_id, ident, run, place), no_id, run, place, scores, ids, feature, weight)

    stream = rows()
    held = next(stream, None)

    def own(number: int) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[0] == number:
            piece = held[1]
            held = next(stream, None)
            yield piece

    while held is not None:
        number = held[0]
        current = own(number)
        yield number, current
        for _ in current:  # what the merge did not ask for
            pass


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    target_text: str = "text",
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    draw_percent: int = DRAW_PERCENT,
) -> DataFrame:
    """(id column, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn."""
    gain = gains(
        counts_array(bucket_counts(docs, text, max_n, buckets), buckets),
        counts_array(bucket_counts(target, target_text, max_n, buckets), buckets),
    )
    scores = cut(scored(docs, gain, text, id_col, max_n, seed), "scores")
    can = scores.filter(F.col("n_words") >= min_words)
    draw = draw_percent * can.count() // 100
    ranked = draw_ranks(can, draw)
    others = scores.filter(F.col("n_words") < min_words).select(
        "id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")
    )
    kind = docs.schema[id_col].dataType
    return ranked.unionByName(others).select(F.col("id").cast(kind).alias(id_col), "n_features", "weight", "score", "rank")
