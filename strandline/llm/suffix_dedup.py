"""Operator 7: exact removal of repeated byte strings by difference-cover suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes.

1. Equal texts become one row with a count (stored, bucketed by a 128-bit key).
2. Each window of ``length`` bytes picks the k-gram of least hash inside it, its
   anchor.  Windows of one anchor are neighbours; with their bytes they form a
   segment.  Equal windows pick equal anchors at equal places, so only segments
   whose anchor hash occurs twice or more can hold a repeat, and all starts of a
   repeated string meet under one anchor.  This loses nothing.
3. Equal segments of an anchor are one row with a count; an anchor with one
   segment that occurs twice is wholly repeated.
4. The distinct segments of the other anchors are cut into slices: windows whose
   places relative to the anchor fall into one stretch of 64.  All windows of a
   stretch share a core of ``length`` - 63 bytes, so equal windows lie in slices
   of equal cores: a class.  Classes of one slice are settled as in 3.  Slices of
   the other classes are dealt out by class, and each task sorts the suffixes of
   its slices by the difference-cover algorithm: triples at two thirds of the
   places are sorted and named, names are sorted recursively until they span
   ``length`` bytes, the other third is ordered by first character and rank of
   the rest, and merged in.  Adjacent suffixes are then compared over ``length``
   bytes.
5. A class too large for a part of a task (a passage that many texts share, in
   different surroundings) is cut again, by stretches of 16, 4 and 1 places.  A
   stretch of one place has one slice a class, so this ends, whatever is hot.
6. Marked stretches go back to their texts, and every document gets the result of
   its text.

Besides, ``n_passages`` counts passages of words that other documents have too:
strings of ``PASSAGE_GRAM`` words, of least hash among those of some
``PASSAGE_WORDS`` successive words, that stand in two documents or more.  Every
shared passage of ``PASSAGE_WORDS`` words, however short in bytes, counts at least
once, and nothing shared under ``PASSAGE_GRAM`` words counts.  It removes nothing.

Defined cases: null and empty texts have no bytes; texts shorter than ``length``
lose nothing; repeated rows are copies of each other; rows without an id get a
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._shared import cut, map_arrow

LENGTH = 400
#: Bytes of the k-grams among which a window picks its anchor.
GRAM = 128
#: Bytes of one suffix sort; whole classes are added up to it.
CHUNK_BYTES = 1_500_000
#: A class of more bytes is cut into shorter stretches.
CLASS_BYTES = 256_000
#: Places (relative to the anchor) of the stretches of each level; the last is 1.
STRETCHES = (64, 16, 4, 1)
#: Bytes whose anchors are found at a time; longer texts are cut with overlap.
SPAN_BYTES = 4_000_000
PASSAGE_WORDS = 50
PASSAGE_GRAM = 25
#: Overlap of spans where passages are looked for; a passage of longer words would be missed at a cut.
PASSAGE_OVERLAP = 1_000_000
BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- suffix sorting


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the values of an array."""
    order = np.argsort(x)
    s = x[order]
    new = np.empty(len(x), np.int64)
    new[order] = np.cumsum(np.concatenate(([1], (s[1:] != s[:-1]).astype(np.int64))))
    return new


def _pairs(a: np.ndarray, b: np.ndarray, high: int) -> np.ndarray:
    """Numbers ordered as the pairs (a, b), for b below ``high``."""
    return a.astype(np.int64) * np.int64(high) + b


def _ranks(c: np.ndarray, after: np.ndarray, place: np.ndarray, span: int, depth: int) -> np.ndarray:
    """Ranks of the samples' strings over at least ``depth`` bytes; equal strings share one.

    ``c``: names from 1, each spanning ``span`` bytes; ``after``: the element that
    follows in its chain (the number of elements at the end); ``place``: index in
    the chain.
    """
    if span >= depth or c.max(initial=0) == len(c):
        return c
    return _dense_order(*_sorted(c, after, place, span, depth), len(c))


def _dense_order(order: np.ndarray, same: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[order] = 1 + np.cumsum(~same)
    return out


def _sorted(c: np.ndarray, after: np.ndarray, place: np.ndarray, span: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all elements by their strings, and whether each equals the one before it.

    One level of the difference cover {1, 2} mod 3.  "Equals" is exact over
    ``depth`` bytes for sampled elements' names and refined beyond; it is only
    used to share ranks.
    """
    n = len(c)
    names = np.append(c, 0)
    second, third = after, np.append(after, n)[after]
    first_of = place % 3
    sample = np.flatnonzero(first_of != 0)
    high = int(c.max(initial=0)) + 1
    # sort the sampled triples and name them
    heads = _dense(_pairs(names[sample], names[second[sample]], high))
    triple = _dense(_pairs(heads, names[third[sample]], high))
    # recurse on the names; the follower in a sampled chain is three places on
    number = np.full(n + 1, len(sample), np.int64)
    number[sample] = np.arange(len(sample))
    fourth = np.append(after, n)[third[sample]]
    got = _ranks(triple, number[fourth], place[sample] // 3, 3 * span, depth)
    rank = np.zeros(n + 1, np.int64)
    rank[sample] = got
    top = int(got.max(initial=0)) + 1
    # the rest: first character, then rank of what follows
    rest = np.flatnonzero(first_of == 0)
    key0 = _pairs(names[rest], rank[second[rest]], top)
    o = np.argsort(key0)
    rest, key0 = rest[o], key0[o]
    # merge: how many sampled suffixes are smaller, by one character against class 1, by two against class 2
    one, two = np.flatnonzero(first_of == 1), np.flatnonzero(first_of == 2)
    less = np.searchsorted(np.sort(_pairs(names[one], rank[second[one]], top)), key0)
    heads = _dense(_pairs(names[np.concatenate((rest, two))], names[second[np.concatenate((rest, two))]], high))
    mine = _pairs(heads[: len(rest)], rank[third[rest]], top)
    less = less + np.searchsorted(np.sort(_pairs(heads[len(rest) :], rank[third[two]], top)), mine)
    by_rank = np.argsort(got)
    order = np.concatenate((rest, sample[by_rank]))
    merged = np.argsort(np.concatenate((2 * less, 2 * np.arange(len(sample)) + 1)), kind="stable")
    order = order[merged]
    # ranks are shared only by sampled neighbours of one name and by rest neighbours of one key
    tie = np.concatenate((key0, -got[by_rank]))[merged]
    kind = np.concatenate((np.zeros(len(rest), bool), np.ones(len(sample), bool)))[merged]
    same = np.zeros(n, bool)
    same[1:] = (tie[1:] == tie[:-1]) & (kind[1:] == kind[:-1])
    return order, same


WORD = 8


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a byte array in the order of their suffixes, exact over ``depth`` bytes; and its 8-byte words.

    Characters are the (overlapping) words of eight bytes; place i is followed by
    i + 8, so that there are eight chains.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(WORD, np.uint8))).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(WORD):
        words = (words << np.uint64(8)) | padded[k : k + n]
    at = np.arange(n)
    order, _ = _sorted(_dense(words), np.minimum(at + WORD, n), at // WORD, WORD, depth)
    return order, words


def repeated_windows(segments: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` windows of ``length`` bytes occur twice or more."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(segments), np.uint8)
    valid = np.zeros(len(text), bool)
    for s, n in zip(starts, windows):
        valid[s : s + n] = True
    order, words = suffix_array(text, length)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    pair = np.arange(len(a))
    offsets = [*range(0, length - WORD + 1, WORD), length - WORD]
    for off in sorted(set(offsets), key=lambda o: (o % 200 != 0, o)):  # adjacent prefixes, word by word
        pair = pair[words[a[pair] + off] == words[b[pair] + off]]
    found = np.zeros(len(text), bool)
    found[a[pair]] = True
    found[b[pair]] = True
    return [found[s : s + n] for s, n in zip(starts, windows)]


# ---------------------------------------------------------------- anchors


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64, kept by each worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS.append(np.cumprod(out))
    return _POWERS[0][:n], _POWERS[1][:n]


def _sums(text: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`_hash` takes the hash of any stretch of bytes."""
    powers, _ = _powers(len(text))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers)))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash in each stretch of ``width`` successive ones."""
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    out = len(h) - width + 1
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[:out], low[width - size : width - size + out])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, place of the anchor) of each anchor of at least ``length`` bytes."""
    n = len(sums) - 1
    _, inverse = _powers(n)
    h = _mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    place = _least(h, length - gram + 1)
    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return h[place[edge]].view(np.int64), edge, np.diff(np.append(edge, len(place))), place[edge]


_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def passages(text: np.ndarray, sums: np.ndarray, words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> np.ndarray:
    """Distinct hashes of the chosen strings of ``gram`` words; any ``words`` successive words hold one."""
    inside = np.concatenate(([False], _IS_WORD[text], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    if len(first) < words:
        return np.zeros(0, np.int64)
    b, e = first[: len(first) - gram + 1], last[gram - 1 :]
    _, inverse = _powers(len(text))
    h = _mixed((sums[e] - sums[b]) * inverse[b])
    return np.unique(h[_least(h, words - gram + 1)]).view(np.int64)


def _anchor_rows(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor hash, segment hash, first window, windows, offset of the anchor) of a text, cut to spans with overlap.

    Passages follow as rows of (hash, 0, 0, 0, -1).
    """
    import xxhash

    at = 0
    shared: set[int] = set()
    overlap = length - 1
    while True:
        part = text[at : at + SPAN_BYTES]
        array = np.frombuffer(part, np.uint8)
        sums = _sums(array)
        if len(part) >= length:
            h, first, n, place = anchors(sums, length, gram)
            for a, f, m, p in zip(h.tolist(), first.tolist(), n.tolist(), place.tolist()):
                s = xxhash.xxh3_64_intdigest(part[f : f + m + length - 1], p - f)
                yield a, s - (1 << 64) if s >> 63 else s, at + f, m, p - f
        if len(text) <= SPAN_BYTES:
            shared.update(passages(array, sums).tolist())
        if at + SPAN_BYTES >= len(text):
            break
        at += SPAN_BYTES - overlap
    if len(text) > SPAN_BYTES:
        for at in range(0, len(text), max(SPAN_BYTES - PASSAGE_OVERLAP, 1)):
            array = np.frombuffer(text[at : at + SPAN_BYTES], np.uint8)
            shared.update(passages(array, _sums(array)).tolist())
            if at + SPAN_BYTES >= len(text):
                break
    for a in sorted(shared):
        yield a, 0, 0, 0, -1


# ---------------------------------------------------------------- the operator


class _Texts:
    """The distinct texts as a table bucketed by their key, for joins that do not move them."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str):
        self.spark = spark
        self.name = f"strandline_texts_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = with_key(docs, text).groupBy("k1", "k2").agg(F.any_value("t").alias("t"), F.count(F.lit(1)).alias("copies"))
        keyed.write.bucketBy(buckets, "k1", "k2").option("compression", "zstd").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def with_key(docs: DataFrame, text: str, *ids: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(*ids, t.alias("t"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, copies, a, s, lo, n, o): one row per anchor of each text, and (o = -1) per passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(["k1", "k2", "copies"])
            which: list[int] = []
            rows: list[tuple[int, int, int, int, int]] = []

            def out() -> pa.RecordBatch:
                taken = keys.take(pa.array(which, pa.int64()))
                a, s, lo, n, o = zip(*rows)
                columns = [pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(o, pa.int32())]
                return pa.RecordBatch.from_arrays([*taken.columns, *columns], ["k1", "k2", "copies", "a", "s", "lo", "n", "o"])

            for i, value in enumerate(batch.column(3)):
                before = len(rows)
                rows += _anchor_rows(value.as_py().encode("utf-8"), length, gram)
                which += [i] * (len(rows) - before)
                if len(rows) >= 20_000:
                    yield out()
                    which, rows = [], []
            if rows:
                yield out()

    worth = texts.filter(F.octet_length("t") >= min(length, 2 * PASSAGE_WORDS - 1)).select("k1", "k2", "copies", "t")
    return map_arrow(worth, run, "k1 long, k2 long, copies long, a long, s long, lo long, n int, o int")


PIECE = ("a", "s", "total", "lo", "n", "o")


def _with_texts(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(t, want): each text with the list of its pieces; texts stay where they are."""
    lists = pieces.groupBy("k1", "k2").agg(F.collect_list(F.struct(*PIECE)).alias("want"))
    return texts.join(lists, ["k1", "k2"]).select("t", "want", "k1", "k2")


def _slices(texts: DataFrame, pieces: DataFrame, length: int, gram: int, stretch: int) -> DataFrame:
    """(a, s, total, c, t, r, k1, k2, lo, n, o): pieces cut by stretches of places; c is the class, t the slice, r its place in the piece."""
    names = ["a", "s", "total", "c", "t", "r", "lo", "n", "o"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        def signed(x: int) -> int:
            return x - (1 << 64) if x >> 63 else x

        for batch in batches:
            rows: list[tuple] = []
            which: list[int] = []
            for i, (text, want) in enumerate(zip(batch.column(0), batch.column(1))):
                data = text.as_py().encode("utf-8")
                before = len(rows)
                for w in want.as_py():
                    lo, n, o = w["lo"], w["n"], w["o"]
                    place = lo + o
                    for block in range((o - n + 1) // stretch, o // stretch + 1):
                        near, far = block * stretch, min(block * stretch + stretch - 1, length - gram)
                        r, last = max(0, o - far), min(n - 1, o - near)
                        core = digest(data[place - near : place - far + length], block)
                        own = digest(data[lo + r : lo + last + length], o - r)
                        rows.append((w["a"], w["s"], w["total"], signed(core), signed(own), r, lo + r, last - r + 1, o - r))
                which += [i] * (len(rows) - before)
                if len(rows) >= 20_000:
                    yield out(batch, rows, which)
                    rows, which = [], []
            if rows:
                yield out(batch, rows, which)

    def out(batch: pa.RecordBatch, rows: list[tuple], which: list[int]) -> pa.RecordBatch:
        taken = batch.select(["k1", "k2"]).take(pa.array(which, pa.int64()))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*rows)], *taken.columns], [*names, "k1", "k2"])

    return map_arrow(_with_texts(texts, pieces), run, ", ".join(f"{c} long" for c in [*names, "k1", "k2"]))


def _bytes_of(texts: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """(a, s, total, n, seg): the bytes of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([r[c] for r in rows], pa.int64()) for c in ("a", "s", "total", "n")], pa.array([r["seg"] for r in rows], pa.binary())],
                ["a", "s", "total", "n", "seg"],
            )

        for batch in batches:
            rows = []
            for text, want in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode("utf-8")
                for w in want.as_py():
                    rows.append(w | {"seg": data[w["lo"] : w["lo"] + w["n"] + length - 1]})
                if len(rows) >= 5000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return map_arrow(_with_texts(texts, pieces), run, "a long, s long, total long, n long, seg binary")


def _stretches(flags: np.ndarray, length: int) -> list[int]:
    """Byte stretches covered by the flagged windows: begin, end, begin, end ..."""
    out: list[int] = []
    for r in np.flatnonzero(flags).tolist():
        if out and r <= out[-1]:
            out[-1] = r + length
        else:
            out += [r, r + length]
    return out


MARKS = "a long, s long, marks array<int>"


def _sorted_marks(segments: DataFrame, length: int) -> DataFrame:
    """(a, s, marks) by suffix sorting; the slices of a class, ``CLASS_BYTES`` at most, meet in one task."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(parts, "a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            flags = repeated_windows([h[4] for h in held], [h[3] for h in held], length)
            rows = []
            for (a, s, total, n, _), f in zip(held, flags):
                marks = [0, n + length - 1] if total > 1 else _stretches(f, length)
                if marks:
                    rows.append((a, s, marks))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                ["a", "s", "marks"],
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= CHUNK_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done()

    return map_arrow(dealt.select("a", "s", "total", "n", "seg"), run, MARKS)


def _kinds(pieces: DataFrame, group: str, kind: str, length: int) -> DataFrame:
    """Distinct pieces (named a, s) of the groups that hold two or more: one place of each, ``different`` and ``bytes`` of the group."""
    kinds = pieces.groupBy(F.col(group).alias("a"), F.col(kind).alias("s")).agg(
        F.sum("total").alias("total"), F.min(F.struct("k1", "k2", "lo", "n", "o")).alias("one")
    )
    groups = kinds.groupBy("a").agg(
        F.sum("total").alias("all"), F.count(F.lit(1)).alias("different"), F.sum(F.col("one.n") + length - 1).alias("bytes")
    )
    return kinds.join(groups.filter(F.col("all") > 1), "a").select("a", "s", "total", "one.*", "different", "bytes")


def _whole(kinds: DataFrame, length: int) -> DataFrame:
    """Marks of pieces that are alone in their group, and so repeated."""
    return kinds.filter("different = 1").select("a", "s", F.array(F.lit(0), (F.col("n") + length - 1).cast("int")).alias("marks"))


def _marks(texts: DataFrame, pieces: DataFrame, length: int, gram: int, class_bytes: int, level: int = 0) -> DataFrame:
    """(a, s, marks) of the pieces (k1, k2, a, s, total, lo, n, o): begin and end of repeated stretches, relative to the piece."""
    stretch = STRETCHES[level]
    slices = cut(_slices(texts, pieces, length, gram, stretch), "slices")
    kinds = cut(_kinds(slices, "c", "t", length), "slice-kinds")
    mixed = kinds.filter("different > 1").drop("different")
    marks = _whole(kinds, length)
    fits = F.col("bytes") <= (class_bytes if stretch > 1 else 1 << 62)
    marks = marks.unionByName(_sorted_marks(_bytes_of(texts, mixed.filter(fits), length), length))
    large = mixed.filter(~fits)
    if stretch > 1 and not large.isEmpty():
        marks = marks.unionByName(_marks(texts, large, length, gram, class_bytes, level + 1))
    found = slices.select("a", "s", "c", "t", "r").join(marks.select(F.col("a").alias("c"), F.col("s").alias("t"), "marks"), ["c", "t"])
    moved = F.transform("marks", lambda m: m + F.col("r").cast("int"))
    return found.groupBy("a", "s").agg(F.flatten(F.collect_list(moved)).alias("marks"))


def _removed(texts: DataFrame, marks: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passages) of each text."""
    joined = texts.join(marks, ["k1", "k2"], "left").join(shared, ["k1", "k2"], "left")
    joined = joined.select("k1", "k2", "copies", "t", "marks", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, shas, spans = [], [], [], [], []
            for copies, text, marked in zip(*[c.to_pylist() for c in batch.columns[2:5]]):
                data = text.encode("utf-8")
                if copies > 1 and len(data) >= length:
                    found = [(0, len(data))]
                else:
                    every = sorted(
                        (m["lo"] + m["marks"][i], m["lo"] + m["marks"][i + 1])
                        for m in marked or () for i in range(0, len(m["marks"]), 2)
                    )
                    found = []
                    for b, e in every:
                        if found and b <= found[-1][1]:
                            found[-1] = (found[-1][0], max(e, found[-1][1]))
                        else:
                            found.append((b, e))
                sha, at = hashlib.sha256(), 0
                for b, e in found:
                    sha.update(data[at:b])
                    at = e
                sha.update(data[at:])
                n_bytes.append(len(data))
                n_removed.append(sum(e - b for b, e in found))
                n_spans.append(len(found))
                shas.append(sha.hexdigest())
                spans.append([x for f in found for x in f])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.int64())), batch.column(5)],
                ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passages"],
            )

    return map_arrow(joined, run, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, n_passages long")


def repeated_bytes(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int | None = None,
    class_bytes: int = CLASS_BYTES,
) -> DataFrame:
    """(id column, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passages) for every row.

    ``length`` is at least 16.  ``spans`` lists begin and end of the removed runs in bytes.
    """
    gram = gram or max(4, min(GRAM, length * GRAM // LENGTH))
    spark = docs.sparkSession
    texts = _Texts(spark, docs, text)
    try:
        found = cut(_occurrences(texts.read(), length, gram), "anchors")
        segments = found.filter("o >= 0")
        kinds = cut(_kinds(segments.withColumnRenamed("copies", "total"), "a", "s", length), "classes")
        mixed = kinds.filter("different > 1").drop("different", "bytes")
        marks = cut(_marks(texts.read(), mixed, length, gram, class_bytes).unionByName(_whole(kinds, length)), "marks")
        placed = segments.join(marks, ["a", "s"]).groupBy("k1", "k2").agg(
            F.collect_list(F.struct("lo", "marks")).alias("marks")
        )
        chosen = found.filter("o < 0").select("a", "k1", "k2", "copies")
        twice = chosen.groupBy("a").agg(F.sum("copies").alias("all")).filter(F.col("all") > 1).select("a")
        shared = chosen.join(twice, "a").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_passages"))
        done = cut(_removed(texts.read(), placed, shared, length), "removed")
    finally:
        texts.drop()
    return with_key(docs, text, id_col).drop("t").join(done, ["k1", "k2"]).select(
        id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passages"
    )
