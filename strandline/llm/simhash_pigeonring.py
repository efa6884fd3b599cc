"""Operator 3: near duplicates by SimHash and pigeonring filtering.

:func:`near_duplicates`.  Fingerprint: 64 bits over the XXH64 of 4-word shingles
(seed 42).  Two texts link if their fingerprints differ in at most four bits; a
class is a connected component of links.

Search.  Copies of one fingerprint are one node.  The 64 bits are a ring of five
segments.  By the pigeonring principle a pair within four differences has a
start from which every chain of l consecutive segments differs in at most
floor(4 l / 5) bits: 0, 1, 2, 3, 4.  The first two budgets become an index key:
the start, its segment as it is, and the next segment with one bit blanked out,
about 26 bits.  Fingerprints of equal keys are candidates; the budgets of three
and four segments prune them; the full Hamming distance decides.  Rows of a key
arrive sorted, so a task holds one run of equal keys at a time.  A long run is
searched breadth first and yields a spanning forest (fewer links than members),
never all of its pairs; a very long one is first divided by the third segment
with two bits blanked out, the budget of the chain of three.

:func:`similar` finds texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more; at that similarity a bit differs with probability
0.15, too often for exact segments of 64 bits.  Fingerprints are 256 bits, a ring
of 16 segments with a budget of 54 bits (over two standard deviations above the 39
expected).  Fingerprints that agree on a sample of bits, in one of several
tables, are candidates; chains of up to four segments within 3, 6, 10, 13 bits
prune them, the full distance decides, and the shingle sets of what is left are
compared exactly.  Bits per sample follow the logarithm of the number of
fingerprints, so that a random pair meets about once in a table; the number of
tables is constant, so that what moves grows with the texts alone.

That leaves links out: beyond the budget, in no common table (the more, the longer
the samples), or within a long run whose forest held other pairs.  :func:`_rest` finds the rest exactly, among texts
that are not yet of one class.  All shingles have one order, seldom ones first; two
sets of similarity t share one of the first n - ceil(t n) + 1 of each, so these are
the keys.  The place of a shared shingle bounds what two sets can share after it;
parities of the members' last bits differ in no more bits than the sets in members;
the sets of what is left are compared exactly.  No class of the wide ring is
compared with itself, so a large group of near copies is not expanded into pairs.
The rows of a frequent key are dealt by the sizes of their sets, whose ratio the
similarity bounds, and in blocks of which every two meet in one task, so no task
holds such a run.

Sets are named by 64 bits; where another 64 bits show that two sets share a name,
these are named anew.

Defined cases: null and empty texts have no words and fingerprint zero, linked
like any other; texts of fewer words than a shingle are one shingle; repeated rows
share their class; rows without an id get a class but never name it; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import cut, map_arrow, spread, uncut
from strandline.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: The ring: widths and first bits of its segments.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
#: Runs of equal keys longer than this are searched breadth first.
PAIRWISE_RUN = 8
#: Runs longer than this are divided by their third segment.
DIVIDED_RUN = 4096
#: The wide ring: segments, bits of each, and the bits that may differ in all.
WIDE_SEGMENTS = 16
WIDE_BUDGET = 54
#: Segments of the chains that prune candidates on the wide ring.
WIDE_CHAIN = 4
WIDE_SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Tables of sampled bits.
WIDE_TABLES = 40
#: Distances by which forests of a long run are laid, so that a failed pair does not cut off its nearer neighbours.
WIDE_FORESTS = (25, 38, WIDE_BUDGET)
#: Fewest bits of the parities of a shingle set.
PARITY_BITS = 1024
#: Shingles are ordered by how often their first bits occur, counted on about so many texts; any order gives the same result.
ORDER_BITS = 16
ORDER_TEXTS = 1 << 16
#: Rows of a frequent key are cut into blocks of about so many, which meet two by two.
MEETING_ROWS = 512
#: Rows of one key that a task holds before it takes the key for a frequent one.
HELD_ROWS = 1 << 16
#: Candidates of long runs that a task gathers before it hands them on.
CANDIDATES = 1 << 19
LANES = np.uint64(0x0101010101010101)


def _hashes(text: str, shingle_words: int = SHINGLE_WORDS) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return []
    if len(words) < shingle_words:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *[e + 1 for e in ends]]
    return [digest(joined[s:e], SEED) for s, e in zip(begins, ends[shingle_words - 1 :])]


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose shingle hashes lie one after another.

    Bits are summed eight lanes at a time in blocks of at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    blocks = -(-n // 255)
    block_text = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_first = first[block_text] + 255 * nth
    text_first = np.cumsum(blocks) - blocks
    got = np.zeros(len(n), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, block_first)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_first, axis=0)
        for lane in range(8):  # little-endian: lane j holds bit 8 j + k
            got |= (2 * sums[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + k)
    out[some] = got
    return out


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id column, fp long) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = spread(docs.select(F.col(id_col).alias("k"), F.col(text).cast("string").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, flat = [], []
            for value in batch.column(1):
                own = _hashes(value.as_py() or "")
                counts.append(len(own))
                flat.append(np.array(own, np.uint64))
            joined = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            fps = simhash(joined, np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["k", "fp"])

    return map_arrow(source, run, f"k {kind}, fp long").withColumnRenamed("k", id_col)


def _keys(fp):
    """Array of the index keys of a fingerprint column."""
    keys = []
    for i in range(5):
        j = (i + 1) % 5
        own = F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND((1 << WIDTHS[i]) - 1)
        near = F.shiftrightunsigned(fp, STARTS[j]).bitwiseAND((1 << WIDTHS[j]) - 1)
        for bit in range(WIDTHS[j]):
            tag = (i << 4 | bit) << 26
            blank = ((1 << WIDTHS[j]) - 1) & ~(1 << bit)
            keys.append(F.lit(tag).cast("long").bitwiseOR(F.shiftleft(own, 13)).bitwiseOR(near.bitwiseAND(blank)))
    return F.array(*keys)


def _mask(first: int, segments: int) -> int:
    out = 0
    for k in range(segments):
        i = (first + k) % 5
        out |= ((1 << WIDTHS[i]) - 1) << STARTS[i]
    return out


THREE = np.array([_mask(i, 3) for i in range(5)], np.uint64)
FOUR = np.array([_mask(i, 4) for i in range(5)], np.uint64)
NEXT = np.array([_mask((i + 1) % 5, 1) for i in range(5)], np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Chain budgets of three and four segments, then the whole distance."""
    x = a ^ b
    ok = np.bitwise_count(x & THREE[start]) <= 2
    ok &= np.bitwise_count(x & FOUR[start]) <= 3
    return ok & (np.bitwise_count(x) <= MAX_BITS)


def _forest(fps: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints; ``near(u, rest)`` says which link to u."""
    left, right = [], []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = near(u, rest)
            if hit.any():
                found = rest[hit]
                left.append(np.repeat(u[None], len(found), axis=0))
                right.append(found)
                queue.extend(found)
                rest = rest[~hit]
    return _joined(left, fps), _joined(right, fps)


def _joined(parts: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    return np.concatenate(parts) if parts else like[:0]


def _run(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long run: fingerprints whose chain of two from ``start`` is within its budget."""

    def near(u: np.uint64, rest: np.ndarray) -> np.ndarray:
        return _linked(u, rest, start)

    if len(fps) <= DIVIDED_RUN:
        return _forest(fps, near)
    third = (start + 2) % 5
    segment = fps >> np.uint64(STARTS[third])
    left, right = [], []
    for i in range(WIDTHS[third]):
        for j in range(i):
            own = segment & np.uint64((1 << WIDTHS[third]) - 1 & ~(1 << i | 1 << j))
            order = np.argsort(own, kind="stable")
            edge = np.flatnonzero(np.diff(own[order])) + 1
            for part in np.split(order, edge):
                if len(part) > 1:
                    a, b = _forest(fps[part], near)
                    left.append(a)
                    right.append(b)
    return _joined(left, fps), _joined(right, fps)


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; rows are sorted by key."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(edge, len(keys)))
    left, right = [], []
    for s, n in zip(edge[size > PAIRWISE_RUN], size[size > PAIRWISE_RUN]):
        a, b = _run(fps[s : s + n], int(keys[s] >> 30))
        left.append(a)
        right.append(b)
    own = np.repeat(size, size)
    place = np.arange(len(keys)) - np.repeat(edge, size)
    for d in range(1, PAIRWISE_RUN):
        i = np.flatnonzero((own <= PAIRWISE_RUN) & (place + d < own))
        if not len(i):
            break
        a, b, tag = fps[i], fps[i + d], keys[i] >> 26
        start = tag >> 4
        ok = _linked(a, b, start)
        # a pair whose second segments are equal shares all keys of the start: it counts at bit 0
        ok &= ((tag & 15) == 0) | ((a ^ b) & NEXT[start] != 0)
        left.append(a[ok])
        right.append(b[ok])
    return _joined(left, fps), _joined(right, fps)


def _in_runs(batches: Iterator[pa.RecordBatch], fps_of, found, beyond=None) -> Iterator[pa.RecordBatch]:
    """``found(keys, fps)`` over whole runs of equal keys of sorted batches (fp, key); ``fps_of`` makes an array of a column.

    With ``beyond``, runs of more than ``HELD_ROWS`` rows are given to it in pieces as they come.
    """
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    passing = None  # key of a run that goes to ``beyond``

    def taken() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])

    for batch in batches:
        k = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        fps = fps_of(batch.column(0))
        if passing is not None:
            end = int(np.searchsorted(k, passing, "right"))
            if end:
                yield from beyond(k[:end], fps[:end])
            if end == len(k):
                continue
            passing, k, fps = None, k[end:], fps[end:]
        waiting.append((k, fps))
        if k[-1] == waiting[0][0][0]:  # one run goes on: only gather
            if beyond and sum(len(w[0]) for w in waiting) > HELD_ROWS:
                yield from beyond(*taken())
                waiting, passing = [], k[-1]
            continue
        keys, fps = taken()
        end = int(np.searchsorted(keys, keys[-1]))
        waiting = [(keys[end:], fps[end:])]
        yield from found(keys[:end], fps[:end])
    if waiting:
        yield from found(*taken())


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect what the distinct fingerprints ``fp`` connect."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    keyed = keyed.repartition(parts, "key").sortWithinPartitions("key")

    def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _links(keys, fps)
        if len(a):
            pair = np.unique(np.stack((a.view(np.int64), b.view(np.int64)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_runs(batches, lambda c: c.to_numpy(zero_copy_only=False).view(np.uint64), found)

    return map_arrow(keyed.select("fp", "key"), run, "a long, b long")


# ---------------------------------------------------------------- the wide ring


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of a hash, one for each lane of 64 bits."""
    h = h + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, shingle_words: int = WIDE_SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(np.array(_hashes(text, shingle_words), np.uint64))


def set_name(members: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(members, SEED)


def second_name(members: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(members, SEED + 1)


def _parities(own: np.ndarray) -> np.ndarray:
    """Parities of how many members end in each value; at least two bits a member, a power of two in all."""
    width = max(PARITY_BITS, 1 << (2 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1)


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Parities in ``width`` bytes."""
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """At most the members that are in one of two sets only, from their parities; the wider are folded."""
    width = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())


def wide_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle_words: int = WIDE_SHINGLE_WORDS) -> DataFrame:
    """(id column, h long, h2 long, fp binary, n int, parity binary, s binary) for every row; h and h2 are hashes of the shingle set s of n members."""
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = spread(docs.select(F.col(id_col).alias("k"), body.alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(value.as_py(), shingle_words) for value in batch.column(1)]
            counts = np.array([len(x) for x in sets], np.int64)
            joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lanes = np.stack([simhash(_mixed(joined, lane), counts) for lane in range(WIDE_SEGMENTS // 4)], axis=1)
            fps = pa.array([x.tobytes() for x in lanes], pa.binary())
            held = [x.tobytes() for x in sets]
            names = [pa.array(np.array([name(x) for x in held], np.uint64).view(np.int64)) for name in (set_name, second_name)]
            parities = pa.array([_parities(x).tobytes() for x in sets], pa.binary())
            own = [*names, fps, pa.array(counts.astype(np.int32)), parities, pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], ["k", "h", "h2", "fp", "n", "parity", "s"])

    schema = f"k {kind}, h long, h2 long, fp binary, n int, parity binary, s binary"
    return map_arrow(source.select("k", "t"), run, schema).withColumnRenamed("k", id_col)


def sample_bits(n: int) -> int:
    """Bits of a sample for ``n`` fingerprints."""
    return min(max(16, math.ceil(math.log2(max(n, 1)))), 60)


def _wide_keys(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(fp, key): the sampled bits of each fingerprint in each table."""
    rng = np.random.default_rng(SEED)
    samples = [np.sort(rng.choice(64 * (WIDE_SEGMENTS // 4), bits, replace=False)) for _ in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            fps = _wide_array(column).view(np.uint8)
            shown = np.unpackbits(fps, axis=1, bitorder="little").astype(np.uint64)
            for t, sample in enumerate(samples):
                key = np.full(len(fps), t + 1, np.uint64)
                for place in sample:
                    key = (key << np.uint64(1)) | shown[:, place]
                # mixed, as the table's number is pushed out of 64 bits by long samples
                key = _mixed(key ^ np.uint64(t << 56), t % 4)
                yield pa.RecordBatch.from_arrays([column, pa.array(key.view(np.int64))], ["fp", "key"])

    return map_arrow(nodes.select("fp"), run, "fp binary, key long")


def _wide_array(column: pa.Array) -> np.ndarray:
    """Fingerprints of an Arrow column as rows of 16-bit segments."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, WIDE_SEGMENTS)


def _wide_near(u: np.ndarray, rest: np.ndarray, most: int) -> np.ndarray:
    """Chains within the proportional budgets from some start, then the whole distance."""
    apart = np.bitwise_count(u ^ rest).astype(np.int64)
    excess = WIDE_SEGMENTS * apart - most  # a chain is within its budget if its excess sums to zero or less
    chain, ok = excess, excess <= 0
    for step in range(1, WIDE_CHAIN):
        chain = chain + np.roll(excess, -step, axis=-1)
        ok &= chain <= 0
    return ok.any(axis=-1) & (apart.sum(axis=-1) <= most)


def _wide_links(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(a, b): pairs of fingerprints within the wide budget, enough of them to connect each run."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _wide_keys(nodes, bits, tables).repartition(parts, "key").sortWithinPartitions("key", "fp")

    def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(edge, len(keys)))
        left, right = [], []
        for s, n in zip(edge[size > PAIRWISE_RUN], size[size > PAIRWISE_RUN]):
            for most in WIDE_FORESTS:
                a, b = _forest(fps[s : s + n], lambda u, rest: _wide_near(u, rest, most))
                left.append(a)
                right.append(b)
        own = np.repeat(size, size)
        place = np.arange(len(keys)) - np.repeat(edge, size)
        for d in range(1, PAIRWISE_RUN):
            i = np.flatnonzero((own <= PAIRWISE_RUN) & (place + d < own))
            i = i[_wide_near(fps[i], fps[i + d], WIDE_BUDGET)] if len(i) else i
            left.append(fps[i])
            right.append(fps[i + d])
        a, b = _joined(left, fps), _joined(right, fps)
        if len(a):
            pairs = sorted({tuple(sorted((x.tobytes(), y.tobytes()))) for x, y in zip(a, b)})
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_runs(batches, _wide_array, found)

    return map_arrow(keyed.select("fp", "key"), run, "a binary, b binary")


def _sieved(pairs: DataFrame, nodes: DataFrame, on: str, similarity: float) -> DataFrame:
    """(a, b): hashes of the sets of ``pairs`` of the column ``on`` of ``nodes``, without those that parities show to be too far apart."""
    own = [F.col(on), F.col("h"), F.col("n"), F.col("parity")]
    met = pairs
    for end, names in (("a", ("a", "x", "xn", "xp")), ("b", ("b", "y", "yn", "yp"))):
        met = met.join(nodes.select(*[c.alias(name) for c, name in zip(own, names)]), end)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*[batch.column(k).to_pylist() for k in range(2, 6)]):
                most = (1 - similarity) * (n + m) / (1 + similarity)
                keep.append(_apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= most * (1 + 1e-9) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(met.select("x", "y", "xn", "yn", "xp", "yp"), near, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` of hashes whose shingle sets have the similarity; ``pairs`` are files of :func:`cut`, which go."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "ends")
    wanted = sets.select("h", "s").join(ends, "h", "left_semi").groupBy("h").agg(F.first("s").alias("s"))
    held = cut(wanted, "met-sets")
    met = pairs.join(held.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(
        held.select(F.col("h").alias("b"), F.col("s").alias("y")), "b"
    )

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = cut(map_arrow(met.select("a", "b", "x", "y"), alike, "a long, b long"), "links")
    for done in (held, ends, pairs):
        uncut(done)
    return found


# ---------------------------------------------------------------- the rest


def _ranks(sets: DataFrame, n: int) -> np.ndarray:
    """Rank of the first bits of a shingle hash: the seldomer, the smaller.  ``n`` is the number of sets."""
    share = sets.filter(F.pmod(F.col("h"), F.lit(max(1, n // ORDER_TEXTS))) == 0).select("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            counts += np.bincount((hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bits", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for row in map_arrow(share, run, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).collect():
        counts[row.bits] = row.n
    ranks = np.empty(1 << ORDER_BITS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << ORDER_BITS, dtype=np.uint64)
    return ranks


def _prefix(own: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first members of a set in the common order: any set of the similarity has one of them among its own."""
    shared = max(1, math.ceil(similarity * len(own) * (1 - 1e-12)))
    low = np.uint64(64 - ORDER_BITS)
    ordered = np.sort(ranks[(own >> low).astype(np.int64)] << low | own & (np.uint64(1) << low) - np.uint64(1))
    return ordered[: max(0, len(own) - shared + 1)]


#: Columns of the rows of runs; those of frequent keys have two more, and parities.
ROW = ("h", "root", "n", "place")
CELL_ROW = (*ROW, "part", "home")


def _may(rows: np.ndarray, similarity: float, cells: bool = False):
    """Which pairs of ``rows`` are of two classes and may have the similarity.

    In ``cells``, rows of one part meet each other in a cell of that part alone, those of
    different parts in the cell of both, and rows that are guests there meet no other guest.
    """
    h, root, n, place = rows[:, :4].T
    kind = np.where(root == 0, h, root)
    left = n - place
    parities = rows[:, len(CELL_ROW) :].view(np.uint64)

    def may(i, j) -> np.ndarray:
        # a pair meets at its first shared member too, and shares nothing before it
        both = np.minimum(left[i], left[j]) * (1 + similarity)
        ok = (kind[i] != kind[j]) & (both * (1 + 1e-9) >= similarity * (n[i] + n[j]))
        if cells:
            ok &= (rows[i, 5] | rows[j, 5]) > 0
            ok &= (rows[i, 4] != rows[j, 4]) | (rows[i, 4] < 0)
        if parities.shape[1] and ok.any():
            apart = np.bitwise_count(parities[i] ^ parities[j]).sum(axis=-1, dtype=np.int64)
            ok &= apart * (1 + similarity) <= (1 - similarity) * (n[i] + n[j]) * (1 + 1e-9) + 1e-9
        return ok

    return may, kind


def _short_runs(keys: np.ndarray, rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right) of row numbers in short runs of equal keys; the numbers of rows of long runs of several classes."""
    may, kind = _may(rows, similarity)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(edge, len(keys)))
    own = np.repeat(size, size)
    nth = np.arange(len(keys)) - np.repeat(edge, size)
    left, right = [], []
    for d in range(1, PAIRWISE_RUN):
        i = np.flatnonzero((own <= PAIRWISE_RUN) & (nth + d < own))
        i = i[may(i, i + d)]
        left.append(i)
        right.append(i + d)
    several = np.logical_or.reduceat(kind != np.repeat(kind[edge], size), edge)
    return np.concatenate(left), np.concatenate(right), np.flatnonzero((own > PAIRWISE_RUN) & np.repeat(several, size))


def _long_runs(keys: np.ndarray, rows: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of pairs in the cells of frequent keys."""
    may, kind = _may(rows, similarity, True)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    for s, m in zip(edge, np.diff(np.append(edge, len(keys)))):
        _, which, count = np.unique(kind[s : s + m], return_inverse=True, return_counts=True)
        largest = int(count.argmax())
        order = s + np.argsort(which == largest, kind="stable")  # the largest class comes last: only others look for pairs
        for at in range(m - count[largest]):
            j = order[at + 1 :]
            j = j[may(order[at], j)]
            if len(j):
                yield np.full(len(j), rows[order[at], 0]), rows[j, 0]


def _rest(sets: DataFrame, nodes: DataFrame, classes: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of hashes of sets that may have the similarity and are not of one of ``classes`` (node, root).

    Pairs of short runs of a key are told at once; rows of long runs get their parities first, so that a group of
    texts that share passages, but are not alike, is not expanded into pairs.
    """
    ranks = _ranks(sets, n)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_prefix(np.frombuffer(x.as_py(), np.uint64), ranks, similarity).view(np.int64) for x in batch.column(2)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(_joined(keys, np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], ["h", "n", "keys"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("key")

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = map_arrow(sets.select("h", "n", "s"), prefixes, "h long, n int, keys array<long>")
    first = first.groupBy("h").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    first = first.join(classes.select(F.col("node").alias("h"), "root"), "h", "left")
    rows = first.select("h", F.coalesce("root", F.lit(0).cast("long")).alias("root"), "n", F.posexplode("keys").alias("place", "key"))

    def table(column: pa.StructArray) -> np.ndarray:
        parts = column.flatten()
        fixed = parts[: len(ROW)] if len(parts) == len(ROW) else parts[: len(CELL_ROW)]
        out = np.stack([part.to_numpy(zero_copy_only=False).astype(np.int64) for part in fixed], axis=1)
        if len(parts) == len(ROW):
            return out
        folded = b"".join(_folded(np.frombuffer(x, np.uint8), PARITY_BITS // 8).tobytes() for x in parts[-1].to_pylist())
        return np.concatenate((out, np.frombuffer(folded, np.int64).reshape(len(out), -1)), axis=1)

    def handed(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        once = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return [once[:, 0], once[:, 1]]

    def marked(a: np.ndarray, b: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """Pairs, and rows of frequent keys."""
        blank = np.arange(len(a) + len(rows)) < len(a)
        held = [np.concatenate(x) for x in ((a, rows[:, 0]), (b, rows[:, 1]), (a, keys), (a, rows[:, 2]), (a, rows[:, 3]))]
        columns = [pa.array(held[0]), pa.array(held[1]), *[pa.array(x, mask=blank) for x in held[2:]]]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "n", "place"])

    def short(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, rest = _short_runs(keys, rows, similarity)
        yield marked(*handed(rows[i, 0], rows[j, 0]), keys[rest], rows[rest])

    def frequent(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        yield marked(none, none, keys, rows)

    def long(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        waiting, many = [], 0
        for pair in _long_runs(keys, rows, similarity):
            waiting.append(pair)
            many += len(pair[0])
            if many >= CANDIDATES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in handed(*map(np.concatenate, zip(*waiting)))], ["a", "b"])
                waiting, many = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in handed(*map(np.concatenate, zip(*waiting)))], ["a", "b"])

    def run_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_runs(batches, table, short, frequent)

    def run_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_runs(batches, table, long)

    rows = dealt(rows).select(F.struct(*ROW).alias("row"), "key")
    met = cut(map_arrow(rows, run_short, "a long, b long, key long, n long, place long"), "runs")
    rows = cells(met.filter("key is not null").select(F.col("a").alias("h"), F.col("b").alias("root"), "key", "n", "place"), similarity)
    rows = dealt(rows.join(nodes.select("h", "parity"), "h"))
    rows = rows.select(F.struct(*CELL_ROW, "parity").alias("row"), "key")
    return met.filter("key is null").select("a", "b").unionAll(map_arrow(rows, run_long, "a long, b long"))


def cells(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (h, root, key, n, place) of frequent keys, dealt to cells: key is the cell's, part and home as :func:`_may` reads them.

    A set is at home among those of about its size and a guest among those of the next
    size.  The rows of a key and size are cut into parts; every two parts share a cell.
    """
    size = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -math.log(similarity) + 1e-9) if similarity < 1 else F.col("n")
    placed = rows.select("*", F.explode(F.array(*[F.struct((size + g).cast("long").alias("size"), F.lit(1 - g).alias("home")) for g in (0, 1)])).alias("c"))
    placed = placed.select("h", "root", "key", "n", "place", "c.*")
    many = placed.groupBy("key", "size").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > MEETING_ROWS)
    # a file of the few large cells: by its size Spark sends it to the rows, or deals both
    large = cut(many.select("key", "size", F.ceil(F.col("rows") / MEETING_ROWS).cast("int").alias("parts")), "large-cells")
    placed = placed.join(large, ["key", "size"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("key", "size", F.least("own", "other"), F.greatest("own", "other"))
    # in the cell of one part all may meet: that is part -1 of it
    part = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    return placed.select("h", "root", cell.alias("key"), "n", "place", part.alias("part"), "home")


def _similar(docs: DataFrame, text: str, id_col: str, shingle_words: int, similarity: float, tables: int) -> DataFrame:
    """(id column, h, h0, h2, fp, component_id, root) for every row; root is the least name of a set of the class."""
    sets = wide_fingerprints(docs, text, id_col, shingle_words)
    sets = cut(sets.withColumn("h0", F.col("h")), "shingle-sets")
    held = [F.first(c).alias(c) for c in ("fp", "n", "parity")]
    while True:
        nodes = sets.groupBy("h").agg(F.min(id_col).alias("least"), *held, F.min("h2").alias("low"), F.max("h2").alias("high"))
        nodes = cut(nodes, "nodes")
        shared = nodes.filter("low <> high").select("h", F.lit(True).alias("shared"))
        if shared.isEmpty():
            break
        apart = sets.join(shared, "h", "left").withColumn("h", F.when(F.col("shared"), F.xxhash64("h", "h2")).otherwise(F.col("h")))
        before, sets = sets, cut(apart.drop("shared"), "shingle-sets")
        uncut(before)
        uncut(nodes)
    prints = cut(sets.select(id_col, "h", "h0", "h2", "fp"), "fingerprints")
    heads = nodes.groupBy("fp").agg(F.min(F.struct("h", "n", "parity")).alias("head"))
    heads = cut(heads.select("fp", "head.*"), "heads")  # one set stands for each fingerprint, the others are of the rest
    near = cut(_sieved(_wide_links(heads, sample_bits(heads.count()), tables).distinct(), heads, "fp", similarity), "pairs")
    classes = cut(connected_components(_verified(near, sets, similarity)), "wide-classes")
    rest = _rest(sets, nodes, classes, nodes.count(), similarity).distinct()
    more = _verified(cut(_sieved(rest, nodes, "h", similarity), "pairs"), sets, similarity)
    uncut(sets)
    links = classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)
    return _classes(prints, nodes, links, id_col, "h")


def similar(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle_words: int = WIDE_SHINGLE_WORDS,
    similarity: float = SIMILARITY, tables: int = WIDE_TABLES,
) -> DataFrame:
    """(id column, fingerprint, component_id, root) for every row, by the Jaccard similarity of shingle sets.

    ``tables`` are those of the wide ring; :func:`_rest` finds what they leave out.
    """
    return _similar(docs, text, id_col, shingle_words, similarity, tables).select(id_col, "fp", "component_id", "root")


# ---------------------------------------------------------------- classes


def _classes(prints: DataFrame, nodes: DataFrame, found: DataFrame, id_col: str, node: str = "fp") -> DataFrame:
    """The columns of ``prints``, component_id and root of every row; ``nodes`` hold the least id of each value of ``node``."""
    roots = connected_components(found).select(F.col("node").alias(node), "root")
    placed = nodes.select(node, "least").join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    placed = cut(placed, "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(named, "root").select(node, "component_id", "root"), node).select(*prints.columns, "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id column, fingerprint, component_id, root) for every row; root is the class's least fingerprint."""
    prints = cut(fingerprints(docs, text, id_col), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = _classes(prints, nodes, links(nodes.select("fp")), id_col)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def keep_one(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle_words: int = WIDE_SHINGLE_WORDS,
    similarity: float = SIMILARITY, tables: int = WIDE_TABLES,
) -> DataFrame:
    """``docs`` with one row of each class of :func:`similar`: the one that names it.

    Of rows that repeat that id, and of classes whose rows all lack an id, the
    largest row stays.
    """
    found = cut(_similar(docs, text, id_col, shingle_words, similarity, tables), "classes")
    naming = found.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count(F.lit(1)).alias("rows"))
    naming = cut(naming, "naming")
    # texts are dealt by id and met there by a table of ids, at every size; they are not sorted
    ids = naming.filter("rows = 1").select(id_col).hint("shuffle_hash")
    kept = docs.join(ids, id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = naming.filter("rows > 1")
    if not repeated.isEmpty():
        rows = docs.join(repeated.select(id_col), id_col, "left_semi")
        kept = kept.unionByName(rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(row).alias("_row")).select("_row.*"))
    nameless = found.filter(F.col("component_id").isNull()).select(F.col("h0").alias("h"), "h2", "root").distinct()
    if not nameless.isEmpty():
        rows = docs.filter(F.col(id_col).isNull()).select(row.alias("_row"), F.col(text).alias("_text"))
        rows = wide_fingerprints(rows, "_text", "_row", shingle_words)
        rows = rows.select("_row", "h", "h2").join(nameless, ["h", "h2"]).groupBy("root").agg(F.max("_row").alias("_row"))
        kept = kept.unionByName(rows.select("_row.*"))
    return kept
