"""Operator 9: approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product.  Vectors are scaled by the longest one
and given one more coordinate that makes all lengths one; queries are made unit
vectors; then the largest inner product is the smallest distance.  A table hashes
by ``n_projections`` Gaussian (2-stable) projections cut into stretches of
``width``.  A query visits, in each table, its own bucket and then perturbed
ones in the order of their estimated success: the sum of squared distances to
the borders crossed.  Candidates of all tables are merged and ranked by the exact
inner product in double precision on the original vectors.

Every row is indexed and no bucket is capped.  Buckets with many rows or many
queries are split into blocks that meet pairwise, so that a task holds one block
of each at a time; what leaves a task is the best ``k`` of each query that it met,
not pairs.  Of equal vectors only the ``k + 1`` smallest ids can be among the nearest ``k``, so
only these are kept (exact, and bounds groups of copies).  Queries that found
fewer than ``k`` are run once more against all rows, in blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of another length are never compared; rows that
repeat an id count once (the largest vector stays); rows without an id take no
part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import cut, map_arrow

N_TABLES = 4
N_PROJECTIONS = 4
WIDTH = 2.2
N_PROBES = 10
SEED = 20240101
#: Rows of a bucket that meet as many queries in one step.
BLOCK_ROWS = 2048
#: Rows (query, minus score, id) that a task gathers before it cuts them to the best of each query.
HELD_ROWS = 200_000
ROWS_SQL = "key long, id long, v array<double>"


def projections(dim: int, table: int, n: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (over ``width``) and offsets of one table."""
    rng = np.random.default_rng((SEED, dim, table))
    return rng.standard_normal((dim + 1, n)) / width, rng.random(n)


def probes(inner: np.ndarray, n_probes: int) -> list[tuple[tuple[int, int], ...]]:
    """Perturbations ((projection, step), ...) of a place inside its bucket, best first.

    ``inner`` are the places between the two borders of each projection, 0 to 1.
    Sets are generated from a heap by shifting or extending the last border.
    """
    borders = sorted([(x * x, i, -1) for i, x in enumerate(inner)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(inner)])
    out: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(borders[0][0], (0,))]
    while heap and len(out) < n_probes:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({borders[c][1] for c in chosen}) == len(chosen):
            out.append(tuple(borders[c][1:] for c in chosen))
        if last + 1 < len(borders):
            step = borders[last + 1][0]
            heapq.heappush(heap, (score - borders[last][0] + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + step, (*chosen, last + 1)))
    return out


def _key(table: int, dim: int, places: np.ndarray) -> np.ndarray:
    """64-bit bucket keys; buckets that collide only add candidates."""
    h = np.full(len(places), (table * 1_000_003 + dim) & 0xFFFFFFFF, np.uint64)
    for column in places.T:
        h = (h ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each vector length of a batch with column v."""
    column = batch.column(batch.schema.get_field_index("v"))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[offsets[rows][:, None] + np.arange(dim)]


def _hashed(vectors: DataFrame, longest: float, tables: int, n: int, width: float, n_probes: int) -> DataFrame:
    """Rows (key, id, v) of each vector and table; with ``n_probes`` over 1, of each probe of a query."""
    query = n_probes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch):
                length = np.sqrt((x * x).sum(axis=1))
                if query:
                    scaled = np.hstack((x / length[:, None], np.zeros((len(x), 1))))
                else:
                    scaled = x / longest
                    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
                    scaled = np.hstack((scaled, rest[:, None]))
                own = batch.take(pa.array(rows))
                for t in range(tables):
                    a, b = projections(x.shape[1], t, n, width)
                    exact = scaled @ a + b
                    home = np.floor(exact)
                    if not query:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_key(t, x.shape[1], home)), own.column(0), own.column(1)], ["key", "id", "v"]
                        )
                        continue
                    places, which = [], []
                    for i, inner in enumerate(exact - home):
                        for moves in probes(inner, n_probes):
                            place = home[i].copy()
                            for p, step in moves:
                                place[p] += step
                            places.append(place)
                            which.append(i)
                    taken = own.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_key(t, x.shape[1], np.array(places))), taken.column(0), taken.column(1)],
                        ["key", "id", "v"],
                    )

    return map_arrow(vectors.select("id", "v"), run, ROWS_SQL)


def _ranked(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch | None:
    """Best ``k`` of a block for each query: rows (query_id, minus score, id)."""
    scores = q @ x.T
    own = query_ids[:, None] == ids[None, :]
    scores[own] = -np.inf
    if x.shape[0] > k:
        # rounding differs with the shape of a product: whatever may belong to the best stays for the exact ranking
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        near = scores >= (kth - slack)[:, None]
    else:
        near = np.ones(scores.shape, bool)
    near &= ~own
    row, col = np.nonzero(near)
    if not len(row):
        return None
    exact = np.empty(len(row))
    for at in range(0, len(row), 65536):
        part = slice(at, at + 65536)
        exact[part] = (q[row[part]] * x[col[part]]).sum(axis=1)
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[row[best]]), pa.array(-exact[best]), pa.array(ids[col[best]])], ["query_id", "minus", "id"]
    )


def _cut(found: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The best ``k`` of each query in some results; a pair found twice counts once."""
    query, minus, ids = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i in range(3))
    order = np.lexsort((ids, minus, query))
    query, minus, ids = query[order], minus[order], ids[order]
    new = np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (minus[1:] != minus[:-1])))
    query, minus, ids = query[new], minus[new], ids[new]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return pa.RecordBatch.from_arrays([pa.array(query[best]), pa.array(minus[best]), pa.array(ids[best])], ["query_id", "minus", "id"])


def _meet(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, minus, id) from rows and queries (key, s, r, id, v) of equal (key, s, r)."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = index.withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)))
    both = both.repartition(parts, "key", "s", "r").sortWithinPartitions("key", "s", "r", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        found: list[pa.RecordBatch] = []
        n_found = 0

        def done() -> None:
            nonlocal n_found
            rows, asks = held
            if rows and asks:
                # vectors of one length only: the key depends on it, but keys may collide
                for dim in {v.shape[1] for _, v in rows}:
                    ids = [i for i, v in rows if v.shape[1] == dim]
                    qs = [i for i, v in asks if v.shape[1] == dim]
                    if qs:
                        x = np.concatenate([v for _, v in rows if v.shape[1] == dim])
                        q = np.concatenate([v for _, v in asks if v.shape[1] == dim])
                        out = _ranked(np.concatenate(ids), x, np.concatenate(qs), q, k)
                        if out is not None:
                            found.append(out)
                            n_found += out.num_rows

        for batch in batches:
            tags = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)], axis=1)
            side = batch.column(3).to_numpy(zero_copy_only=False)
            ids = batch.column(4).to_numpy(zero_copy_only=False)
            parts_of = list(_matrices(batch))
            edge = np.flatnonzero(np.concatenate(([True], (tags[1:] != tags[:-1]).any(axis=1)))) if len(tags) else []
            for a, b in zip(edge, [*edge[1:], len(tags)]):
                tag = tuple(tags[a])
                if tag != now:
                    done()
                    now, held = tag, ([], [])
                    if n_found > HELD_ROWS:
                        cut_rows = _cut(found, k)
                        found, n_found = [cut_rows], cut_rows.num_rows
                        if 2 * n_found > HELD_ROWS:
                            yield cut_rows
                            found, n_found = [], 0
                for rows, x in parts_of:
                    lo, hi = np.searchsorted(rows, (a, b))
                    for s in (0, 1):
                        mine = np.arange(lo, hi)[side[rows[lo:hi]] == s]
                        if len(mine):
                            held[s].append((ids[rows[mine]], x[mine]))
        done()
        if found:
            yield _cut(found, k)

    columns = both.select("key", "s", "r", "side", "id", "v")
    return map_arrow(columns, run, "query_id long, minus double, id long")


def _blocks(counts: DataFrame, name: str) -> DataFrame:
    return counts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest ``k`` over all blocks.

    A pair met in several tables has one score, so its rows share a dense rank:
    Spark drops ranks beyond ``k`` in each task before the rows move, and the
    repetitions after.
    """
    order = Window.partitionBy("query_id").orderBy("minus", "id")
    best = found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    best = best.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.min("minus").alias("minus"))
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), (-F.col("minus")).alias("score"))


def nearest(
    table: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    n_tables: int = N_TABLES, n_projections: int = N_PROJECTIONS, width: float = WIDTH, n_probes: int = N_PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_every``."""
    v = F.col(vector).cast("array<double>")
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(good)
    rows = rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0.0))
    rows = cut(rows.groupBy("id").agg(F.max("v").alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest, n_rows = rows.agg(F.sqrt(F.max(square)), F.count(F.lit(1))).first()
    queries = rows.filter(F.col("id") % query_every == 0)
    same = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")
    keyed = cut(_hashed(index, longest or 1.0, n_tables, n_projections, width, 0), "buckets")
    asked = cut(_hashed(queries, 1.0, n_tables, n_projections, width, n_probes), "probes")
    n_s, n_r = cut(_blocks(keyed, "n_s"), "row-blocks"), cut(_blocks(asked, "n_r"), "query-blocks")
    sizes = n_s.join(n_r, "key")
    meant = keyed.join(sizes, "key").select(
        "key", F.pmod(F.xxhash64("id"), "n_s").cast("int").alias("s"),
        F.explode(F.sequence(F.lit(0), F.col("n_r") - 1)).alias("r"), "id", "v",
    )
    asking = asked.join(sizes, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("n_s") - 1)).alias("s"),
        F.pmod(F.xxhash64("id"), "n_r").cast("int").alias("r"), "id", "v",
    )
    best = cut(_merged(_meet(meant, asking, k), k), "nearest")
    # an exact way for queries whose buckets held too few
    full = best.filter(F.col("rank") == min(k, n_rows - 1)).select("query_id")
    short = cut(queries.join(full, F.col("id") == F.col("query_id"), "left_anti"), "short")
    n_short = short.count()
    if n_short:
        blocks = max(1, -(-n_rows // BLOCK_ROWS))
        more = max(1, -(-n_short // BLOCK_ROWS))
        every = index.select(
            F.lit(0).cast("long").alias("key"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("s"),
            F.explode(F.sequence(F.lit(0), F.lit(more - 1))).alias("r"), "id", "v",
        )
        whole = short.select(
            F.lit(0).cast("long").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("s"),
            F.pmod(F.xxhash64("id"), F.lit(more)).cast("int").alias("r"), "id", "v",
        )
        exact = _merged(_meet(every, whole, k), k)
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
    return best
