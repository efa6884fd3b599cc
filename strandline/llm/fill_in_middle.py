"""Operator 13: fill-in-the-middle, a numpy kernel over the Arrow UTF-8 buffers of whole batches.

A text is cut into units (lines, words with the space before them, or code
points); two keyed draws choose how many units are prefix and prefix with middle,
a third whether the text is transformed at all, a fourth the order of the parts.

All rows of a batch are handled together.  A table of 256 classes is looked up
for every byte; a unit begins where a byte's class and that of the byte before it
say so, or where a row begins; running sums of these marks, less their value at
the start of each row, number the units, and ``searchsorted`` finds the bytes at
which all rows are cut.  Code points are counted from the same classes.  Outputs
are gathered from the input buffer and the markers in stretches, so memory is
some seven times a batch; batches are bounded by bytes and one longer text is a
batch of its own.

Row-local: one scan, no shuffle.

Defined cases: a null text counts as empty; an empty text, or one that holds a
marker, stays plain; a null id is hashed as ``null``; repeated rows are
transformed alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandline.llm._shared import map_arrow, spread

#: Prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
SEED = 7
#: Percent of the texts that are transformed, and of these in the order suffix, prefix, middle.
FIM_PERCENT = 100
SPM_PERCENT = 50
#: Output bytes gathered at a time.
STRETCH = 1 << 20

NEWLINE, SPACE, CONTINUES = 1, 2, 4
#: Class of each byte: bits for a line feed, white space, and bytes that continue a code point.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(9, 14), 32]] |= SPACE
CLASSES[10] |= NEWLINE
CLASSES[0x80:0xC0] |= CONTINUES


def unit_starts(classes: np.ndarray, first: np.ndarray, units: str) -> np.ndarray:
    """Mask of the bytes at which a unit begins; ``first`` holds the first bytes of rows that are not empty."""
    starts = np.zeros(len(classes), bool)
    if units == "lines":
        starts[1:] = classes[:-1] & NEWLINE
    elif units == "words":  # white space belongs to the word after it
        space = (classes & SPACE) > 0
        starts[1:] = space[1:] & ~space[:-1]
    elif units == "chars":
        np.equal(classes & CONTINUES, 0, out=starts)
    else:
        raise ValueError(f"units are lines, words or chars, not {units}")
    starts[first] = True
    return starts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    offsets = offsets.astype(np.int64)
    if data is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    text = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return offsets - offsets[0], text


def marker_places(text: np.ndarray, marker: bytes) -> np.ndarray:
    """First bytes of all places of a marker."""
    places = np.flatnonzero(text == marker[0])
    for k in range(1, len(marker)):
        places = places[places + k < len(text)]
        places = places[text[places + k] == marker[k]]
    return places


def rows_holding(places: np.ndarray, size: int, offsets: np.ndarray) -> np.ndarray:
    """Rows in which the places lie as a whole."""
    rows = np.searchsorted(offsets, places, "right") - 1
    return rows[places + size <= offsets[rows + 1]]


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings, one for each row of the matrices: pieces of ``source`` one after another."""
    ends = np.concatenate(([0], np.cumsum(lengths.sum(axis=1))))
    flat_start, flat_len = starts.ravel(), lengths.ravel()
    stop = np.cumsum(flat_len)
    total = int(ends[-1])
    out = np.empty(total, np.uint8)
    shift = flat_start - (stop - flat_len)  # place in the source less place in the output
    for low in range(0, total, STRETCH):
        high = min(low + STRETCH, total)
        at = np.arange(low, high)
        out[low:high] = source[at + shift[np.searchsorted(stop, at, "right")]]
    wide = total >= 1 << 31
    kind = pa.large_string() if wide else pa.string()
    offsets = ends.astype(np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def checked(markers: tuple[str, str, str]) -> list[bytes]:
    """Markers as bytes: none may hold another or end as another (or it itself) begins, else places would be ambiguous."""
    coded = [m.encode("utf-8") for m in markers]
    for i, a in enumerate(coded):
        for j, b in enumerate(coded):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {markers} can overlap")
    return coded


def cut_batch(column: pa.Array, draws: np.ndarray, units: str, coded: list[bytes], fim: int, spm: int):
    """(units, form, prefix code points, middle code points, output) of all rows; draws are four integers a row."""
    offsets, text = buffers(column)
    rows = len(column)
    begin, end = offsets[:-1], offsets[1:]
    classes = CLASSES[text]
    starts = unit_starts(classes, begin[begin < end], units)
    before = np.zeros(len(text) + 1, np.int32)
    np.cumsum(starts, out=before[1:])
    count = (before[end] - before[begin]).astype(np.int64)
    one, two = draws[:, 0] % (count + 1), draws[:, 1] % (count + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        """Byte of each row at which its unit k begins, its end if there is none."""
        at = np.searchsorted(before[1:], (before[begin] + k + 1).astype(np.int32), "left")
        return np.where(k < count, at, end)

    low, high = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    del before, starts
    leads = np.zeros(len(text) + 1, np.int32)
    np.cumsum((classes & CONTINUES) == 0, out=leads[1:])
    prefix_chars, middle_chars = leads[low] - leads[begin], leads[high] - leads[low]
    del leads, classes

    form = np.where(draws[:, 3] % 100 < spm, 2, 1)
    form[(begin == end) | (draws[:, 2] % 100 >= fim)] = 0
    for m in coded:
        form[rows_holding(marker_places(text, m), len(m), offsets)] = 0

    source = np.concatenate([text, *[np.frombuffer(m, np.uint8) for m in coded]])
    sizes = [len(m) for m in coded]
    places = len(text) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    piece = lambda a, b: (a, b - a)
    mark = lambda k: (np.full(rows, places[k]), np.full(rows, sizes[k]))
    prefix, middle, suffix = piece(begin, low), piece(low, high), piece(high, end)
    orders = {1: (mark(0), prefix, mark(1), suffix, mark(2), middle), 2: (mark(1), suffix, mark(0), prefix, mark(2), middle)}
    s, n = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    s[:, 0], n[:, 0] = begin, np.where(form == 0, end - begin, 0)
    for f, parts in orders.items():
        own = form == f
        for k, (start, size) in enumerate(parts):
            s[own, k], n[own, k] = start[own], size[own]
    return count, form, prefix_chars, middle_chars, gathered(source, s, n)


def rebuild_batch(column: pa.Array, form: np.ndarray, coded: list[bytes]) -> pa.Array:
    """The exact texts behind outputs of :func:`cut_batch`."""
    offsets, text = buffers(column)
    begin, end = offsets[:-1], offsets[1:]
    at = []
    for m in coded:
        places = marker_places(text, m)
        row = np.searchsorted(offsets, places, "right") - 1
        own = (form[row] > 0) & (places + len(m) <= offsets[row + 1])
        place = np.full(len(column), -1)
        place[row[own]] = places[own]
        if np.count_nonzero(own) != np.count_nonzero(form) or (place[form > 0] < 0).any():
            raise ValueError("an output does not hold each marker once")
        at.append(place)
    p, s, m = at
    sizes = [len(c) for c in coded]
    starts, lengths = np.zeros((len(column), 3), np.int64), np.zeros((len(column), 3), np.int64)
    starts[:, 0], lengths[:, 0] = begin, np.where(form == 0, end - begin, 0)
    prefix_end, suffix_end = np.where(form == 1, s, m), np.where(form == 1, m, p)
    own = form > 0
    for k, (start, stop) in enumerate(((p + sizes[0], prefix_end), (m + sizes[2], end), (s + sizes[1], suffix_end))):
        starts[own, k], lengths[own, k] = start[own], (stop - start)[own]
    return gathered(text, starts, lengths)


def transform(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    units: str = "lines",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """(id column, n, form, prefix_chars, middle_chars, output) for every row."""
    coded = checked(markers)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    hashed = F.sha2(key, 256)
    draws = [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    source = spread(docs.select(F.col(id_col), F.col(text))).select(F.col(id_col).alias("k"), body, *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.column_stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)])
            n, form, prefix, middle, out = cut_batch(batch.column(1), drawn, units, coded, fim_percent, spm_percent)
            plain = form == 0
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.array(FORMS, object)[form], pa.string()),
                pa.array(prefix.astype(np.int64), pa.int64(), mask=plain),
                pa.array(middle.astype(np.int64), pa.int64(), mask=plain),
                out,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_arrow(source, run, schema).withColumnRenamed("k", id_col)


def restore(made: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``made`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    coded = checked(markers)
    names = made.columns
    o, f = names.index("output"), names.index("form")
    schema = StructType([*made.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.zeros(len(batch), np.int64)
            said = batch.column(f)
            for k, name in enumerate(FORMS):
                form[np.array(said.to_pylist(), object) == name] = k
            rebuilt = rebuild_batch(batch.column(o), form, coded)
            yield pa.RecordBatch.from_arrays([*batch.columns, rebuilt], [*names, "restored"])

    return map_arrow(made, run, schema)
