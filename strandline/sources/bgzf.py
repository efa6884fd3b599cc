"""Block-compressed files (BGZF) as splittable sources and transactional sinks: BAM, BCF, and text such as VCF.

A file is a chain of small gzip blocks.  A place in it is a virtual offset, the
block's place in the file shifted by 16 bits plus the place in the unpacked block.

Reading.  Without an index a file is cut into byte ranges.  A task searches its
range for the first block (a header whose block unpacks to its checksum), and there
for the first record: a place from which a chain of records makes sense.  It reads
up to the first record of the next range, which it knows for certain; it makes the
same search there and fails if the answers differ, so by induction over the ranges
every record is read once.  With regions and an index (BAI, CSI, TBI) beside the file,
the partitions are the index's chunks, and nothing else of the file is read; without
an index regions are a filter.  Conditions on ``chrom`` and ``pos`` that Spark pushes
down are such regions too.

Writing.  Every task writes one whole file (header, blocks, mark of the end) and its
CSI index under names of its own in a temporary folder; commit moves the files of the
tasks that won into place, abort deletes the folder.  Sorted rows give indexed files.

Formats: ``bgzf_alignments``, ``bgzf_variants``, ``bgzf_lines``.  Paths are local or
URIs that Arrow opens.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

from strandline.sources import packed

#: Compressed bytes of a partition, unless the option ``split`` says otherwise.
SPLIT_BYTES = 32 << 20
#: Bytes fetched at a time.
FETCH_BYTES = 1 << 17
#: Records that must follow one another from the place where a range's first record is looked for.
CHAIN = 6
#: Unpacked bytes looked at for that.
LOOK_BYTES = 1 << 18
BATCH_ROWS = 5000
BLOCK_START = b"\x1f\x8b\x08\x04"
#: Fixed values of the index formats: bits of the smallest bin and levels of bins, unless a file says otherwise.
MIN_SHIFT, DEPTH = 14, 5
#: A written chunk ends after so many bytes, where the next one begins: there it may be divided.
CHUNK_BYTES = 1 << 20
LAST_PLACE = 1 << 29


# ---------------------------------------------------------------- files


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and place in it of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(file, size) of a file, or of the data files of a folder, in order of their names."""
    fs, inner = located(path)
    prefix = path[: len(path) - len(inner)] if "://" in path else ""
    info = fs.get_file_info(inner)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in fs.get_file_info(arrow_fs.FileSelector(inner)) if f.type == arrow_fs.FileType.File]
    keep = [f for f in found if f.base_name.endswith(suffixes) and not f.base_name.startswith(("_", "."))]
    return [(prefix + f.path, f.size) for f in sorted(keep, key=lambda f: f.path)]


def is_blocked(path: str, suffix: str) -> bool:
    """Whether a file, or the first data file of a folder, has the suffix and consists of blocks."""
    try:
        found = listed(path, (suffix,))
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):  # none there, a pattern, or not for Arrow
        return False
    return bool(found) and found[0][0].endswith(suffix) and Blocks(found[0][0]).size_at(0) is not None


class Blocks:
    """Blocks of a file, fetched as they are needed; ``fetched`` counts the bytes."""

    def __init__(self, path: str):
        fs, inner = located(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.fetched = 0
        self._at, self._window = 0, b""

    def raw(self, at: int, n: int) -> bytes:
        if not (self._at <= at and at + n <= self._at + len(self._window)):
            self.file.seek(at)
            self._at, self._window = at, self.file.read(max(n, FETCH_BYTES))
            self.fetched += len(self._window)
        return self._window[at - self._at : at - self._at + n]

    def size_at(self, at: int) -> int | None:
        """Size of the block at a place; None if none can begin there."""
        head = self.raw(at, 12)
        if len(head) < 12 or head[:4] != BLOCK_START:
            return None
        extra = self.raw(at + 12, struct.unpack_from("<H", head, 10)[0])
        k = 0
        while k + 4 <= len(extra):
            size = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC" and size == 2 and k + 6 <= len(extra):
                return struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + size
        return None

    def unpacked(self, at: int) -> tuple[bytes, int]:
        """Content of the block at a place, and the place of the next one."""
        size = self.size_at(at)
        if size is None:
            raise ValueError(f"no block at {at}")
        whole = self.raw(at, size)
        begin = 12 + struct.unpack_from("<H", whole, 10)[0]
        if len(whole) < size or size < begin + 8:
            raise ValueError(f"the block at {at} is cut short")
        out = zlib.decompress(whole[begin:-8], -15)
        check, length = struct.unpack("<II", whole[-8:])
        if len(out) != length or zlib.crc32(out) != check:
            raise ValueError(f"the block at {at} is damaged")
        return out, at + size

    def first_from(self, at: int) -> int:
        """Place of the first block that begins at or after a place; the file's size if none does."""
        if at == 0:
            return 0
        while at < self.size:
            seen = self.raw(at, min(FETCH_BYTES, self.size - at))
            k = seen.find(BLOCK_START)
            if k < 0:
                at += max(1, len(seen) - 3)
                continue
            try:
                self.unpacked(at + k)
                return at + k
            except (ValueError, zlib.error):
                at += k + 1
        return self.size


class Cursor:
    """A place among the unpacked bytes of a file that moves on as bytes are taken."""

    def __init__(self, blocks: Blocks, offset: int):
        self.blocks = blocks
        self.block, self.at = offset >> 16, offset & 0xFFFF
        self.data, self.next = (b"", self.block) if self.block >= blocks.size else blocks.unpacked(self.block)
        self._settle()

    def _settle(self) -> None:
        """Moves to the next block with content if this one is used up."""
        while self.at >= len(self.data) and self.next < self.blocks.size:
            self.block, self.at = self.next, 0
            self.data, self.next = self.blocks.unpacked(self.block)

    @property
    def offset(self) -> int:
        """Virtual offset; the end of the file is the offset of the byte after it."""
        return self.blocks.size << 16 if self.at_end() else self.block << 16 | self.at

    def at_end(self) -> bool:
        return self.at >= len(self.data) and self.next >= self.blocks.size

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        if len(out) < n:
            pieces = [out]
            while n > sum(map(len, pieces)):
                self._settle()
                if self.at_end():
                    raise ValueError("the file is cut short")
                piece = self.data[self.at : self.at + n - sum(map(len, pieces))]
                self.at += len(piece)
                pieces.append(piece)
            out = b"".join(pieces)
        self._settle()
        return out

    def line(self) -> bytes:
        """Bytes up to the next line feed, which is taken too."""
        pieces = []
        while not self.at_end():
            k = self.data.find(b"\n", self.at)
            if k >= 0:
                pieces.append(self.data[self.at : k])
                self.at = k + 1
                self._settle()
                break
            pieces.append(self.data[self.at :])
            self.at = len(self.data)
            self._settle()
        return b"".join(pieces)


# ---------------------------------------------------------------- bins


def bin_of(beg: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    """Number of the smallest bin that holds [beg, end), from 0."""
    for level in range(depth, -1, -1):
        shift = min_shift + 3 * (depth - level)
        if beg >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (beg >> shift)
    return 0


def bins_over(beg: int, end: int, min_shift: int, depth: int) -> Iterator[range]:
    """Ranges of the bins, a range a level, that may hold what overlaps [beg, end)."""
    for level in range(depth + 1):
        shift, first = min_shift + 3 * (depth - level), ((1 << 3 * level) - 1) // 7
        yield range(first + (beg >> shift), first + ((end - 1) >> shift) + 1)


@dataclass
class Index:
    """Chunks of virtual offsets by sequence and bin; the least offset that matters from a place on."""

    min_shift: int = MIN_SHIFT
    depth: int = DEPTH
    names: list[str] | None = None
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    least: list[dict[int, int]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)

    def chunks(self, ref: int, beg: int, end: int) -> list[tuple[int, int]]:
        """Chunks, merged and in order, that hold all records over [beg, end)."""
        if ref >= len(self.bins):
            return []
        own, found, floor = self.bins[ref], [], 0
        end = min(end, 1 << self.min_shift + 3 * self.depth)
        if beg >= end:
            return []
        if self.linear:
            windows = self.linear[ref]
            floor = windows[min(beg >> MIN_SHIFT, len(windows) - 1)] if windows else 0
        else:  # of the smallest bin over the first place that is there, or of one that holds it
            at = ((1 << 3 * self.depth) - 1) // 7 + (beg >> self.min_shift)
            while at and at not in self.least[ref]:
                at = (at - 1) >> 3
            floor = self.least[ref].get(at, 0)
        for numbers in bins_over(beg, end, self.min_shift, self.depth):
            # whichever is shorter: the bins of the range or those that exist
            hit = (b for b in own if b in numbers) if len(numbers) > len(own) else (b for b in numbers if b in own)
            for b in hit:
                found += [(max(a, floor), z) for a, z in own[b] if z > floor]
        return merged(found)


    def starts(self) -> list[int]:
        """Virtual offsets at which the index says that a record begins or ends, in order."""
        found = {x for own in self.bins for chunks in own.values() for c in chunks for x in c}
        return sorted(found | {x for windows in self.linear for x in windows if x})


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order; those that meet, or end and begin in the same block, become one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


class _Fields:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def __call__(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out


def read_index(data: bytes) -> Index:
    """A BAI, CSI or TBI index."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_members(data))
    get = _Fields(data)
    (kind,) = get("4s")
    out = Index()

    def names_of(aux: bytes) -> list[str]:
        size = struct.unpack_from("<i", aux, 24)[0]
        return [n.decode() for n in aux[28 : 28 + size].split(b"\0")[:-1]]

    if kind == b"CSI\1":
        out.min_shift, out.depth, n_aux = get("iii")
        (aux,) = get(f"{n_aux}s")
        out.names = names_of(aux) if n_aux >= 28 else None
        (refs,) = get("i")
    elif kind == b"TBI\1":
        (refs,) = get("i")
        head = get("7i")
        (said,) = get(f"{head[6]}s")
        out.names = [n.decode() for n in said.split(b"\0")[:-1]]
    elif kind == b"BAI\1":
        (refs,) = get("i")
    else:
        raise ValueError("not an index")
    for _ in range(refs):
        own, least = {}, {}
        for _ in range(get("i")[0]):
            (number,) = get("I")
            if kind == b"CSI\1":
                (least[number],) = get("Q")
            n = get("i")[0]
            flat = get(f"{2 * n}Q")
            if number < ((1 << 3 * (out.depth + 1)) - 1) // 7:  # beyond it are counts, not places
                own[number] = list(zip(flat[::2], flat[1::2]))
        out.bins.append(own)
        out.least.append(least)
        if kind != b"CSI\1":
            out.linear.append(list(get(f"{get('i')[0]}Q")))
    return out


def _members(data: bytes) -> Iterator[bytes]:
    """Contents of gzip members one after another."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


class IndexBuilder:
    """Index of records that come in the order of their places."""

    def __init__(self) -> None:
        self.bins: dict[int, dict[int, list[list[int]]]] = {}
        self.windows: dict[int, dict[int, int]] = {}
        self.last: tuple[int, int] = (-1, -1)
        self.after = 0
        self.sorted = True

    def add(self, ref: int, beg: int, end: int, first: int, after: int) -> None:
        """A record over [beg, end) of a sequence, from one virtual offset to another."""
        before, self.after = self.after, after
        if ref < 0:
            return
        end = max(end, beg + 1)
        self.sorted &= (ref, beg) >= self.last
        self.last = (ref, beg)
        chunks = self.bins.setdefault(ref, {}).setdefault(bin_of(beg, end), [])
        # the record before ended where this one begins, be it in the next block
        follows = bool(chunks) and chunks[-1][1] in (before, first)
        if follows and (first >> 16) - (chunks[-1][0] >> 16) < CHUNK_BYTES:
            chunks[-1][1] = after
        elif follows:
            chunks[-1][1] = first
            chunks.append([first, after])
        else:
            chunks.append([first, after])
        windows = self.windows.setdefault(ref, {})
        for w in range(beg >> MIN_SHIFT, ((end - 1) >> MIN_SHIFT) + 1):
            windows.setdefault(w, first)

    def least(self, ref: int, number: int) -> int:
        """Least offset of a record that reaches into a bin's place or later."""
        level = next(k for k in range(DEPTH, -1, -1) if number >= ((1 << 3 * k) - 1) // 7)
        first = (number - ((1 << 3 * level) - 1) // 7) << 3 * (DEPTH - level)
        later = [v for w, v in self.windows[ref].items() if w >= first]
        return min(later, default=0)

    def packed(self, names: list[str], columns: tuple[int, int, int, int] | None) -> bytes:
        """CSI index; ``columns`` are format code and columns of sequence, begin and end for text files."""
        aux = b""
        if columns:
            said = b"".join(n.encode() + b"\0" for n in names)
            aux = struct.pack("<7i", *columns, ord("#"), 0, len(said)) + said
        out = [b"CSI\1", struct.pack("<iii", MIN_SHIFT, DEPTH, len(aux)), aux, struct.pack("<i", len(names))]
        for ref in range(len(names)):
            own = self.bins.get(ref, {})
            out.append(struct.pack("<i", len(own)))
            for number, chunks in sorted(own.items()):
                out.append(struct.pack("<IQi", number, self.least(ref, number), len(chunks)))
                out += [struct.pack("<QQ", *c) for c in chunks]
        return packed.blocked(b"".join(out))


# ---------------------------------------------------------------- formats


@dataclass
class Region:
    chrom: str
    beg: int = 1
    end: int = LAST_PLACE


def regions_of(said: str) -> list[Region]:
    """Regions written as chrom, chrom:beg-end or chrom:beg, apart by commas or semicolons."""
    out = []
    for one in filter(None, said.replace(";", ",").split(",")):
        chrom, mark, span = one.rpartition(":")
        if not mark:
            out.append(Region(one))
            continue
        beg, dash, end = span.partition("-")
        out.append(Region(chrom, int(beg or 1), int(end) if end else LAST_PLACE if dash else int(beg)))
    return out


class Alignments:
    """Records of BAM files."""

    suffixes = (".bam",)
    sql, arrow = packed.READS_SQL, packed.READS_ARROW
    columns = None

    def __init__(self, cursor: Cursor):
        if cursor.take(4) != packed.BAM_MAGIC:
            raise ValueError("not a BAM file")
        cursor.take(*struct.unpack("<i", cursor.take(4)))
        names = []
        for _ in range(*struct.unpack("<i", cursor.take(4))):
            names.append(cursor.take(*struct.unpack("<i", cursor.take(4)))[:-1].decode())
            cursor.take(4)
        self.names: list[str] = names
        self.first = cursor.offset

    def record(self, cursor: Cursor) -> bytes:
        return cursor.take(*struct.unpack("<i", cursor.take(4)))

    def plausible(self, data: bytes, at: int) -> int | None:
        """Place after the record that may begin at a place; None if none can.  Beyond the data: it may, as far as seen."""
        if at + 36 > len(data):
            return len(data) + 1
        size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
        known = len(self.names)
        if not (-1 <= ref < known and -1 <= mate < known and pos >= -1 and mate_pos >= -1 and n_name > 0 and n_seq >= 0):
            return None
        if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
            return None
        end = at + 36 + n_name
        if end <= len(data) and (data[end - 1] != 0 or not all(33 <= c <= 126 for c in data[at + 36 : end - 1])):
            return None
        return at + 4 + size

    def span(self, body: bytes) -> tuple[int, int, int]:
        """(sequence, begin, end) from 0, half-open."""
        ref, pos, n_name, _, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", body)
        size = 0
        if not flag & 4:
            ops = struct.unpack_from(f"<{n_cigar}I", body, 32 + n_name)
            size = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))
        return ref, pos, pos + max(size, 1)

    def row(self, body: bytes) -> dict:
        return packed.alignment(body, [*self.names, None])


class Variants:
    """Records of BCF files."""

    suffixes = (".bcf",)
    sql, arrow = packed.VARIANTS_SQL, packed.VARIANTS_ARROW
    columns = None

    def __init__(self, cursor: Cursor):
        if cursor.take(5) != packed.BCF_MAGIC:
            raise ValueError("not a BCF file")
        header = cursor.take(*struct.unpack("<I", cursor.take(4))).decode()
        self.strings, self.names, self.samples = packed._dictionaries(header)
        self.first = cursor.offset

    def record(self, cursor: Cursor) -> tuple[bytes, bytes]:
        shared, own = struct.unpack("<II", cursor.take(8))
        return cursor.take(shared), cursor.take(own)

    def plausible(self, data: bytes, at: int) -> int | None:
        if at + 32 > len(data):
            return len(data) + 1
        n_shared, n_own, chrom, pos, span, _, _, n_allele, n_sample = struct.unpack_from("<IIiiiIHHI", data, at)
        if not (0 <= chrom < len(self.names) and pos >= -1 and span >= 0 and n_shared >= 24 and n_sample & 0xFFFFFF == len(self.samples)):
            return None
        if n_allele == 0 or n_shared < 24 + n_allele or (n_own == 0) != (n_sample >> 24 == 0):
            return None
        if at + 33 <= len(data) and data[at + 32] & 15 != 7:  # the name that follows is text
            return None
        return at + 8 + n_shared + n_own

    def span(self, record: tuple[bytes, bytes]) -> tuple[int, int, int]:
        chrom, pos, size = struct.unpack_from("<iii", record[0])
        return chrom, pos, pos + max(size, 1)

    def row(self, record: tuple[bytes, bytes]) -> dict:
        return packed.variant(*record, self.strings, self.names, self.samples)


class Lines:
    """Lines of text files; those of VCF files have places.  Lines that begin with ``#`` are the header."""

    suffixes = (".gz", ".bgz")
    sql, arrow = "value string", pa.schema([("value", pa.string())])
    #: Code of VCF in the index, columns of sequence and begin.
    columns = (2, 1, 2, 0)

    def __init__(self, cursor: Cursor):
        self.names: list[str] = []
        self.first = 0

    def record(self, cursor: Cursor) -> bytes:
        return cursor.line()

    def span(self, line: bytes) -> tuple[str, int, int]:
        part = line.split(b"\t", 8)
        beg = int(part[1]) - 1
        end = beg + len(part[3])
        for entry in part[7].split(b";") if len(part) > 7 else ():
            if entry.startswith(b"END="):
                end = max(end, int(entry[4:]))
        return part[0].decode(), beg, end

    def row(self, line: bytes) -> dict:
        return {"value": line.decode().rstrip("\r")}


# ---------------------------------------------------------------- reading


@dataclass
class Range(InputPartition):
    """Records of a file from one virtual offset, or, if ``searched``, from the first found there, up to another."""

    path: str
    begin: int
    end: int
    searched: bool
    header: bool = False

    def __post_init__(self) -> None:
        self.value = (self.path, self.begin)


def first_record(form, blocks: Blocks, at: int) -> int:
    """Virtual offset of the first record that begins in a block at or after a place of the file."""
    block = blocks.first_from(at)
    if block <= form.first >> 16:
        return form.first
    while block < blocks.size:
        own, after = blocks.unpacked(block)
        if isinstance(form, Lines):  # after the first end of a line; one that begins with the block is the earlier range's
            k = own.find(b"\n")
            if k >= 0:
                return Cursor(blocks, block << 16 | (k + 1)).offset
        else:
            data, follow = own, after
            while len(data) < LOOK_BYTES and follow < blocks.size:
                more, follow = blocks.unpacked(follow)
                data += more
            for k in range(len(own)):
                if chained(form, data, k, follow >= blocks.size):
                    return block << 16 | k
        block = after
    return blocks.size << 16


def chained(form, data: bytes, at: int, whole: bool) -> bool:
    """Whether records seem to follow one another from a place; ``whole`` if the file ends with the data."""
    for _ in range(CHAIN):
        if at >= len(data):
            break
        at = form.plausible(data, at)
        if at is None:
            return False
    return at <= len(data) or not whole


class RangeReader:
    """Records of one range of a file."""

    def __init__(self, kind: type, part: Range):
        self.part = part
        self.blocks = Blocks(part.path)
        self.form = kind(Cursor(self.blocks, 0))

    def records(self) -> Iterator[tuple[int, object, int]]:
        """(virtual offset, record, offset after it)."""
        part, form, blocks = self.part, self.form, self.blocks
        begin = first_record(form, blocks, part.begin >> 16) if part.searched else part.begin
        cursor = Cursor(blocks, max(begin, form.first))
        stop = part.end
        border = None
        if part.searched and part.end >> 16 < blocks.size:
            border = blocks.first_from(part.end >> 16)
            stop = border << 16
            if isinstance(form, Lines):
                stop = first_record(form, blocks, part.end >> 16)
        while not cursor.at_end() and cursor.offset < stop:
            at = cursor.offset
            record = form.record(cursor)
            yield at, record, cursor.offset
        if border is not None and not isinstance(form, Lines):
            found = first_record(form, blocks, part.end >> 16)
            if found != cursor.offset and begin < stop:
                raise ValueError(f"{part.path}: the record after {part.end >> 16} begins at {cursor.offset}, not at {found}; read it with its index")


def planned(kind: type, files: list[tuple[str, int]], regions: list[Region] | None, split: int) -> list[Range]:
    """Partitions of files: chunks of their indices for regions, else ranges of bytes."""
    out: list[Range] = []
    for path, size in files:
        index = index_of(path) if regions is not None else None
        if index is None:
            cuts = [*range(0, size, split), size]
            out += [Range(path, a << 16, b << 16, True) for a, b in zip(cuts, cuts[1:])]
            continue
        form = kind(Cursor(Blocks(path), 0))
        names = index.names if index.names is not None else form.names
        chunks = []
        for r in regions:
            if r.chrom in names:
                chunks += index.chunks(names.index(r.chrom), r.beg - 1, r.end)
        starts = index.starts()
        for a, z in merged(chunks):
            out += [Range(path, x, y, False) for x, y in divided(a, z, split, starts)]
        if isinstance(form, Lines):
            out.append(Range(path, 0, size << 16, False, True))
    return out


def divided(begin: int, end: int, split: int, starts: list[int]) -> list[tuple[int, int]]:
    """A chunk in parts of about ``split`` bytes, cut where the index knows that records begin."""
    cuts = [begin]
    for at in starts[bisect_right(starts, begin) : bisect_left(starts, end)]:
        if (at >> 16) - (cuts[-1] >> 16) >= split:
            cuts.append(at)
    return list(zip(cuts, [*cuts[1:], end]))


def index_of(path: str) -> Index | None:
    """The index beside a file, if there is one."""
    stem, _ = os.path.splitext(path)
    for name in (path + ".csi", path + ".bai", path + ".tbi", stem + ".bai"):
        fs, inner = located(name)
        if fs.get_file_info(inner).type == arrow_fs.FileType.File:
            with fs.open_input_file(inner) as f:
                return read_index(f.read())
    return None


REPORT = "path string, begin long, end long, bytes long, records long, kept long"


class Reader(DataSourceReader):
    def __init__(self, kind: type, options: dict[str, str]):
        self.kind = kind
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT_BYTES))
        self.regions = regions_of(options["regions"]) if options.get("regions") else None
        self.report = options.get("report", "false").lower() == "true"
        self.pushed: list[Region] | None = None

    def pushFilters(self, filters):
        """Conditions on chrom and pos choose chunks; Spark still applies them."""
        filters = list(filters)
        chrom, low, high = None, 1, LAST_PLACE
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name == "chrom" and isinstance(f, EqualTo):
                chrom = f.value
            elif name == "pos" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if name == "pos" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = min(high, f.value - isinstance(f, LessThan))
        if chrom is not None and self.regions is None:
            self.pushed = [Region(chrom, low, high)] if low <= high else []
        return filters

    def partitions(self):
        regions = self.regions if self.regions is not None else self.pushed
        return planned(self.kind, listed(self.path, self.kind.suffixes), regions, self.split)

    def read(self, part):
        if part is None:  # no partitions: nothing overlaps
            return
        reader = RangeReader(self.kind, part)
        form = reader.form
        wanted: dict[object, list[tuple[int, int]]] | None = None
        regions = self.regions if self.regions is not None else self.pushed
        if regions is not None:
            wanted = {}
            for r in regions:
                key = r.chrom if isinstance(form, Lines) else form.names.index(r.chrom) if r.chrom in form.names else None
                wanted.setdefault(key, []).append((r.beg - 1, r.end))
        rows, seen, kept = [], 0, 0
        for _, record, _ in reader.records():
            if isinstance(form, Lines):
                heads = record.startswith(b"#") or not record
                if part.header and not heads:
                    break
                if not record or (heads and not part.searched and not part.header):
                    continue
            else:
                heads = False
            seen += 1
            if wanted is not None and not heads:
                ref, beg, end = form.span(record)
                if not any(beg < z and a < end for a, z in wanted.get(ref, ())):
                    continue
            kept += 1
            if not self.report:
                rows.append(packed._firsts(form.row(record)))
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, form.arrow)
                    rows = []
        if self.report:
            values = (part.path, part.begin, part.end, reader.blocks.fetched, seen, kept)
            names = [c.split()[0] for c in REPORT.split(", ")]
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, values)})
        elif rows:
            yield pa.RecordBatch.from_pylist(rows, form.arrow)


# ---------------------------------------------------------------- writing


class BlockWriter:
    """Packs bytes in blocks; records begin in a new block if they do not fit in the rest of one."""

    def __init__(self, out):
        self.out, self.pending, self.written = out, bytearray(), 0

    @property
    def offset(self) -> int:
        return self.written << 16 | len(self.pending)

    def put(self, data: bytes) -> None:
        if self.pending and len(self.pending) + len(data) > packed.BLOCK_BYTES:
            self.flush()
        self.pending += data
        while len(self.pending) > packed.BLOCK_BYTES:
            self._block(bytes(self.pending[: packed.BLOCK_BYTES]))
            del self.pending[: packed.BLOCK_BYTES]

    def flush(self) -> None:
        if self.pending:
            self._block(bytes(self.pending))
            self.pending.clear()

    def _block(self, data: bytes) -> None:
        squeezed = packed.blocked(data)[: -len(packed.END_OF_BLOCKS)]
        self.out.write(squeezed)
        self.written += len(squeezed)

    def close(self) -> None:
        self.flush()
        self.out.write(packed.END_OF_BLOCKS)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, by name in the temporary folder."""

    names: list[str]
    rows: int


class Writer(DataSourceArrowWriter):
    """Files by task; those of the tasks that won are moved into place at commit."""

    def __init__(self, kind: type, options: dict[str, str], overwrite: bool):
        self.kind, self.overwrite = kind, overwrite
        self.path = options["path"].rstrip("/")
        self.header = json.loads(options.get("header", "{}"))
        self.run = uuid.uuid4().hex
        self.temporary = f"{self.path}/_temporary-{self.run}"

    def _coder(self):
        """(bytes before the records, function from a row to (record, sequence, begin, end), names of sequences)."""
        h = self.header
        if self.kind is Alignments:
            chroms = h["chroms"]
            place = {c: i for i, c in enumerate(chroms)} | {None: -1}
            span = Alignments.span

            def code(r: dict):
                record = packed.alignment_record(r, place)
                ref, beg, end = span(None, record[4:])
                if ref >= 0 and beg >= 0:  # the bin that the record itself names
                    record = record[:14] + struct.pack("<H", bin_of(beg, end)) + record[16:]
                return record, ref, max(beg, 0), end

            return packed.alignments_head(chroms, h.get("text", "@HD\tVN:1.6\tSO:coordinate\n"), h.get("lengths")), code, chroms
        if self.kind is Variants:
            said = packed.variants_head(h["contigs"], h["samples"], h["filters"], h["info"], h["formats"])
            number, places = packed.numbered(said)

            def code(r: dict):
                r = r | {"samples": [(s["sample"], s["fields"]) for s in r["samples"]]}
                record = packed.variant_record(r, number, places, h["samples"], h["formats"])
                beg = r["pos"] - 1
                return record, places[r["chrom"]], beg, beg + len(r["ref"])

            return packed.variants_start(said), code, h["contigs"]
        names: list[str] = []
        seen: dict[str, int] = {}

        def code(r: dict):
            line = r["value"].encode()
            chrom, beg, end = Lines.span(None, line)
            if chrom not in seen:
                seen[chrom] = len(names)
                names.append(chrom)
            return line + b"\n", seen[chrom], beg, end

        return "".join(x + "\n" for x in h.get("lines", [])).encode(), code, names

    def write(self, iterator):
        from pyspark import TaskContext

        fs, folder = located(self.temporary)
        fs.create_dir(folder, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{self.run[:8]}-{uuid.uuid4().hex[:8]}{self.kind.suffixes[0] if self.kind is not Lines else '.vcf.gz'}"
        head, code, refs = self._coder()
        index, rows = IndexBuilder(), 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            blocks = BlockWriter(out)
            blocks.put(head)
            blocks.flush()
            for batch in iterator:
                for row in packed.rows_of(batch):
                    record, ref, beg, end = code(row)
                    if len(blocks.pending) + len(record) > packed.BLOCK_BYTES:
                        blocks.flush()
                    first = blocks.offset
                    blocks.put(record)
                    index.add(ref, beg, end, first, blocks.offset)
                    rows += 1
            blocks.close()
        if not rows:
            fs.delete_file(f"{folder}/{name}")
            return Written([], 0)
        names = [name]
        if index.sorted:
            with fs.open_output_stream(f"{folder}/{name}.csi", compression=None) as out:
                out.write(index.packed(refs, self.kind.columns))
            names.append(f"{name}.csi")
        return Written(names, rows)

    def commit(self, messages):
        fs, folder = located(self.path)
        _, inner = located(self.temporary)
        fs.create_dir(folder, recursive=True)
        before = [f.path for f in fs.get_file_info(arrow_fs.FileSelector(folder)) if f.type == arrow_fs.FileType.File]
        for m in messages:
            # the index first: a file that is seen has one
            for name in sorted(m.names if m else [], key=lambda n: not n.endswith(".csi")):
                fs.move(f"{inner}/{name}", f"{folder}/{name}")
        for path in before if self.overwrite else ():
            fs.delete_file(path)
        self._clean()
        with fs.open_output_stream(f"{folder}/_SUCCESS", compression=None):
            pass

    def abort(self, messages):
        self._clean()
        fs, folder = located(self.path)
        if fs.get_file_info(folder).type == arrow_fs.FileType.Directory and not fs.get_file_info(arrow_fs.FileSelector(folder)):
            fs.delete_dir(folder)

    def _clean(self) -> None:
        fs, inner = located(self.temporary)
        if fs.get_file_info(inner).type == arrow_fs.FileType.Directory:
            fs.delete_dir(inner)


class _Source(DataSource):
    kind: type

    def schema(self):
        return REPORT if self.options.get("report", "false").lower() == "true" else self.kind.sql

    def reader(self, schema):
        return Reader(self.kind, dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(self.kind, dict(self.options), overwrite)


class AlignmentsSource(_Source):
    kind = Alignments

    @classmethod
    def name(cls):
        return "bgzf_alignments"


class VariantsSource(_Source):
    kind = Variants

    @classmethod
    def name(cls):
        return "bgzf_variants"


class LinesSource(_Source):
    kind = Lines

    @classmethod
    def name(cls):
        return "bgzf_lines"


def register(spark: SparkSession) -> None:
    """Makes the formats known, and lets conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (AlignmentsSource, VariantsSource, LinesSource):
        spark.dataSource.register(source)


# ---------------------------------------------------------------- tables


def _read(spark: SparkSession, form: str, path: str, regions: str | None, split: int, report: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format(form).option("split", split).option("report", str(report).lower())
    return (reader.option("regions", regions) if regions else reader).load(path)


def read_alignments(spark: SparkSession, path: str, regions: str | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """Rows of a BAM file or a folder of them, with the columns of the text reader; of regions: what overlaps them."""
    return _read(spark, "bgzf_alignments", path, regions, split)


def read_variants(spark: SparkSession, path: str, regions: str | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """Rows of a BCF file or a folder of them: the columns of the text reader, and the samples' fields as maps."""
    return _read(spark, "bgzf_variants", path, regions, split)


def read_lines(spark: SparkSession, path: str, regions: str | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """Lines of a block-compressed VCF; the text readers take them in place of a path."""
    return _read(spark, "bgzf_lines", path, regions, split)


def scan_report(spark: SparkSession, form: str, path: str, regions: str | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, begin, end, bytes, records, kept) of every partition that a scan would have."""
    return _read(spark, form, path, regions, split, True)


def _in_places(rows: DataFrame, chroms: list[str], files: int | None) -> DataFrame:
    """Rows in ranges of the genome, those without a place last, sorted: each range becomes a file."""
    # a table of the sequences that the header names
    numbers = rows.sparkSession.createDataFrame(list(zip(chroms, range(len(chroms)))), "chrom string, _rank int")
    keyed = rows.join(F.broadcast(numbers), "chrom", "left").select(*rows.columns, "_rank")
    order = [F.col("_rank").asc_nulls_last(), "pos"]
    dealt = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).select(*rows.columns)


def write_alignments(reads: DataFrame, path: str, chroms: list[str], files: int | None = None, mode: str = "overwrite", **header) -> None:
    """Sorted, indexed BAM files of rows with the columns of the text reader; ``chroms`` numbers the sequences."""
    register(reads.sparkSession)
    said = json.dumps({"chroms": chroms} | header)
    columns = packed.READS_ARROW.names
    _in_places(reads.select(*columns), chroms, files).write.format("bgzf_alignments").mode(mode).option("header", said).save(path)


def write_variants(
    variants: DataFrame, path: str, contigs: list[str], samples: list[str], filters: list[str], info: list[str], formats: list[str],
    files: int | None = None, mode: str = "overwrite",
) -> None:
    """Sorted, indexed BCF files of rows with the columns of :func:`read_variants`."""
    register(variants.sparkSession)
    said = json.dumps({"contigs": contigs, "samples": samples, "filters": filters, "info": info, "formats": formats})
    columns = packed.VARIANTS_ARROW.names
    _in_places(variants.select(*columns), contigs, files).write.format("bgzf_variants").mode(mode).option("header", said).save(path)


def write_lines(lines: DataFrame, path: str, header: list[str], files: int | None = None, mode: str = "overwrite") -> None:
    """Sorted, indexed block-compressed VCF files of body lines (rank, pos, value) as of :func:`strandline.sources.sinks.vcf_lines`."""
    register(lines.sparkSession)
    dealt = lines.repartitionByRange(files, "rank", "pos") if files else lines.repartitionByRange("rank", "pos")
    dealt.sortWithinPartitions("rank", "pos").select("value").write.format("bgzf_lines").mode(mode).option(
        "header", json.dumps({"lines": header})
    ).save(path)
