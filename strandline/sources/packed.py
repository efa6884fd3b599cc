"""Packed forms of alignments (BAM) and variants (BCF): decoding of whole files, encoding of rows.

A file is one binary row (two gigabytes at most), unpacked as a stream, so that a
worker holds the packed bytes and a batch of rows.  The rows are those of the
text readers, down to the spelling of numbers.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the formats.
BAM_MAGIC, BCF_MAGIC = b"BAM\1", b"BCF\2\2"
CIGAR_LETTERS = "MIDNSHP=X"
BASE_LETTERS = "=ACMGRSVTWYHKDBN"
#: Bases are half bytes, so they are hexadecimal digits in other letters; what is no base becomes no digit.
BASE_OF_DIGIT = str.maketrans("0123456789abcdef", BASE_LETTERS)
DIGIT_OF_BASE = bytes(b"0123456789abcdef"[BASE_LETTERS.index(chr(c))] if chr(c) in BASE_LETTERS else ord("x") for c in range(256))
QUALITY_SHOWN = bytes((q + 33) % 256 for q in range(256))
QUALITY_KEPT = bytes((q - 33) % 256 for q in range(256))
TAG_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
END_OF_BLOCKS = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 0xFF00
BATCH_ROWS = 5000
#: Packed bytes of the files that a partition becomes.
FILE_BYTES = 8 << 20
#: Typed values of BCF: code to (struct letter, missing, end of vector).
BCF_NUMBERS = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -(1 << 31), 1 - (1 << 31))}
BCF_FLOAT_MISSING, BCF_FLOAT_END = 0x7F800001, 0x7F800002


def blocked(data: bytes) -> bytes:
    """Bytes packed in independent gzip blocks that tell their size, with the mark of the end."""
    out = []
    for at in range(0, len(data), BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES]
        squeezed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeezed.compress(part) + squeezed.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + END_OF_BLOCKS


class Stream:
    """Numbers and strings from packed or plain bytes, one after another."""

    def __init__(self, data: bytes):
        raw = io.BytesIO(data)
        self.file = io.BufferedReader(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, 1 << 17)

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise ValueError("the file is cut short")
        return out

    def numbers(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def at_end(self) -> bool:
        return not self.file.peek(1)


# ---------------------------------------------------------------- alignments


def _tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(name, type, value as text) of the tags of a record."""
    at = 0
    while at < len(data):
        name, kind = data[at : at + 2].decode("ascii"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            yield name, kind, data[at:end].decode("utf-8", "replace")
            at = end + 1
        elif kind == "A":
            yield name, kind, chr(data[at])
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{TAG_NUMBERS[sub]}", data, at + 5)
            yield name, kind, ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])
            at += 5 + n * struct.calcsize(TAG_NUMBERS[sub])
        else:
            value = struct.unpack_from("<" + TAG_NUMBERS[kind], data, at)[0]
            yield name, "f" if kind == "f" else "i", f"{value:g}" if kind == "f" else str(value)
            at += struct.calcsize(TAG_NUMBERS[kind])


def decode_alignments(data: bytes) -> Iterator[dict]:
    """Rows of a BAM file, as of :func:`strandline.sources.text.read_reads`."""
    f = Stream(data)
    if f.take(4) != BAM_MAGIC:
        raise ValueError("not a BAM file")
    f.take(f.numbers("i")[0])
    names: list[str | None] = []
    for _ in range(f.numbers("i")[0]):
        names.append(f.take(f.numbers("i")[0])[:-1].decode("utf-8"))
        f.numbers("i")
    names.append(None)  # index -1
    while not f.at_end():
        yield alignment(f.take(f.numbers("i")[0]), names)


@lru_cache(1 << 8)
def _cigar_text(ops: bytes) -> str:
    return "".join(f"{x >> 4}{CIGAR_LETTERS[x & 15]}" for x in struct.unpack(f"<{len(ops) // 4}I", ops))


@lru_cache(1 << 8)
def _cigar_ops(cigar: str) -> bytes:
    number, ops = "", []
    for c in cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | CIGAR_LETTERS.index(c))
            number = ""
    return struct.pack(f"<{len(ops)}I", *ops)


def alignment(body: bytes, names: list[str | None]) -> dict:
    """Row of one record; ``names`` ends with None."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, span = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32 + n_name
    cigar = _cigar_text(body[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    seq = body[at : at + (n_seq + 1) // 2].hex().translate(BASE_OF_DIGIT)[:n_seq]
    at += (n_seq + 1) // 2
    qual = body[at : at + n_seq]
    tags = list(_tags(body[at + n_seq :]))
    return {
        "qname": body[32 : 32 + n_name - 1].decode("utf-8"), "flag": flag, "chrom": names[ref], "pos": pos + 1, "mapq": mapq, "cigar": cigar or None,
        "rnext": None if mate < 0 else "=" if mate == ref else names[mate], "pnext": mate_pos + 1, "tlen": span, "seq": seq or None,
        "qual": None if not qual or qual[0] == 255 else qual.translate(QUALITY_SHOWN).decode("ascii"),
        "tags": [(n, v) for n, _, v in tags], "tag_types": [(n, k) for n, k, _ in tags],
    }


def alignments_head(chroms: list[str], header: str = "@HD\tVN:1.6\n", lengths: list[int] | None = None) -> bytes:
    """What stands before the records of a BAM file."""
    out = [BAM_MAGIC, struct.pack("<i", len(header.encode())), header.encode(), struct.pack("<i", len(chroms))]
    for c, size in zip(chroms, lengths or [(1 << 29) - 1] * len(chroms)):
        out += [struct.pack("<i", len(c.encode()) + 1), c.encode() + b"\0", struct.pack("<i", size)]
    return b"".join(out)


def alignment_record(r: dict, place: dict[str | None, int]) -> bytes:
    """A row as a record; ``place`` numbers the sequences, None as -1."""
    name, seq, ref = r["qname"].encode() + b"\0", r["seq"] or "", place[r["chrom"]]
    ops = _cigar_ops(r["cigar"] or "")
    bases = seq.encode("ascii").translate(DIGIT_OF_BASE).decode("ascii") + "0" * (len(seq) % 2)
    body = struct.pack(
        "<iiBBHHHiiii", ref, r["pos"] - 1, len(name), r["mapq"], 4680, len(ops) // 4, r["flag"], len(seq),
        ref if r["rnext"] == "=" else place[r["rnext"]], r["pnext"] - 1, r["tlen"],
    )
    body += name + ops + bytes.fromhex(bases)
    qual = r["qual"].encode("latin-1") if r["qual"] else b""
    if qual and min(qual) < 33:
        raise ValueError(f"no quality: {r['qual']}")
    body += qual.translate(QUALITY_KEPT) if qual else b"\xff" * len(seq)
    kinds = dict(r["tag_types"] or ())
    for key, value in dict(r["tags"] or ()).items():
        kind = kinds.get(key, "Z")
        body += key.encode() + kind.encode()
        if kind == "i":
            body += struct.pack("<i", int(value))
        elif kind == "f":
            body += struct.pack("<f", float(value))
        elif kind == "A":
            body += value[0].encode()
        elif kind == "B":
            sub, *values = value.split(",")
            body += sub.encode() + struct.pack("<I", len(values))
            body += struct.pack(f"<{len(values)}{TAG_NUMBERS[sub]}", *map(float if sub == "f" else int, values))
        else:
            body += value.encode() + b"\0"
    return struct.pack("<i", len(body)) + body


def encode_alignments(rows: Iterable[dict], chroms: list[str], header: str = "@HD\tVN:1.6\n") -> bytes:
    """A BAM file of rows as :func:`decode_alignments` gives them (maps or lists of pairs for tags)."""
    place = {c: i for i, c in enumerate(chroms)} | {None: -1}
    return blocked(b"".join([alignments_head(chroms, header), *[alignment_record(r, place) for r in rows]]))


def packed_files(rows: Iterable[dict], chroms: list[str], most: int = FILE_BYTES) -> Iterator[bytes]:
    """BAM files of rows, each as long as ``most`` packed bytes or little more; without rows one that is empty.

    Blocks are packed as they fill, so that memory holds one packed file.
    """
    place = {c: i for i, c in enumerate(chroms)} | {None: -1}
    head = alignments_head(chroms)
    kept, size, plain, files = [], 0, bytearray(head), 0
    for r in rows:
        plain += alignment_record(r, place)
        while len(plain) >= BLOCK_BYTES:
            kept.append(blocked(bytes(plain[:BLOCK_BYTES]))[: -len(END_OF_BLOCKS)])
            size += len(kept[-1])
            del plain[:BLOCK_BYTES]
        if size >= most:
            yield b"".join(kept) + blocked(bytes(plain))
            kept, size, plain, files = [], 0, bytearray(head), files + 1
    if kept or len(plain) > len(head) or not files:
        yield b"".join(kept) + blocked(bytes(plain))


# ---------------------------------------------------------------- variants


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, place of the value) of a type descriptor."""
    code, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        (n,), at = _values(data, *_typed(data, at)[::2], 1)
    return code, n, at


def _values(data: bytes, code: int, at: int, n: int) -> tuple[list, int]:
    """``n`` values of a type, None for missing ones, without those after the end of a vector."""
    if code == 7:
        text = data[at : at + n].rstrip(b"\0").decode("utf-8")
        return [text], at + n
    if code == 5:
        raw = struct.unpack_from(f"<{n}I", data, at)
        out = [None if x == BCF_FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", x))[0] for x in raw if x != BCF_FLOAT_END]
        return out, at + 4 * n
    if code == 0:
        return [], at
    letter, missing, end = BCF_NUMBERS[code]
    raw = struct.unpack_from(f"<{n}{letter}", data, at)
    return [None if x == missing else x for x in raw if x != end], at + n * struct.calcsize(letter)


def _shown(values: list) -> str:
    return ",".join("." if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in values) or "."


def _dictionaries(header: str) -> tuple[list[str], list[str], list[str]]:
    """(strings, contigs, samples) that a header numbers; PASS is string 0."""
    strings, contigs = {"PASS": 0}, {}
    samples: list[str] = []
    for line in header.rstrip("\0").split("\n"):
        kind, _, rest = line.partition("=<ID=")
        name = rest.split(",")[0].rstrip(">")
        said = rest.rpartition("IDX=")[2].rstrip(">") if "IDX=" in rest else ""
        if kind in ("##FILTER", "##INFO", "##FORMAT"):
            strings.setdefault(name, int(said) if said else len(strings))
        elif kind == "##contig":
            contigs.setdefault(name, int(said) if said else len(contigs))
        elif line.startswith("#CHROM"):
            samples = line.split("\t")[9:]

    def listed(of: dict[str, int]) -> list[str]:
        out = [""] * (max(of.values(), default=-1) + 1)
        for name, i in of.items():
            out[i] = name
        return out

    return listed(strings), listed(contigs), samples


def _genotype(codes: list) -> str:
    out = ""
    for i, x in enumerate(codes):
        out += ("|" if x & 1 else "/") if i else ""
        out += "." if x < 2 else str((x >> 1) - 1)
    return out or "."


def decode_variants(data: bytes) -> Iterator[dict]:
    """Rows of a BCF file: the columns of the text reader, and ``samples``: (name, fields as pairs) of each sample."""
    f = Stream(data)
    if f.take(5) != BCF_MAGIC:
        raise ValueError("not a BCF file")
    strings, contigs, samples = _dictionaries(f.take(f.numbers("I")[0]).decode("utf-8"))
    while not f.at_end():
        n_shared, n_own = f.numbers("II")
        yield variant(f.take(n_shared), f.take(n_own), strings, contigs, samples)


def variant(shared: bytes, own: bytes, strings: list[str], contigs: list[str], samples: list[str]) -> dict:
    """Row of one record, of its part for all samples and that for each."""
    chrom, pos, _, _, n_info, n_allele, n_sample_fmt = struct.unpack_from("<iiifHHI", shared)
    raw_qual = struct.unpack_from("<I", shared, 12)[0]
    at = 24

    def value(data: bytes, at: int) -> tuple[list, int, int]:
        code, n, at = _typed(data, at)
        got, at = _values(data, code, at, n)
        return got, at, code

    name, at, _ = value(shared, at)
    alleles = []
    for _ in range(n_allele):
        allele, at, _ = value(shared, at)
        alleles.append(allele[0])
    filters, at, _ = value(shared, at)
    info = []
    for _ in range(n_info):
        key, at, _ = value(shared, at)
        got, at, code = value(shared, at)
        info.append((strings[key[0]], "" if code == 0 else _shown(got)))
    n_samples, n_fmt = n_sample_fmt & 0xFFFFFF, n_sample_fmt >> 24
    fields: list[list[tuple[str, str]]] = [[] for _ in range(n_samples)]
    at = 0
    for _ in range(n_fmt):
        key, at, _ = value(own, at)
        tag = strings[key[0]]
        code, n, at = _typed(own, at)
        for cell in fields:
            got, at = _values(own, code, at, n)
            cell.append((tag, _genotype([x or 0 for x in got]) if tag == "GT" else _shown(got)))
    return {
        "chrom": contigs[chrom], "pos": pos + 1, "id": None if not name or name[0] in (".", "") else name[0], "ref": alleles[0], "alts": alleles[1:],
        "qual": None if raw_qual == BCF_FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", raw_qual))[0],
        "filters": [strings[i] for i in filters], "info": info, "samples": [(s, c) for s, c in zip(samples, fields)],
    }


def _descriptor(code: int, n: int) -> bytes:
    return bytes([min(n, 15) << 4 | code]) + (_ints([n]) if n >= 15 else b"")


def _ints(values: list) -> bytes:
    """Whole numbers in four bytes each, with their descriptor."""
    return _descriptor(3, len(values)) + struct.pack(f"<{len(values)}i", *[BCF_NUMBERS[3][1] if v is None else v for v in values])


def _text(value: str) -> bytes:
    raw = value.encode()
    return _descriptor(7, len(raw)) + raw


def variants_head(contigs: list[str], samples: list[str], filters: list[str], info: list[str], formats: list[str]) -> str:
    """Header text that numbers what the records of a BCF file name."""
    head = ["##fileformat=VCFv4.2", *[f"##FILTER=<ID={x}>" for x in filters], *[f"##INFO=<ID={x}>" for x in info], *[f"##FORMAT=<ID={x}>" for x in formats]]
    head += [f"##contig=<ID={x}>" for x in contigs] + ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]) + "\n\0"]
    return "\n".join(head)


def variants_start(header: str) -> bytes:
    return BCF_MAGIC + struct.pack("<I", len(header.encode())) + header.encode()


def variant_record(r: dict, number: dict[str, int], places: dict[str, int], samples: list[str], formats: list[str]) -> bytes:
    """A row as a record; ``number`` and ``places`` number strings and contigs."""
    known = {name: dict(c) for name, c in r["samples"]}
    cells = [known.get(name, {}) for name in samples]  # a sample without a call is missing
    alleles = [r["ref"], *r["alts"]]
    qual = struct.pack("<I", BCF_FLOAT_MISSING) if r["qual"] is None else struct.pack("<f", r["qual"])
    shared = struct.pack("<iii", places[r["chrom"]], r["pos"] - 1, len(r["ref"])) + qual
    shared += struct.pack("<HHI", len(r["info"]), len(alleles), len(formats) << 24 | len(samples)) + _text(r["id"] or ".")
    shared += b"".join(map(_text, alleles)) + (_ints([number[x] for x in r["filters"]]) if r["filters"] else b"\0")
    for key, value in dict(r["info"]).items():
        shared += _ints([number[key]]) + (_text(value) if value else b"\0")
    own = b""
    for tag in formats:
        own += _ints([number[tag]])
        if tag == "GT":
            coded = []
            for c in cells:
                gt = c.get("GT", "./.")
                parts = gt.replace("|", "/").split("/")
                coded.append([(0 if x == "." else int(x) + 1) << 1 | (i > 0 and "|" in gt) for i, x in enumerate(parts)])
            width = max(map(len, coded), default=1)
            own += _descriptor(1, width) + b"".join(struct.pack(f"<{width}b", *(x + [-127] * (width - len(x)))) for x in coded)
        else:
            texts = [c.get(tag, ".").encode() for c in cells]
            width = max(map(len, texts), default=1)
            own += _descriptor(7, width) + b"".join(t.ljust(width, b"\0") for t in texts)
    return struct.pack("<II", len(shared), len(own)) + shared + own


def numbered(header: str) -> tuple[dict[str, int], dict[str, int]]:
    """Numbers of the strings and of the contigs of a header."""
    strings, contigs, _ = _dictionaries(header)
    return {s: i for i, s in enumerate(strings)}, {c: i for i, c in enumerate(contigs)}


def encode_variants(rows: Iterable[dict], contigs: list[str], samples: list[str], filters: list[str], info: list[str], formats: list[str]) -> bytes:
    """A BCF file of rows as :func:`decode_variants` gives them; INFO values and FORMAT fields but GT are stored as text."""
    header = variants_head(contigs, samples, filters, info, formats)
    number, places = numbered(header)
    return blocked(b"".join([variants_start(header), *[variant_record(r, number, places, samples, formats) for r in rows]]))


# ---------------------------------------------------------------- tables

READS_SQL = (
    "qname string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, "
    "tags map<string,string>, tag_types map<string,string>"
)
READS_ARROW = pa.schema(
    [("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()),
     ("rnext", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()),
     ("tags", pa.map_(pa.string(), pa.string())), ("tag_types", pa.map_(pa.string(), pa.string()))]
)
VARIANTS_SQL = (
    "chrom string, pos int, id string, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>, "
    "samples array<struct<sample: string, fields: map<string,string>>>"
)
VARIANTS_ARROW = pa.schema(
    [("chrom", pa.string()), ("pos", pa.int32()), ("id", pa.string()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("qual", pa.float32()),
     ("filters", pa.list_(pa.string())), ("info", pa.map_(pa.string(), pa.string())),
     ("samples", pa.list_(pa.struct([("sample", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])))]
)


def _firsts(row: dict) -> dict:
    """Pairs of a map, of a repeated key the first."""
    out = dict(row)
    for key in ("tags", "tag_types", "info"):
        if key in out:
            if len(dict(out[key])) < len(out[key]):
                out[key] = list({k: v for k, v in reversed(out[key])}.items())[::-1]
    if "samples" in out:
        out["samples"] = [{"sample": s, "fields": c} for s, c in out["samples"]]
    return out


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as of ``to_pylist``; the pairs of a map column are taken from its keys and values at once."""
    columns = []
    for column in batch.columns:
        if pa.types.is_map(column.type) and not column.null_count:
            pairs = list(zip(column.keys.to_pylist(), column.items.to_pylist()))
            at = column.offsets.to_pylist()
            columns.append([pairs[a:b] for a, b in zip(at, at[1:])])
        else:
            columns.append(column.to_pylist())
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*columns))


def decoded(contents: DataFrame, decode: Callable[[bytes], Iterator[dict]], sql: str, arrow: pa.Schema) -> DataFrame:
    """Rows of packed files given as one binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in decode(content.as_py()):
                    rows.append(_firsts(row))
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return contents.mapInArrow(run, sql)


def alignments_of(contents: DataFrame) -> DataFrame:
    return decoded(contents, decode_alignments, READS_SQL, READS_ARROW)


def variants_of(contents: DataFrame) -> DataFrame:
    return decoded(contents, decode_variants, VARIANTS_SQL, VARIANTS_ARROW)


def read_alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of BAM files, with the columns of the text reader."""
    return alignments_of(spark.read.format("binaryFile").load(path).select("content"))


def read_packed_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of BCF files: the columns of the text reader, and the samples' fields as maps."""
    return variants_of(spark.read.format("binaryFile").load(path).select("content"))


def packed_alignments(reads: DataFrame, chroms: list[str]) -> DataFrame:
    """(content): packed files of bounded size for each partition of reads with the columns of the text reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in rows_of(batch))
        for content in packed_files(rows, chroms):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    return reads.mapInArrow(run, "content binary")


def packed_variants(variants: DataFrame, contigs: list[str], samples: list[str], filters: list[str], info: list[str], formats: list[str]) -> DataFrame:
    """(content): one packed file for each partition of variants with their samples' fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r | {"samples": [(s["sample"], s["fields"]) for s in r["samples"]]} for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([encode_variants(rows, contigs, samples, filters, info, formats)], pa.binary())], ["content"])

    return variants.mapInArrow(run, "content binary")
