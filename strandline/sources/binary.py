"""Binary and block formats: BGEN genotypes and blocks of representative haplotypes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Variants of one batch of a reader.
BATCH_VARIANTS = 1000


def parse_bgen(data: bytes) -> Iterator[tuple[str, str, str, int, str, str, list[tuple[float, float, float] | None]]]:
    """(id, rsid, chrom, pos, ref, alt, genotype shares per sample) of each variant of a BGEN file.

    Layouts 1 and 2, plain or zlib; layout 2 must be diploid, unphased, biallelic, 8 bits.
    """
    first, head = struct.unpack_from("<II", data)
    _, n_variants, n_samples, magic = struct.unpack_from("<III4s", data, 4 - 4 + 4)
    if magic not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    flags = struct.unpack_from("<I", data, 4 + head - 4)[0]
    squeezed, layout = flags & 3, flags >> 2 & 15
    if squeezed > 1 or layout not in (1, 2):
        raise ValueError("only zlib and layouts 1 and 2 are handled")
    at = first + 4

    def number(form: str):
        nonlocal at
        value = struct.unpack_from("<" + form, data, at)[0]
        at += struct.calcsize(form)
        return value

    def text(form: str) -> str:
        nonlocal at
        n = number(form)
        out = data[at : at + n].decode("utf-8", "replace")
        at += n
        return out

    for _ in range(n_variants):
        own_samples = number("I") if layout == 1 else n_samples
        name, rsid, chrom, pos = text("H"), text("H"), text("H"), number("I")
        alleles = [text("I") for _ in range(2 if layout == 1 else number("H"))]
        if len(alleles) != 2:
            raise ValueError("only biallelic variants are handled")
        if layout == 1:
            size = number("I") if squeezed else 6 * own_samples
            block = data[at : at + size]
            at += size
            block = zlib.decompress(block) if squeezed else block
            cells = struct.unpack(f"<{3 * own_samples}H", block)
            shares = []
            for i in range(own_samples):
                p = [x / 32768 for x in cells[3 * i : 3 * i + 3]]
                shares.append(tuple(p) if sum(p) > 0 else None)
        else:
            size = number("I")
            block = data[at : at + size]
            at += size
            block = zlib.decompress(block[4:]) if squeezed else block
            n, k, low, high = struct.unpack_from("<IHBB", block)
            phased, bits = block[8 + n], block[9 + n]
            if (k, low, high, phased, bits) != (2, 2, 2, 0, 8):
                raise ValueError("only diploid, unphased, biallelic, 8-bit genotypes are handled")
            shares = []
            for i in range(n):
                a, b = block[10 + n + 2 * i] / 255, block[11 + n + 2 * i] / 255
                shares.append(None if block[8 + i] & 128 else (a, b, max(0.0, 1 - a - b)))
        yield name, rsid, chrom, pos, *alleles, shares


BGEN_SQL = "id string, rsid string, chrom string, pos int, ref string, alt string, gp array<array<float>>"


def bgen_of(contents: DataFrame, from_variant: int = 0, n_variants: int | None = None) -> DataFrame:
    """Variants of BGEN files given as one binary column."""
    end = None if n_variants is None else from_variant + n_variants

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "rsid", "chrom", "pos", "ref", "alt", "gp"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.float32()))]
        arrow = pa.schema(list(zip(names, types)))
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for i, v in enumerate(parse_bgen(content.as_py())):
                    if i < from_variant or (end is not None and i >= end):
                        continue
                    rows.append(dict(zip(names, (*v[:6], [list(s) if s else None for s in v[6]]))))
                    if len(rows) == BATCH_VARIANTS:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return contents.mapInArrow(run, BGEN_SQL)


def read_bgen(spark: SparkSession, path: str, from_variant: int = 0, n_variants: int | None = None) -> DataFrame:
    """chrom, pos, id, rsid, ref, alt, gp (an array of three shares per sample, null if missing)."""
    return bgen_of(spark.read.format("binaryFile").load(path).select("content"), from_variant, n_variants)


def encode_bgen(rows: list[dict], n_samples: int) -> bytes:
    """A BGEN file (layout 2, zlib, 8 bits) of rows as :func:`read_bgen` gives them."""

    def text(form: str, value: str) -> bytes:
        return struct.pack(form, len(value)) + value.encode()

    out = [struct.pack("<IIII4sI", 20, 20, len(rows), n_samples, b"bgen", 1 | 2 << 2)]
    for r in rows:
        body = struct.pack("<IHBB", n_samples, 2, 2, 2) + bytes(2 | (128 if g is None else 0) for g in r["gp"]) + bytes([0, 8])
        body += b"".join(bytes(round(x * 255) for x in g[:2]) if g else bytes(2) for g in r["gp"])
        squeezed = zlib.compress(body)
        out += [text("<H", r["id"]), text("<H", r["rsid"]), text("<H", r["chrom"]), struct.pack("<IH", r["pos"], 2), text("<I", r["ref"]), text("<I", r["alt"])]
        out += [struct.pack("<II", len(squeezed) + 4, len(body)), squeezed]
    return b"".join(out)


def packed_bgen(variants: DataFrame, n_samples: int) -> DataFrame:
    """(content): one file for each partition of variants; the head of a file tells their number, so a partition is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([encode_bgen(rows, n_samples)], pa.binary())], ["content"])

    return variants.mapInArrow(run, "content binary")


def parse_haplotype_blocks(lines: list[str]) -> Iterator[dict]:
    """Blocks of representative haplotypes: position, samples' representatives, and carriers of each site.

    Carriers are written as steps from one carrier to the next.
    """
    at = 0
    lines = [x for x in lines if x and not x.startswith("##")]
    if lines and lines[0].startswith("#CHROM"):
        at = 1
    block = 0
    while at < len(lines):
        head = lines[at].split("\t")
        said = dict(x.split("=", 1) for x in head[7].split(";") if "=" in x)
        n = int(said["VARIANTS"])
        reps = [int(h) for s in head[9:] for h in s.split("|")]
        sites = []
        for line in lines[at + 1 : at + 1 + n]:
            c = line.split("\t")
            steps = [int(x) for x in c[8].split(",") if x] if len(c) > 8 else []
            carriers, last = [], 0
            for s in steps:
                last += s
                carriers.append(last)
            sites.append({"chrom": c[0], "pos": int(c[1]), "ref": c[3], "alt": c[4], "carriers": carriers})
        yield {"block": block, "n_reps": int(said["REPS"]), "reps": reps, "sites": sites}
        block += 1
        at += 1 + n


def subset_block(block: dict, haplotypes: list[int]) -> dict:
    """A block for some haplotypes only; representatives that remain are numbered anew in their order."""
    kept = [block["reps"][h] for h in haplotypes]
    number = {r: i for i, r in enumerate(sorted(set(kept)))}
    sites = [s | {"carriers": [number[c] for c in s["carriers"] if c in number]} for s in block["sites"]]
    return block | {"n_reps": len(number), "reps": [number[r] for r in kept], "sites": sites}


def block_haplotypes(block: dict) -> list[tuple[dict, list[int]]]:
    """Allele of every haplotype at each site of a block."""
    return [(s, [int(r in set(s["carriers"])) for r in block["reps"]]) for s in block["sites"]]


def read_haplotype_blocks(spark: SparkSession, path: str) -> DataFrame:
    schema = "block int, n_reps int, reps array<int>, sites array<struct<chrom: string, pos: int, ref: string, alt: string, carriers: array<int>>>"
    texts = spark.read.text(path, wholetext=True)
    site = pa.struct([("chrom", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string()), ("carriers", pa.list_(pa.int32()))])
    arrow = pa.schema([("block", pa.int32()), ("n_reps", pa.int32()), ("reps", pa.list_(pa.int32())), ("sites", pa.list_(site))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_pylist(list(parse_haplotype_blocks(text.as_py().split("\n"))), arrow)

    return texts.select(F.col("value")).mapInArrow(run, schema)


def haplotype_alleles(blocks: DataFrame, haplotypes: list[int]) -> DataFrame:
    """(chrom, pos, ref, alt, haplotype, allele) of some haplotypes of blocks of representatives."""
    wanted = F.explode(F.array(*[F.lit(h) for h in haplotypes])).alias("haplotype")
    rows = blocks.select("reps", F.explode("sites").alias("s")).select("reps", "s", wanted)
    rep = F.get("reps", F.col("haplotype"))
    allele = F.array_contains(F.col("s.carriers"), rep).cast("int").alias("allele")
    return rows.filter(rep.isNotNull()).select("s.chrom", "s.pos", "s.ref", "s.alt", "haplotype", allele)


def haplotype_block_lines(alleles: DataFrame, per_block: int) -> DataFrame:
    """(chrom, block, line_number, value): blocks of representative haplotypes from (chrom, pos, ref, alt, haplotype, allele).

    Blocks are ``per_block`` successive variants; haplotypes alike in all of them
    share a representative, numbered by first holder.  Carriers are written as
    steps from one carrier to the next.
    """
    order = Window.partitionBy("chrom").orderBy("pos", "ref", "alt")
    sites = alleles.select("chrom", "pos", "ref", "alt").distinct().withColumn("n", F.row_number().over(order) - 1)
    keyed = alleles.join(sites, ["chrom", "pos", "ref", "alt"]).withColumn("block", F.floor(F.col("n") / per_block))
    rows = F.sort_array(F.collect_list(F.struct("n", "allele")))
    held = keyed.groupBy("chrom", "block", "haplotype").agg(F.array_join(F.transform(rows, lambda x: x["allele"].cast("string")), "").alias("word"))
    words = held.groupBy("chrom", "block", "word").agg(F.min("haplotype").alias("first"))
    words = words.withColumn("rep", F.row_number().over(Window.partitionBy("chrom", "block").orderBy("first")) - 1)
    reps = held.join(words.select("chrom", "block", "word", "rep"), ["chrom", "block", "word"])
    said = reps.groupBy("chrom", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("haplotype", "rep"))), lambda x: x["rep"].cast("string")), "|").alias("reps"), (F.max("rep") + 1).alias("n_reps")
    )
    edges = keyed.groupBy("chrom", "block").agg(F.min("pos").alias("pos"), F.count_distinct("n").alias("n_sites"))
    head = said.join(edges, ["chrom", "block"]).select(
        "chrom", "block", F.lit(-1).cast("long").alias("line_number"),
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.lit("."), F.lit("."), F.lit("."), F.lit("."),
                    F.concat(F.lit("VARIANTS="), F.col("n_sites").cast("string"), F.lit(";REPS="), F.col("n_reps").cast("string")), F.lit("GT"), F.col("reps")).alias("value"),
    )
    own = sites.withColumn("block", F.floor(F.col("n") / per_block)).withColumn("place", (F.col("n") % per_block + 1).cast("int"))
    carried = own.join(words, ["chrom", "block"]).filter(F.substring("word", F.col("place"), F.lit(1)) == "1")
    carriers = carried.groupBy("chrom", "block", "n").agg(F.sort_array(F.collect_list("rep")).alias("c"))
    steps = F.transform("c", lambda x, i: (x - F.when(i > 0, F.get("c", i - 1)).otherwise(0)).cast("string"))
    body = own.join(carriers.select("chrom", "block", "n", F.array_join(steps, ",").alias("steps")), ["chrom", "block", "n"], "left")
    name = F.concat_ws(":", "chrom", F.col("pos").cast("string"))
    lines = body.select(
        "chrom", "block", F.col("n").cast("long").alias("line_number"),
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), name, "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.coalesce("steps", F.lit(""))).alias("value"),
    )
    return head.unionByName(lines)


def write_haplotype_blocks(alleles: DataFrame, path: str, per_block: int = 100) -> None:
    """A text file of blocks in order, after its heading."""
    spark = alleles.sparkSession
    lines = haplotype_block_lines(alleles, per_block)
    head = spark.createDataFrame([("", -1, 0, "##fileformat=M3VCF"), ("", -1, 1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT")], "chrom string, block long, line_number long, value string")
    every = head.unionByName(lines.withColumn("block", F.col("block").cast("long")))
    every.coalesce(1).sortWithinPartitions("chrom", "block", "line_number").select("value").write.mode("overwrite").text(path)
