"""Operator 5: WARC archives, written and read back as transactions.

Writing.  Each page gives one capture: a request record, a response (or, where
an equal payload is already kept, a revisit) and a metadata record.  Of equal
payloads of at least ``min_bytes`` bytes, the row with the largest page id is
the response.  Records are plain text lines and a UTF-8 payload, so Spark's own
text writer makes the archives (``\\r\\n\\r\\n`` between records, gzip), and any
file system that Spark writes to will do.

Archives are bounded in bytes: payloads up to ``SMALL_BYTES`` go to files of
``MAX_RECORDS`` rows at most; longer ones have classes of doubling length, with half
as many rows a file in each class.  Class and file are columns of one write, so
the table is scanned once, whatever its longest payload.

Reading.  Each archive is one binary row, unpacked as a stream and parsed by
``Content-Length``, a record at a time.  Transactions are assembled
by joining requests and metadata to their response or revisit through
``WARC-Concurrent-To``; a revisit takes length and digest of the full payload
from the response that it refers to.  One nested row comes out per capture.

Defined cases: a null payload is empty; control characters of a URL are
percent-encoded, a null URL is the empty string; rows that repeat page id and
payload are captures of their own, responses where their page id is the largest;
rows without a page id are written and read back with a null one, and are
responses only if no row with an id has their payload; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._shared import BATCH_BYTES, cut, map_arrow, new_path

CRLF = "\r\n"
#: All records bear one date, so that reruns give the same archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows (captures) of an archive of small payloads, and the longest of these: 200 MB a file at most, before packing.
MAX_RECORDS = 3000
SMALL_BYTES = 1 << 16
#: RFC 4648 digits; a digest of 160 bits is 32 of them.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string or binary column, JVM-side."""
    bits = F.sha1(payload)  # 40 hex digits: eight groups of five, four base32 digits each
    digits = []
    for group in range(8):
        value = F.conv(F.substring(bits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


def _urn(kind: str, seed: Column) -> Column:
    """A name-based URN in the form of a UUID."""
    h = F.md5(F.concat(F.lit(kind + ":"), seed))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record as a string; a null field value leaves its line out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    length = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), length, F.lit(CRLF + CRLF), block)


def write(
    pages: DataFrame, path: str, html: str = "html", url: str = "url", page_id: str = "page_id",
    min_bytes: int = 0, max_records: int = MAX_RECORDS, small_bytes: int = SMALL_BYTES,
) -> None:
    """Write the archives of all pages into folders of ``path``.

    Decisions need only ids, digests and lengths: they are summed by digest
    (map-side first), so a payload that a third of all rows share is no hot key.
    Payloads meet the decision about their digest only where it occurs twice.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    target = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), target.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    kept = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")
    )
    rows = rows.join(cut(kept.filter("n > 1").select("digest", "keeper"), "keepers"), "digest", "left")
    revisit = F.coalesce(F.col("id") != F.col("keeper"), F.col("keeper").isNotNull() & F.col("id").isNull())
    own = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("none")), "digest")
    referred = F.concat_ws("/", F.col("keeper").cast("string"), "digest")
    rows = rows.withColumn("revisit", revisit).withColumn("rid", _urn("response", own))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF), F.when(F.col("revisit"), "").otherwise(F.col("payload")),
    )
    uri = F.col("url")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    main = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("rid")),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
            ("WARC-Refers-To", F.when(F.col("revisit"), _urn("response", referred))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _urn("request", own)),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", F.col("rid")),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}User-Agent: strandline{CRLF + CRLF}")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _urn("metadata", own)),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", F.col("rid")),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    steps = F.expr(f"(bytes - 1) div {small_bytes}")
    kind = F.when(steps <= 0, 0).otherwise(F.length(F.bin(steps)))
    # of so many consecutive rows of a task no more belong to one class
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.select(F.concat_ws(CRLF + CRLF, request, main, metadata).alias("value"), kind.alias("class"), nth.alias("nth"))
    most = F.greatest(F.lit(1).cast("long"), F.expr(f"shiftright({max_records}L, class)"))
    out = out.select("value", "class", F.floor(F.col("nth") / most).alias("stretch"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").partitionBy("class", "stretch").text(path)


RECORD = pa.schema(
    [
        ("kind", pa.string()), ("rid", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
        ("uri", pa.string()), ("date", pa.string()), ("said_digest", pa.string()), ("digest", pa.string()),
        ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("block", pa.binary()),
    ]
)
RECORD_SQL = (
    "kind string, rid string, concurrent_to string, refers_to string, uri string, date string, "
    "said_digest string, digest string, payload_bytes long, page_id long, block binary"
)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, unpacked as a stream."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, 1 << 18)
    count = 0
    while True:
        line = stream.readline()
        while line == CRLF.encode():
            line = stream.readline()
        if not line:
            return
        count += 1
        if not line.startswith(b"WARC/"):
            raise ValueError(f"item {count} is no WARC record")
        fields = {}
        while (line := stream.readline()) != CRLF.encode():
            if not line:
                raise ValueError(f"the head of record {count} is cut short")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {count} is cut short")
        yield fields, block


def records(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """All records of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(content.as_py()):
                    kind = fields.get("warc-type")
                    payload = block
                    if fields.get("content-type", "").startswith("application/http"):
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                    page = None
                    if kind == "metadata":
                        for line in block.decode("utf-8", "replace").split("\r\n"):
                            name, _, value = line.partition(":")
                            if name == "page-id" and value.strip():
                                page = int(value)
                    rows.append(
                        {
                            "kind": kind,
                            "rid": fields.get("warc-record-id"),
                            "concurrent_to": fields.get("warc-concurrent-to"),
                            "refers_to": fields.get("warc-refers-to"),
                            "uri": fields.get("warc-target-uri"),
                            "date": fields.get("warc-date"),
                            "said_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None,
                            "payload_bytes": len(payload) if kind == "response" else None,
                            "page_id": page,
                            "block": block if with_block else None,
                        }
                    )
                    held += len(block) if with_block else 0
                    if len(rows) == 1000 or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    return map_arrow(files, run, RECORD_SQL)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture from the table of :func:`records`.

    The response or revisit leads; requests and metadata join it through their
    concurrent-to identifier.  A rerun of one id (repeated rows) keeps one
    capture per metadata record.
    """
    side = F.col("kind").isin("request", "metadata")
    tied = found.filter(side).groupBy(
        F.col("concurrent_to").alias("rid")
    ).agg(
        F.max(F.when(F.col("kind") == "request", F.struct("rid", "uri", "date", "block"))).alias("request"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("rid", "page_id", "block"))).alias("metadata"),
    )
    main = found.filter(F.col("kind").isin("response", "revisit")).alias("m")
    # cut here, so that the join on the kept record, whose key may be hot, stands alone and can be split
    whole = cut(main.join(tied, "rid", "left"), "captures")
    kept = found.filter(F.col("kind") == "response").groupBy(F.col("rid").alias("refers_to")).agg(
        F.max("digest").alias("kept_digest"), F.max("payload_bytes").alias("kept_bytes")
    )
    kept = kept.join(tied.select(F.col("rid").alias("refers_to"), F.col("metadata.page_id").alias("kept_page")), "refers_to", "left")
    # only revisits refer to another record
    revisits = whole.filter("kind = 'revisit'").join(cut(kept, "kept"), "refers_to", "left")
    whole = whole.filter("kind = 'response'").unionByName(revisits, allowMissingColumns=True)
    return whole.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("kind").alias("record_type"),
        F.coalesce("payload_bytes", "kept_bytes").alias("payload_bytes"),
        F.coalesce("digest", "kept_digest").alias("payload_digest"),
        F.when(F.col("kind") == "revisit", F.col("kept_page")).alias("refers_to"),
        (F.coalesce("digest", "kept_digest") == F.col("said_digest")).alias("digest_holds"),
        F.struct("rid", "uri", "date", "block").alias("response"),
        "request",
        "metadata",
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and give the captures without their blocks."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path)
    return captures(cut(records(spark, path, with_block=False), "records"))
