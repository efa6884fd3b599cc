"""Every operator and pipeline stage on awkward tables: empty ones, nulls in any column, long texts, repeated rows, clashing names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import (
    html_blocks,
    license_scan,
    multiprobe_lsh,
    pii_surrogates,
    quality_rules,
    sentencepiece_bpe,
    simhash_pigeonring,
    source_mixing,
    suffix_dedup,
    warc,
)
from strandline.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
#: Names that the operators use inside.
CLASHING = (
    "k t h fp row key id size skey times rank_key lead target taken salt copies k1 k2 a s lo n o u v seg marks rid kind payload digest "
    "keeper class value attempts _row _text _id _times _copy _body _words _n component_id root least"
).split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<double>"


def long_text():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(30)).capitalize() + "."
    return "\n".join(line() for _ in range(7000))


LONG = long_text()  # more than a million characters
PROSE = "The quick brown fox jumps over the lazy dog, and then it sleeps well until the morning."
ROWS = [
    (1, PROSE, "en", "a", len(PROSE)), (1, PROSE, "en", "a", len(PROSE)), (2, None, None, None, None), (3, "", "en", "a", 0), (None, PROSE, None, "b", None),
    (None, None, None, None, None), (4, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)), (6, PROSE + " Indeed so.", None, None, None),
    (7, "x", "en", "a", 1), (8, "\n \t\n", "en", "a", 4), (9, "Mail me at bob@corp.org or 10.1.2.3, password: ......", "en", "b", 53),
]


def clashed(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


def operators(spark):
    return {
        "op1": lambda d: pii_surrogates.redact(d, report=True),
        "op2": html_blocks.extract,
        "op3": simhash_pigeonring.near_duplicates,
        "op3 similar": simhash_pigeonring.similar,
        "op3 keep_one": simhash_pigeonring.keep_one,
        "op4": quality_rules.profile,
        "op4 clean": quality_rules.clean,
        "op5": warc.round_trip,
        "op6": lambda d: sentencepiece_bpe.encode(d, MODEL),
        "op7": suffix_dedup.repeated_bytes,
        "op8": license_scan.scan,
        "op9": multiprobe_lsh.nearest,
        "op10": source_mixing.mix,
        "op10 apply": source_mixing.apply_mix,
    }


NAMES = sorted(operators(None))


def table(spark, name, rows):
    if name == "op2" or name == "op5":
        made = [(i, f"http://x/{i}", t) for i, t, *_ in rows]
        return clashed(spark.createDataFrame(made, PAGES))
    if name == "op9":
        made = [(i, None if t is None else [float(len(t)), 1.0]) for i, t, *_ in rows]
        return clashed(spark.createDataFrame(made, VECTORS))
    return clashed(spark.createDataFrame(rows, DOCUMENTS))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](table(spark, name, [])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, name):
    given = table(spark, name, ROWS)
    got = operators(spark)[name](given)
    rows = got.collect()
    if name in ("op3 keep_one", "op4 clean", "op10 apply"):
        assert got.columns == given.columns
        if name == "op3 keep_one":
            # copies, a text with two words more, and rows without words are one each; the row of least id stays
            assert sorted(r.doc_id for r in rows) == [1, 2, 4, 7, 9]
        elif name == "op4 clean":
            # "x" and the short mail text have too few words; null ids stay
            assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 1, None, 4, 5, 6], key=str)
    elif name == "op9":
        assert {r.query_id for r in rows} <= {None}
    else:
        assert len(rows) == len(ROWS)
        again = operators(spark)[name](given).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    if name == "op1":
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert by[2].text is None and by[3].text == "" and by[4].text == LONG
        assert "bob@corp.org" not in by[9].text and "10.1.2.3" not in by[9].text and by[9].text.endswith("password: ......")
    if name == "op6":
        library = sentencepiece_bpe.encoder(MODEL).library
        for r in rows:
            text = dict((i, t) for i, t, *_ in ROWS if i is not None).get(r.doc_id) or ""
            if r.doc_id is not None:
                assert r.n_tokens == len(library.encode(text))
    if name == "op7":
        by = {r.doc_id: r for r in rows}
        size = len(LONG.encode())
        assert (by[4].n_bytes, by[4].n_removed, by[4].n_spans) == (size, size, 1)
        assert by[7].kept_sha256 == hashlib.sha256(b"x").hexdigest() and by[2].kept_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    for rows in ([], ROWS):
        given = clashed(spark.createDataFrame(rows, DOCUMENTS))
        got = stage(spark, given, "/nowhere")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == given.columns
        assert (got.count() == 0) is (not rows)


def test_long_text_of_one_repeated_word(spark):
    text = "word " * 300_000
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "word", "en", "a", 4)], DOCUMENTS)
    assert quality_rules.profile(docs).filter("doc_id = 1").first().n_repeat_words == 300_000
    assert [r.n_spans for r in suffix_dedup.repeated_bytes(docs).orderBy("doc_id").collect()] == [1, 0]
    assert sentencepiece_bpe.encode(docs, MODEL).filter("doc_id = 1").first().n_tokens > 0
    assert license_scan.scan(docs).filter("doc_id = 1").first().n_words == 300_000
    assert simhash_pigeonring.similar(docs).select("component_id").distinct().count() == 2


def test_surrogates_by_brute_force(spark):
    """The distributed collision rounds against the same rounds over a dictionary; all invariants of the replacements."""
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        parts = [f"{rnd.choice('abc')}@x{rnd.randint(0, 3)}.io", f"10.0.{rnd.randint(0, 3)}.{rnd.randint(0, 3)}", f"{rnd.randint(100, 999)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"]
        parts += [f"Mr. {rnd.choice(['Smith', 'Jones', 'Müller'])}", f"Frau {rnd.choice(['Schmidt', 'Weber'])}", f"token: {rnd.randint(100000, 100040)}"]
        rnd.shuffle(parts)
        rows.append((i, "; ".join(parts), "en", "a", 0))
    keyed = pii_surrogates.Surrogates("k")
    units = {}
    for _, text, *_ in rows:
        for _, _, kind, canonical in pii_surrogates.detect(text):
            if kind != "given":
                units[kind, canonical] = [0, keyed.canonical(kind, canonical)]
    while True:
        losers = set()
        by = {}
        for (kind, canonical), (attempt, new) in units.items():
            by.setdefault((kind, new), []).append((attempt, canonical))
            if (kind, new) in units:
                losers.add((kind, canonical))
        for (kind, _), own in by.items():
            losers |= {(kind, c) for _, c in sorted(own)[1:]}
        if not losers:
            break
        for kind, canonical in losers:
            attempt = units[kind, canonical][0] + 1
            units[kind, canonical] = [attempt, keyed.canonical(kind, canonical, attempt)]
    attempts = {unit: attempt for unit, (attempt, _) in units.items()}
    want = {i: keyed.replace(text, attempts)[0] for i, text, *_ in rows}
    got = {r.doc_id: r.text for r in pii_surrogates.redact(spark.createDataFrame(rows, DOCUMENTS), "k").collect()}
    assert got == want
    new = [(kind, s) for (kind, _), (_, s) in units.items()]
    assert len(set(new)) == len(new) and not set(new) & set(units)


def test_full_formats_grow(spark):
    """More six-letter codes of one shape than draws can keep apart at first: it ends, and all stay distinct."""
    rows = [(i, f"token: a{i:05d}"[:14] + f" pwd: {i % 10}-----", "en", "a", 0) for i in range(60)]
    got = [r.text for r in pii_surrogates.redact(spark.createDataFrame(rows, DOCUMENTS), "k").collect()]
    codes = {t.split("pwd: ")[1] for t in got}
    assert len(codes) == 10 and not codes & {f"{d}-----" for d in range(10)}


def test_many_sources_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "MAX_SLOTS", 1 << 10)
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 8000).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 7 % 23).cast("int")).alias("text")
    )
    mixed = source_mixing.mix(docs).groupBy("target", "source_size", (F.col("doc_id") % 8000).alias("s")).agg(F.sum("taken").alias("taken"))
    rows = mixed.collect()
    assert len(rows) == 8000 and all(abs(r.taken - r.target) <= 1 for r in rows)


def test_archives_by_length(spark, tmp_path):
    rows = [(i, "u", "x" * n) for i, n in enumerate((0, 10, 63, 64, 65, 128, 129, 1000, 5000, 65, 1000))]
    pages = spark.createDataFrame(rows, PAGES)
    path = str(tmp_path / "warc")
    warc.write(pages, path, small_bytes=64, max_records=4)
    got = warc.captures(warc.records(spark, path)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(4, 9), (7, 10)}
    files = list(tmp_path.rglob("*.gz"))
    assert {p.parent.parent.name for p in files} == {f"class={k}" for k in (0, 1, 2, 4, 7)}
    for p in files:
        n = sum(r.kind != "request" and r.kind != "metadata" for r in warc.records(spark, str(p), False).collect())
        assert 0 < n <= max(1, 4 >> int(p.parent.parent.name[6:]))
