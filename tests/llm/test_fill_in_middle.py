"""Operator 13 against a plain version, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, k string, t string, h0 int, form string, output string, restored string"
UNITS = {"lines": r"[^\n]*\n|[^\n]+", "chars": r"(?s)."}


def rows():
    rnd = random.Random(2)
    parts = ["a", "é", "漢", "😀", "\n", "\n", " ", "word ", "<P", "<", ">", "S>", "\r", " ", "\x00"]
    out = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    out += [(900, None), (901, ""), (902, "\n"), (903, "\n\n\n"), (904, "one <S> two\nthree"), (905, "x\n<M>"), (906, "<P>"), (None, "no id\nat all\n"), (None, None)]
    return out + [(907, "line of a long text, repeated\n" * 60_000), (908, "x" * 1_500_000), (5, out[5][1])]


def brute(i, text, units="lines", seed=7, fim_percent=100, spm_percent=50, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    u = re.findall(UNITS[units], text)
    h = hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in markers) or h3 % 100 >= fim_percent:
        return i, len(u), "plain", None, None, text, text
    P, S, M = markers
    spm = h4 % 100 < spm_percent
    return i, len(u), "spm" if spm else "psm", len(p), len(m), S + s + P + p + M + m if spm else P + p + S + s + M + m, text


@pytest.mark.parametrize("settings", [{}, {"units": "chars", "seed": 3}, {"fim_percent": 40, "spm_percent": 0, "markers": ("<é>", "|suf>", "§")}])
def test_against_plain_version(spark, settings):
    given = rows()
    docs = spark.createDataFrame([(i, t, "k", "t", 1, "f", "o", "r") for i, t in given], SCHEMA)
    marks = {"markers": settings["markers"]} if "markers" in settings else {}
    made = fim.restore(fim.transform(docs, **settings), **marks)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted((tuple(r) for r in made.collect()), key=str)
    assert got == sorted((brute(i, t, **settings) for i, t in given), key=str)


def test_words_keep_all_bytes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in rows()], "doc_id long, text string")
    made = fim.restore(fim.transform(docs, units="words")).collect()
    texts = sorted((i if i is not None else -1, t or "") for i, t in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.restored) for r in made) == texts
    one = fim.cut_batch(pa.array(["a b  c\n"]), np.array([[0, 2, 0, 99]]), "words", fim.checked(fim.MARKERS), 100, 50)
    assert one[0].tolist() == [4] and one[4].to_pylist() == ["<P><S>  c\n<M>a b"]


def test_slices_of_arrays_and_large_strings():
    texts = ["skipped\n", "a\nb\nc", "", "é\n😀"]
    for kind in (pa.string(), pa.large_string()):
        n, form, p, m, out = fim.cut_batch(pa.array(texts, kind)[1:], np.array([[1, 2, 0, 99]] * 3), "lines", fim.checked(fim.MARKERS), 100, 50)
        assert n.tolist() == [3, 0, 2] and form.tolist() == [1, 0, 1]
        assert out.to_pylist() == ["<P>a\n<S>c<M>b\n", "", "<P>é\n<S><M>😀"] and p[0] == 2 and m[2] == 1
        assert fim.rebuild_batch(out, form, fim.checked(fim.MARKERS)).to_pylist() == texts[1:]


@pytest.mark.parametrize("markers", [("<P>", "<P>x", "<M>"), ("aba", "c", "d"), ("ab", "bc", "x"), ("", "a", "b"), ("same", "same", "x")])
def test_markers_that_overlap_are_refused(markers):
    with pytest.raises(ValueError):
        fim.checked(markers)


def test_broken_output_is_an_error():
    with pytest.raises(ValueError):
        fim.rebuild_batch(pa.array(["<P>a<S>b"]), np.array([1]), fim.checked(fim.MARKERS))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(docs)).count() == 0
