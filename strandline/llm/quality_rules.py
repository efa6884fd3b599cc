"""Operator 4: quality rules with line-first cleaning, DataFrame functions only.

Every line of a text is judged on its own (punctuation, navigation, boilerplate,
symbol noise, shouting); lines that fail are removed; a document that loses too
large a share of its word characters, or that fails the base limits on length
and repetition, is rejected.  Everything is a row-local expression: one scan,
no shuffle, no Python.

Defined cases: a null or empty text has no words and fails the base rule; a
line without words is neither kept nor counted; repeated rows are judged alike;
an empty table gives an empty result; columns other than the text and the id
are passed through by :func:`clean` and ignored by :func:`profile`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import SPACE_CLASS, WORD_CLASS, spread, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document is rejected if under this percentage of its word characters is left.
MIN_LEFT_PERCENT = 50

#: Fixed values of the line rules.
SYMBOLS = r"[#*$%&|<>]"
#: Marks of running prose.
PUNCTUATION = r"[.,;:!?…。！？]"
#: Lines of this many words or more must hold such a mark; shorter ones may be headings.
PUNCTUATION_FROM = 40
#: Navigation: tokens that are only separators between link texts.
SEPARATORS = ("|", ">", "»", "•")
SEPARATOR_TOKEN = r"(?:^|[\x20\x09-\x0D])[|>»•](?=[\x20\x09-\x0D]|$)"
#: Words that end in a run of exclamation marks.
SHOUT_TOKEN = r"!!+(?=[\x20\x09-\x0D]|$)"
#: Phrases of notices and controls, in lower case, in the four languages of the corpus.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of use",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "accepter les cookies",
    "conditions d'utilisation",
    "politique de confidentialité",
    "tous droits réservés",
    "aceptar todas las cookies",
    "política de privacidad",
    "términos de uso",
    "todos los derechos reservados",
)
#: Percent of a line's words that may be separators or shouts; symbols per 100 words.
MAX_SEPARATOR_PERCENT = 20
MAX_SHOUT_PERCENT = 30
MAX_SYMBOL_PERCENT = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def profile(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: counts, line-rule figures and both verdicts."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = spread(docs).select(F.col(id_col), body.alias("_body"))
    out = out.withColumn("_words", words_of(F.col("_body")))
    out = out.withColumn("_n", F.size("_words"))
    # Words in repeated windows: windows are compared by a 64-bit hash chained over
    # the hashes of their words.  Texts without a repeated window (nearly all) stop
    # after a hash-set pass; others sort (hash, place) once, n log n work.
    out = out.withColumn(
        "_hw", F.when(F.col("_n") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w)))
    )
    out = out.withColumn(
        "_win",
        F.when(
            F.col("_n") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.col("_n") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("_hw"), i + k) for k in range(WINDOW)]),
            ),
        ),
    )
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"),
            F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("_sorted")
    out = out.withColumn(
        "_places",
        F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False))
                    | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False)),
                ),
                lambda k: F.get(s, k)["i"],
            )
        ),
    )
    p = F.col("_places")
    repeats = F.aggregate(
        F.sequence(F.lit(0), F.size(p) - 1),
        F.lit(0).cast("long"),
        lambda a, k: a + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))),
    )
    out = out.withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike(WORD_CLASS)))
    out = out.withColumn("_symbols", _count(F.col("_body"), SYMBOLS))
    out = out.withColumn("_boiler", _has_boilerplate(F.col("_body")))
    out = out.withColumn(
        "_bad", F.filter("_lines", lambda x: ~line_ok(x, F.col("_symbols") > 0, F.col("_boiler")))
    )
    word_chars = F.length(F.array_join("_words", "")).cast("long")
    lost = F.aggregate("_bad", F.lit(0).cast("long"), lambda a, x: a + _word_chars(x))
    figures = F.struct(
        F.col(id_col),
        F.col("_n").cast("long").alias("n_words"),
        word_chars.alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(s.isNull(), F.lit(0).cast("long")).otherwise(repeats).alias("n_repeat_words"),
        (word_chars - lost).alias("left_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_bad")).cast("long").alias("n_lines_kept"),
    )
    # A generator of one row: filters on the figures stay above it, where each is computed once,
    # instead of being copied below with all that they are made of.
    out = out.select(F.inline(F.array(figures)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", base)
    return out.withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("left_chars") >= MIN_LEFT_PERCENT * F.col("word_chars"))
    )


def _has_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE_CLASS}+", ""))


def line_ok(line: Column, symbols: Column, boilerplate: Column) -> Column:
    """True where a line passes all rules; lines without a word never reach this.

    ``symbols`` and ``boilerplate`` say whether the whole text has any, so that
    the costlier rules are not tried on texts that cannot break them.  Cheap
    byte searches stand before each pattern for the same reason.
    """
    words = _count(line, f"{WORD_CLASS}+")
    separator = F.lit(False)
    for mark in SEPARATORS:
        separator = separator | F.contains(line, F.lit(mark))
    return ~(
        (symbols & (100 * _count(line, SYMBOLS) > MAX_SYMBOL_PERCENT * words))
        | (F.contains(line, F.lit("!!")) & (100 * _count(line, SHOUT_TOKEN) > MAX_SHOUT_PERCENT * words))
        | (separator & (100 * _count(line, SEPARATOR_TOKEN) > MAX_SEPARATOR_PERCENT * words))
        | (boilerplate & _has_boilerplate(line))
        | (~line.rlike(PUNCTUATION) & (words >= PUNCTUATION_FROM))
    )


def clean(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows whose document is kept, with failing lines taken out of the text.

    Lines without words survive (they separate paragraphs).  The columns are
    those of ``docs``; ``n_chars`` follows the text where there is such a column.
    """
    names = docs.columns
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    prof = profile(judged.select("_row", F.col("_row").getField(text).alias(text)), text, "_row")
    kept = prof.filter("kept").select("_row", (F.col("n_lines") > F.col("n_lines_kept")).alias("cut"))
    body = F.col("_row").getField(text)
    has_symbols, boiler = F.regexp_like(body, F.lit(SYMBOLS)), _has_boilerplate(body)
    good = F.array_join(
        F.filter(F.split(body, "\n"), lambda x: ~x.rlike(WORD_CLASS) | line_ok(x, has_symbols, boiler)), "\n"
    )
    kept = kept.withColumn("_text", F.when(F.col("cut"), good).otherwise(body))
    cols = []
    for c in names:
        if c == text:
            cols.append(F.col("_text").alias(c))
        elif c == "n_chars":
            cols.append(F.length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("_row").getField(c).alias(c))
    return kept.select(*cols)
