"""Operator 8: licence scans.

One Aho-Corasick automaton holds the notice phrases and the identifier tag, as
words between spaces, and runs over each text in the same form: A-Z lower-cased,
every run of other ASCII characters one space.  Where it finds the tag, the
expression behind it is read from the raw line and evaluated by a shunting-yard
parser (WITH binds before AND, AND before OR, parentheses group).

Score: 0 without any finding; 1 for a well-formed identifier expression; else
1 - 0.5^n for n phrase places.

Defined cases: null and empty texts have no words; a malformed expression gives
no labels but its phrases count; repeated rows are scanned alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import map_arrow, spread

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of the method (words as they stand between spaces).
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "all rights reserved": "proprietary",
}
#: Identifiers that ask for attribution at most.
PERMISSIVE = frozenset(
    ["0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"]
)
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Lower-cases A-Z, keeps digits and non-ASCII bytes, makes anything else a space.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def to_postfix(expression: str) -> list[str]:
    """Postfix form of a licence expression by the shunting-yard method; raises ValueError."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what must come next
    for token in TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                break  # a remark behind the expression
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError("nothing before a closing parenthesis")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced parentheses")
            stack.pop()
        elif low in PRECEDENCE:
            if operand:
                raise ValueError("an operator without a left side")
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break  # the expression ended; a comment mark or prose follows
            out.append(low)
            operand = False
    if operand:
        raise ValueError("nothing after an operator")
    while stack:
        top = stack.pop()
        if top == "(":
            raise ValueError("unbalanced parentheses")
        out.append(top)
    return out


def evaluate(expression: str, allowed: frozenset[str] | set[str]) -> tuple[set[str], str, bool]:
    """Licences named (with their exceptions), the postfix form, and whether ``allowed`` suffices.

    OR needs one side, AND both; WITH ties an exception to a licence, which is
    allowed if the licence is.  Linear in the expression.
    """
    postfix = to_postfix(expression)
    names: set[str] = set()
    stack: list[tuple[bool, str | None]] = []  # the value, and the name while it is a single licence
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((token.rstrip("+") in allowed, token))
            names.add(token)
            continue
        if len(stack) < 2:
            raise ValueError("an operator without two sides")
        (right, exception), (left, licence) = stack.pop(), stack.pop()
        if token == "with":
            if licence is None or exception is None:
                raise ValueError("WITH takes one licence and one exception")
            names -= {licence, exception}
            names.add(f"{licence} with {exception}")
            stack.append((left, None))
        else:
            stack.append((left or right if token == "or" else left and right, None))
    if len(stack) != 1:
        raise ValueError("no expression")
    return names, " ".join(postfix), stack[0][0]


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, label in (NOTICE_PHRASES | BASE_PHRASES).items():
            self.automaton.add_word(f" {phrase} ", (label, phrase in BASE_PHRASES, len(phrase) + 2))
        self.automaton.add_word(f" {TAG} ", (None, False, len(TAG) + 2))
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        raw = text.encode("utf-8")
        words = raw.translate(TABLE).split()
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        places = 0
        tagged = False
        plain = f" {b' '.join(words).decode('utf-8')} "
        for end, (label, is_base, length) in self.automaton.iter(plain):
            if label is None:
                tagged = True
                continue
            labels.add(label)
            places += 1
            if is_base:
                base.add(label)
                starts.append(end + 1 - length)
        permitted: list[bool] = []
        expressions = []
        for found in TAG_LINE.findall(text) if tagged else ():
            try:
                names, postfix, fine = evaluate(found, PERMISSIVE)
            except ValueError:
                continue
            labels |= names
            expressions.append(postfix)
            permitted.append(fine)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": plain.count(" ", 0, min(starts)) if starts else None,
            "last_word": plain.count(" ", 0, max(starts)) if starts else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": 1.0 if expressions else 1.0 - 0.5**places,
            "expressions": expressions,
            "permissive": all(permitted) if permitted else None,
        }


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, permissive boolean"
)
ARROW = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()),
    ]
)


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id column and the findings.  Row-local: one scan, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = spread(docs.select(F.col(id_col).alias("k"), F.col(text).cast("string").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(value.as_py() or "") for value in batch.column(1)]
            found = pa.RecordBatch.from_pylist(rows, ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["k", *ARROW.names])

    return map_arrow(source, run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", id_col)
