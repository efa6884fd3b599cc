"""The site filter language, compiled to a Column.

Operands: numbers, strings in quotes, site columns (CHROM, POS, ID, REF, ALT, QUAL, FILTER, TYPE), computed ones
(N_ALT, N_SAMPLES, N_MISSING, F_MISSING, AC, AN, AF, MAC, MAF, %ILEN), INFO fields and per-sample FORMAT fields.
Comparisons: = == != < <= > >= and ~ !~ (regular expression); arithmetic + - * /; functions MAX MIN AVG MEAN MEDIAN
STDEV SUM COUNT ABS STRLEN, their per-sample forms SMPL_* and s*, N_PASS, F_PASS, BINOM, PHRED, and those that a caller
gives.  Vectors are indexed by one place, a range or a list: AD[0], AF[1-], AF[0,2].  @name stands for the lines of a
file, compared as a list of strings.  TYPE has a value for each allele and compares as other vectors do.

``&`` and ``|`` combine per-sample conditions within a sample, ``&&`` and ``||`` across samples.  A vector compares
existentially.  On missing values ``=`` holds only if both sides are missing, ``!=`` only if one is, others never.

The rows filtered hold ``chrom, pos, id, ref, alts, qual, filters, info`` (a map) and ``samples``: an array of maps of
FORMAT fields.  Values stay in their rows: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""\s*(?:(?P<file>@[^\s()&|]+)|(?P<index>\[[\d,*-]+\])|(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>"[^"]*"|'[^']*')|(?P<op>&&|\|\||!~|!=|<=|>=|==|[-&|<>=~+*/(),\[\]])"""
    r"""|(?P<name>%?[A-Za-z_][\w.]*(?:/[A-Za-z_][\w.]*)?))"""
)
SITE = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "TYPE", "%ILEN", "N_ALT", "N_SAMPLES", "N_MISSING", "F_MISSING", "AC", "AN", "AF", "MAC", "MAF")
GENOTYPE_CLASSES = ("hom", "het", "hap", "mis", "ref", "alt", "rr", "ra", "ar", "aa", "aA", "Aa", "a", "r")


#: Stands for a list that has nothing in common with a row; a line holds no such character.
NO_LINE = "\n"


@dataclass
class Value:
    """An operand: a function of a sample (or of None for site values) to an array of doubles or strings."""

    get: Callable[[Column | None], Column]
    per_sample: bool
    text: bool
    literal: str | None = None


@dataclass
class Condition:
    """A condition: a function of a sample to a boolean column."""

    get: Callable[[Column | None], Column]
    per_sample: bool

    def site(self) -> Column:
        if self.per_sample:
            return F.exists("samples", lambda s: F.coalesce(self.get(s), F.lit(False)))
        return F.coalesce(self.get(None), F.lit(False))


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the filter at {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    """Recursive descent: or, and, comparison, sum, product, atom."""

    def __init__(self, text: str, info: set[str], formats: set[str], strings: set[str], functions: dict, lines: Callable[[str], list[str]]):
        self.tokens, self.at = tokenize(text), 0
        self.info, self.formats, self.strings = info, formats, strings
        self.functions, self.lines = functions, lines

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"{op} expected")

    def parse(self) -> Condition:
        out = self.either()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        if isinstance(out, Value):
            raise ValueError("the filter is no condition")
        return out

    def either(self):
        left = self.both()
        while op := self.take("||", "|"):
            left = _joined(left, self.both(), op, lambda a, b: a | b)
        return left

    def both(self):
        left = self.compare()
        while op := self.take("&&", "&"):
            left = _joined(left, self.compare(), op, lambda a, b: a & b)
        return left

    def compare(self):
        left = self.sum()
        op = self.take("=", "==", "!=", "<", "<=", ">", ">=", "~", "!~")
        return left if op is None else _compared(left, self.sum(), "=" if op == "==" else op)

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = _arithmetic(left, self.product(), op)
        return left

    def product(self):
        left = self.atom()
        while op := self.take("*", "/"):
            left = _arithmetic(left, self.atom(), op)
        return left

    def atom(self):
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.take("-"):
            return _arithmetic(_number(0.0), self.atom(), "-")
        if self.at >= len(self.tokens):
            raise ValueError("the filter ends too early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return _number(float(word))
        if kind == "str":
            return Value(lambda s: F.array(F.lit(word[1:-1])), False, True, word[1:-1])
        if kind == "name":
            if self.peek() == "(":
                return self.call(word)
            value = self.field(word)
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "index":
                wanted = _places(self.tokens[self.at][1][1:-1])
                self.at += 1
                return Value(lambda s: F.filter(F.filter(value.get(s), lambda x, i: wanted(i)), lambda x: x.isNotNull()), value.per_sample, value.text)
            return value
        if kind == "file":
            listed = self.lines(word[1:])
            if isinstance(listed, Column):
                return Value(lambda s: listed, False, True)
            return Value(lambda s: F.array(*[F.lit(x) for x in listed]).cast("array<string>"), False, True)
        raise ValueError(f"unexpected {word!r}")

    def call(self, word: str):
        self.need("(")
        name = word.upper()
        first = self.either()
        second = self.either() if self.take(",") else None
        self.need(")")
        if name in ("N_PASS", "F_PASS"):
            passed = F.size(F.filter("samples", lambda s: F.coalesce(first.get(s), F.lit(False)))).cast("double")
            value = passed if name == "N_PASS" else passed / F.nullif(F.size("samples"), F.lit(0))
            return Value(lambda s: F.array(value), False, False)
        if name == "BINOM":
            counts = first if second is None else Value(lambda s: F.concat(first.get(s), second.get(s)), first.per_sample or second.per_sample, False)
            return Value(lambda s: _binomial(counts.get(s)), counts.per_sample, False)
        if word in self.functions:
            own = self.functions[word]
            return Value(lambda s: F.transform(first.get(s), lambda x: own(x)), first.per_sample, False)
        per = re.fullmatch(r"(?:SMPL_|s(?=[A-Z]))(\w+)", word)
        base = (per[1] if per else word).upper()
        if base == "STRLEN":
            return Value(lambda s: F.transform(first.get(s), lambda x: F.length(x).cast("double")), first.per_sample, False)
        if base in ("ABS", "PHRED"):
            f = F.abs if base == "ABS" else lambda x: -10 * F.log10(x)
            return Value(lambda s: F.transform(first.get(s), lambda x: f(x)), first.per_sample, False)
        if base not in STATISTICS:
            raise ValueError(f"no function {word}")
        if per or not first.per_sample:
            return Value(lambda s: _list(STATISTICS[base](first.get(s))), first.per_sample, False)
        every = F.flatten(F.transform("samples", lambda s: first.get(s)))
        return Value(lambda s: _list(STATISTICS[base](every)), False, False)

    def field(self, word: str) -> Value:
        where, _, name = word.rpartition("/")
        if not where and name in SITE:
            return _site_value(name)
        if where in ("FORMAT", "FMT") or (not where and name in self.formats and name not in self.info) or (not where and name == "GT"):
            if name == "GT":
                return Value(lambda s: F.array(s["GT"]), True, True)
            if name in self.strings:
                return Value(lambda s: _strings(s[name]), True, True)
            return Value(lambda s: _numbers(s[name]), True, False)
        if where in ("INFO", "") and (name in self.info or where == "INFO"):
            if name in self.strings:
                return Value(lambda s: _strings(F.col("info")[name]), False, True)
            return Value(lambda s: _numbers(F.col("info")[name]), False, False)
        raise ValueError(f"no field {word}")


def _number(x: float) -> Value:
    return Value(lambda s: F.array(F.lit(x)), False, False)


def _list(x: Column) -> Column:
    return F.filter(F.array(x), lambda v: v.isNotNull())


def _numbers(text: Column) -> Column:
    """Numbers of a comma list; missing ones left out; null for none."""
    parts = F.transform(F.split(text, ","), lambda x: F.expr("1") * F.when(x.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$") & (x != "."), x).cast("double"))
    return F.filter(F.coalesce(parts, F.array().cast("array<double>")), lambda x: x.isNotNull())


def _strings(text: Column) -> Column:
    """Parts of a comma list; missing ones left out; none for null."""
    return F.filter(F.coalesce(F.split(text, ","), F.array().cast("array<string>")), lambda x: (x != ".") & (x != ""))


def _places(text: str) -> Callable[[Column], Column]:
    """Which places of a vector an index names: 3, 1-2, 1- or 0,2."""
    spans = []
    for part in text.split(","):
        low, dash, high = part.partition("-")
        if part == "*":
            spans.append((0, None))
        elif not low.isdigit() or (high and not high.isdigit()):
            raise ValueError(f"cannot read the index {text!r}")
        else:
            spans.append((int(low), int(high) if high else None if dash else int(low)))

    def wanted(i: Column) -> Column:
        out = F.lit(False)
        for low, high in spans:
            out = out | ((i >= low) & (i <= high) if high is not None else i >= low)
        return out

    return wanted


def _alleles(s: Column) -> Column:
    return F.split(F.coalesce(s["GT"], F.lit(".")), "[/|]")


def _counts() -> dict[str, Column]:
    every = F.flatten(F.transform("samples", lambda s: F.filter(_alleles(s), lambda a: a != ".")))
    an = F.size(every).cast("double")
    ac = F.size(F.filter(every, lambda a: a != "0")).cast("double")
    missing = F.size(F.filter("samples", lambda s: F.exists(_alleles(s), lambda a: a == "."))).cast("double")
    n = F.size("samples").cast("double")
    mac = F.least(ac, an - ac)
    return {
        "AN": an, "AC": ac, "AF": ac / F.nullif(an, F.lit(0.0)), "MAC": mac, "MAF": mac / F.nullif(an, F.lit(0.0)), "N_SAMPLES": n,
        "N_MISSING": missing, "F_MISSING": missing / F.nullif(n, F.lit(0.0)), "N_ALT": F.size("alts").cast("double"),
    }


def _site_value(name: str) -> Value:
    if name in ("CHROM", "ID", "REF"):
        return Value(lambda s: _list(F.col(name.lower())), False, True)
    if name == "ALT":
        return Value(lambda s: F.col("alts"), False, True)
    if name == "FILTER":
        return Value(lambda s: F.col("filters"), False, True)
    if name == "TYPE":
        kind = lambda a: F.when(a == "*", "overlap").when(a.rlike(r"[\[\]]"), "bnd").when(a.rlike("^<"), "other").when(F.length(a) != F.length("ref"), "indel").when(F.length(a) == 1, "snp").otherwise("mnp")
        return Value(lambda s: F.when(F.size("alts") == 0, F.array(F.lit("ref"))).otherwise(F.transform("alts", kind)), False, True)
    if name in ("POS", "QUAL"):
        return Value(lambda s: _list(F.col(name.lower()).cast("double")), False, False)
    if name == "%ILEN":
        return Value(lambda s: F.transform("alts", lambda a: (F.length(a) - F.length("ref")).cast("double")), False, False)
    return Value(lambda s: _list(_counts()[name]), False, False)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _mean(v: Column) -> Column:
    return _sum(v) / F.nullif(F.size(v), F.lit(0))


def _median(v: Column) -> Column:
    s, n = F.sort_array(v), F.size(v)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _deviation(v: Column) -> Column:
    mean = _mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(F.size(v), F.lit(0)))


STATISTICS = {
    "MAX": F.array_max, "MIN": F.array_min, "SUM": _sum, "AVG": _mean, "MEAN": _mean, "MEDIAN": _median, "STDEV": _deviation,
    "COUNT": lambda v: F.size(v).cast("double"),
}


def _binomial(counts: Column) -> Column:
    """Two-sided exact probability at one half of the first two counts."""
    a, b = F.get(counts, F.lit(0)), F.get(counts, F.lit(1))
    n, low = a + b, F.least(a, b).cast("int")
    # terms C(n, k) / 2^n from k = 0 up to the lesser count, one from another
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("p"))
    walked = F.aggregate(
        F.sequence(F.lit(0), low), start,
        lambda s, k: F.struct((s["t"] + F.log((n - k) / (k + 1.0))).alias("t"), (s["p"] + F.exp(s["t"])).alias("p")),
    )
    return _list(F.when(n == 0, F.lit(-1.0)).when(a == b, F.lit(1.0)).otherwise(F.least(2 * walked["p"], F.lit(1.0))))


def _arithmetic(left: Value, right: Value, op: str) -> Value:
    if left.text or right.text:
        raise ValueError("strings have no arithmetic")

    def apply(x: Column, y: Column) -> Column:
        return {"+": x + y, "-": x - y, "*": x * y, "/": x / F.nullif(y, F.lit(0.0))}[op]

    def get(s):
        a, b = left.get(s), right.get(s)
        one_a, one_b = F.size(a) == 1, F.size(b) == 1
        return F.when(one_b, F.transform(a, lambda x: apply(x, F.get(b, F.lit(0))))).when(
            one_a, F.transform(b, lambda y: apply(F.get(a, F.lit(0)), y))
        ).otherwise(F.zip_with(a, b, lambda x, y: apply(x, y)))

    return Value(get, left.per_sample or right.per_sample, False)


def _genotype_class(gt: Column, word: str) -> Column:
    """Whether a genotype string is of a class: hom, het, hap, mis, ref, alt, or two letters of r (reference) and a."""
    part = F.split(gt, "[/|]")
    a, b, two = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.size(part) == 2
    missing = F.exists(part, lambda x: x == ".")
    low = word.lower() if word not in ("aA", "Aa") else "aA"
    whole = ~missing
    table = {
        "mis": missing, "hap": whole & ~two, "hom": whole & two & (a == b), "het": whole & two & (a != b),
        "ref": whole & F.forall(part, lambda x: x == "0"), "alt": whole & F.exists(part, lambda x: x != "0"), "rr": whole & two & (a == "0") & (b == "0"),
        "ra": whole & two & ((a == "0") != (b == "0")), "ar": whole & two & ((a == "0") != (b == "0")),
        "aa": whole & two & (a == b) & (a != "0"), "aA": whole & two & (a != b) & (a != "0") & (b != "0"),
        "a": whole & ~two & (a != "0"), "r": whole & ~two & (a == "0"),
    }
    return table[low]


def _compared(left: Value, right: Value, op: str) -> Condition:
    per = left.per_sample or right.per_sample
    if op in ("~", "!~"):
        def match(s):
            pattern = F.get(right.get(s), F.lit(0))
            hit = F.exists(left.get(s), lambda x: F.regexp_like(x, pattern))
            return hit if op == "~" else ~hit

        return Condition(match, per)
    if left.text != right.text:
        raise ValueError("a string and a number do not compare")
    if left.text and op not in ("=", "!="):
        raise ValueError("strings compare by = and !=")

    def get(s):
        a, b = left.get(s), right.get(s)
        if left.text:
            word = right.literal
            if left.per_sample and word in GENOTYPE_CLASSES:
                hit = _genotype_class(F.get(a, F.lit(0)), word)
                return hit if op == "=" else ~hit
            if word == ".":
                none = F.coalesce(F.size(a) == 0, F.lit(True)) | F.forall(a, lambda x: x == ".")
                return none if op == "=" else ~none
            b = F.flatten(F.transform(b, lambda x: F.split(x, ",")))
        none_a, none_b = F.size(a) == 0, F.size(b) == 0
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        pair = F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))
        if op == "=":
            return (none_a & none_b) | (~none_a & ~none_b & pair)
        if op == "!=":
            if left.text:
                pair = ~F.arrays_overlap(a, b)
            return (none_a != none_b) | (~none_a & ~none_b & pair)
        return ~none_a & ~none_b & pair

    return Condition(get, per)


def _joined(left: Condition, right: Condition, op: str, f) -> Condition:
    if isinstance(left, Value) or isinstance(right, Value):
        raise ValueError(f"{op} joins conditions")
    if op in ("&", "|") and left.per_sample and right.per_sample:
        return Condition(lambda s: f(F.coalesce(left.get(s), F.lit(False)), F.coalesce(right.get(s), F.lit(False))), True)
    return Condition(lambda s: f(left.site(), right.site()), False)


def lines_of(path: str) -> list[str]:
    """Lines of a list that a filter names; it becomes part of the plan, so it is a short one."""
    from pyspark.sql import SparkSession

    return [r.value for r in SparkSession.getActiveSession().read.text(path).collect() if r.value]


def compile_filter(
    text: str, info: set[str] | None = None, formats: set[str] | None = None, strings: set[str] | None = None,
    functions: dict[str, Callable[[Column], Column]] | None = None, lines: Callable[[str], list[str]] = lines_of,
) -> Column:
    """The Column of a filter.

    ``info`` and ``formats`` name the fields that may stand without a prefix,
    ``strings`` those that hold text; ``functions`` are a caller's own, of one
    value; ``lines`` gives the list behind @name.
    """
    return Parser(text, info or set(), formats or set(), strings or set(), functions or {}, lines).parse().site()


def apply_filters(
    rows, include: str | None = None, exclude: str | None = None, info: set[str] | None = None, formats: set[str] | None = None,
    lists: dict[str, tuple[str, DataFrame]] | None = None, **more,
):
    """Rows that an include filter keeps, or an exclude filter does not drop; not both at once.

    ``lists`` are long lists behind @names: the column that they are compared with, and a
    table of one column.  They meet the rows in a join; a row's list is what it has in common.
    """
    if include and exclude:
        raise ValueError("include and exclude exclude each other")
    columns, met = rows.columns, {}
    for name, (column, table) in (lists or {}).items():
        mark = f"_list_{name}"
        rows = rows.join(table.select(F.col(table.columns[0]).alias(mark)).dropna().distinct(), F.col(column) == F.col(mark), "left")
        met[name] = F.array(F.coalesce(mark, F.lit(NO_LINE)))
    if met:
        other = more.get("lines", lines_of)
        more["lines"] = lambda name: met[name] if name in met else other(name)
    if include:
        rows = rows.filter(compile_filter(include, info, formats, **more))
    elif exclude:
        rows = rows.filter(~compile_filter(exclude, info, formats, **more))
    return rows.select(*columns) if met else rows
