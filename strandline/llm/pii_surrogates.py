"""Operator 1: personal data and secrets replaced by keyed surrogates.

Detection finds e-mail addresses, phone, card, account and social-security
numbers, IPv4 and IPv6 addresses, credentials (by a label or by the prefix of
their issuer), and names (a known given name, a form of address or an introduction
such as "my name is" before capitalised words).  An account number counts if its
check digits hold or the word IBAN stands before it; phone numbers keep the
country code, which the first digits tell.  Each entity has a canonical form; its
surrogate is drawn from an HMAC of key, type, canonical form and attempt, so the
same entity gets the same surrogate in all documents (coreference), and keeps
its format: punctuation, digit and letter classes, check digits, reserved
e-mail domains, and for names the gender and script.  Given names go through a
keyed permutation of their list, surnames are built from syllables, so that a
later "Ms Surname" agrees with the full name.

Collision check.  All distinct entities of the corpus and their surrogates form
a table (pre-aggregated, never gathered).  An entity whose surrogate another one
has too, or that equals a real entity, moves to its next attempt, until none is
left.  Every eighth attempt makes the surrogate one character longer, so a format
that is full (six-digit codes, say) still ends.  Only these exceptions, usually
none, travel back to their documents.

Defined cases: null texts stay null and empty ones empty, without entities;
repeated rows are treated alike; a credential without a letter or digit is no
entity; detection is linear in the text, however many entities it holds; an
empty table gives an empty result; other columns, whatever their names, pass
through :func:`redact` unchanged but for ``n_chars``.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import cut, map_arrow, spread, uncut

DEFAULT_KEY = "strandline surrogates"
#: Attempts after which a surrogate grows by one character.
GROW_AFTER = 8
#: Each growth leaves a tenth of the collisions or fewer; so many rounds mean that something is wrong.
MAX_ROUNDS = 400
#: Parts among which the texts of one hash are dealt when exceptions travel back.
SALTS = 32

#: Given names by (script, gender), and syllables of surnames by script.
GIVEN = {
    ("latin", "m"): (
        "James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Jürgen Klaus Wolfgang "
        "Dieter François Jacques Philippe Antoine Carlos Javier Miguel Alejandro John Peter Andrew George Edward Henry "
        "Stephen Kevin Brian Hans Stefan Matthias Pierre Laurent Juan José Amit Rajesh Ahmed Mohammed Omar Hiroshi"
    ).split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Margaret Nancy Betty Ursula Monika Sabine "
        "Brigitte Françoise Jacqueline Sylvie Véronique Carmen Dolores Guadalupe Mercedes Emma Olivia Emily Alice Laura "
        "Julia Hannah Rebecca Rachel Petra Heike Claudia Camille Nathalie Isabel Lucía Priya Anjali Fatima Aisha Yuki"
    ).split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Владимир Николай Михаил Андрей Алексей".split(),
    ("cyrillic", "f"): "Екатерина Наталья Ольга Татьяна Светлана Людмила Ирина Марина".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νικόλαος Παναγιώτης Χρήστος Βασίλης".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
SYLLABLES = {
    "latin": "bal cor dun fal gar hol kel lam mor nor pel rud sol tam vin wes".split(),
    "cyrillic": "бал вор дун кор лам мор нор пел руд сол там вин гор зел кам лес".split(),
    "greek": "βαλ δαν καρ λαμ μαρ νικ παπ ρουσ σολ ταμ φιλ χαρ γαλ θεο κομ πετ".split(),
}
ADDRESS_M = frozenset(["Mr", "Herr", "Sr", "Señor", "Monsieur", "г-н", "Κύριος"])
ADDRESS_F = frozenset(["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Madame", "Mme", "г-жа", "Κυρία"])
ADDRESS_N = frozenset(["Dr", "Prof"])
#: Words before a name that no list needs to know; their first letter may be a capital.
INTRODUCTIONS = (
    "my name is", "name:", "signed by", "ich heiße", "mein Name ist", "je m'appelle", "mon nom est", "me llamo", "mi nombre es",
    "меня зовут", "με λένε",
)
EMAIL_DOMAINS = ("example.com", "example.net", "example.org")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Where two kinds overlap the earlier one wins.
NUMERIC = (
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", re.compile(
        r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(
        r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
        r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
        r"|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])"
        r"|(?<![\w.,+-])0[1-9](?:([ .-])\d{2})(?:\2\d{2}){3}(?![\w-])")),
)
#: What stands before an account number whose check digits do not hold.
LABELLED_IBAN = re.compile(r"IBAN\W{0,3}\Z", re.IGNORECASE)
#: Fixed values (E.164): country codes of two digits; those that begin with 1 or 7 have one, all others three.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98".split()
)
EMAIL = re.compile(r"[\w.%+-]+@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{12,}")
#: How tokens of known issuers begin.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(sk-(?:[a-z]{2,5}-)?|sk_live_|sk_test_|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|hf_|npm_|AIza)[A-Za-z0-9_-]{16,}"
)
ISSUED_HINTS = ("sk-", "sk_", "gh", "glpat-", "xox", "hf_", "npm_", "AIza")
CREDENTIAL = re.compile(
    r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/=.~!@-]{6,})",
    re.IGNORECASE,
)
CREDENTIAL_HINT = re.compile(r"[=:]")
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ](?:['’][A-ZÀ-ÖØ-Þ])?[^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][^\W\d_]+)?"
GIVEN_OF = {name: kind for kind, names in GIVEN.items() for name in names}
_LEAD = "|".join(sorted([*ADDRESS_M, *ADDRESS_F, *ADDRESS_N, *GIVEN_OF], key=lambda n: (-len(n), n)))
#: Begins with a letter of few kinds, so that the search skips quickly; :func:`detect` looks at the character before.
NAME = re.compile(rf"({_LEAD})(\.?)[ \t]({_CAP})(?:[ \t]({_CAP}))?(?!\w)")
INTRODUCED = re.compile(rf"(?:{'|'.join(f'[{t[0]}{t[0].upper()}]{t[1:]}' for t in INTRODUCTIONS)})[ \t]({_CAP})(?:[ \t]({_CAP}))?(?!\w)")
HAS_DIGIT = re.compile(r"\d")
WORD_OR_DIGIT = re.compile(r"[A-Za-z0-9]")
#: Words, with the parts that hyphens and apostrophes join.
JOINED = re.compile(r"\w+(?:[-'’]\w+)*")


def is_ipv6(text: str) -> bool:
    """Whether a text is an address of the network, and no scope of a program such as ``a::b``."""
    groups = [g for g in text.split(":") if g]
    if len(groups) < 3 and not (groups and len(groups[0]) > 2 and HAS_DIGIT.search(text)):
        return False
    try:
        return int(ipaddress.IPv6Address(text)) > 1  # neither the unspecified nor the loop-back address
    except ValueError:
        return False


def code_length(digits: str) -> int:
    """Digits of the country code that an international number begins with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order, without overlaps."""
    found: list[tuple[int, int, int, str, str]] = []

    def add(rank: int, start: int, end: int, kind: str, canonical: str) -> None:
        found.append((rank, start, end, kind, canonical))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(0, m.start(), m.end(), "email", m[0].lower())
    if "AKIA" in text or "ASIA" in text:
        for m in ACCESS_KEY.finditer(text):
            add(1, m.start(), m.end(), "secret", m[0])
    if any(h in text for h in ISSUED_HINTS):
        for m in ISSUED.finditer(text):
            if HAS_DIGIT.search(m[0]):
                add(1, m.start(), m.end(), "secret", m[0])
    if CREDENTIAL_HINT.search(text):
        for m in CREDENTIAL.finditer(text):
            if WORD_OR_DIGIT.search(m[1]):
                add(1, m.start(1), m.end(1), "secret", m[1])
    if HAS_DIGIT.search(text):
        for rank, (kind, pattern) in enumerate(NUMERIC):
            for m in pattern.finditer(text):
                plain = m[0] if kind in ("ip", "ipv6") else "".join(c for c in m[0] if c.isalnum())
                if kind == "ipv6" and not is_ipv6(plain):
                    continue
                if kind == "iban" and _mod97(plain[4:] + plain[:4]) != 1 and not LABELLED_IBAN.search(text[max(0, m.start() - 8) : m.start()]):
                    continue
                if kind == "phone" and m[0].startswith("+"):
                    plain = "+" + plain
                add(2 + rank, m.start(), m.end(), kind, plain)
    for m in NAME.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        first, second, third = m[1], m[3], m[4]
        gender = "m" if first in ADDRESS_M else "f" if first in ADDRESS_F else "n" if first in ADDRESS_N else ""
        if gender:
            if second in GIVEN_OF and third:
                add(9, m.start(3), m.end(3), "given", second)
                add(9, m.start(4), m.end(4), "surname", third)
            else:
                add(9, m.start(3), m.end(3), "surname", second)
        elif first in GIVEN_OF and not m[2] and second not in GIVEN_OF:
            add(9, m.start(1), m.end(1), "given", first)
            add(9, m.start(3), m.end(3), "surname", second)
    for m in INTRODUCED.finditer(text) if any(t[1:] in text for t in INTRODUCTIONS) else ():
        for group in (1, 2):
            if m[group]:
                add(9, m.start(group), m.end(group), "given" if m[group] in GIVEN_OF else "surname", m[group])
    # later mentions of a person by one part of the name; a given name wins over an equal surname
    known = {c: k for k in ("surname", "given") for _, _, _, kind, c in found if kind == k}
    if known:
        for m in JOINED.finditer(text):
            if m[0] in known:
                add(10, m.start(), m.end(), known[m[0]], m[0])
            elif not m[0].isalnum():
                for part in re.finditer(r"\w+", m[0]):
                    if part[0] in known:
                        add(10, m.start() + part.start(), m.start() + part.end(), known[part[0]], part[0])
    found.sort()
    kept: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for _, start, end, kind, canonical in found:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, end, kind, canonical))
    kept.sort()
    return kept


@lru_cache(maxsize=4096)
def peers(c: str) -> str:
    """Letters that may stand for a letter: those of its kind in its block of 64 code points."""
    base, kind = ord(c) & ~63, unicodedata.category(c)
    return "".join(x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind) or c


class Surrogates:
    """Keyed replacements; a pure function of key, kind, canonical form and attempt."""

    def __init__(self, key: str):
        self.key = key.encode("utf-8")
        self.permuted: dict[tuple[str, str], dict[str, str]] = {}
        for kind, names in GIVEN.items():
            order = sorted(names, key=lambda n: self._digest("given", n, 0))
            self.permuted[kind] = dict(zip(order, [*order[1:], order[0]]))  # a cycle: no name stays itself

    def _digest(self, kind: str, canonical: str, attempt: int) -> bytes:
        return hmac.new(self.key, f"{kind}\0{canonical}\0{attempt}".encode("utf-8"), hashlib.sha256).digest()

    def _draws(self, kind: str, canonical: str, attempt: int) -> Iterator[int]:
        seed, n = self._digest(kind, canonical, attempt), 0
        while True:
            yield from hashlib.sha256(seed + n.to_bytes(4, "big")).digest()
            n += 1

    def canonical(self, kind: str, canonical: str, attempt: int = 0) -> str:
        """Canonical form of the surrogate; never that of the entity itself."""
        out = self._drawn(kind, canonical, attempt)
        while out == canonical:
            attempt += 1000  # grows by then, so that this ends
            out = self._drawn(kind, canonical, attempt)
        return out

    def _drawn(self, kind: str, canonical: str, attempt: int) -> str:
        if kind == "given":
            return self.permuted[GIVEN_OF[canonical]][canonical]
        out = self._first(kind, canonical, attempt)
        more = self._draws(f"{kind} more", canonical, attempt)
        return out + "".join(str(next(more) % 10) for _ in range(0 if kind == "surname" else attempt // GROW_AFTER))

    def _first(self, kind: str, canonical: str, attempt: int) -> str:
        draws = self._draws(kind, canonical, attempt)
        if kind == "surname":
            part = SYLLABLES[script_of(canonical)]
            size = 3 if len(canonical) < 9 else 4
            end = ""
            if script_of(canonical) == "cyrillic":  # these show the gender
                end = "ова" if canonical[-1] in "ая" else "ов"
            return "".join(part[next(draws) % 16] for _ in range(size + attempt // GROW_AFTER)).capitalize() + end
        if kind == "email":
            local, _, domain = canonical.partition("@")
            host = self._shape(domain.split(".")[0], self._draws("domain", domain, 0))
            end = EMAIL_DOMAINS[next(self._draws("domain end", domain, 0)) % 3]
            new = self._shape(local, draws) + (str(next(draws)) if attempt else "")
            return f"{new}@{host}.{end}"
        if kind == "ip":
            return ".".join(str(1 + next(draws) % 254) for _ in range(4))
        if kind == "card":
            body = canonical[0] + self._shape(canonical[1:], draws)
            if luhn(canonical) == 0:
                body = body[:-1] + str((10 - luhn(body[:-1] + "0")) % 10)
            return body
        if kind == "iban":
            body = self._shape(canonical[4:], draws)
            return canonical[:2] + f"{98 - _mod97(body + canonical[:2] + '00'):02d}" + body
        if kind == "ipv6":
            return "".join(self._hex(c, draws) for c in canonical)
        if kind == "secret":
            issued = ISSUED.match(canonical)
            lead = 4 if canonical[:4] in ("AKIA", "ASIA") else issued.end(1) if issued else 0
            return canonical[:lead] + self._shape(canonical[lead:], draws)
        if kind == "phone":  # the country code stays, or the zero before a national number
            lead = 1 + code_length(canonical[1:]) if canonical[0] == "+" else max(int(canonical[0] == "0"), len(canonical) - 10)
            return canonical[:lead] + self._shape(canonical[lead:], draws)
        return self._shape(canonical, draws)

    @staticmethod
    def _hex(c: str, draws: Iterator[int]) -> str:
        """A hexadecimal digit other than zero in the same case; zero and marks stay."""
        if c in ":0":
            return c
        new = "123456789abcdef"[next(draws) % 15]
        return new.upper() if c.isupper() else new

    @staticmethod
    def _shape(text: str, draws: Iterator[int]) -> str:
        """Digits for digits (no leading zero where there was none), letters for letters of the same case."""
        hexes = len(text) >= 12 and not text.isdigit() and all(c in "0123456789abcdef" for c in text)
        out = []
        for i, c in enumerate(text):
            n = next(draws)
            if hexes:
                out.append("0123456789abcdef"[n % 16])
            elif c.isdecimal():
                out.append(str(1 + n % 9) if i == 0 and c != "0" else str(n % 10))
            elif c.isascii() and c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + n % 26))
            elif c.isalpha():
                out.append(peers(c)[n % len(peers(c))])
            else:
                out.append(c)
        return "".join(out)

    def replace(self, text: str, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
        """The text with surrogates, and the kinds found."""
        pieces, at, kinds = [], 0, []
        for start, end, kind, canonical in detect(text):
            new = self.canonical(kind, canonical, attempts.get((kind, canonical), 0))
            pieces += [text[at:start], self._dressed(text[start:end], kind, new)]
            at = end
            kinds.append(kind)
        if not kinds:
            return text, kinds
        pieces.append(text[at:])
        return "".join(pieces), kinds

    @staticmethod
    def _dressed(shown: str, kind: str, new: str) -> str:
        """The surrogate in the punctuation of the text that it replaces."""
        if kind in ("card", "ssn", "phone", "iban"):
            rest = iter(new.lstrip("+"))
            return "".join(next(rest) if c.isalnum() else c for c in shown) + "".join(rest)
        if kind == "email" and shown.isupper():
            return new.upper()
        return new


def luhn(digits: str) -> int:
    """Check sum modulo 10 of a card number; 0 if it holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, canonical, surrogate, attempt 0): distinct entities of a corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            own = {(k, c) for value in batch.column(0) for _, _, k, c in detect(value.as_py() or "") if k != "given"}
            rows = sorted(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in rows], pa.string()),
                    pa.array([c for _, c in rows], pa.string()),
                    pa.array([keyed.canonical(k, c) for k, c in rows], pa.string()),
                ],
                ["kind", "canonical", "surrogate"],
            )

    found = map_arrow(spread(docs.select(F.col(text).cast("string").alias("t"))), run, "kind string, canonical string, surrogate string")
    return found.groupBy("kind", "canonical").agg(F.min("surrogate").alias("surrogate")).withColumn("attempt", F.lit(0))


def collisions(units: DataFrame) -> DataFrame:
    """(kind, canonical) of entities that must draw again."""
    shared = units.groupBy("kind", "surrogate").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canonical")).alias("keeper")
    )
    twice = units.join(shared.filter("n > 1"), ["kind", "surrogate"]).filter(F.col("canonical") != F.col("keeper.canonical"))
    real = units.select("kind", F.col("canonical").alias("surrogate"))
    same = units.join(real, ["kind", "surrogate"], "left_semi")
    return twice.select("kind", "canonical").unionByName(same.select("kind", "canonical")).distinct()


def exceptions(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, int]:
    """(kind, canonical, attempt) of entities whose first surrogate would collide, and their number."""
    units = cut(entities(docs, key, text), "entities")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            rows = batch.to_pylist()
            new = [keyed.canonical(r["kind"], r["canonical"], r["attempt"]) if r["moved"] else r["surrogate"] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(new, pa.string()), batch.column(3)],
                ["kind", "canonical", "surrogate", "attempt"],
            )

    for _ in range(MAX_ROUNDS):
        losers = cut(collisions(units), "collisions")
        if losers.isEmpty():
            uncut(losers)
            break
        moved = units.join(losers.withColumn("moved", F.lit(True)), ["kind", "canonical"], "left")
        moved = moved.withColumn("moved", F.coalesce("moved", F.lit(False))).withColumn(
            "attempt", F.col("attempt") + F.col("moved").cast("int")
        )
        moved = moved.select("kind", "canonical", "surrogate", "attempt", "moved")
        before, units = units, cut(map_arrow(moved, again, "kind string, canonical string, surrogate string, attempt int"), "entities")
        uncut(before)
        uncut(losers)
    else:
        raise RuntimeError("surrogates still collide")
    moved = units.filter("attempt > 0").select("kind", "canonical", "attempt")
    return moved, moved.count()


def redact(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with surrogates in the text; with ``report`` also ``n_entities`` and ``entity_kinds``.

    The exceptions join their documents through the entities found there, so
    nothing about the corpus is broadcast by hand; without exceptions there is
    no join at all.
    """
    names = docs.columns
    moved, n_moved = exceptions(docs, key, text)
    rows = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).cast("string").alias("t"))
    if n_moved:
        rows = _with_attempts(rows, moved)
    else:
        rows = rows.withColumn("attempts", F.lit(None).cast("array<struct<kind: string, canonical: string, attempt: int>>"))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            out, n, kinds = [], [], []
            for value, own in zip(batch.column(1), batch.column(2)):
                shown = value.as_py()
                attempts = {(a["kind"], a["canonical"]): a["attempt"] for a in own.as_py() or ()}
                new, found = keyed.replace(shown, attempts) if shown else (shown, [])
                out.append(new)
                n.append(len(found))
                kinds.append(",".join(sorted(set(found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())],
                ["row", "t", "n", "kinds"],
            )

    done = map_arrow(rows.select("row", "t", "attempts"), run, f"row {row_type}, t string, n long, kinds string")
    cols = []
    for c in names:
        if c == text:
            cols.append(F.col("t").alias(c))
        elif c == "n_chars":
            cols.append(F.length("t").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    if report:
        cols += [F.col("n").alias("n_entities"), F.col("kinds").alias("entity_kinds")]
    return done.select(*cols)


def _with_attempts(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Adds the exceptions that a text mentions, found through a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sorted({(h, k, c) for h, t in zip(batch.column(0).to_pylist(), batch.column(1)) for _, _, k, c in detect(t.as_py() or "")})
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in own], pa.int64()), pa.array([o[1] for o in own], pa.string()), pa.array([o[2] for o in own], pa.string())],
                ["h", "kind", "canonical"],
            )

    rows = rows.withColumn("h", F.xxhash64("t"))
    said = map_arrow(rows.select("h", "t"), run, "h long, kind string, canonical string").distinct()
    own = said.join(moved, ["kind", "canonical"]).groupBy("h").agg(
        F.collect_list(F.struct("kind", "canonical", F.col("attempt").cast("int").alias("attempt"))).alias("attempts")
    )
    # copies of one text are dealt over salts, each of which gets the text's exceptions
    own = cut(own, "attempts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return rows.join(own, ["h", "salt"], "left")
