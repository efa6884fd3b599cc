"""Operator 11: chat formatting by incremental black-box rendering.

A template is anything with ``render(turns) -> str``, where turns are (role, text)
pairs; nothing else of it is looked at.  For every conversation the successive
prefixes of its turns are rendered and each output is compared with the one
before: what is new is the turn's span.  Where the earlier output is no prefix of
the later one the template has rewritten history; the turns whose output changed
are marked and, if their texts were hit, leave the loss mask.  The text inside a
span is found by rendering the same prefix with two probes in its place, which
differ in all their characters: what both outputs share before and after is the
template's own.

Conversations are dealt by their id and streamed in order of their turns.  At most
``2 * window`` turns are rendered at once: a longer conversation is rendered as its
first ``head`` turns and the latest ``window``, so time grows with its length and
memory does not, and a turn leaves as soon as ``window`` turns follow it.  A
template must not look further back than that.  (A conversation is one text and one digest;
one task hashes it in order, whatever its length.)

The default template marks turns by control strings and makes those inside texts
harmless: a backslash doubles, a control string gets one after its first character.
``parse`` reads turns and texts back from what was rendered.

Defined cases: a null text or role is empty; turns of equal number are ordered by
role and text, those without a number come last; rows without an id form one
conversation; repeated rows are turns of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import map_arrow, spread

Turn = tuple[str, str]
#: Roles whose texts are learnt.
LOSS_ROLES = ("assistant",)
WINDOW = 32
HEAD = 2
#: Texts put in place of a turn's own to see what the template adds: letters without a role in any markup.
PROBES = ("q", "z")


class Template(Protocol):
    def render(self, turns: list[Turn]) -> str: ...


class MarkedTemplate:
    """Instructions in brackets, replies up to an end mark, any other role by name."""

    #: Every control string begins with a character that it holds only there.
    CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]")

    def __init__(self) -> None:
        self._unsafe = re.compile("|".join([r"\\", *map(re.escape, self.CONTROLS)]))
        self._turn = re.compile(
            r"(?:<s>)?(?:\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]"
            r"|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?)\[END\]| (?P<assistant>.*?)</s>)",
            re.DOTALL,
        )

    def escape(self, text: str) -> str:
        return self._unsafe.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def turn(self, role: str, text: str) -> str:
        body = self.escape(text)
        if role == "system":
            return f"[SYS] {body} [/SYS]"
        if role == "user":
            return f"[INST] {body} [/INST]"
        if role == "assistant":
            return f" {body}</s>"
        return f"[ROLE]{self.escape(role)}[/ROLE] {body}[END]"

    def render(self, turns: list[Turn]) -> str:
        return "<s>" + "".join(self.turn(*t) for t in turns) if turns else ""

    def parse(self, formatted: str) -> list[Turn]:
        """Turns of a formatted conversation, or of a stretch of whole spans."""
        found, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            at = m.end()
            kind = m.lastgroup
            role = self.unescape(m["role"]) if kind == "other" else kind
            found.append((role, self.unescape(m[kind])))
        return found


def shared_start(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def text_place(template: Template, before: list[Turn], turn: Turn, rendered: str) -> tuple[int, int] | None:
    """Where the text of the last turn stands in ``rendered``; None if the template does not frame it alike for any text."""
    one, two = (template.render([*before, (turn[0], p)]) for p in PROBES)
    start = shared_start(one, two)
    rest = slice(None, start - 1 if start else None, -1)
    after = shared_start(one[rest], two[rest])
    end = len(rendered) - after
    if start + len(PROBES[0]) + after != len(one) or start > end or rendered[:start] != one[:start] or (after and rendered[end:] != one[-after:]):
        return None
    return start, end


class Conversation:
    """Spans of one conversation's turns, fed in order; gives back turns that can no longer change.

    A turn is [number, role, piece, loss from, loss to, rewritten]; the pieces put
    together are the whole output, loss bounds count from the piece's start.
    """

    def __init__(self, template: Template, loss_roles: tuple[str, ...], window: int | None, head: int) -> None:
        self.template, self.loss_roles, self.window, self.head = template, loss_roles, window, head
        self.first: list[Turn] = []
        self.held: list[Turn] = []
        self.output = ""
        self.open: list[list] = []
        self.starts: list[int] = []  # of open turns in the output
        self.seen = 0

    def feed(self, role: str, text: str) -> list[list]:
        turn = (role, text)
        new = self.template.render([*self.held, turn])
        same = shared_start(self.output, new)
        place = text_place(self.template, self.held, turn, new) if role in self.loss_roles else None
        if place is not None:  # where it happens to begin like what stood there before
            same = min(same, place[0])
        rewritten = same < len(self.output)
        if rewritten:
            self._rewrite(same)
        loss = (None, None) if place is None else (place[0] - same, place[1] - same)
        self.seen += 1
        if len(self.first) < self.head:
            self.first.append(turn)
        self.held.append(turn)
        self.open.append([self.seen, role, new[same:], *loss, rewritten])
        self.starts.append(same)
        self.output = new
        return self._slide()

    def _rewrite(self, same: int) -> None:
        """The output beyond ``same`` is gone: turns that had a share of it are marked and cut."""
        for turn, start in zip(self.open, self.starts):
            if start + len(turn[2]) > same:
                turn[2] = turn[2][: max(0, same - start)]
                turn[5] = True
                if turn[4] is not None and turn[4] > len(turn[2]):
                    turn[3] = turn[4] = None

    def _slide(self) -> list[list]:
        if self.window is None or len(self.held) < self.head + 2 * self.window:
            return []
        self.held = [*self.first, *self.held[-self.window :]]
        before = len(self.output)
        self.output = self.template.render(self.held)
        done = self.open[: -self.window]
        self.open = self.open[-self.window :]
        self.starts = [s + len(self.output) - before for s in self.starts[-self.window :]]
        if not self.output.endswith("".join(turn[2] for turn in self.open)):
            raise ValueError(f"the template looks further back than {self.window} turns")
        return done

    def close(self) -> list[list]:
        done, self.open = self.open, []
        return done


SPANS = "nth long, role string, piece string, start long, loss_from long, loss_to long, rewritten boolean"


def in_order(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, r, t): conversations dealt by id, their turns one after another."""
    given = spread(turns.select(F.col(conv_id), F.col(turn), F.col(role), F.col(text)))
    given = given.select(
        F.col(conv_id).alias("c"),
        F.col(turn).alias("n"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    return given.repartition("c").sortWithinPartitions(F.col("c"), F.col("n").asc_nulls_last(), "r", "t").drop("n")


def spans(
    turns: DataFrame,
    template: Template | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = LOSS_ROLES,
    window: int | None = WINDOW,
    head: int = HEAD,
) -> DataFrame:
    """(conv_id, nth, role, piece, start, loss_from, loss_to, rewritten) for every turn, in order within conversations.

    Pieces in order are the formatted conversation; ``start`` is where a piece begins
    in it, the loss bounds count from there, all in code points.
    """
    template = template or MarkedTemplate()
    kind = turns.schema[conv_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Conversation | None = None
        name, gone = None, 0
        out: list[tuple] = []

        def put(done: list[list]) -> None:
            nonlocal gone
            for nth, who, piece, a, b, rewritten in done:
                out.append((name, nth, who, piece, gone, a, b, rewritten))
                gone += len(piece)

        for batch in batches:
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if current is None or c != name:
                    if current is not None:
                        put(current.close())
                    current, name, gone = Conversation(template, loss_roles, window, head), c, 0
                put(current.feed(r, t))
            if out:
                yield _batch(out, batch.schema.field(0).type)
                out = []
        if current is not None:
            put(current.close())
            yield _batch(out, batch.schema.field(0).type)

    return map_arrow(in_order(turns, conv_id, turn, role, text), run, f"c {kind}, {SPANS}").withColumnRenamed("c", conv_id)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["c", *[f.split()[0] for f in SPANS.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), types)], names)


def conversations(found: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, loss, rewritten): each conversation as one string, with the bounds of its loss mask."""
    turn = F.struct("nth", "piece", (F.col("start") + F.col("loss_from")).alias("a"), (F.col("start") + F.col("loss_to")).alias("b"))
    whole = found.groupBy(conv_id).agg(F.sort_array(F.collect_list(turn)).alias("s"), F.max("rewritten").alias("rewritten"))
    bounds = F.transform(F.filter("s", lambda x: x["a"].isNotNull()), lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end")))
    return whole.select(conv_id, F.array_join(F.col("s.piece"), "").alias("formatted"), bounds.alias("loss"), "rewritten")


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewritten long"


def read_back(found: DataFrame, template: MarkedTemplate | None = None, conv_id: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read from the pieces of :func:`spans`, which must come in its order.

    Turns are parsed from the formatted text; what the loss mask covers is unescaped.
    """
    template = template or MarkedTemplate()
    kind = found.schema[conv_id].dataType.simpleString()
    names = ["c", *[f.split()[0] for f in READ.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        name, state = None, None

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, size, bad = state
                out.append((name, n, turns.hexdigest(), chars, loss.hexdigest(), size, bad))

        def batch_of(field: pa.DataType) -> pa.RecordBatch:
            types = [field, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), types)], names)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (conv_id, "piece", "loss_from", "loss_to", "rewritten")]
            for c, piece, a, b, rewritten in zip(*columns):
                if state is None or c != name:
                    close()
                    name, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for who, said in template.parse(piece):
                    state[0] += 1
                    state[1].update(f"{who}\n{said}\n".encode())
                if a is not None:
                    learnt = template.unescape(piece[a:b])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(piece)
                state[5] += bool(rewritten)
            if out:
                yield batch_of(batch.schema.field(0).type)
                out.clear()
        close()
        if out:
            yield batch_of(batch.schema.field(0).type)

    return map_arrow(found, run, f"c {kind}, {READ}").withColumnRenamed("c", conv_id)
