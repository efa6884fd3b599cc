"""Operator 6: SentencePiece BPE encoding by a merge-type prefix table.

For every prefix of a text, BPE has exactly one encoding, and so one last token.
A token that an Aho-Corasick automaton finds ending at a place is that last
token if it is compatible with the last token of the prefix before it: that is,
if BPE over the two joined strings gives back just these two.  One pass fills
the table of last tokens; ids are then read off backwards from the end.

Compatibility.  BPE over two joined tokens takes, in turn, the better next merge
of the two until a merge over the border is better than both.  How a token comes
together on its own (its steps: score of the next merge, first and last part) is
worked out once for each token, so a test walks two short lists of steps.

Three facts of the model, checked when it is loaded, make the pass cheap: no piece
holds the space mark after another character, some characters (the line break
among them) stand in no longer piece, and some marks follow a letter in no piece.
No merge can then cross such a place, so texts are encoded as independent chunks
whose ids are remembered in a bounded table.  A model without these properties is encoded text by text.

Defined cases: null and empty texts have no ids and decode to the empty string;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import map_arrow, spread

SPACE_MARK = "▁"
NEVER = float("-inf")
#: Letters after which a chunk may end, and the marks before which it may, if the model allows it.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏΑ-ωЀ-ӿ"
LETTER = re.compile(f"[{LETTERS}]")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
#: Entries of each of the two generations of the memo tables; all full ones take some 100 MB of a worker.
CHUNK_ENTRIES = 131_072
PAIR_ENTRIES = 131_072
#: Longer chunks are encoded each time, not remembered.
MEMO_CHARS = 40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else (4 if key & 7 == 5 else 8)
        yield key >> 3, data[at : at + size]
        at += size


class Memo:
    """A bounded table of two generations: when the young one is full it becomes the old one."""

    def __init__(self, entries: int):
        self.entries = entries
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PrefixTableEncoder:
    """Encoder of one BPE model; ids as the sentencepiece library gives them."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.library
        normal = {}
        trainer = {}
        with open(model, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 3:
                    normal = dict(_fields(value))
                elif field == 2:
                    trainer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the BPE type")
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("the model rewrites characters or white space; only identity models are handled")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        inside: set[str] = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.pieces.append(piece)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                if sp.is_unused(i):
                    raise ValueError("the model has unused pieces")
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                automaton.add_word(piece, (len(piece), i))
                if len(piece) > 1:
                    inside.update(piece)
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs = Memo(PAIR_ENTRIES)
        self.walked: dict[int, list[tuple[float, str, str]] | None] = {}
        self.memo = Memo(CHUNK_ENTRIES)
        self.shown = [str(i) for i in range(sp.get_piece_size())]
        m = re.escape(SPACE_MARK)
        splits = not any(re.search(f"[^{m}]{m}", p) for p in self.ids)
        lone = "\n" if "\n" not in inside else ""
        after = {b for p in self.ids for a, b in zip(p, p[1:]) if LETTER.match(a)}
        marks = re.escape("".join(sorted(set(MARKS) - after)))
        if not splits:
            pattern = r"(?s).+"
        elif not marks:
            pattern = f"{m}*+[^{m}{lone}]++|{m}++|{lone or '(?!)'}"
        else:  # a chunk ends between a letter and a mark
            inner = f"(?:[{LETTERS}]++|[^{m}{lone}{marks}{LETTERS}]++[{marks}]*+)"
            pattern = f"{m}*+[{marks}]++{inner}*+|{m}*+{inner}++|{m}++|{lone or '(?!)'}"
        self.chunks = re.compile(pattern)

    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the best-scored pair, the leftmost of equals, until none is left."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def steps(self, token: int) -> list[tuple[float, str, str]] | None:
        """States of BPE over a token alone: (score of the next merge, first part, last part); None if it ends in other tokens."""
        known = self.walked.get(token, False)
        if known is not False:
            return known
        parts = list(self.pieces[token])
        score = self.score
        out: list[tuple[float, str, str]] | None = []
        while True:
            best, where = NEVER, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, where = s, i
            out.append((best, parts[0], parts[-1]))
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        if len(parts) > 1:
            out = None
        self.walked[token] = out
        return out

    def border_holds(self, left: int, right: int) -> bool:
        """Whether BPE over two joined tokens gives back these two."""
        a, b = self.steps(left), self.steps(right)
        if a is None or b is None:
            return False
        score = self.score
        i = j = 0
        while True:
            next_a, _, last = a[i]
            next_b, first, _ = b[j]
            over = score.get(last + first)
            # of equal scores the leftmost merge comes first: left of the border, the border, right of it
            if over is not None and over > next_a and over >= next_b:
                return False
            if next_a >= next_b:
                if next_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two tokens; left is -1 at the start."""
        if left < 0:
            return self.steps(right) is not None
        key = (left << 20) | right
        known = self.pairs.get(key)
        if known is None:
            known = self.border_holds(left, right)
            self.pairs.put(key, known)
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        size = len(chunk)
        last: list[int] = [-2] * (size + 1)  # -2: none yet, -3: a character of bytes
        step = [1] * (size + 1)
        last[0] = -1
        done = 0
        pairs = self.pairs
        seen = pairs.young
        for end, (length, token) in self.automaton.iter(chunk):
            end += 1
            if last[end] != -2:
                continue
            while done < end - 1:  # places where no token ends: characters in no piece
                done += 1
                if last[done] == -2:
                    last[done] = -3
            before = last[end - length]
            if before < 0:
                holds = self.steps(token) is not None
            else:
                holds = seen.get(before << 20 | token)
                if holds is None:
                    holds = self.compatible(before, token)
                    seen = pairs.young
            if holds:
                last[end], step[end] = token, length
                done = end
        for i in range(done + 1, size + 1):
            if last[i] == -2:
                last[i] = -3
        out: list[int] = []
        at = size
        while at:
            token = last[at]
            if token == -3:
                out.extend(self.bytes[b] for b in reversed(chunk[at - 1].encode("utf-8")))
            else:
                out.append(token)
            at -= step[at]
        out.reverse()
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of a text, and the same as decimals joined by commas."""
        if not text:
            return [], ""
        marked = text.replace(" ", SPACE_MARK)
        if self.dummy_prefix:
            marked = SPACE_MARK + marked
        memo, shown = self.memo, self.shown
        seen = memo.young
        ids: list[int] = []
        said: list[str] = []
        for chunk in self.chunks.findall(marked):
            entry = seen.get(chunk)
            if entry is None:
                entry = memo.get(chunk)
                if entry is None:
                    found = self.encode_chunk(chunk)
                    entry = (tuple(found), ",".join([shown[i] for i in found]))
                    if len(chunk) <= MEMO_CHARS:
                        memo.put(chunk, entry)
                seen = memo.young
            ids += entry[0]
            said.append(entry[1])
        return ids, ",".join(said)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_LOADED: dict[str, PrefixTableEncoder] = {}


def encoder(model: str) -> PrefixTableEncoder:
    """The encoder of a model file, loaded once in each Python worker."""
    if model not in _LOADED:
        _LOADED[model] = PrefixTableEncoder(model)
    return _LOADED[model]


def encode(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Per row: the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``ids``.

    Row-local: one scan, no shuffle.
    """
    key = docs.schema[id_col]
    source = spread(docs.select(F.col(id_col).alias("k"), F.col(text).cast("string").alias("t")))
    out_schema = f"k {key.dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out_schema += ", ids array<int>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        sha = hashlib.sha256
        for batch in batches:
            counts, hashes, decoded, all_ids = [], [], [], array("i")
            for value in batch.column(1):
                ids, said = enc.encode(value.as_py() or "")
                counts.append(len(ids))
                hashes.append(sha(said.encode("ascii")).hexdigest())
                decoded.append(sha((enc.decode(ids) if ids else "").encode("utf-8")).hexdigest())
                if keep_ids:
                    all_ids.extend(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(all_ids, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(source, run, out_schema).withColumnRenamed("k", id_col)
