"""Operator 11: spans located by rendering prefixes, against the turns themselves."""

import hashlib
import random

import pytest

from strandline.llm import chat_format
from strandline.llm.chat_format import Conversation, MarkedTemplate

SCHEMA = "conv_id long, turn long, role string, text string, c string, r int, t int, n int, nth int, piece string"
ROLES = ["user", "assistant", "system", "tool", "", "assi[ROLE]stant"]


def rows(seed=5, n=40):
    rnd = random.Random(seed)
    parts = [*MarkedTemplate.CONTROLS, "\\", "\\\\", " ", "\n", "ok", "é", "[", "[/INST", "</s", "q", "z", "😀", ""]
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, 9)):
            out.append((c, t, rnd.choice(ROLES), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))))
    out += [(100, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(150)]
    out += [(101, 0, None, None), (101, None, "assistant", "last"), (101, 1, "user", "a"), (101, 1, "user", "a"), (None, 0, "user", "x"), (None, 0, "assistant", None)]
    out += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return out


def by_conversation(given):
    turns = {}
    for c, n, r, t in sorted(given, key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(c, []).append((r or "", t or ""))
    return turns


def frame(spark, given):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "y") for r in given], SCHEMA)


@pytest.mark.parametrize("window", [None, 3, 32])
def test_spans_rebuild_conversations(spark, window):
    given = rows()
    found = chat_format.spans(frame(spark, given), window=window)
    template = MarkedTemplate()
    want = by_conversation(given)
    whole = {r.conv_id: r for r in chat_format.conversations(found).collect()}
    assert set(whole) == set(want)
    for c, turns in want.items():
        got = whole[c]
        assert got.formatted == template.render(turns) and not got.rewritten
        assert template.parse(got.formatted) == turns
        masked = [template.unescape(got.formatted[m.start : m.end]) for m in got.loss]
        assert masked == [t for r, t in turns if r == "assistant"]
    for r in chat_format.read_back(found).collect():
        turns = want[r.conv_id]
        assert r.n_turns == len(turns) and r.n_rewritten == 0
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        learnt = "".join(t for a, t in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(whole[r.conv_id].formatted)


def test_empty_table(spark):
    found = chat_format.spans(frame(spark, []))
    assert found.count() == 0 and chat_format.read_back(found).count() == 0


class Trailer:
    """An end mark after the last turn only: every turn rewrites the end of the one before, no text is hit."""

    def render(self, turns):
        return "".join(f"<{r}>{t}" for r, t in turns) + "<end>"


class Forgetting:
    """Earlier replies lose what stands before their last '#'."""

    def render(self, turns):
        shown = [t if i == len(turns) - 1 or r != "assistant" else t.split("#")[-1] for i, (r, t) in enumerate(turns)]
        return "".join(f"<{r}>{t}\n" for (r, _), t in zip(turns, shown))


class Doubling:
    def render(self, turns):
        return "".join(f"<{r}>{t}|{t}\n" for r, t in turns)


class Counting:
    """Tells the number of turns at the start: looks at all of them."""

    def render(self, turns):
        return "".join(f"{len(turns) - i}:{t};" for i, (_, t) in enumerate(turns))


def turns_of(template, turns, window=None):
    fed = Conversation(template, ("assistant",), window, 2)
    out = [t for r, s in turns for t in fed.feed(r, s)]
    return out + fed.close()


def test_templates_that_rewrite_history():
    turns = [("user", "hi"), ("assistant", "well#yes"), ("user", "so?"), ("assistant", "hm#no")]
    for template in (Trailer(), Forgetting(), Doubling()):
        got = turns_of(template, turns)
        assert "".join(t[2] for t in got) == template.render(turns)
    got = turns_of(Trailer(), turns)
    assert [t[5] for t in got] == [True, True, True, True]
    assert [t[2][t[3] : t[4]] for t in got if t[3] is not None] == ["well#yes", "hm#no"]
    got = turns_of(Forgetting(), turns)
    assert [t[5] for t in got] == [False, True, True, False]
    # the first reply was rewritten and is not learnt; the second stands as it was written
    assert [t[2][t[3] : t[4]] for t in got if t[3] is not None] == ["hm#no"]
    assert all(t[3] is None for t in turns_of(Doubling(), turns))


def test_a_window_too_short_is_an_error():
    turns = [("user", str(i)) for i in range(60)]
    with pytest.raises(ValueError):
        turns_of(Counting(), turns, window=4)
    assert "".join(t[2] for t in turns_of(Trailer(), turns, window=4)[-4:]).endswith("<user>59<end>")


def test_parse_refuses_other_text():
    with pytest.raises(ValueError):
        MarkedTemplate().parse("<s>[INST] never closed")


def test_long_conversation_in_bounded_memory():
    template = MarkedTemplate()
    fed = Conversation(template, ("assistant",), 8, 2)
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i} " * (i % 5)) for i in range(3000)]
    pieces = []
    for r, t in turns:
        pieces += fed.feed(r, t)
        assert len(fed.held) <= 18 and len(fed.open) <= 18
    pieces += fed.close()
    assert "".join(p[2] for p in pieces) == template.render(turns)
