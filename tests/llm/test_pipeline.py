"""The pipeline against a plain reimplementation of its five stages."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from strandline.llm import pii_surrogates, quality_rules, sentencepiece_bpe, source_mixing
from strandline.llm.queries import tokenizer_path

WORD = "[^\x20\x09-\x0d]+"
SF = "/root/testdata/sf0.001"


def line_passes(line):
    words = re.findall(WORD, line)
    percent = lambda n, most: 100 * n > most * len(words)
    return not (
        percent(len(re.findall(r"[#*$%&|<>]", line)), 50)
        or percent(sum(w.endswith("!!") for w in words), 30)
        or percent(sum(w in ("|", ">", "»", "•") for w in words), 20)
        or any(p in line.lower() for p in quality_rules.BOILERPLATE)
        or (len(words) >= 40 and not re.search("[.,;:!?…。！？]", line))
    )


def quality(rows):
    out = []
    for r in rows:
        text = r["text"] or ""
        words = re.findall(WORD, text)
        grams = defaultdict(list)
        for i in range(len(words) - 4):
            grams[tuple(words[i : i + 5])].append(i)
        repeated = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(5)}
        if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not re.search(WORD, x) or line_passes(x)]
        left = sum(map(len, re.findall(WORD, "\n".join(kept))))
        if 100 * left >= 50 * sum(map(len, words)):
            new = "\n".join(kept)
            out.append(r | {"text": new, "n_chars": len(new)})
    return out


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_dedup(rows):
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    best = {}
    for r, c in zip(rows, root):
        best[c] = min(best.get(c, r["doc_id"]), r["doc_id"])
    return [r for r, c in zip(rows, root) if best[c] == r["doc_id"]]


def pii(rows):
    keyed = pii_surrogates.Surrogates(pii_surrogates.DEFAULT_KEY)
    units = {(k, c) for r in rows for _, _, k, c in pii_surrogates.detect(r["text"]) if k != "given"}
    new = {u: keyed.canonical(*u) for u in units}
    # on this table no first surrogate collides or is a real entity, so there is one round
    assert len(set(new.values())) == len(new) and not {(k, s) for (k, _), s in new.items()} & units
    out = []
    for r in rows:
        text = keyed.replace(r["text"], {})[0]
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def mixing(rows):
    sizes = [len(re.findall(WORD, r["text"])) for r in rows]
    total = sum(sizes)
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + ([None] if any(r["source"] is None for r in rows) else [])
    held = {s: sum(n for r, n in zip(rows, sizes) if r["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = total - sum(3 * held[s] for s in names if s not in free)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if 3 * held[s] <= weight[s] * level}
        if not over:
            break
        free -= over
    target = {s: weight[s] * level if s in free else 3 * held[s] for s in names}
    out = []
    for s in names:
        limit = int(target[s] + 0.5)
        own = [(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest(), r, n) for r, n in zip(rows, sizes) if r["source"] == s]
        own.sort(key=lambda x: (x[0], x[1]["doc_id"]))
        at, taken = 0, [0] * len(own)
        for _ in range(3):
            for i, (_, _, n) in enumerate(own):
                taken[i] += max(0, min(limit, at + n) - at)
                at += n
        for t, (_, r, n) in zip(taken, own):
            out += [r] * int(t / max(n, 1) + 0.5)
    return out


def plain(rows):
    return sorted((r["doc_id"], r["text"], r["lang"] or "", r["source"] or "", r["n_chars"]) for r in rows)


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, near_dedup, pii, mixing)):
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        rows = brute(rows)
        assert docs.columns == columns, name
        assert plain(r.asDict() for r in docs.collect()) == plain(rows), name
    library = sentencepiece_bpe.encoder(tokenizer_path("piece_bpe_32k.model")).library
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in last) == sorted((r["doc_id"], library.encode(r["text"])) for r in rows)
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in again.collect()) == sorted((r.doc_id, r.ids) for r in last)
