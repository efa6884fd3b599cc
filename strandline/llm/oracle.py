"""DuckDB SQL of the queries that SQL can express."""

from strandline.llm import fill_in_middle as fim
from strandline.llm import importance_resampling as i
from strandline.llm import quality_rules as q
from strandline.llm import source_mixing as m
from strandline.llm.warc import BASE32

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(regexp_split_to_array({}, '" + _SPACE + "'), lambda x: x <> '')"
_BOILER = " OR ".join("contains(lower(l), '" + p.replace("'", "''") + "')" for p in q.BOILERPLATE)
_MARKS = ", ".join(f"'{s}'" for s in q.SEPARATORS)

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) n FROM rep, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, l, {_WORDS.format("l")} lw, length(l) - length(regexp_replace(l, '{q.SYMBOLS}', '', 'g')) sym
  FROM (SELECT doc_id, unnest(ls) l FROM d)),
judged AS (SELECT doc_id, length(array_to_string(lw, '')) chars, NOT (100 * sym > {q.MAX_SYMBOL_PERCENT} * len(lw)
  OR 100 * len(list_filter(lw, lambda x: ends_with(x, '!!'))) > {q.MAX_SHOUT_PERCENT} * len(lw)
  OR 100 * len(list_filter(lw, lambda x: x IN ({_MARKS}))) > {q.MAX_SEPARATOR_PERCENT} * len(lw)
  OR {_BOILER} OR (NOT regexp_matches(l, '{q.PUNCTUATION}') AND len(lw) >= {q.PUNCTUATION_FROM})) ok FROM lines),
j AS (SELECT doc_id, CAST(coalesce(sum(chars) FILTER (WHERE ok), 0) AS BIGINT) left_chars, count(*) n_lines, count(*) FILTER (WHERE ok) n_lines_kept
  FROM judged GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
  CAST(length(t) - length(regexp_replace(t, '{q.SYMBOLS}', '', 'g')) AS BIGINT) n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) n_repeat_words,
  coalesce(left_chars, 0) left_chars, coalesce(n_lines, 0) n_lines, coalesce(n_lines_kept, 0) n_lines_kept
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN j USING (doc_id)),
f AS (SELECT *, (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND 100 * left_chars >= {q.MIN_LEFT_PERCENT} * word_chars) kept, left_chars, n_lines, n_lines_kept FROM f
"""

_DIGITS = " || ".join(
    f"substr('{BASE32}', ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') t, sha1(coalesce(html, '')) h FROM pages),
k AS (SELECT page_id, CAST(strlen(t) AS BIGINT) payload_bytes, {_DIGITS} payload_digest, max(page_id) OVER (PARTITION BY t) keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id <> keeper THEN keeper END refers_to, true digest_holds FROM k
"""

_W = f"CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN {m.WEIGHTS[0]} WHEN 2 THEN {m.WEIGHTS[1]} ELSE {m.WEIGHTS[2]} END"

OP10 = f"""
WITH s AS (SELECT doc_id id, source, coalesce('v' || source, 'n') skey, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '?' || md5(coalesce(text, '')))) rank_key FROM documents),
t AS (SELECT CAST(sum(size) AS BIGINT) total, CAST(greatest(1, (sum(size) + {m.MAX_SLOTS - 1}) // {m.MAX_SLOTS}) AS BIGINT) block FROM s),
o AS (SELECT skey, source, CAST(sum(size) AS BIGINT) source_size FROM s GROUP BY 1, 2),
w AS (SELECT *, {_W} weight, {m.MAX_EPOCHS} * source_size AS cap FROM o),
r AS (SELECT *, cap / weight::DOUBLE ratio FROM w),
l AS (SELECT r.*, (total::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl FROM r, t
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN ratio <= lvl THEN cap::DOUBLE ELSE weight * ((SELECT total FROM t)::DOUBLE - coalesce(sum(cap) FILTER (WHERE ratio <= lvl) OVER (), 0))
  / sum(weight) FILTER (WHERE ratio > lvl) OVER () END AS target FROM l),
h AS (SELECT *, CAST(round(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / greatest((SELECT total FROM t), 1)::DOUBLE * {m.POINTS}) AS BIGINT) AS hi FROM g),
i AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM h),
n AS (SELECT range slot, (range + 1) * {m.GOLDEN} % {m.POINTS} AS pt FROM range((SELECT CAST((total + block - 1) // block AS BIGINT) FROM t))),
c AS (SELECT skey, slot, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 rnk FROM n JOIN i ON pt >= lo AND pt < hi),
u AS (SELECT i.*, CAST(round(target) AS BIGINT) lim, coalesce(slots, 0) slots FROM i LEFT JOIN (SELECT skey, count(*) slots FROM c GROUP BY skey) USING (skey)),
p AS (SELECT s.*, CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY rank_key, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg FROM s),
k AS (SELECT p.*, u.source_size, u.target, u.lim, u.slots, p.beg // block AS rnk, (total + block - 1) // block AS last FROM p JOIN u USING (skey), t)
SELECT id AS doc_id, size, source_size, target, CAST((SELECT sum(greatest(0, least(e * source_size + beg + size, lim)
  - (e * source_size + beg))) FROM range({m.MAX_EPOCHS}) x(e)) AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 AND beg < lim THEN coalesce(slot, last + rnk - slots) END AS BIGINT) first_slot
FROM k LEFT JOIN c USING (skey, rnk)
"""

_UNSAFE = r"\\|<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[ROLE\]|\[/ROLE\]|\[END\]"
_ESCAPED = "length({0}) + len(regexp_extract_all({0}, '" + _UNSAFE + "'))"

OP11 = f"""
WITH g AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(i))
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, r, t)) turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, t) FILTER (WHERE r = 'assistant'), '')) loss_sha256,
  CAST(3 + sum({_ESCAPED.format("t")} + CASE r WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
    ELSE 19 + {_ESCAPED.format("r")} END) AS BIGINT) formatted_chars, 0::BIGINT n_rewritten
FROM g GROUP BY conv_id
"""

#: CRC-32 of a list of bytes, with the table of its steps as a list ``st``.
_STEP = "list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
_BYTES = "list_transform(range(1, 2 * strlen(w) + 1, 2), lambda k: CAST('0x' || substr(hex(encode(w)), k, 2) AS BIGINT))"
_CRC = f"xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda a, b: xor(a // 256, st[xor(a, b) % 256 + 1])), 4294967295)"
_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH steps AS (SELECT list(s ORDER BY i) st FROM (SELECT i, {_STEP} s FROM range(256) x(i))),
d AS (SELECT row_number() OVER () k, doc_id, {_LOWER} ws FROM documents),
w AS (SELECT k, unnest(ws) w FROM d), b AS (SELECT unnest({_LOWER}) w FROM benchmark),
h AS (SELECT w, {_CRC} % {i.BUCKETS} bucket FROM (SELECT w FROM w UNION SELECT w FROM b), steps),
s AS (SELECT bucket, count(*) n FROM w JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) n FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0)::DOUBLE + {i.BUCKETS} FROM s)
  / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0)::DOUBLE + {i.BUCKETS} FROM t)))) gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT k, CAST(sum(gain) AS BIGINT) weight FROM w JOIN h USING (w) JOIN g USING (bucket) GROUP BY k),
c AS (SELECT doc_id, k, CAST(len(ws) AS BIGINT) n_features, coalesce(weight, 0) weight,
  CAST('0x' || substr(sha256('{i.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) u FROM d LEFT JOIN f USING (k)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) score FROM c),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) rank FROM z WHERE n_features >= {i.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * {i.DRAW_PERCENT} // 100 FROM r) THEN rank END rank FROM z LEFT JOIN r USING (k)
"""

_P, _S, _M = (f"'{x}'" for x in fim.MARKERS)
_H = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) h{k + 1}" for k in range(4))
_CUT = "array_to_string(list_slice(u, {}, {}), '')"

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, {_H} FROM d),
k AS (SELECT *, CAST(len(u) AS BIGINT) n, h1 % (len(u) + 1) x, h2 % (len(u) + 1) y, t = '' OR contains(t, {_P}) OR contains(t, {_S}) OR contains(t, {_M})
  OR h3 % 100 >= {fim.FIM_PERCENT} plain FROM l),
c AS (SELECT *, {_CUT.format("1", "least(x, y)")} p, {_CUT.format("least(x, y) + 1", "greatest(x, y)")} m, {_CUT.format("greatest(x, y) + 1", "n")} s FROM k)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END form,
  CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END middle_chars,
  sha256(CASE WHEN plain THEN t WHEN h4 % 100 < {fim.SPM_PERCENT} THEN {_S} || s || {_P} || p || {_M} || m ELSE {_P} || p || {_S} || s || {_M} || m END) output_sha256,
  sha256(t) restored_sha256 FROM c
"""

ORACLE_SQL = {"op4_quality_rules": OP4, "op5_warc": OP5, "op10_source_mixing": OP10, "op11_chat_format": OP11}
ORACLE_SQL |= {"op12_importance_resampling": OP12, "op13_fill_in_middle": OP13}
