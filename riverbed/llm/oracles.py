"""DuckDB statements for the queries that SQL expresses."""

from __future__ import annotations

from riverbed.llm.quality import BLANKS, KNOWN, LIMITS, SYMBOLS

COMPONENTS = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql() -> str:
    count = lambda text, part: f"((length({text}) - length(replace({text}, {part}, ''))) // length({part}))"
    blank = " + ".join(count("t", f"chr({ord(b)})") for b in BLANKS)
    symbol = " + ".join(count("t", _q(s)) for s in SYMBOLS)
    strip = lambda p: f"(length(t) - length(regexp_replace(t, {_q(p)}, '', 'g')))"
    hits = ", ".join(f"len(list_filter(w, lambda x: lower(x) = {_q(w)}))" for w in KNOWN)
    share = lambda x: f"list_transform({x}, lambda c: c::DOUBLE / nullif(list_sum({x}), 0))"
    part = "CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0.0 END"
    far = lambda p, q: f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: {part})) / 2)) END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines,
  {blank} AS blank, {symbol} AS n_symbols,
  {strip(chr(92) + "p{Lu}+")} AS upper_n, {strip(chr(92) + "p{Nd}+")} AS digit, {strip("[.,;:!?'\"()" + chr(92) + "[" + chr(92) + "]{}_" + chr(92) + "-]+")} AS mark FROM d),
g AS (SELECT r, p, w[p] AS x, w[p + 1] AS y, w[p + 2] AS z FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM b)),
s AS (SELECT r, x, y, z FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT p + j) AS n FROM (SELECT g.r, g.p, unnest([0, 1, 2]) AS j FROM g JOIN s USING (r, x, y, z)) GROUP BY r),
h AS (SELECT b.*, [{hits}] AS hit, coalesce(c.n, 0) AS n_repeat_words, len(w) AS n_words, length(t) AS n_chars FROM b LEFT JOIN c USING (r)),
f AS (SELECT *, [upper_n, digit, mark, n_symbols, blank, greatest(n_chars - upper_n - digit - mark - n_symbols - blank, 0)] AS chars, hit AS common, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
n AS (SELECT lang AS l, [{", ".join(f"sum(chars[{k}])" for k in range(1, 7))}] AS char_norm, [{", ".join(f"sum(common[{k}])" for k in range(1, len(KNOWN) + 1))}] AS word_norm FROM f WHERE NOT base_failed GROUP BY 1),
o AS (SELECT *,
  CASE WHEN n_chars >= {LIMITS["min_chars"]} THEN {far("chars", "char_norm")} END AS char_distance, CASE WHEN n_words >= {LIMITS["min_words"]} THEN CASE WHEN list_sum(word_norm) > 0 AND list_sum(common) = 0 THEN 1.0 ELSE {far("common", "word_norm")} END END AS word_distance
  FROM f LEFT JOIN n ON lang IS NOT DISTINCT FROM l)
SELECT doc_id, n_words::BIGINT AS n_words, (n_chars - blank)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND NOT (coalesce(char_distance, 0) > {LIMITS["max_char_distance"]} OR coalesce(word_distance, 0) > {LIMITS["max_word_distance"]}) AS kept FROM o"""


def licenses_sql(threshold: float = 0.8) -> str:
    """All blocks of texts that hold enough words of a template anywhere, word by word."""
    import re

    from riverbed.llm.licenses import PHRASES, TEMPLATES, needed, width

    lists = lambda ws: "[" + ", ".join(map(_q, ws)) + "]"
    words = lambda x: f"regexp_extract_all({x}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"({lists(p.split(' '))}, {_q(label)})" for p, label in PHRASES.items())
    found = {name: re.findall("[0-9a-z]+", t.lower()) for name, t in TEMPLATES.items()}
    templates = ", ".join(f"({lists(sorted(set(ws)))}, {_q(name)}, {needed(len(set(ws)), threshold)}, {width(len(ws))})" for name, ws in found.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
w AS (SELECT r, doc_id, t, {words("t")} AS w FROM d),
p(ph, label) AS (VALUES {phrases}), m(ws, label, need, wide) AS (VALUES {templates}),
h AS (SELECT r, label, unnest(list_filter(range(0, greatest(len(w) - len(ph) + 1, 0)), lambda i: w[i + 1 : i + len(ph)] = ph)) AS place FROM w, p),
u AS (SELECT r, label, need, wide, len(ws) AS size, w, ws FROM w JOIN m ON len(list_intersect(list_distinct(w), ws)) >= need),
x AS (SELECT r, label, need, wide, size, pos, word FROM (SELECT r, label, need, wide, size, ws, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM u) WHERE list_contains(ws, word)),
b AS (SELECT a.r, a.label, a.need, a.size, count(DISTINCT o.word) AS shared FROM x a JOIN x o ON a.r = o.r AND a.label = o.label AND o.pos BETWEEN a.pos AND a.pos + a.wide - 1 GROUP BY a.r, a.label, a.need, a.size, a.pos),
g AS (SELECT r, label, shared::DOUBLE / size AS score, NULL::BIGINT AS place, false AS base FROM b WHERE shared >= need UNION ALL SELECT r, label, 1.0, place, true FROM h),
a AS (SELECT r, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score FROM w LEFT JOIN a USING (r)"""


MIDDLES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[ \\x09-\\x0D]*[^ \\x09-\\x0D]+|[ \\x09-\\x0D]+') AS w, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(h4[1] % (len(w) + 1), h4[2] % (len(w) + 1)) AS a, greatest(h4[1] % (len(w) + 1), h4[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h4[3] % 100 >= 50 THEN 'plain' WHEN h4[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, n, t, form, CASE WHEN form <> 'plain' THEN array_to_string(w[1:a], '') END AS prefix, CASE WHEN form <> 'plain' THEN array_to_string(w[a + 1 : b], '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(w[b + 1 :], '') END AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def repair_sql() -> str:
    """The grammar's states as columns (cost, audit, lines), turn after turn."""
    far = "{'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}"
    step = lambda s, cost, edit, line="": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'o': {s}.o" + (f" || [{line}]" if line else "") + "}"
    delete = lambda s: step(s, 2, "D")
    stays = "CASE WHEN truncated THEN 5 ELSE 0 END"
    take = lambda s, role: [f"CASE WHEN NOT useless THEN {step(s, f'1 + {stays}', 'R', f"'{role}:' || text")} END", f"CASE WHEN NOT useless AND left(role, 1) = '{role[0]}' THEN {step(s, stays, 'K', "role || ':' || text")} END"]
    least = lambda *x: f"least({', '.join(x)})"
    keep_system = f"CASE WHEN NOT useless AND left(role, 1) = 's' THEN {step('s0', stays, 'K', "role || ':' || text")} END"
    b2 = least(delete("s2"), *(x for s in ("s0", "s1", "s3") for x in take(s, "user")))
    b3 = least(delete("s3"), *take("s2", "assistant"))
    insert = lambda s, role: step(s, 5, "I", f"'{role}:'")
    return f"""
WITH RECURSIVE b AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS b),
j AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS j FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(range(1, length(j) + 1), lambda i: ascii(substr(j, i, 1))::BIGINT), lambda c, x: xor(b[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM j, b),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM g),
f AS (SELECT *, NOT regexp_matches(text, '[^ \\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM n),
t AS (SELECT *, NOT blank AND again AS duplicate, blank OR again AS useless, NOT blank AND NOT again AND open AS truncated FROM f),
r(conv_id, p, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}}, {far}, {{'c': 5::BIGINT, 'a': 'I', 'o': ['user:']}}, {{'c': 10::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']}} FROM conversations
  UNION ALL
  SELECT conv_id, p, s0, s1, s2, least(b3, {insert("s2", "assistant")}) FROM (
    SELECT conv_id, p, s0, s1, least(b2, {insert("s0", "user")}, {insert("s1", "user")}, {insert("b3", "user")}) AS s2, b3 FROM (
      SELECT r.conv_id, t.p, {delete("s0")} AS s0, {least(delete("s1"), keep_system)} AS s1, {b2} AS b2, {b3} AS b3 FROM r JOIN t ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND t.p = r.p + 1))),
z AS (SELECT conv_id, arg_max(least(s0, s3), p) AS s FROM r GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  s.c AS cost, s.a AS audit, sha256(array_to_string(s.o, chr(10))) AS repaired_sha256 FROM z LEFT JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""
