"""SQL (DuckDB) for queries that SQL can express, by plain search over everything, without any filter."""

from __future__ import annotations

from . import license_scan as ls
from . import quality_rules as qr

EMBEDDING_DEDUP = """WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.n AS a, b.n AS b FROM good a JOIN good b ON a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
 reach(a, b) AS (SELECT n, n FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 least AS (SELECT r.a AS n, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.n = r.b GROUP BY r.a),
 counts AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
 SELECT v.vec_id, coalesce(c.n_links, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
 FROM v JOIN least l USING (n) LEFT JOIN counts c USING (n)"""


def _list(words) -> str:
    return "[" + ", ".join("'" + w.decode() + "'" for w in words) + "]"


def _places(phrase: str) -> str:
    words = ls.words(phrase)
    return f"list_filter(range(1, len(words) - {len(words) - 2}), lambda i: words[i:i+{len(words) - 1}] = {_list(words)})"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TEMPLATES = ", ".join(
    f"('{label}', {_list(sorted(set(ls.words(text))))}, {len(ls.words(text))})" for label, text in ls.TEMPLATES.items()
)
_LABELLED = " || ".join(f"CASE WHEN len({_places(p)}) > 0 THEN ['{label}'] ELSE [] END" for p, label in ls.PHRASES.items())

LICENSE_SCAN = f"""WITH t(label, wanted, m) AS (VALUES {_TEMPLATES}),
 w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
 p AS (SELECT doc_id, words, {" || ".join(_places(p) for p in ls.PHRASES)} AS starts, {_LABELLED} AS base FROM w),
 b AS (SELECT doc_id, label, len(list_intersect(list_distinct(words[s + 1 : s + 2 * m]), wanted)) / len(wanted) AS share
  FROM w, t, LATERAL (SELECT unnest(range(0, len(words))) AS s) WHERE list_contains(wanted, words[s + 1])),
 met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM b WHERE share >= {ls.LEAST} GROUP BY doc_id)
 SELECT doc_id, len(words) AS n_words, len(starts) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
 FROM p LEFT JOIN met USING (doc_id)"""

# words by ASCII white space, and the rules of lines as quality_rules has them
_WORDS = "'[^\\x20\\x09-\\x0D]+'"


def _set(signs: str) -> str:
    """A regular expression's set of these characters, quotes doubled for SQL."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in signs) + "]"


_ENDED = f"'{_set(qr.ENDS)}{_set(qr.WHITE + qr.CLOSERS)}*$'"
_MENU = "[" + ", ".join(f"'{w}'" for w in qr.MENU) + "]"
_NOTICED = " OR ".join(f"contains(low, '{n}')" for n in qr.NOTICES)

QUALITY_RULES = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT n, doc_id, text, regexp_extract_all(text, {_WORDS}) AS words FROM d),
 places AS (SELECT n, words, unnest(range(1, len(words) - 1)) AS i FROM w),
 again AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, words[i], words[i + 1], words[i + 2]) AS found FROM places)
  WHERE found > 1),
 repeated AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY n),
 lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM w),
 facts AS (SELECT n, line, regexp_extract_all(line, {_WORDS}) AS held, translate(line, '{_UPPER}', '{_UPPER.lower()}') AS low,
   len(regexp_extract_all(line, '{qr.STACKED}')) AS runs FROM lines WHERE regexp_matches(line, {_WORDS})),
 bars AS (SELECT *, len(list_filter(held, lambda x: regexp_full_match(x, '{_set(qr.SEPARATORS)}+'))) AS bars FROM facts),
 ruled AS (SELECT n, line, len(list_reduce(list_prepend('', held), lambda a, b: a || b)) AS chars, CASE
   WHEN NOT regexp_matches(line, {_ENDED}) OR (runs >= 3 AND 10 * runs > 3 * len(held)) THEN 'punctuation'
   WHEN (bars >= 2 AND len(held) <= 8 * bars) OR len(list_filter(regexp_extract_all(low, {_WORDS}),
     lambda x: regexp_replace(x, '{_set(qr.ENDS)}+$', '') NOT IN {_MENU})) = 0 THEN 'navigation'
   WHEN {_NOTICED} THEN 'boilerplate' END AS rule FROM bars),
 counted AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
   count(*) FILTER (rule = 'punctuation') AS n_punctuation, count(*) FILTER (rule = 'navigation') AS n_navigation,
   count(*) FILTER (rule = 'boilerplate') AS n_boilerplate, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost_chars
  FROM ruled GROUP BY n),
 whole AS (SELECT doc_id, len(words) AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
   len(text) - len(regexp_replace(text, '{_set(qr.SYMBOLS)}', '', 'g')) AS n_symbols, coalesce(n_repeat_words, 0) AS n_repeat_words,
   coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_punctuation, 0) AS n_punctuation,
   coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate,
   coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN repeated USING (n) LEFT JOIN counted USING (n)),
 based AS (SELECT *, n_words < {qr.LEAST_WORDS} OR 100 * n_repeat_words > {qr.MOST_REPEATED} * n_words AS base_failed FROM whole)
 SELECT *, NOT base_failed AND 100 * lost_chars <= {qr.MOST_LOST} * word_chars AS kept FROM based"""

# CRC-32 of an ASCII text, bit by bit
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT),
   lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


def _least(*ways: str) -> str:
    """The cheapest of (cost, audit) pairs, the least audit among equals; null ways can't be gone."""
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _after(letter: str, cost: str, to: str, allowed: str = "true") -> str:
    return f"CASE WHEN {allowed} AND {to} IS NOT NULL THEN {{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a}} END"


def _step(role: str, keeps: dict[str, str], next_: str, own: str) -> str:
    ways = [_after("D", "3", own), _after("R", "2 + cut", next_, "NOT gone")]
    ways += [_after("K", "cut", to, f"NOT gone AND initial = '{initial}'") for initial, to in keeps.items()]
    return f"{_least(*ways)} AS {role}"


# states: b nothing, s system, u user, t assistant last; w_ with inserts before the rest
_INSERTED = f"""SELECT conv, i, {_least("b", _after("I", "2", "u"), _after("II", "4", "t"))} AS b,
  {_least("s", _after("I", "2", "u"), _after("II", "4", "t"))} AS s, {_least("u", _after("I", "2", "t"), _after("II", "4", "u"))} AS u,
  {_least("t", _after("I", "2", "u"), _after("II", "4", "t"))} AS t"""
_PAIR = "STRUCT(c BIGINT, a VARCHAR)"

CONVERSATION_REPAIR = f"""WITH RECURSIVE given AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 fated AS (SELECT *, {_CRC} % 20 AS fate FROM given),
 hurt AS (SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated),
 ordered AS (SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS body,
   row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS seen,
   lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM ordered),
 faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ranked),
 rows_of AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut FROM faulty),
 counted AS (SELECT conv, count(*) AS n, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated,
   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_of GROUP BY conv),
 ends AS (SELECT conv, n AS i, {{'c': 0, 'a': ''}}::{_PAIR} AS b, NULL::{_PAIR} AS s, NULL::{_PAIR} AS u, {{'c': 0, 'a': ''}}::{_PAIR} AS t FROM counted),
 best(conv, i, b, s, u, t) AS ({_INSERTED} FROM ends UNION ALL {_INSERTED} FROM (
  SELECT best.conv, best.i - 1 AS i, {_step("b", {"s": "best.s", "u": "best.u"}, "best.u", "best.b")},
   {_step("s", {"u": "best.u"}, "best.u", "best.s")}, {_step("u", {"a": "best.t"}, "best.t", "best.u")},
   {_step("t", {"u": "best.u"}, "best.u", "best.t")}
  FROM best JOIN rows_of r ON r.conv IS NOT DISTINCT FROM best.conv AND r.i = best.i)),
 found AS (SELECT conv, b.c AS cost, b.a AS audit FROM best WHERE i = 0),
 letters AS (SELECT conv, audit, p, substr(audit, p, 1) AS letter, p - len(replace(substr(audit, 1, p), 'I', '')) AS inserted
  FROM (SELECT conv, audit, unnest(range(1, len(audit) + 1)) AS p FROM found)),
 matched AS (SELECT l.conv, l.p, l.letter, r.role, r.text,
   row_number() OVER (PARTITION BY l.conv ORDER BY l.p) AS place,
   count(*) FILTER (letter = 'K' AND r.initial = 's') OVER (PARTITION BY l.conv) AS systems
  FROM letters l LEFT JOIN rows_of r ON r.conv IS NOT DISTINCT FROM l.conv AND l.letter <> 'I' AND r.i = l.p - l.inserted
  WHERE l.letter <> 'D'),
 repaired AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END
   || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS hash FROM matched GROUP BY conv)
 SELECT g.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(hash, sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv FROM given) g LEFT JOIN counted c ON c.conv IS NOT DISTINCT FROM g.conv
  LEFT JOIN found f ON f.conv IS NOT DISTINCT FROM g.conv LEFT JOIN repaired r ON r.conv IS NOT DISTINCT FROM g.conv"""
