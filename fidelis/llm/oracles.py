"""SQL for the operators that SQL can express; the same rows as the queries of the same names."""

from __future__ import annotations

from fidelis.llm import mixing, secrets, substrings

# What Python takes as white space within a line.
_SPACE = r"\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


NEAR_DUPLICATES = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, count(*) AS common FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
 WHERE 100 * common >= 75 * (total - common)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, least(doc_id, coalesce(least, doc_id)) = doc_id AS kept FROM shingled LEFT JOIN roots USING (doc_id)
"""


def _kind(name: str, pattern: str, group: int) -> str:
    """Matches of one kind with their places: the gaps between them and their own lengths, summed."""
    p = _quoted(pattern)
    return f"""{name}_cut AS (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS parts FROM texts WHERE regexp_matches(t, {p})),
{name}_each AS (SELECT doc_id, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(parts) AS part, unnest(range(len(hits))) AS i FROM {name}_cut),
{name}_at AS (SELECT doc_id, hit, part, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM {name}_each)"""


# Paths of words, as one pattern where the engine follows it without recursion.
_PATH = "^/?([A-Za-z]+[0-9]{0,4}[/_=-]+)+[A-Za-z]*[0-9]{0,4}/?$"
_ALLOWED = " OR ".join(f"regexp_matches(hit, {_quoted(p)})" for p in (*secrets.ALLOW, _PATH))
_CLASS = " ".join(f"WHEN regexp_matches(hit, {_quoted(test)}) THEN {least}" for _, test, _, least in secrets.CLASSES)
_WINDOWED = f"list_max(list_transform(range(1, length(hit) - {secrets.WINDOW - 2}), lambda i: list_entropy(string_split(substr(CASE WHEN regexp_matches(hit, {_quoted(secrets.CLASSES[0][1])}) THEN lower(hit) ELSE hit END, i, {secrets.WINDOW}), ''))))"
_NAMES = "['assign', 'access', 'hex', 'entropy']"
_JOINED = f"string_agg({_NAMES}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"

SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_kind("a", secrets.ASSIGN, 2)}, {_kind("c", secrets.ACCESS, 0)}, {_kind("h", secrets.HEX, 0)}, {_kind("x", secrets.CANDIDATE, 0)},
base AS MATERIALIZED (SELECT doc_id, e - length(hit) AS s, 0 AS k, e FROM a_at WHERE length(part) >= {secrets.ASSIGN_LEAST} UNION ALL SELECT doc_id, e - length(hit), 1, e FROM c_at UNION ALL SELECT doc_id, e - length(hit), 2, e FROM h_at),
apart AS (SELECT * FROM x_at x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.e - length(x.hit) < b.e) AND NOT ({_ALLOWED})),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, e - length(hit), 3, e FROM apart WHERE {_WINDOWED} >= CASE {_CLASS} END),
said AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_entropy,
 coalesce({_JOINED} FILTER (WHERE k < 3), '') AS b, {_JOINED} AS a FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM documents LEFT JOIN said USING (doc_id)
"""

_OUTER = _quoted("".join(c for c in substrings._OUTER if c.isprintable()))


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+\z', '', 'g')"


def _words(x: str) -> str:
    return f"regexp_extract_all(trim(lower({x}), {_OUTER}), '[^{_SPACE}]+')"


SUBSTRINGS = rf"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at,
 string_split(regexp_replace(line, '([.!?]+)([{_SPACE}])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM lines),
sentences AS (SELECT doc_id, i, line_at, unnest(ss) AS part, unnest(range(len(ss))) AS j FROM placed),
offsets AS (SELECT doc_id, i, j, part, line_at + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM sentences),
counted AS (SELECT *, len({_words(_stripped('part'))}) >= {substrings.MIN_WORDS} AS long FROM offsets),
islands AS (SELECT *, CASE WHEN long THEN 2 * j + 1 ELSE -1 - sum(long::INT) OVER (PARTITION BY doc_id, i ORDER BY j) END AS island FROM counted),
joined AS (SELECT doc_id, min(place) AS place, string_agg(part, '' ORDER BY j) AS part FROM islands GROUP BY doc_id, i, island),
stripped AS (SELECT doc_id, place + length(part) - length(regexp_replace(part, '^[{_SPACE}]+', '')) AS start, {_stripped('part')} AS kept FROM joined),
worded AS (SELECT doc_id, start, start + length(kept) AS stop, {_words('kept')} AS w FROM stripped),
units AS MATERIALIZED (SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS stop, len(w) AS words, md5(array_to_string(w, ' ')) AS digest, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS nth FROM worded WHERE len(w) >= {substrings.MIN_WORDS}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY digest) AS occurrences, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start, row_number() OVER w AS copy FROM units WINDOW w AS (PARTITION BY digest ORDER BY doc_id, start, stop)),
repeats AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS island FROM ranked WHERE copy > 1),
runs AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, island) AS run_words FROM repeats)
SELECT doc_id, start, stop AS "end", words::INTEGER AS words, digest, first_doc_id, first_start, occurrences, run_words::BIGINT AS run_words FROM runs WHERE run_words >= {substrings.RUN}
"""

_ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}" for s in ("\\", "<s>", "</s>", "<|", "[INST]", "[/INST]", "|>"))

CHATS = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(text) + {_ESCAPES} + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id
"""

MIXING = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_words, CASE WHEN regexp_matches(text, '( \| [^|\n]*){{3}}') THEN 'table' WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'licence'
 WHEN regexp_matches(text, '[{{}};=]\s*\n|\b(def|class|return|import)\b') THEN 'code' WHEN length(text) < 1000 THEN 'short' ELSE 'prose' END AS topic FROM documents),
cells AS (SELECT source, lang, topic, sum(n_words)::DOUBLE AS mass FROM docs GROUP BY ALL),
shared AS (SELECT *, sum(mass) OVER () AS total, pow(sum(mass) OVER (PARTITION BY source), {mixing.TEMPERATURE}) AS ps, pow(sum(mass) OVER (PARTITION BY lang), {mixing.TEMPERATURE}) AS pl, pow(sum(mass) OVER (PARTITION BY topic), {mixing.TEMPERATURE}) AS pt FROM cells),
goals AS (SELECT source, lang, topic, mass, total, ps / (SELECT sum(p) FROM (SELECT DISTINCT source, ps AS p FROM shared)) * total AS gs, pl / (SELECT sum(p) FROM (SELECT DISTINCT lang, pl AS p FROM shared)) * total AS gl,
 pt / (SELECT sum(p) FROM (SELECT DISTINCT topic, pt AS p FROM shared)) * total AS gt FROM shared),
raked AS (SELECT 0 AS i, *, 1.0::DOUBLE AS w FROM goals UNION ALL SELECT i + 1, source, lang, topic, mass, total, gs, gl, gt, w2 * gt / sum(mass * w2) OVER (PARTITION BY topic) FROM (SELECT *, w1 * gl / sum(mass * w1) OVER (PARTITION BY lang) AS w2
 FROM (SELECT *, w * gs / sum(mass * w) OVER (PARTITION BY source) AS w1 FROM raked WHERE i < 150))),
ordered AS (SELECT *, sum(mass) OVER o AS full_mass, sum(mass * w) OVER () - sum(mass * w) OVER o AS rest, row_number() OVER o AS k FROM raked WHERE i = 150 WINDOW o AS (ORDER BY w DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
stepped AS (SELECT *, ({mixing.SHARE} * total - full_mass + mass) / (rest + mass * w) AS f FROM ordered),
factor AS (SELECT f FROM stepped WHERE f * w <= 1 ORDER BY k LIMIT 1),
plan AS (SELECT source, lang, topic, w, least(1.0::DOUBLE, w * g.f) AS p FROM ordered, factor AS g)
SELECT doc_id, source, lang, topic, n_words, round(w, 6) AS weight, round(p, 6) AS prob, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < p AS sampled FROM docs JOIN plan USING (source, lang, topic)
"""
# Unsigned CRC-32 of a text of ASCII characters: eight steps of its polynomial for each table entry, one entry a character.
_CRC = (
    "xor(list_reduce(list_transform(string_split({x}, ''), lambda k: ascii(k)::BIGINT), lambda c, k: xor(c >> 8, crc.t[(xor(c, k) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
)

SESSIONS = f"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t),
turns AS MATERIALIZED (SELECT conv_id, turn, {_CRC.format(x="conv_id::VARCHAR")} AS c, {_CRC.format(x="conv_id::VARCHAR || ':' || turn::VARCHAR")} AS h FROM conversations, crc WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
timed AS (SELECT 2 * (conv_id >> 3) + c % 2 AS "user", (c >> 1) % 7200 + 300 * turn + h % 600 AS s, h // 600 AS g, h FROM turns),
events AS MATERIALIZED (SELECT "user", s, floor(s / 900.0)::BIGINT + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b, h FROM timed),
so_far AS (SELECT k."user", k.b AS batch, e.s, e.b, e.h, e.s - lag(e.s) OVER (PARTITION BY k."user", k.b ORDER BY e.s) > 600 AS opens FROM (SELECT DISTINCT "user", b FROM events) k JOIN events e ON e."user" = k."user" AND e.b <= k.b),
runs AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY "user", batch ORDER BY s) AS run FROM so_far),
versions AS MATERIALIZED (SELECT "user", batch, min(s)::BIGINT AS start_s, max(s)::BIGINT AS end_s, count(*) AS n_events, count(*) FILTER (WHERE b = batch) AS n_new, sum(h)::BIGINT AS h_sum FROM runs GROUP BY "user", batch, run HAVING count(*) FILTER (WHERE b = batch) > 0),
ended AS MATERIALIZED (SELECT v."user", v.batch, v.start_s, min(w.batch) AS retracted_batch, arg_min(w.start_s, w.batch) AS retracted_start_s FROM versions v JOIN versions w ON w."user" = v."user" AND w.batch > v.batch AND w.start_s <= v.start_s AND w.end_s >= v.end_s GROUP BY ALL),
gone AS (SELECT "user", retracted_batch AS batch, retracted_start_s AS start_s, count(*) AS n FROM ended GROUP BY ALL)
SELECT v."user", v.batch, v.start_s, v.end_s, v.n_events, v.n_new, coalesce(g.n, 0)::BIGINT AS n_retracted, v.h_sum, e.retracted_batch, e.retracted_start_s
FROM versions v LEFT JOIN gone g USING ("user", batch, start_s) LEFT JOIN ended e USING ("user", batch, start_s)
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op3_secret_scan": SECRETS,
    "op6_substring_dedup": SUBSTRINGS,
    "op8_chat_format": CHATS,
    "op10_mixing": MIXING,
    "op12_session_merging": SESSIONS,
}
