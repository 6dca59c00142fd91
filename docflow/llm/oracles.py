"""Expected results of those corpus queries that SQL can express.

The others (learned models, a tokenizer, XXH64 and peeled sketches) are compared
with plain versions in tests/llm.
"""

from __future__ import annotations

from docflow.llm import mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s) x),
placed AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM windows) k WHERE len(w) >= n) x),
found AS (SELECT p.doc_id, p.i, p.n, k.item FROM placed p JOIN windows k ON k.n = p.n AND k.win = p.win),
hit AS (
  SELECT doc_id, COUNT(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place
    FROM (SELECT DISTINCT doc_id, i, n FROM found) f) x
  GROUP BY doc_id),
items AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
  coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
    FROM w, (SELECT unnest(range(1, 6)) AS k) x WHERE len(w) >= k) y),
f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a
  FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
inner_parts AS (
  SELECT lang, a, w, s, unnest(range(1, k - s + 2)) AS i
  FROM (SELECT *, unnest(range(2, k)) AS s FROM f WHERE k > 2) x),
covered AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM inner_parts GROUP BY 1, 2),
kept AS (
  SELECT f.* FROM f LEFT JOIN covered c ON c.lang = f.lang AND c.phrase = f.phrase
  WHERE f.k > 1 AND (c.longer IS NULL OR 100 * c.longer < 100 * f.a)),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS left_part,
    array_to_string(w[c + 1 : k], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept) x),
scored AS (
  SELECT cuts.*, l.a AS l, r.a AS r, n.n,
    CAST((CAST(1000 AS HUGEINT) * cuts.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = left_part
    JOIN f r ON r.lang = cuts.lang AND r.phrase = right_part JOIN n ON n.lang = cuts.lang),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

_MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]", "[ESC]")


def _escaped(column: str) -> str:
    sql = f"replace({column}, '&', '&amp;')"
    for mark in _MARKS:
        entity = {"<": "&lt;", "[": "&#91;"}[mark[0]] + mark[1:]
        sql = f"replace({sql}, '{mark}', '{entity}')"
    return sql


_HOLDS = " OR ".join(f"contains(role, '{m}') OR contains(text, '{m}')" for m in _MARKS)

CHAT = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, bool_or({_HOLDS}) AS clash FROM r GROUP BY conv_id),
t AS (
  SELECT r.conv_id, r.turn, r.role, r.text, c.clash,
    CASE r.role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
      ELSE 23 + length(CASE WHEN c.clash THEN {_escaped("r.role")} ELSE r.role END) END
    + length(CASE WHEN c.clash THEN {_escaped("r.text")} ELSE r.text END) AS chars
  FROM r JOIN c ON c.conv_id = r.conv_id)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT)
    AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
    ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(SUM(chars) + 3 + CASE WHEN bool_or(clash) THEN 5 ELSE 0 END AS BIGINT) AS formatted_chars,
  CASE WHEN bool_or(clash) THEN 1 ELSE 0 END AS escape_level
FROM t GROUP BY conv_id"""

_GRID = 1 << mixing.GRID_BITS


def _bisection(name: str, test: str) -> str:
    """The smallest grid number from which on ``test`` of (z, s, high, mark) holds."""
    z = f"list_sum(list_transform(p.ps, lambda x: pow(x, mid / {_GRID}.0)))"
    s = f"list_sum(list_transform(p.ps, lambda x: pow(x, mid / {_GRID}.0) * ln(x)))"
    high = f"list_max(list_transform(p.ps, lambda x: pow(x, mid / {_GRID}.0 - 1)))"
    condition = test.format(z=z, s=s, high=high, a=f"(mid / {_GRID}.0)")
    return f"""
{name}(low, high) AS (
  SELECT 0, {_GRID + 1}
  UNION ALL
  SELECT CASE WHEN holds THEN low ELSE mid + 1 END, CASE WHEN holds THEN mid ELSE high END
  FROM (SELECT b.low, b.high, b.mid, {condition} AS holds
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM {name}) b, packed p
    WHERE b.low < b.high) x)"""


def _hash(turn: str, key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({turn} AS VARCHAR) || '|' || {key}), 1, 15) AS BIGINT)"


_RECIPE = mixing.Recipe()
MIX = f"""
WITH RECURSIVE rows_v AS (
  SELECT doc_id, source, coalesce(source, '') AS mix_source, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
    coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS n FROM documents),
sizes AS (SELECT mix_source, CAST(SUM(n) AS BIGINT) AS tokens FROM rows_v GROUP BY mix_source),
total AS (SELECT CAST(SUM(tokens) AS BIGINT) AS t FROM sizes),
shares AS (SELECT mix_source, tokens, tokens / CAST(t AS DOUBLE) AS p FROM sizes, total WHERE tokens > 0),
packed AS (SELECT list(p) AS ps, COUNT(*) AS n FROM shares),
{_bisection("ent", f"ln({{z}}) - {{a}} * {{s}} / {{z}} < {_RECIPE.entropy} * ln(p.n)")},
{_bisection("rep", f"{{high}} / {{z}} <= {_RECIPE.max_passes} * (1 + 1e-12)")},
chosen AS (
  SELECT greatest(
    greatest(0, least({_GRID}, (SELECT MAX(low) FROM ent WHERE low >= high) - 1)),
    least({_GRID}, (SELECT MAX(low) FROM rep WHERE low >= high))) / {_GRID}.0 AS a),
powers AS (SELECT s.*, pow(p, a) AS q FROM shares s, chosen),
weights AS (SELECT mix_source, tokens, q / (SELECT SUM(q) FROM powers) AS weight FROM powers),
quotas AS (
  SELECT w.*, CAST(floor(weight * t * (1 + 1e-12) + 1e-6) AS BIGINT) AS quota FROM weights w, total),
plan AS (
  SELECT mix_source, quota // tokens AS whole, quota % tokens AS part,
    quota / CAST(tokens AS DOUBLE) AS passes FROM quotas
  UNION ALL SELECT mix_source, 1, 0, 1.0 FROM sizes WHERE tokens = 0),
lasts AS (
  SELECT r.mix_source, p.part, {_hash("p.whole + 1", "r.k", "pass")} AS h, r.n
  FROM rows_v r JOIN plan p ON p.mix_source = r.mix_source WHERE p.part > 0),
sums AS (
  SELECT mix_source, part, h, SUM(n) OVER (PARTITION BY mix_source ORDER BY h
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM lasts),
cuts AS (SELECT mix_source, MAX(h) AS last_hash FROM sums WHERE until <= part GROUP BY mix_source),
taken AS (
  SELECT r.doc_id, r.source, r.k, r.n, p.whole, p.passes, unnest(range(1, 1 + p.whole
    + CASE WHEN {_hash("p.whole + 1", "r.k", "pass")} <= c.last_hash THEN 1 ELSE 0 END)) AS mix_pass
  FROM rows_v r JOIN plan p ON p.mix_source = r.mix_source
  LEFT JOIN cuts c ON c.mix_source = r.mix_source),
blocks AS (SELECT greatest(1, CAST(ceil(t / {_RECIPE.block_tokens}.0) AS BIGINT)) AS n_blocks FROM total),
dealt AS (
  SELECT t.*, least(CAST(floor((mix_pass - 1 + {_hash("mix_pass", "k", "pass")} / {float(1 << 60)})
      / greatest(passes, CAST(whole AS DOUBLE)) * n_blocks) AS BIGINT), n_blocks - 1) AS mix_block,
    {_hash("mix_pass", "k", "rank")} AS h
  FROM taken t, blocks)
SELECT doc_id, source, mix_pass, n AS mix_tokens, mix_block,
  ROW_NUMBER() OVER (PARTITION BY mix_block ORDER BY h, doc_id NULLS FIRST, mix_pass,
    source NULLS FIRST, n) AS mix_rank
FROM dealt"""

ORACLES = {
    "op1_mix_sources": MIX,
    "op4_chat_format": CHAT,
    "op9_decontaminate": DECONTAMINATE,
    "op12_collocations": COLLOCATIONS,
}
