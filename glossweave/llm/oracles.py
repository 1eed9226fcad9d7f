"""DuckDB SQL that says the same as queries over documents and conversations.

Tokenizers, XXH64, gradients and template trees have no SQL: those operators are
compared with brute force in the tests.
"""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM s JOIN twice USING (h)),
p AS (SELECT r, i, word, max(started) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM (SELECT d.r, i, word, hit.i IS NOT NULL AS started FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) d LEFT JOIN hit USING (r, i)))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM p GROUP BY r) USING (r)
"""

#: The limit has a closed form: passes of the smallest source over those of the largest are (largest / smallest share) ** (1 - exponent).
TEMPERATURE_MIXING = rf"""
WITH d AS (SELECT doc_id, source, greatest(len({_WORDS.format("coalesce(text, '')")}), 1)::BIGINT AS tokens, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS t FROM d GROUP BY source),
p AS (SELECT source, t, t / (SELECT sum(t) FROM s)::DOUBLE AS share FROM s),
a AS (SELECT CASE WHEN max(share) = min(share) THEN 0.0 ELSE greatest(0.0, 1 - ln(2.0) / ln(max(share) / min(share))) END AS a FROM p),
w AS (SELECT source, t, pow(share, a) AS raw FROM p, a),
q AS (SELECT source, t, round(raw / (SELECT sum(raw) FROM w) * ((SELECT sum(raw) FROM w) * (SELECT max(t / raw) FROM w)))::BIGINT AS quota FROM w),
r AS (SELECT source, t, CASE WHEN abs(quota - t) <= 1 THEN t ELSE quota END AS quota FROM q),
e AS (SELECT d.doc_id, d.source, d.tokens, d.digest, r.t, r.quota, unnest(range(0, greatest(ceil(r.quota / r.t::DOUBLE)::BIGINT, 1)))::INT AS pass FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE r.quota > 0),
k AS (SELECT *, ('0x' || substr(md5('17|' || pass || '|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), 1, 15))::BIGINT AS key FROM e),
o AS (SELECT *, pass * t + coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM k)
SELECT doc_id, source, tokens, pass, least(floor(place * 64 / quota), 63)::INT AS block, key FROM o WHERE place < quota
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<', '<\')"
CHAT_FORMAT = rf"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|body|><|end|>') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

LINE_QUALITY = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT r, source, text, no, line, {_WORDS.format("line")} AS lw, array_to_string({_WORDS.format(_LOW.replace("coalesce(text, '')", "line"))}, ' ') AS norm
                   FROM (SELECT r, source, text, unnest(lines) AS line, unnest(range(0, len(lines))) AS no FROM d)),
common AS (SELECT source, norm FROM l WHERE norm <> '' GROUP BY source, norm HAVING count(DISTINCT text) > 20),
marked AS (SELECT l.*, common.norm IS NOT NULL AS gone FROM l LEFT JOIN common ON l.source IS NOT DISTINCT FROM common.source AND l.norm = common.norm),
byline AS (SELECT r, count(*) FILTER (norm <> '') - count(DISTINCT CASE WHEN norm <> '' THEN line END) AS dups, coalesce(sum(len(lw)) FILTER (gone), 0) AS gone_words, count(*) FILTER (gone) AS n_gone FROM marked GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(0, 8) t(j) GROUP BY r),
m AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(n_gone, 0)::INT AS n_common_lines, (len(w) - coalesce(gone_words, 0))::BIGINT AS words_left
      FROM d LEFT JOIN byline USING (r) LEFT JOIN cover ON cover.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= 20 AND words_left >= n_words * 0.2 AS kept, n_common_lines, words_left FROM m
"""

DECONTAMINATION = rf"""
WITH item AS (SELECT item_id::VARCHAR AS id, {_ALNUM.format(_LOW)} AS w FROM benchmark),
win AS (SELECT DISTINCT id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(_LOW)} AS w FROM documents),
hit AS MATERIALIZED (SELECT r, i, win.k, id FROM (SELECT r, ks.k, i, array_to_string(w[i : i + ks.k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM win) ks, LATERAL (SELECT unnest(range(1, len(w) - ks.k + 2)) AS i)) p JOIN win ON p.k = win.k AND p.s = win.s),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
