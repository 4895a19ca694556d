"""DuckDB SQL that recomputes the queries whose results SQL can express."""

from __future__ import annotations

from .line_dedup import BLANK, FIELD, PIECE
from .secret_scan import BASE, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN first USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN pat USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
reach(a, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT link.b, reach.m FROM reach JOIN link ON link.a = reach.a)
SELECT d.doc_id, m AS class_id, coalesce(l, 0) AS n_links, coalesce(k, 0) AS n_copies
FROM d JOIN (SELECT a, min(m) AS m FROM reach GROUP BY 1) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS l, count(*) FILTER (same) AS k FROM link GROUP BY 1) c ON c.a = d.doc_id
"""

LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
piece AS (SELECT text, unnest(list_distinct(regexp_extract_all(text, '{PIECE}'))) AS p FROM d),
common AS (SELECT p FROM piece GROUP BY 1 HAVING count(*) >= 5),
copied AS (SELECT text FROM piece LEFT JOIN common ON common.p = piece.p GROUP BY 1 HAVING 6 * (count(*) - count(common.p)) < count(*)),
raw AS (SELECT doc_id, i, text, text NOT IN (SELECT text FROM copied) AS own, trim(regexp_replace(ls[i], '{BLANK}', ' ', 'g'), ' ') AS t FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
masks AS (SELECT doc_id, i, text, own, regexp_replace(t, '{FIELD}', '<*>', 'g') AS masked FROM raw),
p AS (SELECT *, string_split(masked, ' ') AS w FROM masks WHERE regexp_matches(masked, '\p{{L}}')),
known AS (SELECT masked FROM p WHERE own GROUP BY 1 HAVING count(DISTINCT text) >= 5),
rest AS (SELECT *, {{'n': len(w), 'lead': w[1:2]}} AS leaf FROM p ANTI JOIN known USING (masked) WHERE len(w) >= 4),
crowd AS (SELECT leaf FROM rest GROUP BY 1 HAVING count(*) FILTER (own) >= 5),
alike AS (SELECT doc_id, i, text, own, f, k, w[1:k] || w[k + f + 1:len(w)] AS key FROM (
  SELECT *, unnest(range(2, len(w) - f + 1)) AS k FROM (SELECT *, unnest(range(1, least(3, len(w) // 4) + 1)) AS f FROM rest SEMI JOIN crowd USING (leaf)))),
near AS (SELECT f, k, key FROM alike WHERE own GROUP BY ALL HAVING count(DISTINCT text) >= 5),
gone AS (SELECT doc_id, i FROM p SEMI JOIN known USING (masked) UNION SELECT doc_id, i FROM alike SEMI JOIN near USING (f, k, key)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, ls[i] AS x, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _rule_sql(k: int) -> str:
    rule = RULES[k]
    # RE2 can't look behind: the character before a rule that must stand alone is matched too and counted off.
    pattern = (f"(?:^|[^{rule.alone}])({rule.pattern})" if rule.alone else rule.pattern).replace("'", "''")
    group, lead = (1, "len(m) - len(g)") if rule.alone else (rule.group, "0")
    return f"""r{k} AS (SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, s + {lead} AS a, s + len(m) AS b FROM (
  SELECT doc_id, m, g, sum(len(gap)) OVER w + coalesce(sum(len(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE len(g) >= {rule.least})"""


_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(_rule_sql(k) for k in range(len(RULES)))},
span AS ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(RULES)))}),
told AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) FILTER (kind IN ({_KINDS})) AS base, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) AS spans FROM span GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)
"""

COPIES = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY p) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(p) AS text_sha256
FROM d WINDOW w AS (PARTITION BY p ORDER BY n DESC, doc_id)
"""

AUDIT = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
kinds AS (SELECT part, good, toxic, mask, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, i, 1 << (instr('ABCDE', o[i]) - 1) AS own, list_sum([1 << (instr('ABCDE', o[j]) - 1) for j in range(1, i)]) AS prior FROM orders, range(1, 6) r(i)),
counts AS (SELECT part, o, i, own,
  sum(CASE WHEN mask & own = 0 AND mask & coalesce(prior, 0) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & own > 0 AND mask & coalesce(prior, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & coalesce(prior, 0) > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN good AND mask & own > 0 AND mask & coalesce(prior, 0) = 0 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN toxic AND mask & own > 0 AND mask & coalesce(prior, 0) = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM kinds, steps GROUP BY ALL)
SELECT part, o AS filter_order, i::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts
"""


def _assigned(k: int) -> str:
    """Each part's distance to its nearest entry and that entry, as distance * 64 + entry."""
    return f"a{k} AS (SELECT vec_id, part, p.v, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.v)])::BIGINT * 64 + e) AS m FROM p JOIN c{k} c USING (part) GROUP BY ALL)"


def _moved(k: int) -> str:
    return f"""s{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT part, m % 64 AS e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM (SELECT part, m, v, unnest(range(1, len(v) + 1)) AS j FROM a{k}) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS (SELECT part, e, coalesce(s.v, c.v) AS v FROM c{k} c LEFT JOIN s{k} s USING (part, e))"""


VECTORS = f"""
WITH k AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE len(embedding) > 0 AND len([x for x in embedding if coalesce(isfinite(x), false)]) = len(embedding)),
p AS (SELECT vec_id, part, v[part * w + 1:part * w + w] AS v FROM (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(16)) AS part FROM k)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m % 64)), 2, '0'), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS h FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN k USING (vec_id), book
"""

ORACLES = {
    "op1_secret_scan": SECRETS,
    "op4_substring_dedup": SUBSTRINGS,
    "op7_ngram_join": NEAR_DUPLICATES,
    "op8_decontamination": CONTAMINATION,
    "op9_line_dedup": LINES,
    "op11_exact_dedup": COPIES,
    "op12_filter_audit": AUDIT,
    "op13_vector_codes": VECTORS,
}
