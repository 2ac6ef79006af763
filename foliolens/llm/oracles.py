"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from foliolens.llm import secret_scan, url_reputation

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
 ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
c AS (SELECT min(doc_id) AS doc_id, g FROM s GROUP BY g), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM c),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS n, doc_id AS m FROM c UNION SELECT u.a, r.m FROM u JOIN r ON u.b = r.n),
l AS (SELECT n, min(m) AS m FROM r GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE c.doc_id END AS class_id,
 CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE l.m END AS component_id FROM s JOIN c USING (g) JOIN l ON l.n = c.doc_id"""

OP2 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
win AS (SELECT doc_id, i AS p, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) > 12)),
o AS (SELECT k, min(doc_id) AS o FROM win GROUP BY 1),
f AS (SELECT doc_id, p FROM win JOIN o USING (k) WHERE o < doc_id),
m AS (SELECT t.doc_id, t.p, word, max(f.p IS NOT NULL) OVER (PARTITION BY t.doc_id ORDER BY t.p ROWS 12 PRECEDING) AS gone FROM t LEFT JOIN f ON t.doc_id = f.doc_id AND t.p = f.p)
SELECT d.doc_id, count(word)::BIGINT AS n_words, (count(*) FILTER (gone))::BIGINT AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id) GROUP BY 1"""


def _op3() -> str:
    """The same patterns, in RE2; texts between matches and matches, laid out in order, give the places."""
    parts = []
    for no, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        part = f"regexp_extract(hit, '{p}', {r.group})" if r.group else "hit"
        parts.append(
            f"""SELECT doc_id, {no} AS no, '{r.kind}' AS kind, {str(r.base).lower()} AS base, stop - length(hit) AS start, stop FROM (
SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(string_split_regex(t, '{p}')) AS gap, unnest(generate_series(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d)
WHERE hit IS NOT NULL) WHERE length({part}) >= {r.least}"""
        )
    spans = " UNION ALL ".join(parts)
    count = ", ".join(f"(count(*) FILTER (kind = '{k}'))::BIGINT AS n_{k}" for k in ("assign", "access", "hex"))
    one = "kind || ':' || start || ':' || stop, ',' ORDER BY start, no"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({spans})
SELECT d.doc_id, {count}, sha256(coalesce(string_agg({one}) FILTER (base), '')) AS base_sha256, coalesce(string_agg({one}) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY 1"""


def _level(source: str, prior: str, out: str) -> str:
    """Counts n, k with a prior mean, shrunk."""
    lo, hi = url_reputation.RHO_LIMITS
    over, pairs = f"sum((k - n * {prior}) ** 2 - n * {prior} * (1 - {prior})) OVER ()", f"sum(n * (n - 1) * {prior} * (1 - {prior})) OVER ()"
    return f"""SELECT *, (k + s * {prior}) AS alpha, (n - k + s * (1 - {prior})) AS beta, (k + s * {prior}) / (n + s) AS {out} FROM (
SELECT *, 1 / least(greatest(coalesce(over_ / nullif(pairs_, 0), {hi}), {lo}), {hi}) - 1 AS s FROM (SELECT *, {over} AS over_, {pairs} AS pairs_ FROM ({source})))"""


def _op5() -> str:
    up, low = string.ascii_uppercase, string.ascii_lowercase
    fits = []
    for _, rule in sorted(url_reputation.RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in url_reputation.RULES)
    two = f"(?:^|\\.)((?:{'|'.join(url_reputation.SECOND_LEVEL)})\\.[a-z]{{2}})$"
    h = f"""SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, coalesce(nullif(regexp_extract(host, '{two}', 1), ''), string_split(host, '.')[-1]) AS suffix FROM j GROUP BY host"""
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{up}', '{low}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
jr AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM hp), jv AS (SELECT *, CASE rule {verdict} END AS ruled FROM jr),
j AS (SELECT *, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM jv),
h AS (SELECT *, CASE WHEN host = suffix THEN host ELSE string_split(substr(host, 1, greatest(length(host) - length(suffix) - 1, 0)::BIGINT), '.')[-1] || '.' || suffix END AS domain FROM ({h})),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2), sf AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dm GROUP BY 1),
s1 AS ({_level("SELECT *, (sum(k) OVER () + 0.5) / (sum(n) OVER () + 1) AS m0 FROM sf", "m0", "m1")}),
d1 AS ({_level("SELECT dm.*, m1 FROM dm JOIN s1 USING (suffix)", "m1", "m2")}),
h1 AS ({_level("SELECT h.*, m2 FROM h JOIN d1 USING (domain)", "m2", "rate")}),
b AS (SELECT host, rate - {url_reputation.BOUND_Z} * sqrt(alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1))) AS bound FROM h1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > {url_reputation.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN b USING (host)"""


def _op11() -> str:
    """Parts as rows; two rounds of nearest entry and floored mean, and a last assignment."""
    each = range(1, 5)

    def nearest(book: str) -> str:
        far = " + ".join(f"(x[{i}] - y[{i}]) * (x[{i}] - y[{i}])" for i in each)
        return f"SELECT vec_id, p, d, k FROM (SELECT vec_id, p, k, {far} AS d, row_number() OVER (PARTITION BY vec_id, p ORDER BY {far}, k) AS nth FROM q JOIN {book} USING (p)) WHERE nth = 1"

    def moved(book: str, given: str) -> str:
        mean = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in each)
        return f"SELECT p, k, coalesce(m, y) AS y FROM {book} LEFT JOIN (SELECT p, k, [{mean}] AS m FROM q JOIN {given} USING (vec_id, p) GROUP BY p, k) USING (p, k)"

    return f"""WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, p, list_transform(v[4 * p + 1:4 * p + 4], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM e, (SELECT unnest(generate_series(0, 15)) AS p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e), b0 AS (SELECT p, k, x AS y FROM q JOIN s USING (vec_id) WHERE k < 64),
a0 AS ({nearest("b0")}), b1 AS ({moved("b0", "a0")}), a1 AS ({nearest("b1")}), b2 AS ({moved("b1", "a1")}), a2 AS ({nearest("b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(y[1] || ',' || y[2] || ',' || y[3] || ',' || y[4], ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN e USING (vec_id), h"""


ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op2_substring_dedup": OP2, "op3_secret_scan": _op3(), "op5_url_reputation": _op5(), "op11_vector_codes": _op11()}
