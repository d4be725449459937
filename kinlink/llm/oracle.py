"""SQL (DuckDB) of the text operators that SQL can express."""

from __future__ import annotations

from .chat import OP4_SQL
from .secrets import ENCODINGS, NUMBER_EQUAL, STEPS, TEXT_CHANGES, TEXT_EQUAL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (
    SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""

OP8_SQL = rf"""
WITH d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS MATERIALIZED (
    SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p : p + 9], ' '))) AS g
    FROM i WHERE len(w) > 0
), x AS MATERIALIZED (
    SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k
), h AS MATERIALIZED (
    SELECT doc_id, p, k, item FROM (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM x) JOIN v USING (k, g)
), hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ANYCASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = rf"""(?:{_ANYCASE})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = rf"""^(?:{_ANYCASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, place: int, pattern: str, keep: str = "true") -> str:
    """doc_id, start, place, end, kind, value of a pattern's matches; the texts between them give the places."""
    return f"""SELECT doc_id, CAST(e - length(m) AS INTEGER) AS "start", {place} AS place, CAST(e AS INTEGER) AS "end", '{kind}' AS kind, m FROM (
        SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
            SELECT doc_id, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {keep}"""


def _tail(z: str) -> str:
    """P(Z > z), the same approximation as the operator's."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    series = "0.0"
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = f"(({series} + {c}) * {t})"
    tail = f"({series} * exp(-({z}) * ({z}) / 2) / 2.5066282746310002)"
    return f"(CASE WHEN ({z}) >= 0 THEN {tail} ELSE 1 - {tail} END)"


_SQUEEZE = "regexp_replace(regexp_replace({0}, '1+', '1', 'g'), '0+', '0', 'g')"
_CLASSES = "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[+/]', '', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g'), 'Aa', 'a')"
_LETTERS = f"regexp_replace(regexp_replace(regexp_replace({_CLASSES}, 'A+', 'A', 'g'), 'a+', 'a', 'g'), '0+', '0', 'g')"

OP1_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents
), fixed AS MATERIALIZED (
    {_spans("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6")}
    UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]{16,}")}
    UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}")}
), c0 AS ({_spans("random", 3, "[A-Za-z0-9+/_-]{20,}={0,2}")}
), c1 AS (SELECT *, regexp_replace(rtrim(m, '='), '[-_]', '/', 'g') AS s FROM c0
), c2 AS (
    SELECT *, CAST(length(s) AS DOUBLE) AS n, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN '{a}'" for _, p, a in ENCODINGS[:-1])} ELSE '{ENCODINGS[-1][2]}' END AS alphabet FROM c1
), c3 AS (
    SELECT *, CAST(length(alphabet) AS DOUBLE) AS size, list_transform(string_split(s, ''), lambda x: CAST(instr(alphabet, x) AS DOUBLE)) AS xs,
        list_sum(list_transform(list_distinct(string_split(s, '')), lambda x: pow(n - length(replace(s, x, '')), 2.0))) AS squares FROM c2
), c4 AS (
    SELECT *, size / n * squares - n AS chi, size - 1 AS k, array_to_string(list_transform(xs, lambda x: CASE WHEN x > size / 2 THEN '1' ELSE '0' END), '') AS bits,
        list_transform(xs, lambda x: x - list_sum(xs) / n) AS moved, greatest(CAST(length({_LETTERS}) AS DOUBLE) - 1, 0) AS changes,
        greatest(CAST(length(regexp_replace(s, '[+/]', '', 'g')) AS DOUBLE) - 1, 1) AS places, length(alphabet) = 10 AS number, n * (n - 1) / 2 AS pairs FROM c3
), c5 AS (
    SELECT *, CAST(length(replace(bits, '0', '')) AS DOUBLE) AS ones, CAST(length({_SQUEEZE.format("bits")}) AS DOUBLE) AS runs,
        list_sum(list_transform(moved, lambda x: x * x)) AS variance,
        list_sum(list_transform(range(1, CAST(n AS BIGINT)), lambda i: moved[i] * moved[i + 1])) AS lag,
        greatest(least(changes / places, 1 - 1e-9), 1e-9) AS rate,
        CASE WHEN number THEN {NUMBER_EQUAL[0]} ELSE {TEXT_EQUAL[0]} END AS two, CASE WHEN number THEN {NUMBER_EQUAL[1]} ELSE {TEXT_EQUAL[1]} END AS three FROM c4
), c6 AS (
    SELECT *, 2 * ones * (n - ones) / n + 1 AS mean FROM c5
), c7 AS (
    SELECT *, (mean - 1) * (mean - 2) / (n - 1) AS spread,
        {_tail("((pow(greatest(chi / k, 1e-9), 1.0 / 3) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k)))")} AS p_chi,
        CASE WHEN variance > 0 THEN 2 * {_tail("abs(lag / variance * sqrt(n) + 1 / sqrt(n))")} ELSE 0.0 END AS p_serial,
        {_tail("((pairs * two - (squares - n) / 2) / sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * three))")} AS p_equal,
        CASE WHEN rate > {TEXT_CHANGES} THEN exp(-places * (rate * ln(rate / {TEXT_CHANGES}) + (1 - rate) * ln((1 - rate) / (1 - {TEXT_CHANGES})))) * least(1.0, rate * (1 - {TEXT_CHANGES}) / ((rate - {TEXT_CHANGES}) * sqrt(2 * 3.141592653589793 * places * rate * (1 - rate)))) ELSE 1.0 END AS bound FROM c6
), c8 AS (
    SELECT *, least(1.0, 3 * least(p_chi, p_serial, CASE WHEN spread > 0 THEN 2 * {_tail("abs(runs - mean) / sqrt(spread)")} ELSE 0.0 END)) AS p_random,
        greatest(p_equal * bound, 1e-300) AS evidence FROM c7
), c9 AS (SELECT *, CAST(floor(-{STEPS} * log10(greatest(evidence * (1 - ln(evidence)) / n, 1e-300))) AS INTEGER) AS step FROM c8
), steps AS (
    SELECT step, sum(tests) OVER (ORDER BY step DESC) AS found, sum(tests) OVER () AS tests, sum(n) OVER () AS n FROM (SELECT step, count(*) AS tests, sum(n) AS n FROM c9 GROUP BY step)
), cut AS (SELECT min(step) AS cut FROM steps WHERE n / tests * pow(10, -step / {STEPS}.0) <= 0.01 * found / tests
), every_span AS (
    SELECT doc_id, "start", place, "end", kind FROM fixed
    UNION ALL SELECT doc_id, "start", place, "end", kind FROM c9 WHERE p_random >= 1e-3 AND step >= (SELECT cut FROM cut)
        AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.doc_id = c9.doc_id AND f."start" < c9."end" AND c9."start" < f."end")
), lists AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", place) FILTER (WHERE kind <> 'random') AS base,
        string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", place) AS spans FROM every_span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (doc_id)
"""

ORACLE_SQL = {"op1_secret_scan": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_benchmark_decontamination": OP8_SQL}
