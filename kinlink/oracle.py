"""The same queries in SQL for a second engine (DuckDB), put together from common table expressions."""

from __future__ import annotations

from .functions.text import ADDRESS_WORDS, LEGAL, LEGAL_VARIANT
from .plans.params import DEFAULT

_NOT_WORD = r"[^\p{L}\p{N}_]+"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _tokens(x: str) -> str:
    return _words(f"regexp_replace({x}, '{_NOT_WORD}', ' ', 'g')")


def _join(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, '{by}'), '')"


def _without(x: str, dropped: list[str]) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({_list(dropped)}, w))"


_DOCUMENTS = r"""ent AS MATERIALIZED (
    SELECT 'S' || src || '-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS entity_id,
           array_to_string(ws[1:5], ' ') AS business_name, array_to_string(ws[6:15], ' ') AS business_address,
           country, src, array_to_string(ws[6:25], ' ') AS truth_key
    FROM (SELECT doc_id, doc_id % 3 + 1 AS src, coalesce(lang, '') AS country,
                 string_split_regex(regexp_replace(coalesce(text, ''), '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g'), '[ \n\t\r]+') AS ws
          FROM documents))"""
_PARTS = """ent AS MATERIALIZED (
    SELECT 'S' || src || '-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS entity_id, p_name AS business_name,
           concat_ws(' ', p_brand, p_type, CAST(p_size AS VARCHAR)) AS business_address, p_brand AS country, src
    FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 <= 2 THEN 2 ELSE 3 END AS src FROM part))"""
_NAME, _ADDR = "replace(lower(business_name), '&', ' and ')", "lower(business_address)"
_PREP = f"""prep AS MATERIALIZED (
    SELECT *, {_join("list_sort(" + _words("nn") + ")")} AS sn, {_join(_words("nn"), "")} AS cn, {_join("list_sort(" + _words("na") + ")")} AS sa
    FROM (SELECT *, {_join(_without(_tokens(_NAME), LEGAL))} AS nn, {_join(_tokens(_NAME))} AS nnf, {_join(_tokens(_ADDR))} AS na,
                 trim(lower(country)) AS cl, substr(entity_id, 1, 2) AS source FROM ent))"""
_VNAME, _VADDR = "replace(strip_accents(lower(business_name)), '&', ' and ')", "strip_accents(lower(business_address))"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ADDRESS_WORDS.items()) + "}"
_VPREP = f"""prep AS MATERIALIZED (
    SELECT *, {_join("list_sort(" + _words("nn") + ")")} AS sn, {_join(_words("nn"), "")} AS cn, {_join("list_sort(" + _words("na") + ")")} AS sa,
           list_distinct({_words("nn")}) AS tokens, list_distinct(regexp_extract_all(na, '\\p{{Nd}}+')) AS numbers
    FROM (SELECT *, {_join(_without(_tokens(_VNAME), LEGAL_VARIANT))} AS nn, {_join(_tokens(_VNAME))} AS nnf,
                 {_join("list_transform(" + _tokens(_VADDR) + f", lambda w: coalesce(element_at({_MAP}, w)[1], w))")} AS na,
                 trim(lower(country)) AS cl FROM ent))""".replace(f"element_at({_MAP}, w)[1]", f"({_MAP})[w]")
_SIDES = "s1 AS (SELECT * FROM prep WHERE src = 1), s23 AS (SELECT * FROM prep WHERE src > 1)"
_TRUTH = """truth AS (
    SELECT a.entity_id AS entity_id_s1, b.entity_id AS entity_id_s2s3 FROM ent a JOIN ent b USING (country, truth_key)
    WHERE a.src = 1 AND b.src > 1 AND truth_key <> '')"""


def _key(name: str, key: str, tag: str, cap: int | None) -> str:
    keep = f"QUALIFY row_number() OVER (PARTITION BY country, {key} ORDER BY entity_id) <= {cap}" if cap else ""
    return f"""{name} AS (
    SELECT a.country, a.entity_id AS entity_id_s1, b.entity_id AS entity_id_s2s3, '{tag}' AS block
    FROM (SELECT country, entity_id, {key} AS k FROM s1) a JOIN (SELECT country, entity_id, {key} AS k FROM s23 {keep}) b USING (country, k) WHERE k <> '')"""


def _token(name: str, limits, tag: str) -> str:  # noqa: ANN001
    def rows(side: str) -> str:
        return f"SELECT country, tok, entity_id, count(*) AS m FROM (SELECT country, entity_id, unnest({_words('nn')}) AS tok FROM {side}) WHERE length(tok) >= {limits.min_len} GROUP BY ALL"

    return f"""{name}_r AS ({rows("s23")}), {name}_k AS (SELECT country, tok FROM {name}_r GROUP BY ALL HAVING sum(m) <= {limits.max_freq}),
{name}_l AS (SELECT * FROM ({rows("s1")}) JOIN {name}_k USING (country, tok) QUALIFY sum(m) OVER (PARTITION BY country, entity_id) >= {limits.min_shared}),
{name} AS (
    SELECT a.country, a.entity_id AS entity_id_s1, b.entity_id AS entity_id_s2s3, '{tag}' AS block, CAST(sum(a.m * b.m) AS BIGINT) AS n
    FROM {name}_l a JOIN {name}_r b USING (country, tok) GROUP BY a.country, a.entity_id, b.entity_id HAVING sum(a.m * b.m) >= {limits.min_shared}
    QUALIFY row_number() OVER (PARTITION BY a.country, a.entity_id ORDER BY sum(a.m * b.m) DESC, b.entity_id) <= {limits.cap})"""


_COMPACT = f"CASE WHEN length(cn) >= {DEFAULT.compact_min} THEN cn ELSE '' END"
_E, _S, _C = _key("e", "nn", "E", 200), _key("s", "sn", "S", 200), _key("c", _COMPACT, "C", 200)
_T, _L = _token("t", DEFAULT.tokens, "T"), _token("l", DEFAULT.rare_tokens, "L")


def _cands(cap: int) -> str:
    rows = " UNION ALL ".join(f"SELECT country, entity_id_s1, entity_id_s2s3, block FROM {x}" for x in "esctl")
    return f"""{_E}, {_S}, {_C}, {_T}, {_L}, pairs AS MATERIALIZED (
    SELECT country, entity_id_s1, entity_id_s2s3, string_agg(DISTINCT block, ',' ORDER BY block) AS block, count(DISTINCT block) AS n_blocks
    FROM ({rows}) GROUP BY country, entity_id_s1, entity_id_s2s3 QUALIFY row_number() OVER (PARTITION BY entity_id_s1 ORDER BY entity_id_s2s3) <= {cap})"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


_BASE = (_DOCUMENTS, _PREP, _SIDES)
_CANDS = _cands(DEFAULT.candidate_cap)
_VBASE = (_DOCUMENTS, _VPREP, _SIDES)


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / least(len(list_distinct({a})), len(list_distinct({b}))) ELSE 0.0 END"


def _ratio_of_lengths(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN least(length({a}), length({b})) / greatest(length({a}), length({b})) ELSE 0.0 END"


def _equal(a: str, b: str) -> str:
    return f"CAST({a} = {b} AND {a} <> '' AS DOUBLE)"


def _lcs(a: str, b: str) -> str:
    step = f"list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, CASE WHEN ca = substr({b}, j, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0::BIGINT])"
    return f"CASE WHEN {a} = {b} THEN length({a}) WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_last(list_reduce(string_split({a}, ''), lambda prev, ca: {step}, list_transform(range(0, length({b}) + 1), lambda x: 0::BIGINT))) END"


_NW, _AW = [(_words(f"a.{c}"), _words(f"b.{c}")) for c in ("nn", "na")]
_SET_FEATURES = {
    "name_exact": _equal("a.nn", "b.nn"),
    "name_sorted_exact": _equal("a.sn", "b.sn"),
    "name_jaccard": _jaccard(*_NW),
    "name_overlap": _overlap(*_NW),
    "name_lr": _ratio_of_lengths("a.nn", "b.nn"),
    "addr_exact": _equal("a.na", "b.na"),
    "addr_jaccard": _jaccard(*_AW),
    "addr_overlap": _overlap(*_AW),
    "addr_lr": _ratio_of_lengths("a.na", "b.na"),
    "addr_miss": "CAST(a.na = '' OR b.na = '' AS DOUBLE)",
    "country_eq": _equal("a.cl", "b.cl"),
    "is_s2": "CAST(starts_with(b.entity_id, 'S2') AS DOUBLE)",
    "n_blocks": "CAST(n_blocks AS DOUBLE)",
    **{f"blk_{t}": f"CAST(contains(block, '{t}') AS DOUBLE)" for t in "ESCTL"},
}
_PAIRED = "FROM pairs JOIN s1 a ON a.entity_id = entity_id_s1 JOIN s23 b ON b.entity_id = entity_id_s2s3"
_FEATURES = "SELECT entity_id_s1, entity_id_s2s3, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _SET_FEATURES.items()) + f" {_PAIRED}"
_SCORED = f"""scored AS MATERIALIZED (
    SELECT entity_id_s1, entity_id_s2s3, round(0.5 * ({_SET_FEATURES["name_jaccard"]}) + 0.2 * ({_SET_FEATURES["name_lr"]}) + 0.3 * ({_SET_FEATURES["addr_jaccard"]}), 6) AS score {_PAIRED})"""
_PREDICTED = "pred AS (SELECT entity_id_s1, entity_id_s2s3 FROM scored WHERE score >= 0.6)"


def _counts(pairs: str, by: str = "", roster: str = "SELECT entity_id AS entity_id_s1 FROM s1") -> str:
    b = f"{by}, " if by else ""
    using = f"({b}entity_id_s1)"
    return f"""counts AS (
    SELECT {b}entity_id_s1, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(n_hit, 0) AS n_hit FROM ({roster})
    LEFT JOIN (SELECT {b}p.entity_id_s1, count(*) AS n_pred, count(t.entity_id_s1) AS n_hit FROM {pairs} p
               LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.entity_id_s1 = p.entity_id_s1 AND t.entity_id_s2s3 = p.entity_id_s2s3 GROUP BY ALL) USING {using}
    LEFT JOIN (SELECT entity_id_s1, count(DISTINCT entity_id_s2s3) AS n_true FROM truth GROUP BY ALL) USING (entity_id_s1)),
f AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_hit = 0 THEN 0.0
    ELSE 1.25 * (n_hit / n_pred) * (n_hit / n_true) / (0.25 * (n_hit / n_pred) + n_hit / n_true) END AS f05 FROM counts)"""


_SUMMARY = """round(avg(f05), 6) AS macro_f05, round(CASE WHEN sum(n_pred) > 0 THEN sum(n_hit) / sum(n_pred) ELSE 0.0 END, 6) AS precision,
    round(CASE WHEN sum(n_true) > 0 THEN sum(n_hit) / sum(n_true) ELSE 0.0 END, 6) AS recall, CAST(sum(n_hit) AS BIGINT) AS tp,
    CAST(sum(n_pred) - sum(n_hit) AS BIGINT) AS fp, CAST(sum(n_true) - sum(n_hit) AS BIGINT) AS fn,
    round(CASE WHEN count(*) FILTER (WHERE n_true = 0) > 0 THEN count(*) FILTER (WHERE n_true = 0 AND n_pred = 0) / count(*) FILTER (WHERE n_true = 0) ELSE 1.0 END, 6) AS singleton_accuracy,
    count(*) AS n_entities"""
_STEPS = "(SELECT unnest([" + ", ".join(map(str, DEFAULT.thresholds)) + "]::DOUBLE[]) AS threshold)"
_SWEPT = (*_BASE, _TRUTH, _CANDS, _SCORED, f"pred AS (SELECT threshold, entity_id_s1, entity_id_s2s3 FROM scored, {_STEPS} WHERE score >= threshold)", _counts("pred", "threshold", f"SELECT threshold, entity_id AS entity_id_s1 FROM s1, {_STEPS}"))
_SWEEP = f"SELECT threshold, {_SUMMARY} FROM f GROUP BY threshold"


def _lists(pairs: str, name: str) -> str:
    return f"SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS {name} FROM s1 LEFT JOIN (SELECT entity_id_s1 AS entity_id, string_agg(DISTINCT entity_id_s2s3, ',' ORDER BY entity_id_s2s3) AS ids FROM {pairs} GROUP BY ALL) USING (entity_id)"


_TOP = _cands(5)
_FIVE = 5
_HASH = "md5(entity_id || '|42')"
_LCS_PAIRS = f"""p AS MATERIALIZED (
    SELECT DISTINCT a.nn AS a_nn, b.nn AS b_nn, a.sn AS a_sn, b.sn AS b_sn FROM s1 a JOIN
    (SELECT * FROM s23 QUALIFY row_number() OVER (PARTITION BY country, array_to_string(string_split(na, ' ')[1:3], ' ') ORDER BY entity_id) <= 200) b
    ON a.country = b.country AND array_to_string(string_split(a.na, ' ')[1:3], ' ') = array_to_string(string_split(b.na, ' ')[1:3], ' '))"""
_PART = (_PARTS, _PREP, _SIDES)


def _indel(a: str, b: str, lcs: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN 2.0 * {lcs} / (length({a}) + length({b})) ELSE 0.0 END"


_TOKEN_SET = f"""SELECT a_nn, b_nn, round(CASE WHEN a_nn = '' OR b_nn = '' THEN 0.0 WHEN s <> '' AND (l = '' OR r = '') THEN 1.0
    ELSE greatest(1 - (length(l) + length(r) - 2 * ({_lcs("l", "r")})) / (2 * (length(s) + sep) + length(l) + length(r)),
                  CASE WHEN sep = 1 THEN 1 - (1 + length(l)) / (2 * length(s) + 1 + length(l)) ELSE 0.0 END,
                  CASE WHEN sep = 1 THEN 1 - (1 + length(r)) / (2 * length(s) + 1 + length(r)) ELSE 0.0 END) END, 6) AS token_set
FROM (SELECT *, CASE WHEN s <> '' THEN 1 ELSE 0 END AS sep FROM (
    SELECT a_nn, b_nn, {_join(f"list_sort(list_distinct(list_filter({_words('a_nn')}, lambda w: list_contains({_words('b_nn')}, w))))")} AS s,
           {_join(f"list_sort(list_distinct(list_filter({_words('a_nn')}, lambda w: NOT list_contains({_words('b_nn')}, w))))")} AS l,
           {_join(f"list_sort(list_distinct(list_filter({_words('b_nn')}, lambda w: NOT list_contains({_words('a_nn')}, w))))")} AS r FROM (SELECT DISTINCT a_nn, b_nn FROM p)))"""

_VCANDS = ", ".join(
    [
        _key("m1", "nn", "exact", None),
        _key("m2", "sn", "sorted", None),
        _key("m3", "CASE WHEN length(cn) >= 5 THEN substr(cn, 1, 5) ELSE '' END", "prefix", None),
    ]
)
_VTOKEN = """vr AS (SELECT country, entity_id, unnest(tokens) AS tok FROM s23), vk AS (SELECT country, tok FROM vr GROUP BY ALL HAVING count(*) < 1000),
vl AS (SELECT *, greatest(1, least(2, count(*) OVER (PARTITION BY country, entity_id))) AS need
       FROM (SELECT country, entity_id, unnest(tokens) AS tok FROM s1) JOIN vk USING (country, tok) WHERE length(tok) > 1),
m4 AS (SELECT a.country, a.entity_id AS entity_id_s1, b.entity_id AS entity_id_s2s3, 'token' AS block, count(*) AS n
       FROM vl a JOIN vr b USING (country, tok) JOIN vk USING (country, tok) GROUP BY ALL HAVING count(*) >= max(need))"""
_VNUM_ANY = """m5 AS (SELECT DISTINCT a.country, a.entity_id AS entity_id_s1, b.entity_id AS entity_id_s2s3, 'addr_number' AS block
       FROM (SELECT country, entity_id, unnest(numbers) AS x FROM s1) a JOIN (SELECT country, entity_id, unnest(numbers) AS x FROM s23) b USING (country, x))"""
_VNUM = """m5 AS (SELECT DISTINCT a.country, a.entity_id AS entity_id_s1, b.entity_id AS entity_id_s2s3, 'addr_number' AS block
       FROM (SELECT country, entity_id, unnest(numbers) AS x FROM s1) a JOIN (SELECT country, entity_id, unnest(numbers) AS x FROM s23) b USING (country, x) WHERE length(x) >= 4)"""
_VPAIRS = f"""pairs AS (SELECT country, entity_id_s1, entity_id_s2s3, string_agg(DISTINCT block, ',' ORDER BY block) AS methods, count(DISTINCT block) AS n_methods
       FROM ({" UNION ALL ".join(f"SELECT country, entity_id_s1, entity_id_s2s3, block FROM m{i}" for i in range(1, 6))}) WHERE entity_id_s1 <> entity_id_s2s3 GROUP BY country, entity_id_s1, entity_id_s2s3
       QUALIFY row_number() OVER (PARTITION BY entity_id_s1 ORDER BY count(DISTINCT block) DESC, entity_id_s2s3) <= {_FIVE})"""



def _ratio(a: str, b: str) -> str:
    return _indel(a, b, f"({_lcs(a, b)})")


def _token_set(a: str, b: str) -> str:
    """Over the columns of the join, as a scalar subquery for each pair."""
    x, y = _words(a), _words(b)
    part = lambda p, q, there: _join(f"list_sort(list_distinct(list_filter({p}, lambda w: {there}list_contains({q}, w))))")
    whole = f"""SELECT CASE WHEN s <> '' AND (l = '' OR r = '') THEN 1.0
        ELSE greatest(1 - (length(l) + length(r) - 2 * ({_lcs("l", "r")})) / (2 * (length(s) + sep) + length(l) + length(r)),
                      CASE WHEN sep = 1 THEN 1 - (1 + length(l)) / (2 * length(s) + 1 + length(l)) ELSE 0.0 END,
                      CASE WHEN sep = 1 THEN 1 - (1 + length(r)) / (2 * length(s) + 1 + length(r)) ELSE 0.0 END) END
        FROM (SELECT *, CASE WHEN s <> '' THEN 1 ELSE 0 END AS sep FROM (SELECT {part(x, y, "")} AS s, {part(x, y, "NOT ")} AS l, {part(y, x, "NOT ")} AS r))"""
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE ({whole}) END"


_ALL_FEATURES = _SET_FEATURES | {
    "name_ratio": _ratio("a.nn", "b.nn"),
    "name_tsort": _ratio("a.sn", "b.sn"),
    "name_tset": _token_set("a.nn", "b.nn"),
    "compact_ratio": _ratio("a.cn", "b.cn"),
    "name_full_ratio": _ratio("a.nnf", "b.nnf"),
    "addr_ratio": _ratio("a.na", "b.na"),
    "addr_tsort": _ratio("a.sa", "b.sa"),
    "nx_addr": f"({_ratio('a.sn', 'b.sn')}) * ({_ratio('a.sa', 'b.sa')})",
}


def _partial(a: str, b: str) -> str:
    s, t = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    w = f"substr({t}, greatest(i, 0) + 1, i + length({s}) - greatest(i, 0))"
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN list_max(list_transform(range(1 - length({s}), length({t})), lambda i: 2.0 * ({_lcs(s, w)}) / (length({s}) + length({w})))) ELSE 0.0 END"


_VARIANT_FEATURES = {
    "name_exact": _equal("a.nn", "b.nn"),
    "name_sorted_exact": _equal("a.sn", "b.sn"),
    "name_ratio": _ratio("a.nn", "b.nn"),
    "name_partial_ratio": _partial("a.nn", "b.nn"),
    "name_token_sort": _ratio("a.sn", "b.sn"),
    "name_token_set": _token_set("a.nn", "b.nn"),
    "name_jaccard": _jaccard("a.tokens", "b.tokens"),
    "name_overlap": _overlap("a.tokens", "b.tokens"),
    "name_len_ratio": _ratio_of_lengths("a.nn", "b.nn"),
    "name_full_ratio": _ratio("a.nnf", "b.nnf"),
    "name_first_token": "coalesce(CAST(list_min(a.tokens) = list_min(b.tokens) AS DOUBLE), 0.0)",
    "compact_name_ratio": _ratio("a.cn", "b.cn"),
    "addr_exact": _equal("a.na", "b.na"),
    "addr_ratio": _ratio("a.na", "b.na"),
    "addr_token_sort": _ratio("a.sa", "b.sa"),
    "addr_jaccard": _jaccard(*_AW),
    "addr_overlap": _overlap(*_AW),
    "addr_len_ratio": _ratio_of_lengths("a.na", "b.na"),
    "addr_num_jaccard": _jaccard("a.numbers", "b.numbers"),
    "addr_num_overlap": _overlap("a.numbers", "b.numbers"),
    "addr_missing_any": "CAST(a.na = '' OR b.na = '' AS DOUBLE)",
    "addr_missing_both": "CAST(a.na = '' AND b.na = '' AS DOUBLE)",
    "country_match": _equal("a.cl", "b.cl"),
    "name_x_addr": f"({_ratio('a.sn', 'b.sn')}) * ({_ratio('a.sa', 'b.sa')})",
    "name_x_addr_jaccard": f"({_jaccard('a.tokens', 'b.tokens')}) * ({_jaccard(*_AW)})",
    "is_s2": "CAST(starts_with(b.entity_id, 'S2') AS DOUBLE)",
    "n_blocking_methods": "CAST(n_methods AS DOUBLE)",
    **{f"has_{m}_block": f"CAST(list_contains(string_split(methods, ','), '{m}') AS DOUBLE)" for m in ("exact", "sorted", "token", "prefix")},
}
_DAMAGED = """k AS (SELECT entity_id, coalesce(ids, '') AS ids, CAST(substr(entity_id, 4) AS BIGINT) // 3 % 10 AS k FROM s1
       LEFT JOIN (SELECT entity_id_s1 AS entity_id, string_agg(DISTINCT entity_id_s2s3, ',' ORDER BY entity_id_s2s3) AS ids FROM pred GROUP BY ALL) USING (entity_id)),
one AS (SELECT entity_id, k, CASE k WHEN 1 THEN ids || ',' || entity_id WHEN 2 THEN ids || ',S4-1' WHEN 3 THEN ids || ',S2-1,S2-1' ELSE ids END AS ids FROM k WHERE k <> 4),
rows AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k = 5)"""
_PAIR_ROWS = "country, entity_id_s1, entity_id_s2s3, block"
ORACLE_SQL = {
    "norm_name": _sql("SELECT entity_id, nn FROM prep", _DOCUMENTS, _PREP),
    "norm_name_full": _sql("SELECT entity_id, nnf FROM prep", _DOCUMENTS, _PREP),
    "norm_addr": _sql("SELECT entity_id, na FROM prep", _DOCUMENTS, _PREP),
    "sorted_name": _sql("SELECT entity_id, sn FROM prep", _DOCUMENTS, _PREP),
    "compact_name": _sql("SELECT entity_id, cn, cl, source FROM prep", _DOCUMENTS, _PREP),
    "gt_explode": _sql("SELECT DISTINCT * FROM truth", _DOCUMENTS, _TRUTH),
    "source_union": _sql("SELECT CAST(src AS INTEGER) AS src, country, count(*) AS n FROM ent WHERE src > 1 GROUP BY ALL", _DOCUMENTS),
    "countries": _sql("SELECT DISTINCT country FROM ent", _DOCUMENTS),
    "block_exact": _sql(f"SELECT {_PAIR_ROWS} FROM e", *_BASE, _E),
    "block_sorted": _sql(f"SELECT {_PAIR_ROWS} FROM s", *_BASE, _S),
    "block_compact": _sql(f"SELECT {_PAIR_ROWS} FROM c", *_BASE, _C),
    "token_freq": _sql("SELECT country, tok, CAST(sum(m) AS BIGINT) AS freq FROM t_r GROUP BY ALL", *_BASE, _T),
    "block_token": _sql(f"SELECT {_PAIR_ROWS}, n FROM t", *_BASE, _T),
    "block_long": _sql(f"SELECT {_PAIR_ROWS}, n FROM l", *_BASE, _L),
    "block_union": _sql(f"SELECT {_PAIR_ROWS}, n_blocks FROM pairs", *_BASE, _CANDS),
    "cand_cap": _sql(f"SELECT {_PAIR_ROWS}, n_blocks FROM pairs", *_BASE, _TOP),
    "feat_sets": _sql(_FEATURES, *_BASE, _CANDS),
    "feat_v5": _sql("SELECT entity_id_s1, entity_id_s2s3, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _ALL_FEATURES.items()) + f" {_PAIRED}", *_BASE, _CANDS),
    "feat_lcs": _sql(
        f"SELECT a_nn, b_nn, CAST(lcs AS INTEGER) AS lcs, round({_indel('a_nn', 'b_nn', 'lcs')}, 6) AS ratio, round({_indel('a_sn', 'b_sn', 'slcs')}, 6) AS token_sort FROM (SELECT *, {_lcs('a_nn', 'b_nn')} AS lcs, {_lcs('a_sn', 'b_sn')} AS slcs FROM p)",
        *_PART,
        _LCS_PAIRS,
    ),
    "feat_token_set": _sql(_TOKEN_SET, *_PART, _LCS_PAIRS),
    "labels": _sql("SELECT entity_id_s1, entity_id_s2s3, CAST((entity_id_s1, entity_id_s2s3) IN (SELECT (entity_id_s1, entity_id_s2s3) FROM truth) AS INTEGER) AS label FROM pairs", *_BASE, _TRUTH, _CANDS),
    "class_counts": _sql(
        "SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM (SELECT CAST((entity_id_s1, entity_id_s2s3) IN (SELECT (entity_id_s1, entity_id_s2s3) FROM truth) AS INTEGER) AS y FROM pairs)",
        *_BASE,
        _TRUTH,
        _CANDS,
    ),
    "entity_f05": _sql("SELECT entity_id_s1, n_pred, n_true, n_hit, round(f05, 6) AS f05 FROM f", *_BASE, _TRUTH, _CANDS, _SCORED, _PREDICTED, _counts("pred")),
    "macro_f05": _sql(f"SELECT {_SUMMARY} FROM f", *_BASE, _TRUTH, _CANDS, _SCORED, _PREDICTED, _counts("pred")),
    "cand_recall": _sql(
        "SELECT round(CASE WHEN sum(n_true) > 0 THEN sum(n_hit) / sum(n_true) ELSE 0.0 END, 6) AS recall, CAST(sum(n_hit) AS BIGINT) AS found, CAST(sum(n_true) AS BIGINT) AS n_true, round(avg(n_pred), 6) AS avg_candidates FROM counts",
        *_BASE,
        _TRUTH,
        _CANDS,
        _counts("pairs"),
    ),
    "threshold_sweep": _sql(_SWEEP, *_SWEPT),
    "best_threshold": _sql(f"SELECT * FROM ({_SWEEP}) ORDER BY macro_f05 DESC, threshold LIMIT 1", *_SWEPT),
    "results_list": _sql(_lists("pred", "matched_entity_ids"), *_BASE, _CANDS, _SCORED, _PREDICTED),
    "cand_list": _sql(_lists("pairs", "candidate_entity_ids"), *_BASE, _TOP),
    "output_summary": _sql(
        "SELECT count(*) AS n_entities, count(n) AS matched, count(*) - count(n) AS singletons, CAST(coalesce(sum(n), 0) AS BIGINT) AS links FROM s1 LEFT JOIN (SELECT entity_id_s1 AS entity_id, count(*) AS n FROM pred GROUP BY ALL) USING (entity_id)",
        *_BASE,
        _CANDS,
        _SCORED,
        _PREDICTED,
    ),
    "validate_subset": _sql(
        "SELECT count(DISTINCT entity_id_s1) AS n_entities, count(*) AS n_pairs FROM (SELECT * FROM pred EXCEPT SELECT entity_id_s1, entity_id_s2s3 FROM top)",
        *_BASE,
        _CANDS,
        _SCORED,
        _PREDICTED,
        "top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY entity_id_s1 ORDER BY entity_id_s2s3) <= 5)",
    ),
    "validate_dups": _sql(
        "SELECT entity_id, 'row' AS what FROM rows GROUP BY entity_id HAVING count(*) > 1 UNION ALL SELECT entity_id, 'id in list' AS what FROM rows WHERE trim(ids) <> '' AND len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))",
        *_BASE, _CANDS, _SCORED, _PREDICTED, _DAMAGED,
    ),
    "validate_prefix": _sql(
        "SELECT CASE WHEN starts_with(id, 'S2-') OR starts_with(id, 'S3-') THEN 'ok' WHEN starts_with(id, 'S1-') THEN 'self' ELSE 'prefix' END AS kind, count(*) AS n FROM (SELECT unnest(string_split(ids, ',')) AS id FROM rows WHERE trim(ids) <> '') GROUP BY ALL",
        *_BASE, _CANDS, _SCORED, _PREDICTED, _DAMAGED,
    ),
    "validate_coverage": _sql(
        "SELECT entity_id, 'missing' AS what FROM (SELECT entity_id FROM s1 EXCEPT SELECT entity_id FROM rows) UNION ALL SELECT entity_id, 'unexpected' AS what FROM (SELECT entity_id FROM rows EXCEPT SELECT entity_id FROM s1)",
        *_BASE, _CANDS, _SCORED, _PREDICTED, _DAMAGED,
    ),
    "feat_partial": _sql(f"SELECT a_nn, b_nn, round({_partial('a_nn', 'b_nn')}, 6) AS partial FROM (SELECT DISTINCT a_nn, b_nn FROM p)", *_PART, _LCS_PAIRS),
    "feat_mod": _sql("SELECT entity_id_s1, entity_id_s2s3, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _VARIANT_FEATURES.items()) + f" {_PAIRED}", *_VBASE, _VCANDS, _VTOKEN, _VNUM, _VPAIRS),
    "split_exact": _sql(
        f"SELECT entity_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, entity_id) <= floor(count(*) OVER () * 0.2) THEN 'validation' ELSE 'train' END AS part FROM s1", *_BASE
    ),
    "sample_per_country": _sql(f"SELECT country, entity_id FROM s1 QUALIFY row_number() OVER (PARTITION BY country ORDER BY {_HASH}, entity_id) <= 20", *_BASE),
    "sample_overall": _sql(f"SELECT entity_id FROM s1 ORDER BY {_HASH}, entity_id LIMIT 50", *_BASE),
    "inject_truth": _sql(
        f"SELECT {_PAIR_ROWS}, n_blocks FROM pairs UNION ALL SELECT a.country, entity_id_s1, entity_id_s2s3, 'G' AS block, 0 AS n_blocks FROM (SELECT * FROM truth EXCEPT SELECT entity_id_s1, entity_id_s2s3 FROM pairs) JOIN s1 a ON a.entity_id = entity_id_s1",
        *_BASE,
        _TRUTH,
        _CANDS,
    ),
    "norm_name_mod": _sql("SELECT entity_id, nn, nnf, sn, cn FROM prep", _DOCUMENTS, _VPREP),
    "addr_abbrev": _sql("SELECT entity_id, na FROM prep", _DOCUMENTS, _VPREP),
    "addr_numbers": _sql("SELECT entity_id, coalesce(array_to_string(list_sort(numbers), ','), '') AS numbers FROM prep", _PARTS, _VPREP),
    "char_ngrams": _sql(
        "SELECT entity_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, length(cn) - 1), lambda i: substr(cn, i, 3)))), ','), '') AS grams FROM prep", _PARTS, _VPREP
    ),
    "block_prefix": _sql(f"SELECT {_PAIR_ROWS} FROM m3", *_VBASE, _key("m3", "CASE WHEN length(cn) >= 5 THEN substr(cn, 1, 5) ELSE '' END", "prefix", 200)),
    "block_addr_num": _sql(f"SELECT {_PAIR_ROWS} FROM m5", _PARTS.replace("p_brand AS country", "p_name AS country"), _VPREP, _SIDES, _VNUM_ANY),
    "block_token_mod": _sql(f"SELECT {_PAIR_ROWS}, n FROM m4", *_VBASE, _VTOKEN),
    "cand_mod": _sql("SELECT country, entity_id_s1, entity_id_s2s3, methods, n_methods FROM pairs", *_VBASE, _VCANDS, _VTOKEN, _VNUM, _VPAIRS),
}
