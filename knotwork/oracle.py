"""DuckDB SQL for the queries: one chain of common table expressions, and what each query selects from it."""

from __future__ import annotations

from knotwork.functions import tables as T


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


DBA = r"\b(?:doing business as|d\s*/\s*b\s*/\s*a|d\.b\.a\.?|dba|trading as|t/a|a\.k\.a\.?|aka)\b"


def leet(t: str) -> str:
    n = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"
    return f"CASE WHEN regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '[^0-9]') AND {n} <= 2 AND length({t}) - {n} >= 4 THEN translate({t}, '{T.LEET_FROM}', '{T.LEET_TO}') ELSE {t} END"


def null_text(s: str) -> str:
    return rf"regexp_replace(lower({s}), '<\s*null\s*>|\bn/a\b|\bnull\b|\bnone\b', ' ', 'g')"


def address(s: str) -> str:
    out = f"(' ' || regexp_replace(regexp_replace({null_text(s)}, '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g') || ' ')"
    for full, code in [*T.US_STATES.items(), *T.IN_STATES.items()]:
        if " " in full:
            out = rf"regexp_replace({out}, '\b{full}\b', '{code}', 'g')"
    word = leet("t")
    for d in (T.US_STATES, T.IN_STATES, T.ADDRESS_WORDS):
        word = f"list_transform([{word}], lambda w: coalesce({_map(d)}[w], w))[1]"
    plain = "coalesce(nullif(ltrim(regexp_extract(t, '^([0-9]+)', 1), '0'), ''), '0')"
    suffix = "regexp_extract(t, '^[0-9]+([a-z]{0,3})$', 1)"
    one = f"CASE WHEN regexp_matches(t, '^[0-9]+[a-z]{{0,3}}$') THEN CASE WHEN {suffix} IN ('', 'st', 'nd', 'rd', 'th') THEN [{plain}] ELSE [{plain}, {suffix}] END ELSE list_filter([{word}], lambda w: NOT list_contains({_list(T.ADDRESS_FILLER)}, w)) END"
    return f"flatten(list_transform(list_filter(regexp_split_to_array({out}, ' +'), lambda x: x <> ''), lambda t: {one}))"


def core(tokens: str) -> str:
    kept = f"list_filter({tokens}, lambda x: NOT list_contains({_list(T.LEGAL_WORDS)}, x))"
    return f"CASE WHEN len({kept}) = 0 THEN {tokens} ELSE {kept} END"


def _cosine(name: str, terms: str, to: str, min_df: int = 1, max_df: float = 0.3) -> dict[str, str]:
    tf = lambda side: f"SELECT id, country, term, count(*) AS tf FROM (SELECT id, country, unnest({terms}) AS term FROM {side}) GROUP BY ALL"
    w = lambda t: f"SELECT id, country, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, country, term, (1 + ln(tf)) * idf AS w FROM {t} JOIN {name}_idf USING (country, term))"
    return {
        f"{name}_s": tf("s1n"), f"{name}_q": tf("qn"),
        f"{name}_idf": f"SELECT country, term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT country, term, count(*) AS df FROM {name}_s GROUP BY ALL) JOIN (SELECT country, count(*) AS n FROM s1n GROUP BY ALL) USING (country) WHERE df >= {min_df} AND df <= {max_df} * n",
        f"{name}_ws": w(f"{name}_s"), f"{name}_wq": w(f"{name}_q"),
        f"{name}_cos": f"SELECT q.id AS q_id, s.id AS s_id, country, round(sum(q.w * s.w), 6) AS {to} FROM {name}_wq q JOIN {name}_ws s USING (country, term) GROUP BY ALL",
    }


CTES: dict[str, str] = {
    "toks": "SELECT doc_id, lang AS country, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents",
    "rec": "SELECT 'S' || (doc_id % 3 + 1) AS src, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, doc_id, country, array_to_string(t[1:4], ' ') AS business_name, array_to_string(t[5:12], ' ') AS business_address FROM toks",
    "truth": "SELECT q.doc_id AS q_id, min(s.doc_id) AS s_id FROM rec q JOIN rec s USING (country, business_name, business_address) WHERE q.src <> 'S1' AND s.src = 'S1' GROUP BY 1",
    "traded": f"SELECT *, CASE WHEN trim(r) <> '' THEN trim(r) ELSE business_name END AS trade FROM (SELECT *, regexp_extract(business_name, '(?s)^.*?{DBA}(.*)$', 1) AS r FROM rec)",
    "norm0": f"SELECT src, doc_id AS id, country, business_name, business_address, starts_with(business_name, '#') AS is_domain, regexp_matches(business_name, '[\\x{{0900}}-\\x{{0D7F}}]') AS has_indic, trim(business_address) = '' AS addr_missing, list_transform(list_filter(string_split(trade, ' '), lambda x: x <> ''), lambda t: {leet('t')}) AS tokens, {address('business_address')} AS addr FROM traded",
    "norm": f"SELECT *, list_filter(addr, lambda t: regexp_matches(t, '^[a-z]{{2,}}$')) AS alpha, {core('tokens')} AS ctok, array_to_string({core('tokens')}, ' ') AS core, list_filter(addr, lambda t: regexp_matches(t, '^[0-9]+$')) AS numbers FROM norm0",
    "normg": "SELECT *, CASE WHEN length(x) < 3 THEN [] ELSE list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) END AS grams FROM (SELECT *, '<' || replace(core, ' ', '') || '>' AS x FROM norm)",
    "s1n": "SELECT * FROM normg WHERE src = 'S1'",
    "qn": "SELECT * FROM normg WHERE src <> 'S1'",
    **_cosine("nm", "grams", "cos_name"),
    **_cosine("ad", "addr", "cos_addr"),
    "comb": "SELECT q_id, s_id, country, coalesce(cos_name, 0.0) AS cos_name, coalesce(cos_addr, 0.0) AS cos_addr, round(0.5 * coalesce(cos_name, 0.0) + 0.5 * coalesce(cos_addr, 0.0), 7) AS cos_comb FROM nm_cos FULL JOIN ad_cos USING (q_id, s_id, country)",
    "cand": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos_comb DESC, s_id) AS rank FROM comb) WHERE rank <= 10",
    "scored": "SELECT *, round(least(greatest(0.6 * cos_name + 0.4 * cos_addr, 0.001), 0.999), 6) AS p FROM cand",
    "r3": "SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, s_id) AS r FROM scored",
    "top3": "SELECT q_id, max(s_id) FILTER (r = 1) AS s_id, max(p) FILTER (r = 1) AS p1, max(s_id) FILTER (r = 2) AS s_2, coalesce(max(p) FILTER (r = 2), 0.0) AS p2, coalesce(max(p) FILTER (r = 3), 0.0) AS p3 FROM r3 WHERE r <= 3 GROUP BY q_id",
    "pred": "SELECT q_id, s_id, p1 FROM top3 WHERE p1 >= 0.7",
    "ents": "SELECT id AS s_id, country FROM s1n",
    "cnt": "SELECT e.s_id, e.country, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM ents e LEFT JOIN (SELECT s_id, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM (SELECT s_id, coalesce(a.t, 0) AS t, coalesce(b.p, 0) AS p FROM (SELECT q_id, s_id, 1 AS t FROM truth) a FULL JOIN (SELECT q_id, s_id, 1 AS p FROM pred) b USING (q_id, s_id)) GROUP BY s_id) USING (s_id)",
    "cntf": "SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END AS f FROM cnt",
    "pairs": "SELECT c.q_id, c.s_id, c.country, c.rank, c.cos_name, c.cos_addr, c.cos_comb, q.src AS qsrc, q.is_domain, q.has_indic, q.addr_missing, q.ctok AS qct, s.ctok AS sct, q.alpha AS qal, s.alpha AS sal, q.core AS qc, s.core AS sc, q.business_name AS qname, s.business_name AS sname, q.business_address AS qa, s.business_address AS sa, q.tokens AS qt, s.tokens AS st, q.addr AS qad, s.addr AS sad, q.numbers AS qnum, s.numbers AS snum FROM cand c JOIN qn q ON q.id = c.q_id JOIN s1n s ON s.id = c.s_id",
}

_IDF = lambda tokens: f"SELECT country, token, round(greatest(least(ln(n) - ln(1 + df), 12.0), 0.0), 6) AS idf FROM (SELECT country, token, count(*) AS df FROM (SELECT country, unnest(list_distinct({tokens})) AS token FROM s1n) GROUP BY ALL) JOIN ncty USING (country)"
_HASH = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
_F = "CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END"


def weighted(q: str, s: str, idf: str) -> str:
    tokens = f"SELECT q_id, s_id, country, {q} AS q, {s} AS s, unnest(list_distinct(list_concat({q}, {s}))) AS token FROM pairs"
    each = f"SELECT t.q_id, t.s_id, list_contains(t.q, t.token) AS a, list_contains(t.s, t.token) AS b, coalesce(i.idf, c.unseen) AS w FROM ({tokens}) t LEFT JOIN {idf} i USING (country, token) JOIN ncty c USING (country)"
    return f"SELECT q_id, s_id, sum(CASE WHEN a AND b THEN w ELSE 0 END) AS sh, sum(CASE WHEN a THEN w ELSE 0 END) AS qs, sum(CASE WHEN b THEN w ELSE 0 END) AS ss, coalesce(max(CASE WHEN a AND NOT b THEN w END), 0.0) AS qo, coalesce(max(CASE WHEN b AND NOT a THEN w END), 0.0) AS so, sum((a AND NOT b AND w >= 6)::INT)::BIGINT AS qr FROM ({each}) GROUP BY 1, 2"


def swept(pred: str, grid: str, half: str = _HASH("s_id::VARCHAR") + " % 2") -> str:
    """t, half and mean F of predictions (t, q_id, s_id)."""
    hits = f"SELECT t, p.s_id, count(*) AS n, count(x.q_id) AS tp FROM ({pred}) p LEFT JOIN truth x USING (q_id, s_id) GROUP BY ALL"
    rows = f"SELECT e.t, e.half, coalesce(h.tp, 0) AS tp, coalesce(h.n - h.tp, 0) AS fp, e.k - coalesce(h.tp, 0) AS fn FROM (SELECT s_id, {half} AS half, k, unnest({grid}) AS t FROM (SELECT s_id, (SELECT count(*) FROM truth z WHERE z.s_id = ents.s_id) AS k FROM ents)) e LEFT JOIN ({hits}) h USING (s_id, t)"
    return f"SELECT t, half, round(avg({_F}), 6) AS f FROM ({rows}) GROUP BY ALL"


CTES |= {
    "ncty": "SELECT country, count(*) AS n, round(greatest(least(ln(count(*)), 12.0), 0.0), 6) AS unseen FROM s1n GROUP BY ALL",
    "idfn": _IDF("ctok"),
    "idfa": _IDF("alpha"),
    "sib": "SELECT t.q_id, t.s_id, t.p1, (t.p1 >= 0.5)::BIGINT AS conf, array_to_string(q.numbers, ' ') AS nums, coalesce(q.numbers[1], '') AS num1, replace(q.core, ' ', '') AS nkey FROM top3 t JOIN qn q ON q.id = t.q_id",
    "rm": "SELECT country, core, max(id) AS s_id FROM s1n GROUP BY country, core HAVING count(*) >= 2 AND count(DISTINCT business_address) >= 2",
    "strest": "SELECT q_id, s_id, p AS p1 FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, s_id) AS r FROM scored WHERE s_id NOT IN (SELECT s_id FROM rm)) WHERE r = 1",
}


def sql(select: str) -> str:
    if select.startswith("WITH "):
        select = f"SELECT * FROM ({select})"
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + select
