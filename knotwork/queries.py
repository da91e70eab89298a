"""Named queries over the fixture tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import similarity as S
from knotwork.functions import text as X
from knotwork.operators import dictionary as D
from knotwork.operators import evaluation as E
from knotwork.operators import features as P
from knotwork.operators import retrieval as R
from knotwork.operators import roles
from knotwork.operators.relations import place_by_hash
from knotwork.oracle import address, core, leet, null_text, sql, weighted
from knotwork.plans import link as L
from knotwork.sources import records as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(select: str | None = None):
    """Registers a function under its name, with the SELECT that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if select:
            ORACLES[f.__name__] = sql(select)
        return f

    return add


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return L.normalised_records(spark, d)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _norm(spark, d)
    return n.where("src = 'S1'"), n.where("src <> 'S1'")


def _joined(c: Column | str) -> Column:
    return F.array_join(c, " ")


# ---- sources, normalisation -------------------------------------------------------------------------------------------


@query("SELECT * FROM rec")
def er_records(spark, d):
    return src.er_records(spark, d)


@query("SELECT * FROM truth")
def er_truth(spark, d):
    return src.er_truth(spark, d)


@query("SELECT id, array_to_string(tokens, ' ') AS name FROM norm")
def name_tokens(spark, d):
    return _norm(spark, d).select("id", _joined("tokens").alias("name"))


@query(f"SELECT doc_id, array_to_string(list_transform(t, lambda t: {leet('t')}), ' ') AS fixed FROM toks")
def leet_fix(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", _joined(F.transform(X.words("text"), X.leet)).alias("fixed"))


@query("SELECT id, core FROM norm")
def name_core(spark, d):
    return _norm(spark, d).select("id", "core")


@query("SELECT id, array_to_string(addr, ' ') AS addr FROM norm")
def addr_tokens(spark, d):
    return _norm(spark, d).select("id", _joined("addr").alias("addr"))


@query("SELECT id, array_to_string(numbers, ' ') AS numbers, len(numbers)::BIGINT AS n FROM norm")
def addr_numbers(spark, d):
    return _norm(spark, d).select("id", _joined("numbers").alias("numbers"), _long(F.size("numbers")).alias("n"))


_ADDRESSES = ["12 Main Street, Suite 4, New York 0010", "94b Saint Road near West Virginia", "no. 007 1st floor, Tamil Nadu & Goa", "<null> n/a 5 California 10th", "", "Plot 12abc Uttar Pradesh", "5taffing Hall District of Columbia"]
_NAMES = ["John Smith dba Acme Co", "www.my-shop.co.in", "https://acme.com", "plain name", "x d/b/a", "foo trading as Bar & Baz", "a.k.a. Zed", "my shop.com now"]


def _literals(xs: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in xs) + ") v(s)"


@query(f"SELECT s, array_to_string({address('s')}, ' ') AS addr FROM {_literals(_ADDRESSES)}")
def addr_state_map(spark, d):
    return spark.createDataFrame([(x,) for x in _ADDRESSES], "s string").select("s", _joined(X.address_tokens("s")).alias("addr"))


@query(f"SELECT s, {null_text('s')} AS cleaned FROM {_literals(_ADDRESSES)}")
def null_text_removed(spark, d):
    return spark.createDataFrame([(x,) for x in _ADDRESSES], "s string").select("s", X.without_null_text("s").alias("cleaned"))


@query(rf"SELECT s, CASE WHEN trim(r) <> '' THEN r ELSE lower(s) END AS name FROM (SELECT s, regexp_extract(lower(s), '(?s)^.*?{X.DBA}(.*)$', 1) AS r FROM {_literals(_NAMES)})")
def dba_extract(spark, d):
    return spark.createDataFrame([(x,) for x in _NAMES], "s string").select("s", X.after_dba("s").alias("name"))


@query(f"SELECT s, CASE WHEN contains(s, ' ') THEN '' ELSE replace(regexp_extract(lower(s), '{X.DOMAIN}', 1), '-', ' ') END AS label FROM {_literals(_NAMES)}")
def domain_name(spark, d):
    return spark.createDataFrame([(x,) for x in _NAMES], "s string").select("s", X.domain_label("s").alias("label"))


@query("SELECT src, count(*) AS n, count(DISTINCT country) AS countries, sum((business_address = '')::INT)::BIGINT AS without_address, min(length(business_name))::BIGINT AS shortest, max(length(business_name))::BIGINT AS longest, round(avg(length(business_name)), 6) AS mean_length, count(*) - count(DISTINCT business_name) AS repeated_names FROM rec GROUP BY src")
def profile_table(spark, d):
    r = src.er_records(spark, d)
    n = F.length("business_name")
    return r.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("country").alias("countries"), F.count_if(F.col("business_address") == "").alias("without_address"), _long(F.min(n)).alias("shortest"), _long(F.max(n)).alias("longest"), F.round(F.avg(n), 6).alias("mean_length"), (F.count("*") - F.countDistinct("business_name")).alias("repeated_names"))


@query("SELECT coalesce(m, 0) AS matches, count(*) AS entities FROM ents LEFT JOIN (SELECT s_id, count(*) AS m FROM truth GROUP BY 1) USING (s_id) GROUP BY 1")
def match_distribution(spark, d):
    s1, _ = _sides(spark, d)
    m = L.truth(spark, d).groupBy("s_id").agg(F.count("*").alias("m"))
    return s1.select(F.col("id").alias("s_id")).join(m, "s_id", "left").groupBy(F.coalesce("m", F.lit(0)).alias("matches")).agg(F.count("*").alias("entities"))


# The fixture's true links have equal names and no Indic script, so the dictionary is learned from first candidates of training entities there.
_TRAIN = "SELECT q_id, s_id FROM cand WHERE rank = 1 AND s_id % 5 >= 2"
_DICT = f"SELECT a, b, count(*) AS n FROM (SELECT unnest(q.tokens) AS a, unnest(s.tokens) AS b FROM ({_TRAIN}) c JOIN qn q ON q.id = c.q_id JOIN s1n s ON s.id = c.s_id WHERE len(q.tokens) = len(s.tokens)) GROUP BY ALL"
_DICT_BEST = f"SELECT a, b, n FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS total, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM ({_DICT})) WHERE r = 1 AND a <> b AND n >= 3 AND n >= 0.6 * total"


def _dictionary(spark, d) -> DataFrame:
    s1, q = _sides(spark, d)
    return D.learned(L.candidates(spark, d).where("rank = 1 AND s_id % 5 >= 2"), q, s1)


@query(_DICT_BEST)
def token_dictionary(spark, d):
    return _dictionary(spark, d)


@query(f"SELECT id, array_to_string(list(coalesce(b, w) ORDER BY i), ' ') AS name FROM (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM qn) LEFT JOIN ({_DICT_BEST}) ON a = w GROUP BY id")
def apply_dictionary(spark, d):
    _, q = _sides(spark, d)
    return D.applied(q, _dictionary(spark, d)).where(F.size("tokens") > 0).select("id", _joined("tokens").alias("name"))


def _noise_sql(field: str, column: str) -> str:
    links = "SELECT q_id, s_id FROM top3 WHERE p1 >= 0.6"
    one = lambda side, a, b: f"SELECT '{field}' AS field, '{side}' AS side, q.country, unnest(list_filter(list_distinct({a}.{column}), lambda x: NOT list_contains({b}.{column}, x))) AS token FROM ({links}) p JOIN qn q ON q.id = p.q_id JOIN s1n s ON s.id = p.s_id"
    return f"{one('q_only', 'q', 's')} UNION ALL {one('s_only', 's', 'q')}"


@query(f"SELECT field, side, country, token, n, round(n / links, 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY field, side, country ORDER BY n DESC, token) AS r FROM (SELECT field, side, country, token, count(*) AS n FROM ({_noise_sql('name', 'tokens')} UNION ALL {_noise_sql('addr', 'addr')}) GROUP BY ALL)) JOIN (SELECT country, count(*) AS links FROM top3 JOIN qn ON qn.id = q_id WHERE p1 >= 0.6 GROUP BY country) USING (country) WHERE r <= 28")
def mine_noise_tokens(spark, d):
    """On the fixture links from 0.6 on; its sure ones hardly differ."""
    s1, q = _sides(spark, d)
    return D.noise(L.linked_pairs(spark, d, 0.6), q, s1)


# ---- candidates -------------------------------------------------------------------------------------------------------


def _keys(spark, d):
    n = _norm(spark, d).withColumn("name", F.col("business_name")).withColumn("first2", F.array_join(F.array_sort(F.slice("tokens", 1, 2)), " ")).withColumn("prefix4", F.substring(F.replace("core", F.lit(" "), F.lit("")), 1, 4)).withColumn("number", F.regexp_extract("business_address", r"\b([0-9]{3,6})\b", 1))
    return n.where("src = 'S1'"), n.where("src <> 'S1'")


_KEYS = r"SELECT id, src, country, business_name AS name, core, array_to_string(list_sort(tokens[1:2]), ' ') AS first2, substr(replace(core, ' ', ''), 1, 4) AS prefix4, regexp_extract(business_address, '\b([0-9]{3,6})\b', 1) AS number FROM norm"


def _block_sql(*keys: str) -> str:
    return f"SELECT q.id AS q_id, s.id AS s_id FROM ({_KEYS}) q JOIN ({_KEYS}) s USING (country, {', '.join(keys)}) WHERE q.src <> 'S1' AND s.src = 'S1' AND " + " AND ".join(f"{k} <> ''" for k in keys)


_UNION_SQL = " UNION ".join(_block_sql(*k) for k in (("name",), ("core",), ("first2",), ("prefix4", "number")))


@query(_block_sql("name"))
def block_exact(spark, d):
    return R.equal_key_pairs(*_keys(spark, d), "name")


@query(_block_sql("core"))
def block_clean(spark, d):
    return R.equal_key_pairs(*_keys(spark, d), "core")


@query(_block_sql("first2"))
def block_first2(spark, d):
    return R.equal_key_pairs(*_keys(spark, d), "first2")


@query(_block_sql("prefix4", "number"))
def block_prefix_num(spark, d):
    return R.equal_key_pairs(*_keys(spark, d), "prefix4", "number")


@query(_UNION_SQL)
def block_union(spark, d):
    s, q = _keys(spark, d)
    out = R.equal_key_pairs(s, q, "name")
    for keys in (("core",), ("first2",), ("prefix4", "number")):
        out = out.unionByName(R.equal_key_pairs(s, q, *keys))
    return out.distinct()


_RARE = "SELECT DISTINCT q.id AS q_id, s.id AS s_id FROM (SELECT id, country, unnest(list_distinct(tokens)) AS token FROM qn) q JOIN (SELECT id, country, arg_min(token, (f, token)) AS token FROM (SELECT id, country, unnest(list_distinct(tokens)) AS token FROM s1n) JOIN (SELECT token, count(*) AS f FROM (SELECT unnest(list_distinct(tokens)) AS token FROM qn) WHERE length(token) >= 4 GROUP BY token HAVING count(*) BETWEEN 2 AND 300) USING (token) GROUP BY id, country) s USING (country, token)"


@query(_RARE)
def rare_token_block(spark, d):
    return R.rare_token_pairs(*_sides(spark, d))


@query(f"SELECT count(*) AS pairs, count(t.q_id) AS found, (SELECT count(*) FROM truth) AS links, round(count(t.q_id) / (SELECT count(*) FROM truth), 6) AS recall, round(count(*) / (SELECT count(*) FROM s1n), 6) AS per_entity FROM ({_UNION_SQL}) p LEFT JOIN truth t USING (q_id, s_id)")
def blocking_metrics(spark, d):
    t = L.truth(spark, d)
    pairs = block_union(spark, d).join(t.withColumn("hit", F.lit(1)), ["q_id", "s_id"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))
    s1, _ = _sides(spark, d)
    out = pairs.crossJoin(t.agg(F.count("*").alias("links"))).crossJoin(s1.agg(F.count("*").alias("e")))  # one row each
    return out.select("pairs", "found", "links", F.round(F.col("found") / F.col("links"), 6).alias("recall"), F.round(F.col("pairs") / F.col("e"), 6).alias("per_entity"))


@query("SELECT id, country, term, round(w, 6) AS w FROM nm_ws")
def tfidf_name(spark, d):
    s1, q = (x.withColumn("grams", R.name_grams(F.col("core"))) for x in _sides(spark, d))
    return R.tfidf(s1, q, "grams", **L.LIMITS)[0].select("id", "country", "term", F.round("w", 6).alias("w"))


@query("SELECT id, country, term, round(w, 6) AS w FROM ad_wq")
def tfidf_addr(spark, d):
    return R.tfidf(*_sides(spark, d), "addr", **L.LIMITS)[1].select("id", "country", "term", F.round("w", 6).alias("w"))


@query("SELECT * FROM nm_cos")
def rowwise_cosine(spark, d):
    s1, q = (x.withColumn("grams", R.name_grams(F.col("core"))) for x in _sides(spark, d))
    return R.cosines(s1, q, "grams", "cos_name", **L.LIMITS)


@query("SELECT * FROM cand")
def retrieve_topk(spark, d):
    return L.candidates(spark, d)


@query("SELECT DISTINCT q.id, q.country FROM qn q ANTI JOIN (SELECT DISTINCT country FROM s1n WHERE country <> 'fr') s USING (country)")
def orphan_countries(spark, d):
    s1, q = _sides(spark, d)
    return q.select("id", "country").join(s1.where("country <> 'fr'").select("country").distinct(), "country", "left_anti").select("id", "country").distinct()


@query("SELECT q_id, s_id, cos_comb, row_number() OVER (PARTITION BY q_id ORDER BY cos_comb DESC, s_id) AS rank FROM cand WHERE ('0x' || substr(md5(s_id::VARCHAR), 1, 8))::BIGINT % 100 >= 19")
def drop_and_rerank(spark, d):
    kept = L.candidates(spark, d).where(E.bucket(F.col("s_id"), 100) >= 19)
    return R.ranked(kept.drop("rank")).select("q_id", "s_id", "cos_comb", "rank")


# ---- pair features ----------------------------------------------------------------------------------------------------


def _pairs(spark, d, weighed: bool = False) -> DataFrame:
    s1, q = _sides(spark, d)
    s1, q = (x.withColumn("ctok", X.core(F.col("tokens"))).withColumn("alpha", F.filter("addr", lambda t: t.rlike("^[a-z]{2,}$"))) for x in (s1, q))
    names = {"core": "c", "business_name": "name", "business_address": "a", "tokens": "t", "addr": "ad", "numbers": "num", "ctok": "ct", "alpha": "al"}
    if weighed:
        s1, q = (P.weighed(P.weighed(x, s1, "ctok", "ctokw"), s1, "alpha", "alphaw") for x in (s1, q))
        names |= {"ctokw": "ctw", "alphaw": "alw"}
    side = lambda x, p, *more: x.select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(p + n) for c, n in names.items()), *more)
    return L.candidates(spark, d).join(side(q, "q", F.col("src").alias("qsrc"), "is_domain", "has_indic", "addr_missing"), "q_id").join(side(s1, "s"), "s_id")


@query("SELECT q_id, s_id, count(*) OVER q AS n_cands, max(cos_comb) OVER q AS comb_max, round(cos_comb - coalesce(CASE WHEN rank = 1 THEN max(CASE WHEN rank = 2 THEN cos_comb END) OVER q ELSE max(cos_comb) OVER q END, 0.0), 7) AS comb_gap, round(cos_comb - coalesce(lead(cos_comb) OVER (PARTITION BY q_id ORDER BY rank), 0.0), 7) AS gap_next, round(cos_name - max(cos_name) OVER q, 6) AS name_gap, round(cos_addr - max(cos_addr) OVER q, 6) AS addr_gap FROM cand WINDOW q AS (PARTITION BY q_id)")
def query_context(spark, d):
    q, o = W.partitionBy("q_id"), W.partitionBy("q_id").orderBy("rank")
    c = F.col("cos_comb")
    second = F.max(F.when(F.col("rank") == 2, c)).over(q)
    return L.candidates(spark, d).select("q_id", "s_id", F.count("*").over(q).alias("n_cands"), F.max(c).over(q).alias("comb_max"), F.round(c - F.coalesce(F.when(F.col("rank") == 1, second).otherwise(F.max(c).over(q)), F.lit(0.0)), 7).alias("comb_gap"), F.round(c - F.coalesce(F.lead(c).over(o), F.lit(0.0)), 7).alias("gap_next"), F.round(F.col("cos_name") - F.max("cos_name").over(q), 6).alias("name_gap"), F.round(F.col("cos_addr") - F.max("cos_addr").over(q), 6).alias("addr_gap"))


_I = "len(list_intersect(qt, st))"


@query(f"SELECT q_id, s_id, {_I}::BIGINT AS tok_inter, round({_I} / greatest(len(list_distinct(list_concat(qt, st))), 1), 6) AS tok_jacc, round({_I} / greatest(len(list_distinct(qt)), 1), 6) AS tok_q_cov, round({_I} / greatest(len(list_distinct(st)), 1), 6) AS tok_s_cov, coalesce(qt[1] = st[1], false) AS first_tok_eq, qc = sc AS nm_exact, replace(qc, ' ', '') = replace(sc, ' ', '') AS key_exact FROM pairs")
def token_set_features(spark, d):
    inter = F.size(F.array_intersect("qt", "st"))
    share = lambda n: F.round(inter / F.greatest(n, F.lit(1)), 6)
    key = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return _pairs(spark, d).select("q_id", "s_id", _long(inter).alias("tok_inter"), share(F.size(F.array_union("qt", "st"))).alias("tok_jacc"), share(F.size(F.array_distinct("qt"))).alias("tok_q_cov"), share(F.size(F.array_distinct("st"))).alias("tok_s_cov"), F.coalesce(F.get("qt", F.lit(0)) == F.get("st", F.lit(0)), F.lit(False)).alias("first_tok_eq"), (F.col("qc") == F.col("sc")).alias("nm_exact"), (key("qc") == key("sc")).alias("key_exact"))


@query("SELECT q_id, s_id, len(list_distinct(qnum))::BIGINT AS num_q, len(list_distinct(snum))::BIGINT AS num_s, len(list_intersect(qnum, snum))::BIGINT AS num_inter, coalesce(qnum[1] = snum[1], false) AS num_first_eq, len(qnum) > 0 AND len(snum) > 0 AND len(list_intersect(qnum, snum)) = 0 AS num_conflict, coalesce(round(abs(try_cast(qnum[1] AS DOUBLE) - try_cast(snum[1] AS DOUBLE)) / greatest(try_cast(qnum[1] AS DOUBLE), try_cast(snum[1] AS DOUBLE), 1.0), 6), -1.0) AS num_rel_diff FROM pairs")
def number_features(spark, d):
    a, b = (F.get(c, F.lit(0)) for c in ("qnum", "snum"))
    x, y = (c.try_cast("double") for c in (a, b))
    inter = F.size(F.array_intersect("qnum", "snum"))
    diff = F.when(x.isNotNull() & y.isNotNull(), F.round(F.abs(x - y) / F.greatest(x, y, F.lit(1.0)), 6))
    return _pairs(spark, d).select("q_id", "s_id", _long(F.size(F.array_distinct("qnum"))).alias("num_q"), _long(F.size(F.array_distinct("snum"))).alias("num_s"), _long(inter).alias("num_inter"), F.coalesce(a == b, F.lit(False)).alias("num_first_eq"), ((F.size("qnum") > 0) & (F.size("snum") > 0) & (inter == 0)).alias("num_conflict"), F.coalesce(diff, F.lit(-1.0)).alias("num_rel_diff"))


@query("SELECT id AS s_id, count(*) OVER (PARTITION BY country, core) AS s1_name_dup FROM s1n")
def name_dup(spark, d):
    s1, _ = _sides(spark, d)
    return s1.select(F.col("id").alias("s_id"), F.count("*").over(W.partitionBy("country", "core")).alias("s1_name_dup"))


@query("SELECT s_id, count(*) AS s1_rank1_deg FROM cand WHERE rank = 1 GROUP BY s_id")
def rank1_degree(spark, d):
    return L.candidates(spark, d).where("rank = 1").groupBy("s_id").agg(F.count("*").alias("s1_rank1_deg"))


def _margin_sql(x: str) -> str:
    return f"round(coalesce(CASE WHEN {x} = max({x}) OVER q THEN {x} - list({x} ORDER BY {x} DESC) OVER q[2] ELSE {x} - max({x}) OVER q END, {x}), 6) AS m_{x}".replace("OVER q[2]", "OVER (PARTITION BY q_id)").replace(f"list({x} ORDER BY {x} DESC) OVER (PARTITION BY q_id)", f"(list_reverse_sort(list({x}) OVER q))[2]")


_COV = "round(len(list_intersect(qnum, snum)) / greatest(len(list_distinct(qnum)), 1), 6)"


@query(f"SELECT q_id, s_id, {_margin_sql('cos_name')}, {_margin_sql('cos_addr')}, {_margin_sql('num_q_cov')}, sum((cos_name >= 0.95 * mx)::INT) OVER q::BIGINT AS n_name_ties FROM (SELECT q_id, s_id, cos_name, cos_addr, {_COV} AS num_q_cov, max(cos_name) OVER (PARTITION BY q_id) AS mx FROM pairs) WINDOW q AS (PARTITION BY q_id)")
def margins(spark, d):
    p = _pairs(spark, d).select("q_id", "s_id", "cos_name", "cos_addr", P.number_coverage())
    p = p.withColumn("near", (F.col("cos_name") >= 0.95 * F.max("cos_name").over(W.partitionBy("q_id"))).cast("long"))
    return p.select("q_id", "s_id", *(P.margin(x).alias(f"m_{x}") for x in ("cos_name", "cos_addr", "num_q_cov")), F.sum("near").over(W.partitionBy("q_id")).alias("n_name_ties"))


@query("SELECT * FROM idfn")
def idf_catalog(spark, d):
    return P.idf(_sides(spark, d)[0].withColumn("ctok", X.core(F.col("tokens"))), "ctok")


_DIRECT = f"""SELECT p.q_id, p.s_id, coalesce(round(n.sh / greatest(n.qs, 1e-6), 6), 0.0) AS nm_wcov_q, coalesce(round(n.sh / greatest(n.ss, 1e-6), 6), 0.0) AS nm_wcov_s, coalesce(n.qo, 0.0) AS nm_qonly_idf_max, coalesce(n.so, 0.0) AS nm_sonly_idf_max, coalesce(round(n.sh, 6), 0.0) AS nm_shared_idf,
coalesce(round(a.sh / greatest(a.qs, 1e-6), 6), 0.0) AS ad_wcov_q, coalesce(a.qo, 0.0) AS ad_qonly_idf_max, coalesce(a.qr, 0) AS ad_qonly_n_rare, coalesce(round(a.sh, 6), 0.0) AS ad_shared_idf,
coalesce(qnum[1]::BIGINT = snum[1]::BIGINT, false) AS prem_eq, coalesce(list_contains(list_transform(snum, lambda x: x::BIGINT), qnum[1]::BIGINT), false) AS prem_in_s, coalesce(list_contains(list_transform(qnum, lambda x: x::BIGINT), snum[1]::BIGINT), false) AS s_prem_in_q, len(list_filter(qnum, lambda x: NOT list_contains(list_transform(snum, lambda y: y::BIGINT), x::BIGINT))) = 0 AS q_nums_subset,
coalesce(round(abs(qnum[1]::DOUBLE - snum[1]::DOUBLE) / greatest(qnum[1]::DOUBLE, snum[1]::DOUBLE, 1.0), 6), -1.0) AS prem_close, lower(trim(qname)) = lower(trim(sname)) AS raw_name_eq, lower(trim(qa)) = lower(trim(sa)) AS raw_addr_eq
FROM pairs p LEFT JOIN ({weighted('qct', 'sct', 'idfn')}) n USING (q_id, s_id) LEFT JOIN ({weighted('qal', 'sal', 'idfa')}) a USING (q_id, s_id)"""


@query(_DIRECT)
def direct_features(spark, d):
    return P.direct(_pairs(spark, d, weighed=True))


def _support(tag: str, keys: str, none: str) -> str:
    w = f"(PARTITION BY s_id, {keys})"
    return f"CASE WHEN {none} THEN -1 ELSE count(*) OVER {w} - 1 END AS sup_{tag}_all, CASE WHEN {none} THEN -1 ELSE sum(conf) OVER {w}::BIGINT - conf END AS sup_{tag}_conf"


_GROUP = f"SELECT *, round(sup_nums_conf / greatest(g_conf, 1), 6) AS sup_nums_frac, round(sup_name_conf / greatest(g_conf, 1), 6) AS sup_name_frac FROM (SELECT q_id, s_id, count(*) OVER s - 1 AS g_all, sum(conf) OVER s::BIGINT - conf AS g_conf, round(sum(p1) OVER s - p1, 6) AS g_psum, {_support('nums', 'nums', 'nums = ' + chr(39) * 2)}, {_support('num1', 'num1', 'nums = ' + chr(39) * 2)}, {_support('name', 'nkey', 'false')}, {_support('both', 'nums, nkey', 'nums = ' + chr(39) * 2)} FROM sib WINDOW s AS (PARTITION BY s_id))"


def _siblings(spark, d) -> DataFrame:
    return P.siblings(E.top3(L.scored(spark, d)), _sides(spark, d)[1])


@query(_GROUP)
def group_features(spark, d):
    return _siblings(spark, d)


@query()
def sibling_likeness(spark, d):
    return P.fuzzy_siblings(E.top3(L.scored(spark, d)), _sides(spark, d)[1])


@query("SELECT q_id, s_id, qname = sname AS name_exact, qa = sa AS addr_exact, round(CASE WHEN len(qad) = 0 OR len(sad) = 0 THEN 0.0 ELSE len(list_intersect(qad, sad)) / len(list_distinct(list_concat(qad, sad))) END, 6) AS addr_jacc, round(least(length(qname), length(sname)) / greatest(length(qname), length(sname), 1), 6) AS len_ratio, abs(length(qname) - length(sname))::BIGINT AS len_diff, qa = '' AS q_addr_missing, sa = '' AS s_addr_missing FROM pairs")
def proto_set_features(spark, d):
    n, m = F.length("qname"), F.length("sname")
    return _pairs(spark, d).select("q_id", "s_id", (F.col("qname") == F.col("sname")).alias("name_exact"), (F.col("qa") == F.col("sa")).alias("addr_exact"), F.round(S.set_jaccard(F.col("qad"), F.col("sad")), 6).alias("addr_jacc"), F.round(F.least(n, m) / F.greatest(n, m, F.lit(1)), 6).alias("len_ratio"), _long(F.abs(n - m)).alias("len_diff"), (F.col("qa") == "").alias("q_addr_missing"), (F.col("sa") == "").alias("s_addr_missing"))


_G = "CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"


@query(f"SELECT q_id, s_id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jacc FROM (SELECT q_id, s_id, {_G.format('qname')} AS a, {_G.format('sname')} AS b FROM pairs)")
def char3_jaccard(spark, d):
    return _pairs(spark, d).select("q_id", "s_id", F.round(S.set_jaccard(S.grams(F.col("qname")), S.grams(F.col("sname"))), 6).alias("jacc"))


@query("SELECT q_id, s_id, i <> '' AND i = replace(sname, ' ', '') AS acronym FROM (SELECT q_id, s_id, sname, CASE WHEN len(string_split(qname, ' ')) >= 2 THEN array_to_string(list_transform(string_split(qname, ' '), lambda t: substr(t, 1, 1)), '') ELSE '' END AS i FROM pairs)")
def acronym_equal(spark, d):
    i = S.initials(F.col("qname"))
    return _pairs(spark, d).select("q_id", "s_id", ((i != "") & (i == F.replace("sname", F.lit(" "), F.lit("")))).alias("acronym"))


@query("SELECT q_id, s_id, round(CASE WHEN qname = '' OR sname = '' THEN (qname = sname)::INT::DOUBLE ELSE jaro_winkler_similarity(qname, sname) END, 6) AS jw FROM pairs")
def jaro_winkler(spark, d):
    return _pairs(spark, d).select("q_id", "s_id", F.round(S.jaro_winkler_udf("qname", "sname"), 6).alias("jw"))


def _edits() -> Column:
    return P.edits("qc", "sc", _joined("qt"), _joined("st"), _joined("qad"), _joined("sad")).alias("e")


@query()
def fuzzy_features(spark, d):
    e = _pairs(spark, d).select("q_id", "s_id", _edits()).select("q_id", "s_id", "e.*")
    return e.select("q_id", "s_id", *(F.round(n, 6).alias(n) for n in P.EDITS), *(P.margin(x).alias(f"m_{x}") for x in ("nm_tset", "full_ratio", "ad_tset")))


@query()
def role_features(spark, d):
    p = _pairs(spark, d).select("q_id", "s_id", roles.role_features("qname", "sname", "qa", "sa", "qc", "sc", _joined("qad"), _joined("sad")).alias("r"))
    return p.select("q_id", "s_id", "r.*")


@query()
def transliterated(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(X.fold(X.transliterate("text")).cast("binary")).alias("folded_md5"))


# ---- decisions --------------------------------------------------------------------------------------------------------


@query("SELECT q_id, s_id, p1, p2 FROM top3")
def best_per_query(spark, d):
    return E.top3(L.scored(spark, d)).select("q_id", "s_id", "p1", "p2")


@query("SELECT * FROM top3")
def top3(spark, d):
    return E.top3(L.scored(spark, d))


@query("SELECT * FROM pred")
def assign_threshold(spark, d):
    return L.linked_pairs(spark, d)


_EF = "SELECT *, count(*) OVER o AS m, sum(p) OVER o AS got, sum(p) OVER s AS tot, exp(sum(ln(greatest(1 - p, 1e-9))) OVER s) AS none FROM scored WHERE p >= 0.02 WINDOW s AS (PARTITION BY s_id), o AS (PARTITION BY s_id ORDER BY p DESC, q_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT e.q_id, e.s_id, e.p FROM ({_EF}) e JOIN (SELECT s_id, arg_max(m, (round(1.25 * got / (0.25 * tot + m), 9), -m)) AS keep, max(round(1.25 * got / (0.25 * tot + m), 9)) AS ef, max(none) AS none FROM ({_EF}) GROUP BY s_id) b USING (s_id) WHERE b.ef > b.none AND e.m <= b.keep AND e.p >= 0.5")
def expected_f05(spark, d):
    return E.expected_f_subset(L.scored(spark, d))


_CONFLICT = "len(qnum) > 0 AND len(snum) > 0 AND len(list_intersect(qnum, snum)) = 0"


@query(f"SELECT t.q_id, t.s_id, CASE WHEN {_CONFLICT} AND g.sup_nums_all >= 1 AND t.p1 < 0.1 THEN 0.0 ELSE t.p1 END AS p FROM top3 t JOIN pairs p USING (q_id, s_id) JOIN ({_GROUP}) g USING (q_id, s_id)")
def conflict_guard(spark, d):
    return E.guarded(E.top3(L.scored(spark, d)), _pairs(spark, d).withColumn("num_conflict", P.conflict()), _siblings(spark, d))


# ---- evaluation -------------------------------------------------------------------------------------------------------


def _counts(spark, d, predicted: DataFrame | None = None) -> DataFrame:
    s1, _ = _sides(spark, d)
    e = s1.select(F.col("id").alias("s_id"), "country")
    p = L.linked_pairs(spark, d) if predicted is None else predicted
    return E.entity_counts(e, L.truth(spark, d), p).join(e, "s_id")


_MACRO = "count(*) AS n, round(avg(CASE WHEN tp + fp = 0 THEN (fn = 0)::INT ELSE tp / (tp + fp) END), 6) AS precision, round(avg(CASE WHEN tp + fn = 0 THEN (fp = 0)::INT ELSE tp / (tp + fn) END), 6) AS recall, round(avg(f), 6) AS f05"


@query(f"SELECT {_MACRO} FROM cntf")
def macro_f05(spark, d):
    return E.macro_f(_counts(spark, d))


@query("SELECT s_id, tp, fp, fn FROM cnt")
def macro_counts(spark, d):
    return _counts(spark, d).select("s_id", "tp", "fp", "fn")


@query(f"SELECT country, {_MACRO} FROM cntf GROUP BY country")
def slices(spark, d):
    return E.macro_f(_counts(spark, d), "country")


@query("SELECT t, round(avg(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END), 6) AS f05 FROM (SELECT t, e.s_id, coalesce(sum(hit * pr), 0) AS tp, coalesce(sum((1 - hit) * pr), 0) AS fp, coalesce(sum(hit * (1 - pr)), 0) AS fn FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8])::DOUBLE AS t) CROSS JOIN ents e LEFT JOIN (SELECT g.t AS t2, x.s_id, x.hit, (x.p1 >= g.t)::INT AS pr FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8])::DOUBLE AS t) g, (SELECT s_id, coalesce(p.p1, -1) AS p1, (tr.q_id IS NOT NULL)::INT AS hit FROM top3 p FULL JOIN truth tr USING (q_id, s_id)) x) y ON y.t2 = t AND y.s_id = e.s_id GROUP BY t, e.s_id) GROUP BY t")
def threshold_sweep(spark, d):
    s1, _ = _sides(spark, d)
    grid = F.explode(F.array(*(F.lit(t) for t in (0.5, 0.6, 0.7, 0.8)))).alias("t")  # four rows for each
    both = E.top3(L.scored(spark, d)).select("q_id", "s_id", "p1").join(L.truth(spark, d).withColumn("hit", F.lit(1)), ["q_id", "s_id"], "full")
    both = both.select("s_id", F.coalesce("p1", F.lit(-1.0)).alias("p1"), F.coalesce("hit", F.lit(0)).alias("hit"), grid).withColumn("pr", (F.col("p1") >= F.col("t")).cast("int"))
    per = both.groupBy("t", "s_id").agg(F.sum(F.col("hit") * F.col("pr")).alias("tp"), F.sum((1 - F.col("hit")) * F.col("pr")).alias("fp"), F.sum(F.col("hit") * (1 - F.col("pr"))).alias("fn"))
    per = s1.select(F.col("id").alias("s_id"), grid).join(per, ["s_id", "t"], "left").na.fill(0)
    return per.groupBy("t").agg(F.round(F.avg(E.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("f05"))


_MULT = "SELECT p.s_id, sum((t.q_id IS NOT NULL AND t.s_id = p.s_id)::INT) AS tp, sum(CASE WHEN t.q_id IS NULL THEN 4 WHEN t.s_id <> p.s_id THEN 1 ELSE 0 END) AS fp FROM pred p LEFT JOIN truth t ON t.q_id = p.q_id GROUP BY 1"


@query(f"SELECT round(avg(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END), 6) AS f05 FROM (SELECT e.s_id, coalesce(m.tp, 0) AS tp, coalesce(m.fp, 0) AS fp, c.fn FROM ents e JOIN cnt c USING (s_id) LEFT JOIN ({_MULT}) m USING (s_id))")
def neg_multiplicity(spark, d):
    t = L.truth(spark, d).select("q_id", F.col("s_id").alias("true_s"))
    p = L.linked_pairs(spark, d).join(t, "q_id", "left")
    w = p.groupBy("s_id").agg(F.count_if(F.col("true_s") == F.col("s_id")).alias("tp"), F.sum(F.when(F.col("true_s").isNull(), 4).when(F.col("true_s") != F.col("s_id"), 1).otherwise(0)).alias("fp"))
    per = _counts(spark, d).select("s_id", "fn").join(w, "s_id", "left").na.fill(0)
    return per.agg(F.round(F.avg(E.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("f05"))


_FOLD = "CASE s_id % 5 WHEN 0 THEN 'DEV' WHEN 1 THEN 'CONF' ELSE 'TRAIN' END"


def _fold(c: Column) -> Column:
    return F.when(c % 5 == 0, "DEV").when(c % 5 == 1, "CONF").otherwise("TRAIN")


@query(f"SELECT s_id, {_FOLD} AS fold FROM ents")
def folds(spark, d):
    return _sides(spark, d)[0].select(F.col("id").alias("s_id"), _fold(F.col("id")).alias("fold"))


@query(f"SELECT q_id, true_s, {_FOLD} AS fold FROM (SELECT q_id, t.s_id AS true_s, coalesce(t.s_id, c.s_id) AS s_id FROM (SELECT q_id, s_id FROM cand WHERE rank = 1) c FULL JOIN truth t USING (q_id))")
def query_folds(spark, d):
    first = L.candidates(spark, d).where("rank = 1").select("q_id", "s_id")
    both = first.join(L.truth(spark, d).select("q_id", F.col("s_id").alias("true_s")), "q_id", "full")
    return both.select("q_id", "true_s", _fold(F.coalesce("true_s", "s_id")).alias("fold"))


@query("SELECT s_id, country, k, row_number() OVER (PARTITION BY country, k ORDER BY md5(s_id::VARCHAR)) <= round(0.2 * count(*) OVER (PARTITION BY country, k)) AS validation FROM (SELECT e.s_id, country, least(count(t.q_id), 2) AS k FROM ents e LEFT JOIN truth t USING (s_id) GROUP BY ALL)")
def stratified_split(spark, d):
    t = L.truth(spark, d).groupBy("s_id").agg(F.count("*").alias("m"))
    e = _sides(spark, d)[0].select(F.col("id").alias("s_id"), "country").join(t, "s_id", "left").select("s_id", "country", F.least(F.coalesce("m", F.lit(0)), F.lit(2)).alias("k"))
    return place_by_hash(e, ["country", "k"], "s_id", "place", "n").select("s_id", "country", "k", (F.col("place") <= F.round(0.2 * F.col("n"))).alias("validation"))


@query("SELECT country, core, max(id) AS removed, count(*) AS members FROM s1n GROUP BY country, core HAVING count(*) >= 2 AND count(DISTINCT business_address) >= 2")
def stress_twins(spark, d):
    g = _sides(spark, d)[0].groupBy("country", "core").agg(F.max("id").alias("removed"), F.count("*").alias("members"), F.countDistinct("business_address").alias("a"))
    return g.where("members >= 2 AND a >= 2").drop("a")


@query("SELECT q_id, s_id, p FROM (SELECT q_id, s_id, p, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, s_id) AS r FROM scored WHERE ('0x' || substr(md5(s_id::VARCHAR), 1, 8))::BIGINT % 100 >= 19) WHERE r = 1")
def density_sim(spark, d):
    kept = L.scored(spark, d).where(E.bucket(F.col("s_id"), 100) >= 19)
    return E.top3(kept).select("q_id", "s_id", F.col("p1").alias("p"))


@query("SELECT p.q_id || '#' || i AS q_id, p.s_id FROM pred p ANTI JOIN truth t USING (q_id), (SELECT unnest([1, 2, 3]) AS i)")
def prevalence_sim(spark, d):
    out = L.linked_pairs(spark, d).join(L.truth(spark, d), "q_id", "left_anti")
    return out.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(F.concat_ws("#", F.col("q_id").cast("string"), F.col("i").cast("string")).alias("q_id"), "s_id")


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN p.s_id IS NOT NULL AND t.s_id = p.s_id THEN 'TP' WHEN p.s_id IS NOT NULL AND t.s_id IS NULL THEN 'FP_distractor' WHEN p.s_id IS NOT NULL THEN 'FP_wrong_s1' WHEN c.q_id IS NULL THEN 'FN_not_retrieved' ELSE 'FN_below' END AS class FROM truth t FULL JOIN pred p USING (q_id) LEFT JOIN (SELECT q_id, s_id FROM cand) c ON c.q_id = t.q_id AND c.s_id = t.s_id) GROUP BY class")
def error_classes(spark, d):
    t = L.truth(spark, d).select("q_id", F.col("s_id").alias("true_s"))
    c = L.candidates(spark, d).select("q_id", F.col("s_id").alias("true_s"), F.lit(1).alias("seen"))
    b = t.join(L.linked_pairs(spark, d), "q_id", "full").join(c, ["q_id", "true_s"], "left")
    got, true = F.col("s_id").isNotNull(), F.col("true_s")
    return b.groupBy(F.when(got & (true == F.col("s_id")), "TP").when(got & true.isNull(), "FP_distractor").when(got, "FP_wrong_s1").when(F.col("seen").isNull(), "FN_not_retrieved").otherwise("FN_below").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT country, least(floor(p1 * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p1), 6) AS mean FROM top3 JOIN qn ON qn.id = q_id GROUP BY ALL")
def score_histogram(spark, d):
    t = E.top3(L.scored(spark, d)).join(_sides(spark, d)[1].select(F.col("id").alias("q_id"), "country"), "q_id")
    return t.groupBy("country", _long(F.least(F.floor(F.col("p1") * 10), F.lit(9))).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p1"), 6).alias("mean"))


@query("SELECT country, count(*) AS records, round(avg((p1 >= 0.7)::INT), 6) AS accepted, round(median(p1), 6) AS median_p, round(avg(p1 - p2), 6) AS margin FROM top3 JOIN qn ON qn.id = q_id GROUP BY country")
def shift_profile(spark, d):
    t = E.top3(L.scored(spark, d)).join(_sides(spark, d)[1].select(F.col("id").alias("q_id"), "country"), "q_id")
    return t.groupBy("country").agg(F.count("*").alias("records"), F.round(F.avg((F.col("p1") >= 0.7).cast("int")), 6).alias("accepted"), F.round(F.median("p1"), 6).alias("median_p"), F.round(F.avg(F.col("p1") - F.col("p2")), 6).alias("margin"))


@query("SELECT CASE WHEN a.q_id IS NULL THEN 'added' WHEN b.q_id IS NULL THEN 'dropped' WHEN a.s_id = b.s_id THEN 'same' ELSE 'moved' END AS change, count(*) AS n FROM (SELECT q_id, s_id FROM top3 WHERE p1 >= 0.7) a FULL JOIN (SELECT q_id, s_id FROM top3 WHERE p1 >= 0.5) b USING (q_id) GROUP BY 1")
def prediction_diff(spark, d):
    t = E.top3(L.scored(spark, d))
    a, b = (t.where(F.col("p1") >= x).select("q_id", F.col("s_id").alias(n)) for x, n in ((0.7, "a"), (0.5, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").when(F.col("a") == F.col("b"), "same").otherwise("moved")
    return a.join(b, "q_id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE 5.0 * f / (4.0 * f + t) END), 6) AS ceiling FROM (SELECT e.s_id, count(t.q_id) AS t, count(c.q_id) AS f FROM ents e LEFT JOIN truth t ON t.s_id = e.s_id LEFT JOIN cand c ON c.q_id = t.q_id AND c.s_id = t.s_id GROUP BY e.s_id)")
def oracle_ceiling(spark, d):
    t = L.truth(spark, d)
    perfect = t.join(L.candidates(spark, d).select("q_id", "s_id"), ["q_id", "s_id"], "left_semi")
    c = _counts(spark, d, perfect)
    return c.agg(F.count("*").alias("n"), F.round(F.avg(E.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("ceiling"))


@query("SELECT 'S1-' || e.s_id AS source1_entity_id, coalesce(string_agg(r.entity_id, ',' ORDER BY r.entity_id), '') AS matched_entity_ids FROM ents e LEFT JOIN pred p USING (s_id) LEFT JOIN rec r ON r.doc_id = p.q_id GROUP BY e.s_id")
def write_grouped(spark, d):
    ids = src.er_records(spark, d).select("doc_id", "entity_id")
    pairs = L.linked_pairs(spark, d).join(ids.select(F.col("doc_id").alias("q_id"), F.col("entity_id").alias("q")), "q_id").join(ids.select(F.col("doc_id").alias("s_id"), F.col("entity_id").alias("s1_id")), "s_id")
    s1 = src.er_records(spark, d).where("src = 'S1'").select("entity_id")
    return src.grouped(s1, pairs.select("s1_id", F.col("q").alias("q_id")))


_BAD = [("S2-1", ""), ("S1-0", "S2-1,S2-1,S1-3,S9-1,S2-999999999"), ("S1-6", "S3-2"), ("S1-999999999", "S3-2,S3-2")]
_SHEET = "SELECT 'S1-' || e.s_id AS s1, list(r.entity_id) FILTER (r.entity_id IS NOT NULL) AS ids FROM ents e LEFT JOIN pred p USING (s_id) LEFT JOIN rec r ON r.doc_id = p.q_id WHERE e.s_id <> 9 GROUP BY 1 UNION ALL SELECT s1, list_filter(string_split(x, ','), lambda i: i <> '') FROM (VALUES " + ", ".join(map(str, _BAD)) + ") v(s1, x)"


@query(f"""WITH sheet AS ({_SHEET}), each AS (SELECT s1, unnest(ids) AS id FROM sheet)
SELECT 'extra_entity' AS rule, count(DISTINCT s1) AS n FROM sheet WHERE s1 NOT IN (SELECT entity_id FROM rec WHERE src = 'S1')
UNION ALL SELECT 'repeated_row', count(*) FROM (SELECT s1 FROM sheet GROUP BY s1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_id', count(DISTINCT s1) FROM sheet WHERE len(ids) > len(list_distinct(ids))
UNION ALL SELECT 'self_match', count(DISTINCT id) FROM each WHERE id LIKE 'S1-%'
UNION ALL SELECT 'wrong_prefix', count(DISTINCT id) FROM each WHERE id NOT LIKE 'S1-%' AND id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%'
UNION ALL SELECT 'unknown_id', count(DISTINCT id) FROM each WHERE (id LIKE 'S2-%' OR id LIKE 'S3-%') AND id NOT IN (SELECT entity_id FROM rec WHERE src <> 'S1')
UNION ALL SELECT 'missing_entity', count(*) FROM rec WHERE src = 'S1' AND entity_id NOT IN (SELECT s1 FROM sheet)""")
def validate_rules(spark, d):
    """The grouped output with an entity taken out and rows put in that break each rule."""
    from knotwork.operators.validation import violations

    rows = write_grouped(spark, d).where("source1_entity_id <> 'S1-9'").unionByName(spark.createDataFrame(_BAD, "source1_entity_id string, matched_entity_ids string"))
    return violations(rows, src.er_records(spark, d)).select("rule", "n")


from knotwork import queries_more  # noqa: E402, F401  registers further queries here
