"""Further queries: features, normal forms, retrieval, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import tables as T
from knotwork.functions import text as X
from knotwork.operators import evaluation as E
from knotwork.operators import features as P
from knotwork.operators import models as M
from knotwork.operators import nearest as N
from knotwork.operators import relations as R2
from knotwork.operators import retrieval as R
from knotwork.oracle import _F, _HASH, _map, address, swept
from knotwork.plans import link as L
from knotwork.plans import store
from knotwork.queries import _CONFLICT, _COV, _GROUP, _MACRO, _RARE, _UNION_SQL, _edits, _literals, _pairs, _siblings, _sides, block_union, query, rare_token_block
from knotwork.sources import records as src

# ---- relations --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, entity_id, row_number() OVER (ORDER BY doc_id) - 1 AS \"index\" FROM rec")
def with_row_index(spark, d):
    return R2.with_row_index(src.er_records(spark, d).select("doc_id", "entity_id"), "doc_id")


@query("SELECT q_id, s_id, c.country, s.core FROM cand c JOIN s1n s ON s.id = c.s_id WHERE rank = 1")
def join_checked(spark, d):
    s1 = _sides(spark, d)[0].select(F.col("id").alias("s_id"), "core")
    return R2.join_checked(L.candidates(spark, d).where("rank = 1").select("q_id", "s_id", "country"), s1, ["s_id"])


@query("SELECT e.s_id, t.q_id, row_number() OVER (ORDER BY e.s_id, t.q_id NULLS FIRST) - 1 AS place FROM ents e LEFT JOIN truth t USING (s_id)")
def join_in_order(spark, d):
    e = _sides(spark, d)[0].select(F.col("id").alias("s_id"))
    rows = R2.join_in_order(e, L.truth(spark, d), ["s_id"], "s_id")
    # The place proves the order; a key for each row of the left side and its matches.
    per = rows.withColumn("i", F.row_number().over(W.partitionBy("s_id").orderBy(F.col("q_id").asc_nulls_first())))
    before = R2.running_before(per.groupBy(F.col("s_id").alias("of")).agg(F.count("*").alias("n")), "of", "n", "before")
    return per.join(before, F.col("s_id") == F.col("of")).select("s_id", "q_id", (F.col("before") + F.col("i") - 1).alias("place"))


_BINS = "CASE WHEN k <= 0 THEN '0' WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' ELSE '4+' END"


@query(f"SELECT {_BINS} AS matches, count(*) AS n, round(avg(f), 6) AS f05 FROM (SELECT f, tp + fn AS k FROM cntf) GROUP BY 1")
def cut_bins(spark, d):
    c = _entity_f(spark, d)
    return c.groupBy(R2.binned(F.col("tp") + F.col("fn"), [0, 1, 3], ["0", "1", "2-3", "4+"]).alias("matches")).agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("f05"))


@query("SELECT doc_id FROM rec WHERE ('0x' || substr(md5(doc_id || '#7'), 1, 8))::BIGINT % 10000 < 2500")
def sample_random(spark, d):
    return R2.sampled(src.er_records(spark, d).select("doc_id"), "doc_id", 0.25, seed=7)


@query("SELECT s_id, count(*) AS pairs, sum((a.nums <> '' AND a.nums = b.nums)::INT)::BIGINT AS same_numbers FROM sib a JOIN sib b USING (s_id) WHERE a.q_id < b.q_id GROUP BY s_id")
def sibling_pairs(spark, d):
    q = _sides(spark, d)[1].select(F.col("id").alias("q_id"), F.array_join("numbers", " ").alias("nums"))
    a = E.top3(L.scored(spark, d)).select("q_id", "s_id").join(q, "q_id")
    b = a.select("s_id", F.col("q_id").alias("o_id"), F.col("nums").alias("o_nums"))
    return a.join(b, "s_id").where("q_id < o_id").groupBy("s_id").agg(F.count("*").alias("pairs"), F.count_if((F.col("nums") != "") & (F.col("nums") == F.col("o_nums"))).alias("same_numbers"))


@query("(SELECT q_id, s_id FROM pred INTERSECT SELECT q_id, s_id FROM cand) EXCEPT SELECT q_id, s_id FROM truth")
def pair_algebra(spark, d):
    two = lambda x: x.select("q_id", "s_id")
    return two(L.linked_pairs(spark, d)).intersect(two(L.candidates(spark, d))).exceptAll(two(L.truth(spark, d)))


@query("SELECT q_id, s_id, cos_comb FROM cand ORDER BY cos_comb DESC, q_id, s_id LIMIT 25")
def global_topk(spark, d):
    return L.candidates(spark, d).select("q_id", "s_id", "cos_comb").orderBy(F.desc("cos_comb"), "q_id", "s_id").limit(25)


@query("SELECT country, round(quantile_cont(p1, 0.25), 6) AS q25, round(quantile_cont(p1, 0.95), 6) AS q95, min(p1) AS least, max(p1) AS most FROM top3 JOIN qn ON qn.id = q_id GROUP BY country")
def score_quantiles(spark, d):
    t = _top(spark, d)
    return t.groupBy("country").agg(*(F.round(F.percentile("p1", p), 6).alias(n) for p, n in ((0.25, "q25"), (0.95, "q95"))), F.min("p1").alias("least"), F.max("p1").alias("most"))


def _top(spark, d) -> DataFrame:
    """Each record's best candidates with the record's country."""
    return E.top3(L.scored(spark, d)).join(_sides(spark, d)[1].select(F.col("id").alias("q_id"), "country"), "q_id")


def _entities(spark, d) -> DataFrame:
    return _sides(spark, d)[0].select(F.col("id").alias("s_id"), "country")


def _entity_f(spark, d, predicted: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn and F0.5 of each entity."""
    c = E.entity_counts(_entities(spark, d), L.truth(spark, d), L.linked_pairs(spark, d) if predicted is None else predicted)
    return c.withColumn("f", E.f_beta(F.col("tp"), F.col("fp"), F.col("fn")))


# ---- normal forms -----------------------------------------------------------------------------------------------------

_INDIC = ["श्री राम Traders", "plain", "తెలుగు", "Café Ünï", "", "മലയാളം 12"]


@query(rf"SELECT s, regexp_matches(s, '[\x{{0900}}-\x{{0D7F}}]') AS has_indic FROM {_literals(_INDIC)}")
def indic_detect(spark, d):
    return spark.createDataFrame([(x,) for x in _INDIC], "s string").select("s", X.has_indic("s").alias("has_indic"))


_TRICKY = ["A.B.C. Traders", "u.s steel", "M/s Ram & Sons", "l'Oreal d'Or", "** Foo Bar **", "#tag", "www.my-shop.co.in", "John dba Acme Inc", "5taffing H0use Ltd", "O'Reilly + Co", "", "The Company"]
#: What the name normaliser has to give for them, told by hand.
_NORMAL = {"A.B.C. Traders": "abc traders", "u.s steel": "u s steel", "M/s Ram & Sons": "ram and sons", "l'Oreal d'Or": "oreal or", "** Foo Bar **": "foo bar", "#tag": "tag", "www.my-shop.co.in": "my shop", "John dba Acme Inc": "acme inc", "5taffing H0use Ltd": "staffing house ltd", "O'Reilly + Co": "oreilly and co", "": "", "The Company": "the company"}
_CORES = {"A.B.C. Traders": "abc traders", "u.s steel": "u s steel", "M/s Ram & Sons": "ram sons", "l'Oreal d'Or": "oreal or", "** Foo Bar **": "foo bar", "#tag": "tag", "www.my-shop.co.in": "my shop", "John dba Acme Inc": "acme", "5taffing H0use Ltd": "staffing house", "O'Reilly + Co": "oreilly", "": "", "The Company": "the company"}


def _rows(*columns: list) -> str:
    q = lambda x: str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in zip(*columns))


@query(f"SELECT * FROM (VALUES {_rows(_TRICKY, [_NORMAL[x] for x in _TRICKY], [_CORES[x] for x in _TRICKY], [x in ('#tag', 'www.my-shop.co.in') for x in _TRICKY])}) v(s, name, core, is_domain)")
def normalize_name(spark, d):
    rows = spark.createDataFrame([(x,) for x in _TRICKY], "s string")
    t = X.name_tokens(X.latin("s"))
    return rows.select("s", F.array_join(t, " ").alias("name"), F.array_join(X.core(t), " ").alias("core"), X.is_domain("s").alias("is_domain"))


_FRENCH = ["12 bis rue des Fleurs, Paris, Île-de-France", "3 ter av Foch, Haute-Savoie", "app 4, 7 crs Mirabeau, Bouches du Rhone", "rpt 5, Lot", "9 allee Paris Centre", ""]


@query(f"SELECT s, array_to_string(list_filter(list_transform({address(chr(97))}, lambda t: coalesce({_map(T.ADDRESS_WORDS_FR)}[t], t)), lambda t: t <> 'apt'), ' ') AS addr FROM (SELECT s, array_to_string(list_transform(string_split(strip_accents(s), ','), lambda c: coalesce({_map(T.FR_AREAS)}[trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))], c)), ',') AS a FROM {_literals(_FRENCH)})")
def fr_address(spark, d):
    rows = spark.createDataFrame([(x,) for x in _FRENCH], "s string").select("s", X.latin("s").alias("l"))
    return rows.select("s", F.array_join(X.french_address_tokens(X.address_tokens(X.french_area("l"))), " ").alias("addr"))


_FRENCH_NAMES = {"S.A Dupont et Cie": "dupont", "Compagnie P.C. Légère": "legere", "a.b.c Sport": "abc sport", "Boulangerie de l'Étoile E.I.": "boulangerie etoile", "Cie": "cie"}


@query(f"SELECT * FROM (VALUES {_rows(list(_FRENCH_NAMES), list(_FRENCH_NAMES.values()))}) v(s, core)")
def fr_name(spark, d):
    rows = spark.createDataFrame([(x,) for x in _FRENCH_NAMES], "s string")
    return rows.select("s", F.array_join(X.core(X.french_name_tokens(X.latin("s")), tuple(T.LEGAL_WORDS_FR)), " ").alias("core"))


@query(f"SELECT id, array_to_string(CASE WHEN country = 'fr' THEN list_filter(list_transform(addr, lambda t: coalesce({_map(T.ADDRESS_WORDS_FR)}[t], t)), lambda t: t <> 'apt') ELSE addr END, ' ') AS addr FROM norm")
def locale_override(spark, d):
    n = L.normalised_records(spark, d)
    return n.select("id", F.array_join(F.when(F.col("country") == "fr", X.french_address_tokens(F.col("addr"))).otherwise(F.col("addr")), " ").alias("addr"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[&+]', ' and ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SUFFIXED = rf"trim(regexp_replace(regexp_replace(n, '\b(?:{'|'.join(X.SUFFIXES)})\b', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT s, n AS name, {_SUFFIXED} AS clean FROM (SELECT s, {_PLAIN} AS n FROM (SELECT * FROM {_literals(_TRICKY)} UNION ALL SELECT business_name FROM rec))")
def plain_names(spark, d):
    rows = spark.createDataFrame([(x,) for x in _TRICKY], "s string").unionByName(src.er_records(spark, d).select(F.col("business_name").alias("s")))
    return rows.select("s", X.plain_name("s").alias("name")).select("s", "name", X.without_suffixes(F.col("name")).alias("clean"))


# ---- retrieval --------------------------------------------------------------------------------------------------------

_WORDS = "list_concat(tokens, CASE WHEN len(tokens) < 2 THEN [] ELSE list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) END)"
_CHARS = "flatten(list_transform(tokens, lambda t: CASE WHEN length(t) = 0 THEN [' ' || t || ' '] ELSE list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(' ' || t || ' ', i, 3)), CASE WHEN length(t) < 2 THEN [] ELSE list_transform(range(1, length(t)), lambda i: substr(' ' || t || ' ', i, 4)) END) END))"


def _global_sql(terms: str, k: int, min_df: int, max_df: float) -> str:
    tf = lambda side: f"SELECT id, country, term, count(*) AS tf FROM (SELECT id, country, unnest({terms}) AS term FROM {side}) GROUP BY ALL"
    idf = f"SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM ({tf('qn')}) GROUP BY ALL), (SELECT count(*) AS n FROM qn) WHERE df >= {min_df} AND df <= {max_df} * n"
    w = lambda side: f"SELECT id, country, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, country, term, (1 + ln(tf)) * idf AS w FROM ({tf(side)}) JOIN ({idf}) USING (term))"
    cos = f"SELECT a.id AS s_id, b.id AS q_id, round(sum(a.w * b.w), 6) AS cos FROM ({w('s1n')}) a JOIN ({w('qn')}) b USING (country, term) GROUP BY ALL"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY cos DESC, q_id) AS rank FROM ({cos})) WHERE rank <= {k}"


def _global(spark, d, grams, k, min_df, max_df) -> DataFrame:
    s1, q = (x.withColumn("grams", grams(F.col("tokens"))) for x in _sides(spark, d))
    keep = lambda df, part: store.kept(spark, d, f"{grams.__name__}-{k}-{min_df}-{max_df}-{part}", lambda: df)
    return N.global_topk(q, s1, "grams", k, min_df, max_df, keep)


@query(_global_sql(_WORDS, 10, 2, 0.2))
def word_tfidf_topk(spark, d):
    return _global(spark, d, R.word_grams, 10, 2, 0.2)


@query(_global_sql(_CHARS, 20, 2, 0.2))
def char_tfidf_topk(spark, d):
    return _global(spark, d, R.bounded_grams, 20, 2, 0.2)


@query(f"{_UNION_SQL} UNION {_RARE} UNION SELECT q_id, s_id FROM ({_global_sql(_CHARS, 20, 2, 0.2)})")
def hybrid_union(spark, d):
    return block_union(spark, d).unionByName(rare_token_block(spark, d)).unionByName(char_tfidf_topk(spark, d).select("q_id", "s_id")).distinct()


@query("SELECT q_id, s_id, cos_comb, rank FROM cand WHERE country <> 'fr' OR rank <= 5")
def patch_queries(spark, d):
    renewed = _sides(spark, d)[1].where("country = 'fr'").select(F.col("id").alias("q_id"))
    return R.patched(L.candidates(spark, d), L.candidates(spark, d, 5), renewed).select("q_id", "s_id", "cos_comb", "rank")


@query("SELECT (SELECT count(*) FROM cand) AS kept, round(1 - (SELECT count(*) FROM cand) / sum(s.n * q.n), 6) AS reduction FROM (SELECT country, count(*) AS n FROM s1n GROUP BY 1) s JOIN (SELECT country, count(*) AS n FROM qn GROUP BY 1) q USING (country)")
def reduction_ratio(spark, d):
    s1, q = _sides(spark, d)
    n = lambda x, to: x.groupBy("country").agg(F.count("*").alias(to))
    all_ = n(s1, "s").join(n(q, "q"), "country").agg(F.sum(F.col("s") * F.col("q")).alias("all"))
    return L.candidates(spark, d).agg(F.count("*").alias("kept")).join(F.broadcast(all_)).select("kept", F.round(1 - F.col("kept") / F.col("all"), 6).alias("reduction"))  # one row each


# ---- features ---------------------------------------------------------------------------------------------------------

_B = lambda c: f"CASE WHEN len({c}) = 0 THEN [''] ELSE {c} END"
_AD = f"len(list_intersect({_B('qad')}, {_B('sad')}))"


@query(f"SELECT q_id, s_id, length(qc) AS len_q, length(sc) AS len_s, round(least(length(qc), length(sc)) / greatest(length(qc), length(sc), 1), 6) AS len_ratio, round({_AD} / greatest(len(list_distinct(list_concat({_B('qad')}, {_B('sad')}))), 1), 6) AS ad_jacc, round({_AD} / greatest(len(list_distinct({_B('qad')})), 1), 6) AS ad_q_cov, {_COV} AS num_q_cov, length(array_to_string(qad, ' ')) AS ad_len_q, length(array_to_string(sad, ' ')) AS ad_len_s, addr_missing AS q_addr_missing FROM pairs")
def length_features(spark, d):
    return _pairs(spark, d).select("q_id", "s_id", *P.lengths_and_coverage())


_ONLY = lambda a, b, n: f"len(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x)))::BIGINT AS {n}"


@query(f"SELECT q_id, s_id, {_ONLY('qct', 'sct', 'nm_q_only')}, {_ONLY('sct', 'qct', 'nm_s_only')}, {_ONLY('qad', 'sad', 'ad_q_only')}, {_ONLY('qnum', 'snum', 'num_q_only')}, {_ONLY('snum', 'qnum', 'num_s_only')}, list_sort(list_distinct(qnum)) = list_sort(list_distinct(snum)) AS num_set_eq, coalesce(round(abs(qnum[1]::DOUBLE - snum[1]::DOUBLE) / greatest(qnum[1]::DOUBLE, snum[1]::DOUBLE, 1.0), 6), -1.0) AS num_rel_diff FROM pairs")
def difference_features(spark, d):
    return _pairs(spark, d).select("q_id", "s_id", *P.differences())


@query("SELECT q_id, s_id, qsrc = 'S3' AS q_is_s3, is_domain AS q_domain, has_indic AS q_indic, n AS s1_name_dup, coalesce(g, 0) AS s1_rank1_deg FROM pairs JOIN (SELECT id AS s_id, count(*) OVER (PARTITION BY country, core) AS n FROM s1n) USING (s_id) LEFT JOIN (SELECT s_id, count(*) AS g FROM cand WHERE rank = 1 GROUP BY 1) USING (s_id)")
def flag_features(spark, d):
    return P.flagged(_pairs(spark, d), _sides(spark, d)[0])


# ---- decisions --------------------------------------------------------------------------------------------------------

_GRID = (0.5, 0.6, 0.7, 0.8)
_GRID_SQL = "[0.5, 0.6, 0.7, 0.8]::DOUBLE[]"


def _crossfit_sql(sweep: str) -> str:
    best = f"SELECT max(CASE WHEN half = 0 THEN b END) AS t_h0, max(CASE WHEN half = 1 THEN b END) AS t_h1 FROM (SELECT half, arg_max(t, (f, -t)) AS b FROM ({sweep}) GROUP BY half)"
    return f"SELECT t_h0, t_h1, round((max(CASE WHEN half = 0 AND t = t_h1 THEN f END) + max(CASE WHEN half = 1 AND t = t_h0 THEN f END)) / 2, 6) AS crossfit FROM ({sweep}), ({best}) GROUP BY ALL"


_SEGMENT = swept(f"SELECT t, q_id, s_id FROM (SELECT x.*, q.src, unnest({_GRID_SQL}) AS t FROM top3 x JOIN qn q ON q.id = x.q_id) WHERE CASE WHEN src = 'S3' THEN p1 >= t ELSE p1 >= 0.7 END", _GRID_SQL)


@query("SELECT q_id, s_id, country FROM top3 JOIN qn ON qn.id = q_id WHERE CASE WHEN country = 'fr' THEN p1 >= 0.6 ELSE p1 >= 0.7 END")
def assemble_by_country(spark, d):
    t = _top(spark, d)
    return E.assembled({"fr": (t, 0.6), None: (t, 0.7)}).select("q_id", "s_id", "country")


@query(_crossfit_sql(_SEGMENT))
def segment_threshold(spark, d):
    t = E.top3(L.scored(spark, d)).join(_sides(spark, d)[1].select(F.col("id").alias("q_id"), "src"), "q_id")
    return E.cross_fitted(E.swept(_entities(spark, d), L.truth(spark, d), E.by_segment(t, F.col("src") == "S3", _GRID, 0.7), _GRID))


_PLACES = f"SELECT t, q_id, s_id FROM (SELECT *, unnest({_GRID_SQL}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY p1 DESC, q_id) AS place FROM top3 WHERE p1 >= 0.3)) WHERE CASE WHEN place > 1 THEN p1 >= t ELSE p1 >= 0.7 END"


@query(_crossfit_sql(swept(_PLACES, _GRID_SQL)))
def first_additional_threshold(spark, d):
    t = E.place_on_entity(E.top3(L.scored(spark, d)))
    return E.cross_fitted(E.swept(_entities(spark, d), L.truth(spark, d), E.by_segment(t, F.col("place") > 1, _GRID, 0.7), _GRID))


@query("SELECT q_id, s_id, round(CASE WHEN p1 BETWEEN 0.001 AND 0.6 THEN cos_name ELSE p1 END, 6) AS p FROM top3 JOIN cand USING (q_id, s_id)")
def gate_blend(spark, d):
    both = E.top3(L.scored(spark, d)).join(L.candidates(spark, d).select("q_id", "s_id", "cos_name"), ["q_id", "s_id"])
    return both.select("q_id", "s_id", F.round(M.gated(F.col("p1"), F.col("cos_name"), 0.001, 0.6), 6).alias("p"))


@query("SELECT q_id, s_id, w, round(w * p1 + (1 - w) * cos_name, 7) AS p FROM top3 JOIN cand USING (q_id, s_id), (SELECT unnest([0.0, 0.5])::DOUBLE AS w)")
def arith_blend(spark, d):
    both = E.top3(L.scored(spark, d)).join(L.candidates(spark, d).select("q_id", "s_id", "cos_name"), ["q_id", "s_id"]).withColumn("w", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    return both.select("q_id", "s_id", "w", F.round(M.blended(F.col("p1"), F.col("cos_name"), F.col("w")), 7).alias("p"))


@query("SELECT q.q_id, q.country, sum((p.p1 >= g.v)::INT)::BIGINT AS step FROM top3 p JOIN (SELECT id AS q_id, country FROM qn) q USING (q_id) JOIN (SELECT country, unnest(quantile_cont(p1, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v FROM top3 JOIN qn ON qn.id = q_id GROUP BY country) g USING (country) GROUP BY ALL")
def quantile_normalise(spark, d):
    return M.quantile_steps(_top(spark, d), "p1", "country", 10).select("q_id", "country", "step")


# ---- evaluation -------------------------------------------------------------------------------------------------------


@query("SELECT s_id, country || '|' || replace(core, ' ', '') AS family FROM (SELECT id AS s_id, country, core FROM s1n)")
def family_key(spark, d):
    return _families(spark, d)


def _families(spark, d) -> DataFrame:
    return _sides(spark, d)[0].select(F.col("id").alias("s_id"), F.concat_ws("|", "country", F.replace("core", F.lit(" "), F.lit(""))).alias("family"))


def _at(t: float) -> str:
    return f"SELECT s_id, {_F} AS f FROM (SELECT e.s_id, coalesce(sum(h), 0) AS tp, coalesce(sum(1 - h), 0) AS fp, (SELECT count(*) FROM truth z WHERE z.s_id = e.s_id) - coalesce(sum(h), 0) AS fn FROM ents e LEFT JOIN (SELECT p.s_id, (x.q_id IS NOT NULL)::INT AS h FROM top3 p LEFT JOIN truth x USING (q_id, s_id) WHERE p.p1 >= {t}) USING (s_id) GROUP BY e.s_id)"


_FAM = f"SELECT country || '|' || replace(core, ' ', '') AS family, count(*) AS n, sum(a.f) AS a, sum(b.f) AS b FROM s1n JOIN ({_at(0.5)}) a ON a.s_id = id JOIN ({_at(0.7)}) b ON b.s_id = id GROUP BY 1"
_TIMES = " + ".join(f"(u >= {x})::INT" for x in E._POISSON)
_BOOT = f"SELECT round, sum(({_TIMES}) * (b - a)) / sum(({_TIMES}) * n) AS diff FROM (SELECT *, {_HASH('family || chr(35) || round')}::DOUBLE / 4294967296.0 AS u FROM ({_FAM}), (SELECT unnest(range(0, 50)) AS round)) GROUP BY round"


@query(f"SELECT (SELECT round(sum(b - a) / sum(n), 6) FROM ({_FAM})) AS diff, round(quantile_cont(diff, 0.025), 5) AS low, round(quantile_cont(diff, 0.975), 5) AS high FROM ({_BOOT})")
def paired_bootstrap(spark, d):
    t = E.top3(L.scored(spark, d))
    a, b = (_entity_f(spark, d, t.where(F.col("p1") >= x)).select("s_id", F.col("f").alias(n)) for x, n in ((0.5, "a"), (0.7, "b")))
    f = _families(spark, d).join(a, "s_id").join(b, "s_id").groupBy("family").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = f.agg(F.round(F.sum(F.col("b") - F.col("a")) / F.sum("n"), 6).alias("diff"))
    spread = E.bootstrap(f, 50).agg(F.round(F.percentile("diff", 0.025), 5).alias("low"), F.round(F.percentile("diff", 0.975), 5).alias("high"))
    return whole.join(F.broadcast(spread))  # one row each


@query("SELECT src, sum(t * p)::BIGINT AS tp, sum((1 - t) * p)::BIGINT AS fp, sum(t * (1 - p))::BIGINT AS fn, round(sum(t * p) / greatest(sum(p), 1), 6) AS precision, round(sum(t * p) / greatest(sum(t), 1), 6) AS recall, round(1.25 * sum(t * p) / greatest(1.25 * sum(t * p) + 0.25 * sum(t * (1 - p)) + sum((1 - t) * p), 1e-9), 6) AS f05 FROM (SELECT q_id, coalesce(a.t, 0) AS t, coalesce(b.p, 0) AS p FROM (SELECT q_id, s_id, 1 AS t FROM truth) a FULL JOIN (SELECT q_id, s_id, 1 AS p FROM pred) b USING (q_id, s_id)) JOIN qn ON qn.id = q_id GROUP BY src")
def pair_metrics(spark, d):
    t, p = L.truth(spark, d).withColumn("t", F.lit(1)), L.linked_pairs(spark, d).select("q_id", "s_id").withColumn("p", F.lit(1))
    both = t.join(p, ["q_id", "s_id"], "full").na.fill(0, ["t", "p"]).join(_sides(spark, d)[1].select(F.col("id").alias("q_id"), "src"), "q_id")
    tp, fp, fn = F.sum(F.col("t") * F.col("p")), F.sum((1 - F.col("t")) * F.col("p")), F.sum(F.col("t") * (1 - F.col("p")))
    share = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return both.groupBy("src").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), share(tp, F.sum("p")).alias("precision"), share(tp, F.sum("t")).alias("recall"), F.round(1.25 * tp / F.greatest(1.25 * tp + 0.25 * fn + fp, F.lit(1e-9)), 6).alias("f05"))


@query("SELECT count(*) AS singletons, round(avg((fp = 0)::INT), 6) AS accuracy FROM cnt WHERE tp + fn = 0")
def singleton_accuracy(spark, d):
    return _entity_f(spark, d).where("tp + fn = 0").agg(F.count("*").alias("singletons"), F.round(F.avg((F.col("fp") == 0).cast("int")), 6).alias("accuracy"))


@query(f"SELECT n > 1 AS ambiguous, {_MACRO} FROM cntf JOIN (SELECT id AS s_id, count(*) OVER (PARTITION BY country, core) AS n FROM s1n) USING (s_id) GROUP BY 1")
def ambiguous_names(spark, d):
    n = _sides(spark, d)[0].select(F.col("id").alias("s_id"), (F.count("*").over(W.partitionBy("country", "core")) > 1).alias("ambiguous"))
    return E.macro_f(_entity_f(spark, d).join(n, "s_id"), "ambiguous")


_KEPT = "s_id % 11 <> 3"
_LINKS = "SELECT p.q_id, p.s_id, coalesce(x.s_id = p.s_id, false)::INT AS h, x.s_id IS NULL OR x.s_id % 11 = 3 AS lost FROM pred p LEFT JOIN truth x USING (q_id)"
_DROPPED = f"SELECT k, round(avg({_F}), 6) AS f05 FROM (SELECT s_id, k, coalesce(sum(h), 0) AS tp, coalesce(sum(CASE WHEN h IS NULL OR h = 1 THEN 0 WHEN lost THEN k ELSE 1 END), 0) AS fp, max(n) - coalesce(sum(h), 0) AS fn FROM (SELECT s_id, (SELECT count(*) FROM truth z WHERE z.s_id = ents.s_id) AS n, unnest([1, 2, 4]) AS k FROM ents WHERE {_KEPT}) LEFT JOIN ({_LINKS}) USING (s_id) GROUP BY s_id, k) GROUP BY k"


@query(_DROPPED)
def dropped_truth(spark, d):
    """Entities taken out of the catalog: their records count as unmatched, and wrong links of unmatched records count 1, 2 and 4 times."""
    kept = _entities(spark, d).where(_KEPT).select("s_id")
    return E.with_multiplicity(kept, L.truth(spark, d), L.linked_pairs(spark, d), (1, 2, 4))


_STRESS = f"SELECT s_id, {_F} AS f, tp + fn AS k FROM (SELECT e.s_id, coalesce(sum(h), 0) AS tp, coalesce(sum(1 - h), 0) AS fp, (SELECT count(*) FROM truth z WHERE z.s_id = e.s_id) - coalesce(sum(h), 0) AS fn FROM (SELECT s_id FROM ents WHERE s_id NOT IN (SELECT s_id FROM rm)) e LEFT JOIN (SELECT p.s_id, (x.q_id IS NOT NULL)::INT AS h FROM strest p LEFT JOIN truth x USING (q_id, s_id) WHERE p.p1 >= 0.7) USING (s_id) GROUP BY e.s_id)"


def _stress(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalog without one entity of each group of twins, those twins that stay, and the records' best candidates among what stays."""
    s1 = _sides(spark, d)[0]
    groups = s1.groupBy("country", "core").agg(F.max("id").alias("removed"), F.count("*").alias("members"), F.countDistinct("business_address").alias("a")).where("members >= 2 AND a >= 2")
    removed = groups.select(F.col("removed").alias("s_id"))
    left = s1.select(F.col("id").alias("s_id"), "country", "core").join(removed, "s_id", "left_anti")
    return left, left.join(groups.select("country", "core"), ["country", "core"], "left_semi").select("s_id"), E.top3(L.scored(spark, d).join(removed, "s_id", "left_anti"))


@query(f"SELECT count(*) AS n, round(avg(f), 6) AS f_all, round(avg(f) FILTER (tw), 6) AS f_twins, count(*) FILTER (tw) AS n_twins, round(avg(f) FILTER (tw AND k = 0), 6) AS f_twins_zero FROM (SELECT *, s_id IN (SELECT id FROM s1n JOIN rm USING (country, core)) AS tw FROM ({_STRESS}))")
def stress_eval(spark, d):
    left, twins, top = _stress(spark, d)
    c = E.entity_counts(left, L.truth(spark, d), top.where("p1 >= 0.7")).join(twins.withColumn("tw", F.lit(True)), "s_id", "left").withColumn("tw", F.coalesce("tw", F.lit(False)))
    # entity_counts also sees links to removed entities; only those that stay are counted.
    f = E.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))
    mean = lambda cond: F.round(F.avg(F.when(cond, f)), 6)
    return c.agg(F.count("*").alias("n"), mean(F.lit(True)).alias("f_all"), mean(F.col("tw")).alias("f_twins"), F.count_if("tw").alias("n_twins"), mean(F.col("tw") & (F.col("tp") + F.col("fn") == 0)).alias("f_twins_zero"))


@query("SELECT least(k, 8) AS cluster_size, count(*) AS records, round(avg((coalesce(p1, 0) >= 0.7)::INT), 6) AS accepted FROM (SELECT x.q_id, count(*) OVER (PARTITION BY x.s_id) AS k, p1 FROM truth x JOIN rm USING (s_id) LEFT JOIN strest p USING (q_id)) GROUP BY 1")
def stress_distractors(spark, d):
    left, _, top = _stress(spark, d)
    lost = L.truth(spark, d).join(left, "s_id", "left_anti").withColumn("k", F.count("*").over(W.partitionBy("s_id")))
    rows = lost.select("q_id", "k").join(top.select("q_id", "p1"), "q_id", "left")
    return rows.groupBy(F.least("k", F.lit(8)).alias("cluster_size")).agg(F.count("*").alias("records"), F.round(F.avg((F.coalesce("p1", F.lit(0.0)) >= 0.7).cast("int")), 6).alias("accepted"))


_CC = f"SELECT p.q_id, t.p1, coalesce(x.s_id = t.s_id, false) AS correct FROM top3 t JOIN pairs p USING (q_id, s_id) JOIN ({_GROUP}) g USING (q_id, s_id) LEFT JOIN truth x ON x.q_id = t.q_id WHERE {_CONFLICT} AND g.sup_nums_all >= 1"
_BAND = "CASE WHEN p1 < 0.1 THEN '0.0-0.1' WHEN p1 < 0.5 THEN '0.1-0.5' WHEN p1 < 0.7 THEN '0.5-0.7' ELSE '0.7-1.0' END"


@query(f"SELECT {_BAND} AS band, count(*) AS n, round(avg(correct::INT), 6) AS true_rate, round(avg((p1 >= 0.7)::INT), 6) AS accept_rate FROM ({_CC}) GROUP BY 1")
def conflict_segment(spark, d):
    pairs = _pairs(spark, d).where(P.conflict()).select("q_id", "s_id")
    t = E.top3(L.scored(spark, d)).join(pairs, ["q_id", "s_id"], "left_semi").join(_siblings(spark, d).where("sup_nums_all >= 1").select("q_id", "s_id"), ["q_id", "s_id"], "left_semi")
    t = t.join(L.truth(spark, d).select("q_id", F.col("s_id").alias("x")), "q_id", "left").withColumn("correct", F.coalesce(F.col("x") == F.col("s_id"), F.lit(False)))
    p = F.col("p1")
    band = F.when(p < 0.1, "0.0-0.1").when(p < 0.5, "0.1-0.5").when(p < 0.7, "0.5-0.7").otherwise("0.7-1.0")
    return t.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("true_rate"), F.round(F.avg((p >= 0.7).cast("int")), 6).alias("accept_rate"))


@query(f"SELECT count(*) AS n, round(avg((cos_comb >= 0.7 AND gap >= 0.2)::INT), 6) AS strong, round(avg((cos_comb < 0.4)::INT), 6) AS weak, round(avg((qc = sc AND cov = 1 AND NOT cf AND NOT addr_missing)::INT), 6) AS same_name_and_numbers FROM (SELECT *, cos_comb - coalesce(second, 0.0) AS gap, {_CONFLICT} AS cf, {_COV} AS cov FROM pairs LEFT JOIN (SELECT q_id, cos_comb AS second FROM cand WHERE rank = 2) USING (q_id) WHERE rank = 1)")
def density_free_rules(spark, d):
    second = L.candidates(spark, d).where("rank = 2").select("q_id", F.col("cos_comb").alias("second"))
    r = _pairs(spark, d).where("rank = 1").join(second, "q_id", "left").withColumn("gap", F.col("cos_comb") - F.coalesce("second", F.lit(0.0))).withColumn("cov", P.number_coverage())
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    same = (F.col("qc") == F.col("sc")) & (F.col("cov") == 1) & ~P.conflict() & ~F.col("addr_missing")
    return r.agg(F.count("*").alias("n"), rate((F.col("cos_comb") >= 0.7) & (F.col("gap") >= 0.2)).alias("strong"), rate(F.col("cos_comb") < 0.4).alias("weak"), rate(same).alias("same_name_and_numbers"))


@query()
def density_free_likeness(spark, d):
    r = _pairs(spark, d).where("rank = 1").select("addr_missing", P.number_coverage(), P.conflict().alias("cf"), _edits())
    name, place = F.col("e.nm_tset"), F.col("e.ad_tset")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return r.agg(F.count("*").alias("n"), rate((name >= 95) & (place >= 95)).alias("near_identical"), rate((name >= 90) & (F.col("num_q_cov") == 1) & ~F.col("cf") & ~F.col("addr_missing")).alias("name_and_numbers"))


@query()
def fp_reason_tags(spark, d):
    """Why a wrong link may have been made, by the first rule that holds."""
    wrong = L.linked_pairs(spark, d).join(L.truth(spark, d), ["q_id", "s_id"], "left_anti")
    p = _pairs(spark, d).join(wrong.select("q_id", "s_id"), ["q_id", "s_id"], "left_semi")
    p = p.select("q_id", "s_id", "addr_missing", P.conflict().alias("cf"), F.size(F.array_except("qnum", "snum")).alias("more"), _edits())
    reason = F.when(F.col("addr_missing"), "no_address_name_only").when(F.col("cf"), "numeric_mismatch").when(F.col("more") > 0, "extra_or_changed_number").when(F.col("e.nm_tset") < 90, "name_word_changed").when(F.col("e.ad_tset") < 90, "address_token_changed").otherwise("near_identical")
    return p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_TWIN = "SELECT t.q_id, t.s_id, t.p1, q.numbers <> s.numbers AS dev, q.core <> s.core AS name_dev, len(q.numbers) > 0 AS has, count(*) OVER (PARTITION BY t.s_id, q.numbers) AS same_nums, count(*) OVER (PARTITION BY t.s_id, q.core) AS same_name, count(*) OVER (PARTITION BY t.s_id) AS size, sum((t.p1 >= 0.7)::INT) OVER (PARTITION BY t.s_id) AS taken FROM top3 t JOIN qn q ON q.id = t.q_id JOIN s1n s ON s.id = t.s_id"


@query(f"SELECT CASE WHEN p1 >= 0.7 THEN CASE WHEN x.q_id IS NOT NULL THEN 'TP' ELSE 'FP' END ELSE CASE WHEN x.q_id IS NOT NULL THEN 'FN' ELSE 'TN' END END AS cls, count(*) AS n, round(avg(dev::INT), 6) AS share_nums_dev, round(avg(same_nums - 1) FILTER (dev AND has), 6) AS mean_dev_support, round(avg((same_nums > 1)::INT) FILTER (dev AND has), 6) AS share_dev_supported, round(avg(same_name - 1) FILTER (name_dev), 6) AS mean_name_dev_support, round(avg(size), 6) AS mean_group_size, round(avg(taken), 6) AS mean_accepted FROM ({_TWIN}) LEFT JOIN truth x USING (q_id, s_id) GROUP BY 1")
def twin_stats(spark, d):
    s1, q = _sides(spark, d)
    t = E.top3(L.scored(spark, d)).select("q_id", "s_id", "p1").join(q.select(F.col("id").alias("q_id"), F.col("numbers").alias("qn"), F.col("core").alias("qc")), "q_id").join(s1.select(F.col("id").alias("s_id"), F.col("numbers").alias("sn"), F.col("core").alias("sc")), "s_id")
    n = lambda *by: F.count("*").over(W.partitionBy("s_id", *by))
    t = t.withColumn("same_nums", n("qn")).withColumn("same_name", n("qc")).withColumn("size", n()).withColumn("taken", F.sum((F.col("p1") >= 0.7).cast("int")).over(W.partitionBy("s_id")))
    t = t.join(L.truth(spark, d).withColumn("hit", F.lit(True)), ["q_id", "s_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    dev, name, has = F.col("qn") != F.col("sn"), F.col("qc") != F.col("sc"), F.size("qn") > 0
    mean = lambda x, c=None: F.round(F.avg(x if c is None else F.when(c, x)), 6)
    cls = F.when(F.col("p1") >= 0.7, F.when(F.col("hit"), "TP").otherwise("FP")).otherwise(F.when(F.col("hit"), "FN").otherwise("TN"))
    return t.groupBy(cls.alias("cls")).agg(F.count("*").alias("n"), mean(dev.cast("int")).alias("share_nums_dev"), mean(F.col("same_nums") - 1, dev & has).alias("mean_dev_support"), mean((F.col("same_nums") > 1).cast("int"), dev & has).alias("share_dev_supported"), mean(F.col("same_name") - 1, name).alias("mean_name_dev_support"), mean(F.col("size")).alias("mean_group_size"), mean(F.col("taken")).alias("mean_accepted"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN q.business_address = '' OR s.business_address = '' THEN 'missing address' WHEN q.core = s.core THEN 'legal suffix variation' WHEN list_sort(list_distinct(q.ctok)) = list_sort(list_distinct(s.ctok)) THEN 'token reordering' WHEN len(list_intersect(q.tokens, s.tokens)) = 0 THEN 'different-looking names' ELSE 'spelling variation' END AS category FROM (SELECT q_id, s_id FROM cand WHERE rank <= 2 EXCEPT SELECT q_id, s_id FROM pred) m JOIN qn q ON q.id = m.q_id JOIN s1n s ON s.id = m.s_id) GROUP BY 1")
def missed_match_categories(spark, d):
    """What sets pairs apart that weren't linked; on the fixture the two best candidates, as its true pairs have equal names."""
    missed = L.candidates(spark, d).where("rank <= 2").select("q_id", "s_id").exceptAll(L.linked_pairs(spark, d).select("q_id", "s_id"))
    p = _pairs(spark, d).join(missed, ["q_id", "s_id"], "left_semi")
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    c = F.when((F.col("qa") == "") | (F.col("sa") == ""), "missing address").when(F.col("qc") == F.col("sc"), "legal suffix variation").when(same("qct", "sct"), "token reordering").when(F.size(F.array_intersect("qt", "st")) == 0, "different-looking names").otherwise("spelling variation")
    return p.groupBy(c.alias("category")).agg(F.count("*").alias("n"))
