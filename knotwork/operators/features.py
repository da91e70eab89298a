"""What is known about a candidate pair. Sets and weights are expressions; edit ratios are one Arrow UDF that works on distinct pairs of strings."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from knotwork.functions import similarity as S

#: Inverse document frequencies lie between 0 and this; a token from RARE on is rare.
MOST_IDF, RARE = 12.0, 6.0


def _long(c: Column) -> Column:
    return c.cast("long")


def filled(tokens: Column) -> Column:
    """No tokens count as one empty one, so two empty sides share it."""
    return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(tokens)


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), 6)


def number_coverage() -> Column:
    q = F.array_distinct("qnum")
    return share(F.size(F.array_intersect(q, "snum")), F.size(q)).alias("num_q_cov")


def lengths_and_coverage() -> list[Column]:
    """Lengths of names and addresses, and how much of the query's address and numbers the entity has."""
    n, m = F.length("qc"), F.length("sc")
    a, b = filled(F.col("qad")), filled(F.col("sad"))
    both = F.size(F.array_intersect(a, b))
    return [_long(n).alias("len_q"), _long(m).alias("len_s"), F.round(F.least(n, m) / F.greatest(n, m, F.lit(1)), 6).alias("len_ratio"), share(both, F.size(F.array_union(a, b))).alias("ad_jacc"), share(both, F.size(F.array_distinct(a))).alias("ad_q_cov"), number_coverage(),
            _long(F.length(F.array_join("qad", " "))).alias("ad_len_q"), _long(F.length(F.array_join("sad", " "))).alias("ad_len_s"), F.col("addr_missing").alias("q_addr_missing")]


def differences() -> list[Column]:
    """Tokens and numbers that one side only has."""
    x, y = (F.get(c, F.lit(0)).try_cast("double") for c in ("qnum", "snum"))
    only = lambda a, b: _long(F.size(F.array_except(a, b)))
    apart = F.when(x.isNotNull() & y.isNotNull(), F.round(F.abs(x - y) / F.greatest(x, y, F.lit(1.0)), 6))
    return [only("qct", "sct").alias("nm_q_only"), only("sct", "qct").alias("nm_s_only"), only("qad", "sad").alias("ad_q_only"), only("qnum", "snum").alias("num_q_only"), only("snum", "qnum").alias("num_s_only"),
            (F.array_sort(F.array_distinct("qnum")) == F.array_sort(F.array_distinct("snum"))).alias("num_set_eq"), F.coalesce(apart, F.lit(-1.0)).alias("num_rel_diff")]


def conflict() -> Column:
    return (F.size("qnum") > 0) & (F.size("snum") > 0) & (F.size(F.array_intersect("qnum", "snum")) == 0)


def flagged(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Flags of the query, how many entities of the country have the entity's name, and how many queries have it first."""
    names = catalog.select(F.col("id").alias("s_id"), F.count("*").over(W.partitionBy("country", "core")).alias("s1_name_dup"))
    first = pairs.where("rank = 1").groupBy("s_id").agg(F.count("*").alias("s1_rank1_deg"))
    rows = pairs.select("q_id", "s_id", (F.col("qsrc") == "S3").alias("q_is_s3"), F.col("is_domain").alias("q_domain"), F.col("has_indic").alias("q_indic"))
    return rows.join(names, "s_id").join(first, "s_id", "left").na.fill(0, ["s1_rank1_deg"])


def margin(x: str) -> Column:
    """x less the best x of the query's other candidates; x itself where there is no other."""
    q = W.partitionBy("q_id")
    best, second = F.max(x).over(q), F.get(F.sort_array(F.collect_list(x).over(q), asc=False), F.lit(1))
    return F.round(F.coalesce(F.when(F.col(x) == best, F.col(x) - second).otherwise(F.col(x) - best), F.col(x)), 6)


def idf(catalog: DataFrame, tokens: str) -> DataFrame:
    """(country, token, idf) over the catalog of a country."""
    df = catalog.select("country", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))
    return df.join(catalog.groupBy("country").agg(F.count("*").alias("n")), "country").select("country", "token", F.round(F.greatest(F.least(F.log("n") - F.log(1 + F.col("df")), F.lit(MOST_IDF)), F.lit(0.0)), 6).alias("idf"))


def unseen(catalog: DataFrame) -> DataFrame:
    """(country, unseen): the weight of tokens that the catalog of a country doesn't have."""
    return catalog.groupBy("country").agg(F.round(F.greatest(F.least(F.log(F.count("*")), F.lit(MOST_IDF)), F.lit(0.0)), 6).alias("unseen"))


def weighed(records: DataFrame, catalog: DataFrame, tokens: str, to: str) -> DataFrame:
    """The records with their distinct tokens and what these weigh, in the order of the tokens. Weights are joined once for a record, not for each of its pairs."""
    t = records.select("id", "country", F.explode(F.array_distinct(tokens)).alias("token")).join(idf(catalog, tokens), ["country", "token"], "left").join(unseen(catalog), "country")
    rows = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", F.coalesce("idf", "unseen").alias("w")))).alias(to))
    return records.join(rows, "id", "left").withColumn(to, F.coalesce(to, F.array().cast("array<struct<token:string,w:double>>")))


def _shared(q: str, s: str, to: str) -> list[Column]:
    """Sums and largest weights of shared and one-sided tokens of a pair, from the weighed tokens of both."""
    within = lambda x, y, inside: F.filter(x, lambda t: F.array_contains(F.col(y)["token"], t["token"]) == inside)["w"]
    sum_ = lambda w: F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    most = lambda w: F.coalesce(F.array_max(w), F.lit(0.0))
    only = within(q, s, False)
    return [x.alias(f"{to}_{n}") for n, x in {"sh": sum_(within(q, s, True)), "qs": sum_(F.col(q)["w"]), "ss": sum_(F.col(s)["w"]), "qo": most(only), "so": most(within(s, q, False)), "qr": _long(F.size(F.filter(only, lambda w: w >= RARE)))}.items()]


def direct(pairs: DataFrame) -> DataFrame:
    """Sixteen pieces of evidence that look at the pair alone: weighted tokens of names and addresses (qctw, sctw, qalw, salw: `weighed`), numbers, equality as written."""
    cover = lambda x, y: F.round(F.col(x) / F.greatest(F.col(y), F.lit(1e-6)), 6)
    q, s = (F.transform(c, lambda x: x.try_cast("long")) for c in ("qnum", "snum"))
    a, b = F.get(q, F.lit(0)), F.get(s, F.lit(0))
    x, y = a.cast("double"), b.cast("double")
    low = lambda c: F.lower(F.trim(c))
    own = [F.coalesce(a == b, F.lit(False)).alias("prem_eq"), F.coalesce(F.array_contains(s, a), F.lit(False)).alias("prem_in_s"), F.coalesce(F.array_contains(q, b), F.lit(False)).alias("s_prem_in_q"), (F.size(F.array_except(q, s)) == 0).alias("q_nums_subset"),
           F.coalesce(F.round(F.abs(x - y) / F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y, F.lit(1.0))), 6), F.lit(-1.0)).alias("prem_close"), (low("qname") == low("sname")).alias("raw_name_eq"), (low("qa") == low("sa")).alias("raw_addr_eq")]
    names = [cover("nm_sh", "nm_qs").alias("nm_wcov_q"), cover("nm_sh", "nm_ss").alias("nm_wcov_s"), F.col("nm_qo").alias("nm_qonly_idf_max"), F.col("nm_so").alias("nm_sonly_idf_max"), F.round("nm_sh", 6).alias("nm_shared_idf")]
    places = [cover("ad_sh", "ad_qs").alias("ad_wcov_q"), F.col("ad_qo").alias("ad_qonly_idf_max"), F.col("ad_qr").alias("ad_qonly_n_rare"), F.round("ad_sh", 6).alias("ad_shared_idf")]
    rows = pairs.select("q_id", "s_id", *own, *_shared("qctw", "sctw", "nm"), *_shared("qalw", "salw", "ad"))
    return rows.select("q_id", "s_id", *(c for c in rows.columns[2:9]), *names, *places)


def siblings(top: DataFrame, records: DataFrame, sure: float = 0.5) -> DataFrame:
    """Thirteen numbers about the other records whose best entity is the same: how many, how many sure, their scores, and how many of them share numbers, the first number, the name, both; -1 for numbers where a record has none."""
    r = records.select(F.col("id").alias("q_id"), F.array_join("numbers", " ").alias("nums"), F.coalesce(F.get("numbers", F.lit(0)), F.lit("")).alias("num1"), F.replace("core", F.lit(" "), F.lit("")).alias("nkey"))
    d = top.select("q_id", "s_id", "p1").join(r, "q_id").withColumn("conf", (F.col("p1") >= sure).cast("long"))
    group = W.partitionBy("s_id")
    d = d.withColumn("g_all", F.count("*").over(group) - 1).withColumn("g_conf", F.sum("conf").over(group) - F.col("conf")).withColumn("g_psum", F.round(F.sum("p1").over(group) - F.col("p1"), 6))
    for tag, keys in {"nums": ["nums"], "num1": ["num1"], "name": ["nkey"], "both": ["nums", "nkey"]}.items():
        w = W.partitionBy("s_id", *keys)
        none = (F.col("nums") == "") if tag != "name" else F.lit(False)
        d = d.withColumn(f"sup_{tag}_all", F.when(none, -1).otherwise(F.count("*").over(w) - 1)).withColumn(f"sup_{tag}_conf", F.when(none, -1).otherwise(F.sum("conf").over(w) - F.col("conf")))
    part = lambda tag: F.round(F.col(f"sup_{tag}_conf") / F.greatest("g_conf", F.lit(1)), 6).alias(f"sup_{tag}_frac")
    return d.select("q_id", "s_id", "g_all", "g_conf", "g_psum", *(f"sup_{t}_{k}" for t in ("nums", "num1", "name", "both") for k in ("all", "conf")), part("nums"), part("name"))


EDITS = ["nm_ratio", "nm_tset", "nm_tsort", "nm_partial", "key_ratio", "key_partial", "key_jw", "full_ratio", "ad_ratio", "ad_tset", "ad_tsort", "ad_partial", "nm_diff_ratio", "ad_qonly_in_s"]
_EDITS = StructType([StructField(n, DoubleType()) for n in EDITS])


def _cached(f):
    return functools.lru_cache(maxsize=100_000)(f)


_ratio, _sort, _set, _partial, _jw = map(_cached, (S.ratio, S.token_sort, S.token_set, S.partial, S.jaro_winkler))


def _edits(qc: str, sc: str, qn: str, sn: str, qa: str, sa: str) -> tuple:
    x, y = qc.replace(" ", ""), sc.replace(" ", "")
    only = lambda a, b: " ".join(sorted({*a.split()} - {*b.split()}))
    dq, ds, da = only(qc, sc), only(sc, qc), only(qa, sa)
    return (_ratio(qc, sc), _set(qc, sc), _sort(qc, sc), _partial(qc, sc), _ratio(x, y), _partial(x, y), _jw(x, y), _ratio(qn, sn), _ratio(qa, sa), _set(qa, sa), _sort(qa, sa), _partial(qa, sa), _ratio(dq, ds) if dq or ds else 100.0, _partial(da, sa) if da else 100.0)


@F.pandas_udf(_EDITS)
def edits(qc: pd.Series, sc: pd.Series, qn: pd.Series, sn: pd.Series, qa: pd.Series, sa: pd.Series) -> pd.DataFrame:
    """Fourteen edit-based likenesses of cores, whole names and normalised addresses."""
    memo: dict[tuple, tuple] = {}
    rows = zip(*(c.fillna("") for c in (qc, sc, qn, sn, qa, sa)))
    return pd.DataFrame([memo.get(r) or memo.setdefault(r, _edits(*r)) for r in rows], columns=EDITS)


def _likenesses(a: str, b: str, n: str, m: str) -> tuple:
    return _set(a, b), _ratio(a, b), _set(n, m)


_NEAR = StructType([StructField(n, DoubleType()) for n in ("sa", "sa_r", "sn")])


@F.pandas_udf(_NEAR)
def _near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_likenesses(*r) for r in zip(a, b, n, m)], columns=_NEAR.names)


def fuzzy_siblings(top: DataFrame, records: DataFrame, sure: float = 0.5) -> DataFrame:
    """Eight numbers about how alike a record is to the others whose best entity is the same; -1 where there are none. Pairs of records lie within one entity, and go into a maximum at once."""
    d = top.select("q_id", "s_id", "p1").join(records.select(F.col("id").alias("q_id"), F.array_join("addr", " ").alias("addr"), "core"), "q_id")
    o = d.select("s_id", F.col("q_id").alias("o_id"), (F.col("p1") >= sure).alias("o_conf"), F.col("addr").alias("o_addr"), F.col("core").alias("o_core"))
    p = d.join(o, "s_id").where("q_id <> o_id").select("q_id", "o_conf", _near("addr", "o_addr", "core", "o_core").alias("x")).select("q_id", "o_conf", "x.*").withColumn("both", F.least("sa_r", "sn"))
    conf, non = F.col("o_conf"), ~F.col("o_conf")
    most = lambda c, x: F.max(F.when(c, F.col(x)))
    n90 = lambda c: F.count_if(c & (F.col("both") >= 90)).cast("double")
    got = p.groupBy("q_id").agg(most(conf, "sa").alias("fz_addr_conf"), most(conf, "sa_r").alias("fz_addr_r_conf"), most(conf, "sn").alias("fz_name_conf"), most(conf, "both").alias("fz_both_conf"), n90(conf).alias("fz_n90_conf"), most(non, "sa_r").alias("fz_addr_r_non"), most(non, "both").alias("fz_both_non"), n90(non).alias("fz_n90_non"))
    return top.select("q_id").join(got, "q_id", "left").na.fill(-1.0)
