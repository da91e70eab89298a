"""Candidate generation: exact keys, rare tokens, and TF-IDF by an inverted index.

`cosines` joins postings on (country, term), which gives the exact dot product of all pairs that share a term; its rows grow with both sides of a common term. `best` gives the same k best of each query without them: a floor under the query's k-th best score, found from its rarest terms, tells which common terms can't bring a pair to the top by themselves; those are only looked up for pairs that can still get there."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def name_grams(core: Column, n: int = 3) -> Column:
    """Runs of n characters of '<core without blanks>', with repeats."""
    text = F.concat(F.lit("<"), F.replace(core, F.lit(" "), F.lit("")), F.lit(">"))
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def tfidf(catalog: DataFrame, queries: DataFrame, terms: str, min_df: int = 2, max_df: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Unit weights (id, country, term, w) of both sides. The vocabulary and ln((1 + n) / (1 + df)) + 1 come from the catalog of a country; tf counts as 1 + ln(tf)."""
    tf = lambda d: d.select("id", "country", F.explode(terms).alias("term")).groupBy("id", "country", "term").agg(F.count("*").alias("tf"))
    s = tf(catalog)
    n = catalog.groupBy("country").agg(F.count("*").alias("n"))
    df = s.groupBy("country", "term").agg(F.count("*").alias("df")).join(n, "country").where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n")))
    idf = df.select("country", "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))

    def weights(side: DataFrame) -> DataFrame:
        raw = side.join(idf, ["country", "term"]).withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
        return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))).select("id", "country", "term", "w")

    return weights(s), weights(tf(queries))


def cosines(catalog: DataFrame, queries: DataFrame, terms: str, to: str, **limits) -> DataFrame:
    """(q_id, s_id, country, to) of all pairs that share a term."""
    s, q = tfidf(catalog, queries, terms, **limits)
    pairs = q.select(F.col("id").alias("q_id"), "country", "term", F.col("w").alias("wq")).join(s.select(F.col("id").alias("s_id"), "country", "term", F.col("w").alias("ws")), ["country", "term"])
    return pairs.groupBy("q_id", "s_id", "country").agg(F.round(F.sum(F.col("wq") * F.col("ws")), 6).alias(to))


#: Pairs of postings that are joined all at once; beyond, only those that can bring a pair to the top. Both ways give the same rows.
AT_ONCE = 100_000_000
#: Postings, for each of the k, from which the floor under a query's k-th best score is found.
PROBE = 16
#: More than rounding can move a score by.
SLACK = 2e-6


def postings(catalog: DataFrame, queries: DataFrame, fields: dict[str, str], **limits) -> tuple[DataFrame, DataFrame]:
    """Weights (id, country, field, term, w) of both sides. fields: name -> column of terms."""
    both = [tuple(side.withColumn("field", F.lit(name)) for side in tfidf(catalog, queries, terms, **limits)) for name, terms in fields.items()]
    s, q = (reduce(DataFrame.unionByName, sides) for sides in zip(*both))
    return s, q


def best(s: DataFrame, q: DataFrame, shares: dict[str, float], k: int, to: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, at_once: int = AT_ONCE) -> DataFrame:
    """(q_id, s_id, country, each field's cosine, `to`, rank): the k best pairs of each query by the fields' cosines in their shares, among pairs that share a term; ties by the catalog id. Exact.

    s, q: postings. Up to at_once pairs of them, which is counted first, are joined as they are. Beyond, a floor under each query's k-th best score comes first: the least whole score of the k pairs that look best by the query's rarest terms. Its terms are put in order from the most common on; as long as all terms so far, by bounds of what they can give, stay below the floor, a pair that shares only these isn't among the best. So only the terms after them are joined. Pairs that could reach the floor with the left-out terms then get these by id. A query with fewer than k such pairs has no floor, and all its terms are joined. keep(rows, name) may write tables that are read twice."""
    share = reduce(lambda c, f: c.when(F.col("field") == f, F.lit(shares[f])), list(shares)[1:], F.when(F.col("field") == (first := list(shares)[0]), F.lit(shares[first])))
    score = reduce(lambda a, b: a + b, (F.col(f) * v for f, v in shares.items()))
    sums = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("wq") * F.col("ws"))), F.lit(0.0)).alias(f) for f in shares]

    s = keep(s, "catalog")
    terms = s.groupBy("country", "field", "term").agg(F.max("w").alias("most"), F.count("*").alias("df"))
    by_term = s.select(F.col("id").alias("s_id"), "country", "field", "term", F.col("w").alias("ws"))
    q = q.join(terms, ["country", "field", "term"]).withColumn("bound", share * F.col("w") * F.col("most"))
    q = keep(q.select(F.col("id").alias("q_id"), "country", "field", "term", F.col("w").alias("wq"), "df", "bound"), "queries")

    matched = lambda q, *more: q.select("q_id", "country", "field", "term", "wq").join(by_term, ["country", "field", "term"]).groupBy("q_id", "s_id", "country").agg(*sums, *more)

    def completed(pairs: DataFrame, left_out: DataFrame) -> DataFrame:
        """The pairs with what the left-out terms of their query add, looked up by both ids."""
        at = pairs.select("q_id", "s_id").join(left_out.select("q_id", "country", "field", "term", "wq"), "q_id")
        more = at.join(by_term.drop("country"), ["s_id", "field", "term"]).groupBy("q_id", "s_id", "country").agg(*sums)
        return pairs.select("q_id", "s_id", "country", *shares).unionByName(more).groupBy("q_id", "s_id", "country").agg(*(F.sum(f).alias(f) for f in shares))

    rounded = [F.round(f, 6).alias(f) for f in shares]
    if (q.agg(F.sum("df").alias("n")).first()["n"] or 0) <= at_once:
        return ranked(matched(q).select("q_id", "s_id", "country", *rounded).withColumn(to, F.round(score, 7)), k, to)

    one, term = W.partitionBy("q_id"), F.struct("field", "term")
    q = q.withColumn("before", F.coalesce(F.sum("df").over(one.orderBy("df", term).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    common = one.orderBy(F.desc("df"), term).rowsBetween(W.unboundedPreceding, 0)
    # Two bounds of what the terms so far can give: at their greatest weights, and for any catalog row, whose weights have length 1 in each field.
    lengths = reduce(lambda a, b: a + b, (shares[f] * F.sqrt(F.coalesce(F.sum(F.when(F.col("field") == f, F.col("wq") * F.col("wq"))).over(common), F.lit(0.0))) for f in shares))
    q = q.withColumn("covered", F.least(F.sum("bound").over(common), lengths))
    early = F.col("before") < PROBE * k
    probes = keep(ranked(matched(q.where(early)).withColumn("so_far", score), k, "so_far"), "probes")
    # k pairs of the query have this score at least, so the k-th best has.
    floor = completed(probes, q.where(~early)).groupBy("q_id").agg(F.count("*").alias("n"), F.min(score).alias("floor")).where(F.col("n") == k).drop("n")
    q = keep(q.join(floor, "q_id", "left").na.fill(0.0, ["floor"]).withColumn("asks", F.col("covered") >= F.col("floor") - SLACK).drop("before", "df", "bound"), "asks")

    late = q.where("NOT asks")
    square = lambda f, x: F.coalesce(F.sum(F.when(F.col("field") == f, F.col(x) * F.col(x))), F.lit(0.0))
    needs = q.groupBy("q_id").agg((F.max("floor") - SLACK).alias("needs"))
    rest = late.groupBy("q_id").agg(F.max("covered").alias("rest"), *(square(f, "wq").alias(f"late_{f}") for f in shares))
    needs = needs.join(rest, "q_id", "left").na.fill(0.0)
    found = matched(q.where("asks"), *(square(f, "ws").alias(f"met_{f}") for f in shares)).join(needs, "q_id")
    # The weights of the catalog's row that were met leave the rest of length 1 for the left-out terms.
    room = reduce(lambda a, b: a + b, (shares[f] * F.sqrt(F.col(f"late_{f}") * F.greatest(1.0 - F.col(f"met_{f}"), F.lit(0.0))) for f in shares))
    found = found.where(score + F.least("rest", room) >= F.col("needs")).select("q_id", "s_id", "country", *shares)
    whole = completed(keep(found, "reach"), late).select("q_id", "s_id", "country", *rounded)
    return ranked(whole.withColumn(to, F.round(score, 7)), k, to)


def ranked(pairs: DataFrame, k: int = 10, by: str = "cos_comb") -> DataFrame:
    """The k best of each query; ties by the catalog id. Spark prunes inside each partition first (WindowGroupLimit)."""
    order = W.partitionBy("q_id").orderBy(F.col(by).desc(), F.col("s_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def rare_token_pairs(catalog: DataFrame, queries: DataFrame, least: int = 4, low: int = 2, high: int = 300) -> DataFrame:
    """Pairs by a catalog record's rarest token: `least` characters at least, in low to high records to link. Ties by the token."""
    q = queries.select("id", "country", F.explode(F.array_distinct("tokens")).alias("token")).where(F.length("token") >= least)
    freq = q.groupBy("token").agg(F.count("*").alias("f")).where(F.col("f").between(low, high))
    s = catalog.select("id", "country", F.explode(F.array_distinct("tokens")).alias("token")).join(freq, "token")
    rarest = s.groupBy("id", "country").agg(F.min(F.struct("f", "token"))["token"].alias("token"))
    return q.select(F.col("id").alias("q_id"), "country", "token").join(rarest.select(F.col("id").alias("s_id"), "country", "token"), ["country", "token"]).select("q_id", "s_id").distinct()


def equal_key_pairs(catalog: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """Pairs of one country with equal keys that aren't empty."""
    filled = lambda d, to: d.where(" AND ".join(f"{k} <> ''" for k in keys)).select(F.col("id").alias(to), "country", *keys)
    return filled(queries, "q_id").join(filled(catalog, "s_id"), ["country", *keys]).select("q_id", "s_id")


def word_grams(tokens: Column) -> Column:
    """Single words and runs of two, with repeats."""
    n = F.size(tokens)
    two = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(2)), " "))
    return F.concat(tokens, F.when(n < 2, F.array().cast("array<string>")).otherwise(two))


def bounded_grams(tokens: Column, low: int = 3, high: int = 4) -> Column:
    """Runs of `low` to `high` characters inside each word between blanks, with repeats; a shorter word between blanks as a whole."""

    def runs(word: Column, k: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(word) - (k - 1), F.lit(1)))
        return F.when(F.length(word) < k, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.substring(word, i, F.lit(k))))

    def one(t: Column) -> Column:
        word = F.concat(F.lit(" "), t, F.lit(" "))
        return F.when(F.length(word) < low, F.array(word)).otherwise(F.concat(*(runs(word, k) for k in range(low, high + 1))))

    return F.flatten(F.transform(tokens, one))


def patched(old: DataFrame, fresh: DataFrame, renewed: DataFrame) -> DataFrame:
    """The old candidates with those of the queries in `renewed` (q_id) taken out and the fresh ones of these queries put in."""
    return old.join(renewed, "q_id", "left_anti").unionByName(fresh.join(renewed, "q_id", "left_semi").select(old.columns))
