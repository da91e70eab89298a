"""Decisions on scored candidates, and what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BETA2 = 0.25


def bucket(x: Column, n: int) -> Column:
    """A number below n that depends on the text of x only: eight hexadecimal digits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n))


def top3(scored: DataFrame) -> DataFrame:
    """Per record the three best candidates: s_id, p1, s_2, p2, p3; missing scores are 0."""
    order = W.partitionBy("q_id").orderBy(F.col("p").desc(), F.col("s_id"))
    r = scored.withColumn("r", F.row_number().over(order)).where("r <= 3")
    at = lambda i, c: F.max(F.when(F.col("r") == i, F.col(c)))
    return r.groupBy("q_id").agg(at(1, "s_id").alias("s_id"), at(1, "p").alias("p1"), at(2, "s_id").alias("s_2"), F.coalesce(at(2, "p"), F.lit(0.0)).alias("p2"), F.coalesce(at(3, "p"), F.lit(0.0)).alias("p3"))


def f_beta(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 from counts; nothing predicted where nothing is true counts 1."""
    return F.when(tp + fp + fn == 0, 1.0).otherwise(5.0 * tp / F.greatest(5 * tp + 4 * fp + fn, F.lit(1)))


def entity_counts(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """s_id, tp, fp, fn of each entity; entities: s_id; truth and predicted: (q_id, s_id), repeats count once."""
    t = truth.select("q_id", "s_id").distinct().withColumn("t", F.lit(1))
    p = predicted.select("q_id", "s_id").distinct().withColumn("p", F.lit(1))
    both = t.join(p, ["q_id", "s_id"], "full").na.fill(0, ["t", "p"])
    per = both.groupBy("s_id").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    return entities.select("s_id").distinct().join(per, "s_id", "left").na.fill(0)


def macro_f(counts: DataFrame, *by: str) -> DataFrame:
    f = f_beta(F.col("tp"), F.col("fp"), F.col("fn"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, (F.col("fn") == 0).cast("double")).otherwise(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))
    recall = F.when(F.col("tp") + F.col("fn") == 0, (F.col("fp") == 0).cast("double")).otherwise(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    return counts.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(precision), 6).alias("precision"), F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg(f), 6).alias("f05"))


def expected_f_subset(scored: DataFrame, least: float = 0.02, floor: float = 0.5) -> DataFrame:
    """Per entity the best prefix of its records by falling p: the m with the largest expected F0.5, if that beats taking none. Of these only records from `floor` on."""
    s = scored.where(F.col("p") >= least)
    order = W.partitionBy("s_id").orderBy(F.col("p").desc(), F.col("q_id")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("s_id")
    s = s.withColumn("m", F.count("*").over(order)).withColumn("got", F.sum("p").over(order)).withColumn("all", F.sum("p").over(whole))
    s = s.withColumn("none", F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))).over(whole)))
    s = s.withColumn("ef", F.round((1 + BETA2) * F.col("got") / (BETA2 * F.col("all") + F.col("m")), 9))
    best = s.groupBy("s_id").agg(F.max(F.struct("ef", (-F.col("m")).alias("m"))).alias("b"), F.max("none").alias("none"))
    best = best.where(F.col("b.ef") > F.col("none")).select("s_id", (-F.col("b.m")).alias("keep"))
    return s.join(best, "s_id").where((F.col("m") <= F.col("keep")) & (F.col("p") >= floor)).select("q_id", "s_id", "p")


def swept(entities: DataFrame, truth: DataFrame, predicted: DataFrame, grid: tuple[float, ...], half: Column | None = None) -> DataFrame:
    """t, half and mean F0.5 of predictions (t, q_id, s_id) for each t of the grid, over the entities (s_id) of each half."""
    half = bucket(F.col("s_id"), 2) if half is None else half
    hits = predicted.join(truth.select("q_id", "s_id", F.lit(1).alias("hit")), ["q_id", "s_id"], "left").groupBy("t", "s_id").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    every = entities.select("s_id", half.alias("half")).join(truth.groupBy("s_id").agg(F.count("*").alias("k")), "s_id", "left").withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    rows = every.join(hits, ["s_id", "t"], "left").na.fill(0, ["k", "n", "tp"])
    return rows.groupBy("t", "half").agg(F.round(F.avg(f_beta(F.col("tp"), F.col("n") - F.col("tp"), F.col("k") - F.col("tp"))), 6).alias("f"))


def cross_fitted(sweep: DataFrame) -> DataFrame:
    """One row: the best t of each half (the least of equals), and the mean F0.5 of each half at the other's best t."""
    best = sweep.groupBy("half").agg(F.max(F.struct("f", (-F.col("t")).alias("t")))["t"].alias("neg"))
    best = best.agg(*(F.max(F.when(F.col("half") == h, -F.col("neg"))).alias(f"t_h{h}") for h in (0, 1)))
    both = sweep.join(F.broadcast(best))  # a row for each t and half, and one row
    other = lambda h: F.max(F.when((F.col("half") == h) & (F.col("t") == F.col(f"t_h{1 - h}")), F.col("f")))
    return both.groupBy("t_h0", "t_h1").agg(F.round((other(0) + other(1)) / 2, 6).alias("crossfit"))


def by_segment(scored: DataFrame, segment: Column, grid: tuple[float, ...], otherwise: float, p: str = "p1") -> DataFrame:
    """Predictions (t, q_id, s_id): records of the segment from t on, all others from `otherwise` on."""
    return scored.withColumn("t", F.explode(F.array(*map(F.lit, grid)))).where(F.when(segment, F.col(p) >= F.col("t")).otherwise(F.col(p) >= otherwise)).select("t", "q_id", "s_id")


def place_on_entity(scored: DataFrame, least: float = 0.3, p: str = "p1") -> DataFrame:
    """The records from `least` on with `place`, their number by falling p among those of their entity."""
    return scored.where(F.col(p) >= least).withColumn("place", F.row_number().over(W.partitionBy("s_id").orderBy(F.col(p).desc(), F.col("q_id"))))


def assembled(parts: dict[str | None, tuple[DataFrame, float]], p: str = "p1") -> DataFrame:
    """One set of links from a model and threshold for each country; None stands for all countries that aren't named. Rows have q_id, s_id, country."""
    named = [c for c in parts if c is not None]
    out = None
    for country, (rows, threshold) in parts.items():
        part = rows.where((F.col("country") == country if country is not None else ~F.col("country").isin(named)) & (F.col(p) >= threshold)).select("q_id", "s_id", "country", p)
        out = part if out is None else out.unionByName(part)
    return out


def guarded(top: DataFrame, pairs: DataFrame, siblings: DataFrame, below: float = 0.1) -> DataFrame:
    """q_id, s_id and p: 0 where a record below `below` has other numbers than its entity and a sibling that shares its numbers. pairs: num_conflict; siblings: sup_nums_all."""
    both = top.join(pairs.select("q_id", "s_id", "num_conflict"), ["q_id", "s_id"]).join(siblings.select("q_id", "s_id", "sup_nums_all"), ["q_id", "s_id"])
    return both.select("q_id", "s_id", F.when(F.col("num_conflict") & (F.col("sup_nums_all") >= 1) & (F.col("p1") < below), 0.0).otherwise(F.col("p1")).alias("p"))


#: Poisson(1) up to each count, for counts 0 to 5.
_POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)


def bootstrap(families: DataFrame, rounds: int) -> DataFrame:
    """(round, diff) of a paired bootstrap: families (family, n, a, b) with sums of both F0.5 values are drawn as units, each as often as a Poisson number by its hash says; so no task or driver sees all families."""
    drawn = families.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("#", "family", F.col("round").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = sum(((u >= x).cast("int") for x in _POISSON), F.lit(0))
    return drawn.withColumn("k", times).groupBy("round").agg((F.sum(F.col("k") * (F.col("b") - F.col("a"))) / F.sum(F.col("k") * F.col("n"))).alias("diff"))


def with_multiplicity(entities: DataFrame, truth: DataFrame, predicted: DataFrame, times: tuple[int, ...]) -> DataFrame:
    """(k, f05) over the entities (s_id): wrong links of records without a true entity among them count k times, other wrong links once. Records of entities that aren't there have none."""
    there = truth.join(entities, "s_id", "left_semi").select("q_id", F.col("s_id").alias("true_s"))
    p = predicted.select("q_id", "s_id").join(entities, "s_id", "left_semi").join(there, "q_id", "left").withColumn("hit", F.coalesce(F.col("true_s") == F.col("s_id"), F.lit(False)))
    links = p.groupBy("s_id").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit") & F.col("true_s").isNull()).alias("lost"), F.count_if(~F.col("hit") & F.col("true_s").isNotNull()).alias("moved"))
    rows = entities.select("s_id").join(there.groupBy(F.col("true_s").alias("s_id")).agg(F.count("*").alias("n")), "s_id", "left").join(links, "s_id", "left").na.fill(0)
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, times)))).withColumn("fp", F.col("lost") * F.col("k") + F.col("moved"))
    return rows.groupBy("k").agg(F.round(F.avg(f_beta(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp"))), 6).alias("f05"))
