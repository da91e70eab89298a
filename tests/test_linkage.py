import pytest
from pyspark.sql import functions as F

from knotwork.operators import evaluation as E
from knotwork.operators import models, relations, retrieval
from knotwork.operators.validation import violations
from knotwork.sources import records


def test_macro_f_by_hand(spark):
    entities = spark.createDataFrame([(i,) for i in range(5)], "s_id long")
    truth = spark.createDataFrame([(10, 0), (11, 1), (12, 1), (13, 3), (14, 4)], "q_id long, s_id long")
    predicted = spark.createDataFrame([(10, 0), (10, 0), (11, 1), (13, 3), (20, 3)], "q_id long, s_id long")
    counts = {r.s_id: (r.tp, r.fp, r.fn) for r in E.entity_counts(entities, truth, predicted).collect()}
    assert counts == {0: (1, 0, 0), 1: (1, 0, 1), 2: (0, 0, 0), 3: (1, 1, 0), 4: (0, 0, 1)}
    assert E.macro_f(E.entity_counts(entities, truth, predicted)).first().f05 == pytest.approx((1 + 5 / 6 + 1 + 5 / 9 + 0) / 5, abs=1e-6)


def test_expected_f_takes_none_where_that_is_better(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8), (3, 1, 0.1), (4, 2, 0.05)], "q_id long, s_id long, p double")
    assert {(r.q_id, r.s_id) for r in E.expected_f_subset(scored).collect()} == {(1, 1), (2, 1)}


def test_ranks_break_ties_by_id(spark):
    pairs = spark.createDataFrame([(1, s, 0.5) for s in range(20)], "q_id long, s_id long, cos_comb double")
    assert [r.s_id for r in retrieval.ranked(pairs).orderBy("rank").collect()] == list(range(10))


def test_best_pairs_with_and_without_a_floor(spark):
    import random

    deal = random.Random(5)
    common = ["of", "and", "co"]
    # Every row has common terms, so each query shares one with all rows; ties and repeated rows come with the few words.
    row = lambda i: (i, "x" if i % 4 else "y", common[: deal.randint(1, 3)] + [f"w{int(deal.paretovariate(0.7)) % 60}" for _ in range(deal.randint(0, 4))], [str(deal.randint(1, 9)) for _ in range(deal.randint(0, 3))])
    schema = "id long, country string, name array<string>, addr array<string>"
    catalog, queries = spark.createDataFrame([row(i) for i in range(400)], schema), spark.createDataFrame([row(i) for i in range(1000, 1150)], schema)
    fields, shares, limits = {"a": "name", "b": "addr"}, {"a": 0.5, "b": 0.5}, {"min_df": 1, "max_df": 1.0}
    plain = retrieval.cosines(catalog, queries, "name", "a", **limits).join(retrieval.cosines(catalog, queries, "addr", "b", **limits), ["q_id", "s_id", "country"], "full").na.fill(0.0, ["a", "b"])
    plain = retrieval.ranked(plain.withColumn("c", F.round(0.5 * F.col("a") + 0.5 * F.col("b"), 7)), 5, "c")
    rows = lambda df: sorted((r.q_id, r["rank"], r.s_id, r.a, r.b, r.c) for r in df.collect())
    s, q = retrieval.postings(catalog, queries, fields, **limits)
    left_out = []
    seen = lambda df, part: (left_out.append(df.where("NOT asks").count()) if part == "asks" else None, df)[1]
    for at_once in (0, 10**9):
        assert rows(retrieval.best(s, q, shares, 5, "c", seen, at_once)) == rows(plain)
    assert len(left_out) == 1 and left_out[0] > 0
    nothing = catalog.limit(0)
    assert retrieval.best(*retrieval.postings(nothing, queries, fields, **limits), shares, 5, "c").isEmpty()


def test_places_by_hash(spark):
    import hashlib

    rows = [(i, None if i % 3 == 0 else "x") for i in range(500)]
    got = {r.id: (r.place, r.n) for r in relations.place_by_hash(spark.createDataFrame(rows, "id long, g string"), ["g"], "id", "place", "n").collect()}
    for g in (None, "x"):
        ids = sorted((i for i, h in rows if h == g), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [got[i] for i in ids] == [(k, len(ids)) for k in range(1, len(ids) + 1)]


def test_rules(spark):
    rec = spark.createDataFrame([("S1-1", "S1"), ("S1-2", "S1"), ("S2-1", "S2")], "entity_id string, src string")
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-2"), ("S1-9", "S9-1,S2-7")], "source1_entity_id string, matched_entity_ids string")
    assert {r.rule: r.n for r in violations(rows, rec).collect()} == {"repeated_row": 1, "repeated_id": 1, "self_match": 1, "wrong_prefix": 1, "unknown_id": 1, "missing_entity": 1, "extra_entity": 1}


def test_tsv_keeps_quotes_and_empty_lists(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A" b\t\tx\n')
    assert records.read_tsv(spark, str(tmp_path / "a.tsv")).first().asDict() == {"entity_id": "S1-1", "business_name": '"A" b', "business_address": "", "country": "x"}
    rows = records.grouped(spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string"), spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-1")], "s1_id string, q_id string"))
    records.write_grouped(rows.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part*")).read_text().splitlines()
    assert sorted(text[1:]) == ["S1-1\tS2-1,S2-2", "S1-2\t"]


def test_models_and_self_training(spark):
    rows = spark.createDataFrame([(i, j, float(i == j) + 0.01 * ((i * 7 + j) % 5), int(i == j)) for i in range(20) for j in range(5)], "q_id long, s_id long, x double, y int")
    fitted = models.fit(rows, ["x"], "lr")
    assert models.score(fitted, rows).where((F.col("p") >= 0.5) != (F.col("y") == 1)).count() == 0
    pseudo = models.pseudo_labels(spark.createDataFrame([(1, 1, 0.99), (1, 2, 0.4), (2, 1, 0.01), (3, 1, 0.5)], "q_id long, s_id long, p double"))
    assert {(r.q_id, r.s_id): r.y for r in pseudo.collect()} == {(1, 1): 1, (1, 2): 0, (2, 1): 0}
    assert models.self_trained(rows, rows.drop("y"), ["x"], "lr") is not None


def test_stream_links_each_batch_once(spark, tmp_path):
    from knotwork.streaming.link import link_stream

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    link_stream(stream, lambda b: b.withColumn("s", F.col("id") % 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
