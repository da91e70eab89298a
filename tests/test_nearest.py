import cProfile
import random

import pyarrow as pa
from pyspark.sql import functions as F

from knotwork.operators import nearest as module
from knotwork.operators import retrieval
from knotwork.operators.nearest import global_topk, idf, nearest
from knotwork.plans import link


def dealt(spark, ids, seed=5):
    deal = random.Random(seed)
    common = ["of", "and", "co", "\x01", "\x02\x03", ""]
    row = lambda i: (i, "x" if i % 4 else "y" if i % 8 else None, common[: deal.randint(1, 6)] + [f"w{int(deal.paretovariate(0.7)) % 60}" for _ in range(deal.randint(0, 4))], [str(deal.randint(1, 9)) for _ in range(deal.randint(0, 3))])
    return spark.createDataFrame([row(i) for i in ids], "id long, country string, name array<string>, addr array<string>")


def test_nearest_in_blocks_is_the_plain_way(spark):
    catalog, queries = dealt(spark, range(400)), dealt(spark, range(1000, 1150), 6)
    catalog = catalog.unionByName(catalog.where("id < 60").withColumn("id", F.col("id") + 500))  # copies
    fields, limits = {"a": "name", "b": "addr"}, {"min_df": 1, "max_df": 1.0}
    plain = retrieval.cosines(catalog, queries, "name", "a", **limits).join(retrieval.cosines(catalog, queries, "addr", "b", **limits), ["q_id", "s_id", "country"], "full").na.fill(0.0, ["a", "b"])
    rows = lambda df: sorted((r.q_id, r["rank"], r.s_id, r.country, r.a, r.b, r.c) for r in df.collect())
    for k in (5, 700):
        want = rows(retrieval.ranked(plain.withColumn("c", F.round(0.5 * F.col("a") + 0.5 * F.col("b"), 7)), k, "c"))
        for block, part in ((150, 60), (10**6, 10**6)):
            assert rows(nearest(catalog, queries, fields, idf(catalog, fields, **limits), {"a": 0.5, "b": 0.5}, k, "c", block=block, part=part)) == want
    assert nearest(catalog.limit(0), queries, fields, idf(catalog.limit(0), fields, **limits), {"a": 0.5, "b": 0.5}, 5, "c").isEmpty()


def test_global_weights_are_those_of_the_whole_index(spark):
    index = spark.createDataFrame([(i, "x" if i < 3 else "y", ["a", "b"] if i else ["a", "c"]) for i in range(6)], "id long, country string, t array<string>")
    asked = spark.createDataFrame([(9, "x", ["c", "a"])], "id long, country string, t array<string>")
    assert [(r.s_id, r.q_id, r.cos, r["rank"]) for r in global_topk(index, asked, "t", 1, 1, 1.0).collect()] == [(9, 0, 1.0, 1)]


def shuffled(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_candidates_do_not_shuffle_pairs_of_postings(spark, tmp_path):
    # A quarter of the catalog shares each of four words; 1,000 by 2,000 rows, 500,000 pairs.
    text = lambda i: f"name{i} g{i % 12 // 3}x own{i} g{i % 12 // 3}y h{i % 12 // 3} j{i % 12 // 3} street{i} town{i % 97}"
    spark.createDataFrame([(i, text(i), "en") for i in range(3000)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    assert link.candidates(spark, str(tmp_path)).count() == 20_000
    assert shuffled(spark) - before < 200_000


def test_few_calls_for_a_query(monkeypatch):
    # A tenth of the catalog shares each of a query's thirty terms.
    deal = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    row = lambda side, i: {"side": side, "id": i, "a": "".join(sorted("\x01" + w for w in deal.sample(words, 30))), "idf": []}
    rows = [row(0, i) for i in range(3000)] + [row(1, i) for i in range(3000, 3100)] + [{"side": 2, "id": 0, "a": "".join("\x01" + w for w in words), "idf": [1.0 + i / 300 for i in range(300)]}]
    table = pa.Table.from_pylist(rows, pa.schema([("side", pa.int32()), ("id", pa.int64()), ("a", pa.string()), ("idf", pa.list_(pa.float64()))]))
    best = lambda: [x for b in module._of_task(table, ["a"], [1.0], 10) for x in zip(*b.to_pydict().values())]
    with cProfile.Profile() as profile:
        whole = best()
    assert len(whole) == 1000 and sum(x.callcount for x in profile.getstats()) < 100 * 100
    monkeypatch.setattr(module, "POSTINGS", 500)
    monkeypatch.setattr(module, "STRETCH", 7)
    monkeypatch.setattr(module, "TOGETHER", 30)
    assert best() == whole
