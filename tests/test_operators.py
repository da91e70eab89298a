import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import dictionary, features, models, relations, roles
from knotwork.operators import evaluation as E
from knotwork.plans import runs
from knotwork.sources import sinks


@pytest.mark.parametrize(
    "address, want",
    [
        ("0012 Main Street, apartment 004, Floor 02", ("12", ("4",), ("2",))), ("3rd floor, 12 Main Street", ("", (), ("3",))), ("3rd Avenue 90210", ("", (), ())), ("N°12 bis rue des Fleurs, appartement 4, 2ème étage", ("12bis", ("4",), ("2",))),
        ("D.No.1-04-283/3 Main Road", ("1-4-283/3", (), ())), ("12B Main Street", ("12b", (), ())), ("Main Street, Springfield, 90210", ("", (), ())), ("#12 Main St #4", ("12", ("4",), ())), ("１２ Main St Suite B", ("12", ("b",), ())),
        ("१२ Main St Unit No 4", ("12", ("4",), ())), ("12 Apt 4 Main Street", ("12", ("4",), ())), ("12 Floor 4 Main Street", ("12", (), ("4",))), ("", ("", (), ())),
    ],
)
def test_address_roles(address, want):
    assert roles.parts(address) == want


def pair(q_addr="12 Main St Unit 4", s_addr="12 Main St Unit 4", q_core="acme", s_core="acme", q_norm="12 main st", s_norm="12 main st"):
    return roles.features("Acme Inc", "Acme Inc", q_addr, s_addr, q_core, s_core, q_norm, s_norm)


def test_role_features():
    assert len(roles.NAMES) == 25
    d = pair()
    assert (d["prem_equal"], d["unit_equal"], d["addr_alpha_ratio"]) == (1, 1, 1)
    d = pair("12 Main St Unit 4", "4 Main St Unit 12")
    assert (d["prem_conflict"], d["unit_conflict"], d["role_cross_match"]) == (1, 1, 1)
    d = pair("12A Main St", "12B Main St")
    assert (d["prem_equal"], d["prem_suffix_conflict"], d["prem_numset_jaccard"]) == (0, 1, 1)
    assert set(roles.features(*[""] * 8).values()) == {0.0}
    typo, changed = pair(q_norm="12 maim st", q_core="acne"), pair(q_norm="12 elm st", q_core="beta")
    assert typo["addr_qonly_fuzzy"] > changed["addr_qonly_fuzzy"] and typo["name_qonly_fuzzy"] > changed["name_qonly_fuzzy"]
    assert pair(q_core="ibm", s_core="international business machines")["name_acronym_equal"] == 1 and pair()["name_acronym_equal"] == 0


def test_role_features_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, "12 x", None, None, "c", None, "d")] * 3, ", ".join(f"c{i} string" for i in range(8)))
    got = rows.select(roles.role_features(*rows.columns).alias("r")).select("r.*").collect()
    assert len({tuple(r) for r in got}) == 1 and got[0].prem_one_known == 1.0


def test_indic_names_become_latin(spark):
    rows = spark.createDataFrame([("राम ट्रेडर्स",), ("Café Ünï",), (None,)], "s string")
    got = [r[0] for r in rows.select(F.array_join(X.name_tokens(X.latin("s")), " ")).collect()]
    assert got[0].split()[0] == "ram" and got[1] == "cafe uni"


def test_dictionary_from_true_links(spark):
    q = spark.createDataFrame([(i, ["ram", "kampani"] if i < 4 else ["ram", "x"]) for i in range(5)], "id long, tokens array<string>")
    s = spark.createDataFrame([(i, ["rama", "company"]) for i in range(5)], "id long, tokens array<string>")
    pairs = spark.createDataFrame([(i, i) for i in range(5)], "q_id long, s_id long")
    d = dictionary.learned(pairs, q, s)
    assert {(r.a, r.b, r.n) for r in d.collect()} == {("ram", "rama", 5), ("kampani", "company", 4)}
    once = dictionary.applied(q, d, F.col("id") < 4)
    assert [r.tokens for r in once.orderBy("id").collect()] == [["rama", "company"]] * 4 + [["ram", "x"]]
    assert [r.tokens for r in dictionary.applied(once, d).orderBy("id").collect()][:4] == [["rama", "company"]] * 4


def test_checked_join_and_order(spark):
    left, right = spark.createDataFrame([(1, 5), (0, 6)], "i long, k long"), spark.createDataFrame([(5, "a"), (6, "b")], "k long, v string")
    assert [r.v for r in relations.join_in_order(left, relations.join_checked(left.select("k"), right, ["k"]), ["k"], "i").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="more than one row for 5"):
        relations.join_checked(left, right.unionByName(right), ["k"]).collect()
    rows = spark.createDataFrame([(x,) for x in (9000, 5, -3, 4096, 8191)], "k long")
    assert {r.k: r["index"] for r in relations.with_row_index(rows, "k").collect()} == {-3: 0, 5: 1, 4096: 2, 8191: 3, 9000: 4}
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 9.0, None)], "x double").select(relations.binned(F.col("x"), [0, 1], ["0", "1", "2+"])).collect()]
    assert got == ["0", "1", "2+", "2+", None]


def test_multiplicity_and_lost_entities_by_hand(spark):
    """Four entities, the truth of six records, four links; wrong links of unmatched records weigh 1 or 4, then without entity 3."""
    e = spark.createDataFrame([(i,) for i in range(4)], "s_id long")
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 3)], "q_id long, s_id long")
    links = spark.createDataFrame([(0, 0), (2, 1), (3, 1), (4, 0)], "q_id long, s_id long")
    f = lambda tp, fp, fn: 5 * tp / (5 * tp + 4 * fp + fn) if tp + fp + fn else 1.0
    got = {r.k: r.f05 for r in E.with_multiplicity(e, truth, links, (1, 4)).collect()}
    assert got == {k: pytest.approx((f(1, k, 1) + f(1, 1, 0) + 1 + f(0, 0, 1)) / 4, abs=1e-6) for k in (1, 4)}
    got = {r.k: r.f05 for r in E.with_multiplicity(e.where("s_id <> 3"), truth, links, (1, 4)).collect()}
    assert got == {k: pytest.approx((f(1, k, 1) + f(1, k, 0) + 1) / 3, abs=1e-6) for k in (1, 4)}


def test_cross_fitted_thresholds_by_hand(spark):
    sweep = spark.createDataFrame([(0.5, 0, 0.8), (0.6, 0, 0.9), (0.5, 1, 0.7), (0.6, 1, 0.6)], "t double, half int, f double")
    assert tuple(E.cross_fitted(sweep).first()) == (0.6, 0.5, pytest.approx((0.8 + 0.6) / 2))


def test_siblings_by_hand(spark):
    top = spark.createDataFrame([(1, 9, 0.9), (2, 9, 0.2), (3, 9, 0.8), (4, 8, 0.7)], "q_id long, s_id long, p1 double")
    records = spark.createDataFrame([(1, ["5"], "a b", ["5", "x"]), (2, ["5"], "a b", ["5", "x"]), (3, [], "ab", ["y"]), (4, [], "z", [])], "id long, numbers array<string>, core string, addr array<string>")
    got = {r.q_id: r for r in features.siblings(top, records).collect()}
    assert (got[2].g_all, got[2].g_conf, got[2].g_psum, got[2].sup_nums_all, got[2].sup_nums_conf, got[2].sup_name_all, got[2].sup_nums_frac, got[2].sup_name_frac) == (2, 2, 1.7, 1, 1, 2, 0.5, 1.0)
    assert (got[3].sup_nums_all, got[3].sup_name_all, got[4].g_all) == (-1, 2, 0)
    fuzzy = {r.q_id: r for r in features.fuzzy_siblings(top, records).collect()}
    assert fuzzy[2].fz_addr_conf == 100 and fuzzy[2].fz_n90_conf == 1 and fuzzy[1].fz_n90_non == 1 and fuzzy[4].fz_addr_conf == -1


def labelled(spark):
    return spark.createDataFrame([(i, j, float(i == j) + 0.01 * ((i * 7 + j) % 5), float((i + j) % 3), int(i == j), "a" if i % 2 else "b") for i in range(30) for j in range(5)], "q_id long, s_id long, x double, deg double, y int, country string")


def test_stacked_and_cross_fitted_models(spark):
    rows = labelled(spark)
    first = models.fit(rows, ["x"], "lr")
    second = models.stacked(rows, first, ["x"], "lr")
    inputs = models.stack_inputs(models.score(first, rows))
    assert inputs.where(F.abs(F.col("p1") - F.col("p2") - F.col("margin12")) > 1e-12).isEmpty()
    assert second.transform(inputs).where((F.col("prediction") == 1) != (F.col("y") == 1)).isEmpty()
    out, fitted = models.cross_fitted(rows, ["x"], "lr")
    assert out.count() == rows.count() and out.where((F.col("p") >= 0.5) != (F.col("y") == 1)).isEmpty()
    assert models.mean_score(fitted, rows).where((F.col("p") >= 0.5) != (F.col("y") == 1)).isEmpty()
    grouped = lambda best: best.groupBy("s_id").agg(F.count("*").cast("double").alias("n_best")).join(best.select("q_id", "s_id"), "s_id")
    now, _ = models.iterated(rows, ["x"], grouped, "lr")
    assert now.count() == rows.count() and "n_best" in now.columns
    assert models.transferred(rows, "country", "a", "b", ["x"], "lr").where((F.col("p") >= 0.5) != (F.col("y") == 1)).isEmpty()
    flips = models.flips(models.fit(rows, ["x"], "lr"), rows.withColumn("other", F.lit(0.0)), "other")
    assert {r.by: (r.n, r.mean_rise, r.accepted_now) for r in flips.collect()} == {k: (150, 0.0, 0) for k in (1, 2, 4, 8)}
    norm = models.quantile_normalised(rows.select("q_id", "country", "x"), "x", "country", 10)
    assert norm.agg(F.min("x"), F.max("x")).first()[1] == 1.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "us"), (2, "fr")], "id long, country string")
    sinks.write_by_country(df, str(tmp_path / "t"))
    sinks.write_by_country(df.where("country = 'us'").withColumn("id", F.lit(7).cast("long")), str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(7, "us"), (2, "fr")}
    sinks.write_report(df, str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("part*")).read_text().splitlines() == ["id,country", "1,us", "2,fr"]
    assert sinks.write_metrics(df.agg(F.count("*").alias("n")), str(tmp_path / "m.json")) == {"n": 2}
    model = models.fit(labelled(spark), ["x"], "lr")
    sinks.save_model(model, str(tmp_path / "model"))
    assert models.score(sinks.load_model(str(tmp_path / "model")), labelled(spark)).count() == 150
    assert sinks.write_archive({"m.json": str(tmp_path / "m.json")}, str(tmp_path / "a.zip")) == ["m.json"]
    with pytest.raises(FileNotFoundError):
        sinks.write_archive({"x": str(tmp_path / "none")}, str(tmp_path / "b.zip"))
    assert sinks.grouped_counts(spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")) == (2, 1)


def test_runs(tmp_path):
    (tmp_path / "in.txt").write_text("a")
    run = runs.Run(str(tmp_path / "run"), {"k": 10})
    assert not run.done("step", [str(tmp_path / "in.txt")])
    run.complete("step", [str(tmp_path / "in.txt")], rows=3)
    assert runs.Run(str(tmp_path / "run"), {"k": 10}).done("step", [str(tmp_path / "in.txt")])
    (tmp_path / "in.txt").write_text("b")
    assert not run.done("step", [str(tmp_path / "in.txt")])
    with pytest.raises(ValueError):
        runs.Run(str(tmp_path / "run"), {"k": 5})
    assert runs.promoted({"F": 0.9, "F_us": 0.8}, {"F": 0.91, "F_us": 0.799}, {"F": 0.005, "F_us": -0.002, "F_fr": 0}) == {"F": True, "F_us": True, "F_fr": False}
    assert runs.sealed(str(tmp_path), "conf", lambda: 5) == 5
    with pytest.raises(PermissionError):
        runs.sealed(str(tmp_path), "conf", lambda: 5)
