"""What queries on candidates may shuffle and read."""

import cProfile
import random

import pytest

from knotwork.functions import similarity as S
from knotwork.functions import text
from knotwork.operators import roles
from knotwork.plans import link
from knotwork.queries import QUERIES
from test_nearest import shuffled

#: Queries that shuffled the pairs of postings that their candidates come from.
CANDIDATES = ["acronym_equal", "arith_blend", "assign_threshold", "char3_jaccard", "char_tfidf_topk", "cut_bins", "density_free_likeness", "density_free_rules", "direct_features", "error_classes", "fuzzy_features", "global_topk", "jaro_winkler", "macro_f05", "margins", "mine_noise_tokens", "missed_match_categories", "neg_multiplicity", "number_features", "oracle_ceiling", "pair_algebra", "role_features", "singleton_accuracy"]
#: Queries that read all texts again for the true links.
TRUTH = ["cut_bins", "error_classes", "macro_f05", "neg_multiplicity", "oracle_ceiling", "pair_algebra", "singleton_accuracy"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A table on which a quarter of the catalog shares each of four words, 500,000 pairs; and what its candidates shuffle."""
    at = tmp_path_factory.mktemp("table")
    text = lambda i: f"name{i} g{i % 12 // 3}x own{i} g{i % 12 // 3}y h{i % 12 // 3} j{i % 12 // 3} street{i} town{i % 97}"
    spark.createDataFrame([(i, text(i), "en") for i in range(3000)], "doc_id long, text string, lang string").write.parquet(str(at / "documents.parquet"))
    before = shuffled(spark)
    link.candidates(spark, str(at)).count()
    return str(at), shuffled(spark) - before


@pytest.mark.parametrize("name", CANDIDATES)
def test_no_pairs_of_postings_are_shuffled(spark, table, name):
    path, shared = table
    before = shuffled(spark)
    QUERIES[name](spark, path).collect()
    assert shared + shuffled(spark) - before < 500_000


@pytest.mark.parametrize("name", TRUTH)
def test_texts_are_read_once(spark, table, name):
    assert not [f for f in QUERIES[name](spark, table[0]).inputFiles() if "documents.parquet" in f]


def test_windows_left_out_do_not_change_the_best():
    deal = random.Random(3)
    text = lambda n: "".join(deal.choice("abc ") for _ in range(deal.randint(1, n)))
    for _ in range(2000):
        a, b = sorted((text(9), text(20)), key=len)
        assert S.partial(a, b) == max(S.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def test_tokens_are_weighed_by_record(spark, table):
    path, _ = table
    before = shuffled(spark)
    assert len(QUERIES["direct_features"](spark, path).collect()) == 20_000
    assert shuffled(spark) - before < 30_000


def test_words_of_a_pair_are_compared_in_one_pass():
    deal = random.Random(4)
    words = lambda n, k: " ".join("".join(deal.choice("abcde") for _ in range(deal.randint(1, n))) for _ in range(k))
    for _ in range(500):
        a, b = words(9, deal.randint(0, 6)), words(9, deal.randint(0, 6))
        x, y = set(a.split()), set(b.split())
        best = [max(S.ratio(t, u) for u in y) for t in sorted(x - y)] if y else []
        assert roles.unmatched(a, b)[0] == (0.0 if not x or not y else sum(best) / (100 * len(best)) if best else 1.0)
    a, b = words(9, 20), words(9, 20)
    with cProfile.Profile() as profile:
        roles.unmatched(a, b)
    assert sum(x.callcount for x in profile.getstats()) < 2500


def test_a_word_of_an_address_is_mapped_once(spark):
    column = text.address_tokens("a")
    assert str(column).count("translate(") == 1
    rows = spark.createDataFrame([("007th 0012b New York str33t 000",), ("Tamil Nadu & north carolina",), ("",)], "a string")
    assert [r.x for r in rows.select(column.alias("x")).collect()] == [["7", "12", "b", "ny", "st", "0"], ["tn", "nc"], []]


def test_jaro_winkler_of_short_names():
    """As DuckDB has it; two equal letters are alike."""
    import duckdb

    names = [""] + [x + y + z for x in "ab" for y in ("", *"ab") for z in ("", *"ab c")]
    rows = duckdb.sql(f"SELECT a, b, jaro_winkler_similarity(a, b) FROM (SELECT unnest({names}) AS a), (SELECT unnest({names}) AS b) WHERE a <> '' AND b <> ''").fetchall()
    assert S.jaro_winkler("a", "a") == 1.0 and S.jaro_winkler("a", "b") == 0.0
    assert [(a, b) for a, b, x in rows if abs(S.jaro_winkler(a, b) - x) > 1e-9] == []
