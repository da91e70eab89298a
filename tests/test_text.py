import pytest
from pyspark.sql import functions as F

from knotwork.functions import similarity as S
from knotwork.functions import text as X
from knotwork.operators import roles


@pytest.mark.parametrize("raw, want", [("रमेश कुमार", "ramesh kumar"), ("क", "ka"), ("తెలుగు", "telugu"), ("दिल्ली", "dilli"), ("plain", "plain"), ("", "")])
def test_transliteration(raw, want):
    assert X.transliterate_text(raw) == want


def test_fold():
    assert X.fold_text("Éœß’ ñ") == "Eoess' n"


@pytest.mark.parametrize("f, a, b, want", [(S.ratio, "", "", 100), (S.ratio, "abc", "abd", 200 / 3), (S.token_sort, "b a", "a b", 100), (S.token_set, "a b", "a b c", 100), (S.token_set, "", "a", 0), (S.partial, "abc", "xxabcx", 100), (S.partial, "", "a", 0), (S.jaro_winkler, "martha", "marhta", 0.9611111)])
def test_similarities(f, a, b, want):
    assert f(a, b) == pytest.approx(want)


def test_common_length_against_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.common_length(a, b) == t[-1][-1]


@pytest.mark.parametrize(
    "raw, want",
    [("12 Main Street, apartment 004, Floor 02", ("12", ("4",), ("2",))), ("D.No.1-04-283/3 Main Road", ("1-4-283/3", (), ())), ("12 apt 4", ("12", ("4",), ())), ("2nd floor, 5 rue X", ("", (), ("2",))), ("5 bis rue", ("5bis", (), ())), ("Main Road #7", ("", ("7",), ())), ("unit b", ("", ("b",), ())), ("", ("", (), ()))],
)
def test_address_roles(raw, want):
    assert roles.parts(raw) == want


def test_unknown_role_is_no_evidence():
    out = roles.features("a", "a", "", "12 Main", "a", "a", "", "12 main")
    assert not out["prem_known"] and not out["prem_conflict"] and out["prem_one_known"]


def test_addresses_and_names(spark):
    rows = spark.createDataFrame([("94b Saint Road, West Virginia",), ("no. 007 1st floor",), ("",), (None,)], "s string")
    got = [r[0] for r in rows.select(F.array_join(X.address_tokens("s"), " ")).collect()]
    assert got == ["94 b st rd wv", "7 1", "", None]
    names = spark.createDataFrame([("M/s. S.A.S.U. L'Oréal & Co",), ("preparat0ry 94b",)], "s string")
    assert [r[0] for r in names.select(F.array_join(X.name_tokens("s"), " ")).collect()][1] == "preparatory 94b"
    assert [r[0] for r in names.select(F.array_join(X.core(F.array(F.lit("the"), F.lit("inc"))), " ")).collect()] == ["the inc"] * 2


def test_first_words_are_those_of_the_whole_text(spark):
    texts = ["", " ", "A", "..a b", "a b c", "-a--b  c d.", "a b c d e f", "..a b c d", "Ünï a1 b2 c3 d4", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(X.words("s", 3).alias("few"), F.slice(X.words("s"), 1, 3).alias("all"))
    assert all(r.few == r["all"] for r in rows.collect())
