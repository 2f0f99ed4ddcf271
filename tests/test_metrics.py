import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlens.functions.metrics import REGISTRY, common_subsequence_ratio, jaro_winkler, metric, pair_score, phonetic
from twinlens.functions.text import fold_text


@pytest.mark.parametrize("word, code", [("Wright", "RT"), ("Knight", "KNT"), ("Young", "YNJ"), ("Ridge", "RJ"), ("Smith", "SM0"), ("Smyth", "SM0"), ("Schmidt", "SXMTT"), ("Nation", "NXN"), ("Hugh", "HKH"), ("Sarah", "SRH"), ("Low", "LW"), ("Jack", "JK"), ("Xavier", "KSFR"), ("Phil", "FL"), ("Charles", "XRLS"), ("Edge", "EJ"), ("Edg", "EJ"), ("123", ""), ("Москва", "")])
def test_phonetic(spark, word, code):
    assert spark.createDataFrame([(word,)], "w string").select(phonetic("w")).first()[0] == code


@pytest.mark.parametrize("a, b, score", [("martha", "marhta", 0.961111), ("Dixon", "Dicksonx", 0.813333), ("abcdefgh", "abxyzwvu", 0.6), ("abcabcaca", "bcabacab", 0.765212), ("a", "b", 0)])
def test_jaro_winkler(a, b, score):
    assert jaro_winkler(a, b) == pytest.approx(score, abs=1e-6)


@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_ranges(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1 and jaro_winkler(a, a) == 1
    assert 0 <= common_subsequence_ratio(a, b) == common_subsequence_ratio(b, a) <= 1


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    want = 1.0 if a == b else 2 * rows[-1][-1] / (len(a) + len(b)) if a and b else 0.0
    assert common_subsequence_ratio(a, b) == pytest.approx(want)


def test_folding():
    assert fold_text("St. Louis") == fold_text("St Louis") and fold_text("Zürich") == "zurich"
    assert fold_text("---") == fold_text("***") == "" and fold_text("Москва") != fold_text("東京")


@pytest.mark.parametrize("name, a, b, params, score", [
    ("exact-match", "Reagan-National", "Reagan National", {}, 1), ("exact-match", "USA", "usa", {"normalization": "none"}, 0), ("exact-match", "---", "***", {}, 1),
    ("edit-distance", "kitten", "sitting", {}, 0.571429), ("edit-distance", "NY", "NJ", {}, None), ("edit-distance", "Abc", "abc", {}, 0.666667),
    ("token-jaccard", "blue anvil", "anvil red", {}, 0.333333), ("token-jaccard", "Zürich, CH", "zurich ch", {"tokenMode": "alphanumeric"}, 1),
    ("token-sort-ratio", "Smith John", "john smith", {}, 1), ("token-sort-ratio", "blue anvil", "anvil red", {}, 0.736842), ("token-sort-ratio", "", "", {}, 1),
    ("phonetic", "Smith", "Smyth", {}, 1), ("phonetic", "12", "Москва", {"emptyCode": "abstain"}, None),
])
def test_pair_scores(spark, name, a, b, params, score):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(pair_score(name, F.col("a"), F.col("b"), params).alias("s")).first()["s"]
    assert got is None if score is None else got == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("a, b, score", [(100.0, 95.0, 0.95), (0.2, 0.7, 0.5), (-10.0, 10.0, 0)])
def test_numeric(spark, a, b, score):
    got = spark.createDataFrame([(a, b)], "a double, b double").select(pair_score("numeric-proximity", F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert got == pytest.approx(score)


def test_parameters_are_declared(spark):
    assert len(REGISTRY) == 8
    with pytest.raises(ValueError):
        pair_score("edit-distance", F.lit("a"), F.lit("b"), {"unheard": 1})
    with pytest.raises(KeyError):
        metric("unheard")
