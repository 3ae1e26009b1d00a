import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels, predicates, text


@pytest.fixture
def V(spark):
    return F.col("v")


PATHS = ["/a/x.bz2", "x.bz2y.bz2", "x.bz2y", "/a/", "X.BZ2", None]


def test_acquisition_key(column, V):
    assert column(PATHS, text.acquisition_key(V)) == ["x", "x", "x.bz2y", "", "X.BZ2", None]


def test_downstream_key(column, V):
    keys = text.downstream_key(text.base_name(V))
    assert column(PATHS, keys) == ["x", "xy", "xy", "", "X.BZ2", None]
    assert column(PATHS, text.canonical_key(V)) == ["x", "xy", "xy", "", "X.BZ2", None]


def test_period_of_text_and_timestamp(column, V):
    assert column(["2023-04-05 01:02:03", None], text.period(V, "month")) == ["2023-04", None]
    stamp = [datetime.datetime(2023, 4, 5, 1)]
    assert column(stamp, text.period(V, "year"), "timestamp_ntz") == ["2023"]
    assert column(stamp, text.period(V, "month"), "timestamp") == ["2023-04"]


def test_base_names(column, V):
    names = ["abc__claims__shared", "abc", "__abc__x"]
    assert column(names, text.base_schema(V)) == ["abc", "abc", ""]
    assert column(names, text.standard_base(V)) == ["abc", "abc", "abc"]


def test_type_message(column, V):
    assert column(["835"], text.type_message(V, F.lit(True))) == ["Table 835 type exists"]
    assert column(["837"], text.type_message(V, F.lit(False))) == [
        "Table 837 type does not exist - need to investigate"
    ]


def test_blank_and_populated(column, V):
    assert column([None, "", " ", "a"], predicates.is_blank(V)) == [True, True, False, False]
    ids = [None, "", "  ", "NaN", " nan ", "A17", "17"]
    assert column(ids, predicates.is_populated(V)) == [False] * 5 + [True, True]
    assert column([float("nan"), 1.0], predicates.is_populated(V), "double") == [False, True]


def test_substring_predicates(column, V):
    assert column(["x835", "837x", "x", None], predicates.contains_any(V, ["835", "837"])) == [
        True, True, False, None,
    ]
    assert column(["a_INGESTED", "aXingested", "b"], predicates.contains_ci(V, "_ingested")) == [
        True, False, False,
    ]


def test_crosswalk(column, V):
    names = ["835__a_crosswalk", "crosswalk_b_837", "crosswalk", "835__x", "836_crosswalk"]
    assert column(names, predicates.is_crosswalk(V)) == [True, True, False, False, False]


def test_parameter_match(column, V):
    values = ["TP_A", "TPxA", "", None]
    assert column(values, predicates.matches_param(V, "TP_A")) == [True, True, False, None]
    assert column(values, predicates.matches_param(V, "")) == [True, True, True, None]
    assert column(values, predicates.matches_param(V, "T%A")) == [True, True, False, None]


def test_keyword_class(column, V):
    rules = [("one", ["plate"]), ("none", []), ("two", ["red", "for"])]
    names = ["Red Plate", "FORD", "blue", "for sale", None]
    assert column(names, labels.keyword_class(V, rules)) == ["one", "two", "Other", "two", "Other"]
    whole = labels.keyword_class(V, rules, "none", whole_word=True)
    assert column(names, whole) == ["one", "none", "none", "two", "none"]
    assert column(["a"], labels.keyword_class(V, [])) == ["Other"]


def test_size_bin(column, V):
    bins = labels.size_bin(V, [(500, "Medium"), (2000, "Large")], "Small")
    amounts = [2000.0, 1999.99, 500.0, 499.99, None]
    expected = ["Large", "Medium", "Medium", "Small", "Small"]
    assert column(amounts, bins, "double") == expected
    nan_safe = labels.size_bin(predicates.nan_to_null(V), [(2000, "Large")], "Small")
    assert column([float("nan"), 3000.0], nan_safe, "double") == ["Small", "Large"]


def test_place_class(column, V):
    cities = ["Home", "home", "Near", None]
    plain = labels.place_class(V, "Home", ["Near"])
    assert column(cities, plain) == ["home", "other", "near", "other"]
    folded = labels.place_class(V, "Home", ["Near"], normalize=True)
    assert column(cities, folded) == ["home", "home", "near", "other"]


def test_type_code(column, V):
    assert column(["835_837_x", "837", "x"], labels.type_code(V)) == ["835", "837", None]


def test_labels_and_recodes(column, V):
    same = labels.same_type_label(V, F.lit("835"), "same", "different")
    assert column(["835", "837", None], same) == ["same", "different", "different"]
    override = labels.override_where(F.lit("True"), V, "missing", "False")
    assert column(["it is missing", "fine", None], override) == ["False", "True", "True"]
    assert column([True, False, None], labels.bool_text(V), "boolean") == ["True", "False", None]
    assert column(["a", "b", None], labels.replace_values(V, {"a": "A"})) == ["A", "b", None]
    assert column(["yes", "no", None], labels.binary_label(V, "yes")) == [1, 0, None]
    assert column([0, 1], labels.signed_label(V), "int") == [-1, 1]
    assert column([0.3, 0.29, None], labels.classify(V), "double") == [1, 0, None]
    assert column(["1.5", "x", None], labels.to_number(V)) == [1.5, None, None]
