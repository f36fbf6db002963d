import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions import labels as L
from nearfold.functions import text as X
from nearfold.functions import values as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_white_space_of_every_kind_collapses(spark):
    got = value(spark, X.collapse_whitespace(F.lit(" a\t\x1c\x85b 　 c\x0b ")))
    assert got == "a b c"
    assert value(spark, X.collapse_whitespace(F.lit(None).cast("string"))) == ""


def test_tokens_keep_accents_and_drop_single_letters(spark):
    got = value(spark, X.tokenize(F.lit("Été à la Café_2, x 42 naïve")))
    assert got == ["été", "la", "café_2", "42", "naïve"]


def test_stop_words_go_before_ngrams_and_repeats_stay(spark):
    tokens = X.drop_stop_words(X.tokenize(F.lit("the king of the king kong")), ["the", "of"])
    assert value(spark, X.ngrams(tokens, 2)) == ["king", "king", "kong", "king king", "king kong"]
    assert value(spark, X.ngrams(F.array().cast("array<string>"), 2)) == []
    three = value(spark, X.ngrams(F.array(*map(F.lit, "abc")), 3))
    assert three == ["a", "b", "c", "a b", "b c", "a b c"]


def test_label_cells(spark):
    cell = F.lit("\tSpace Opera,robot\u00a0,,\u2003Desert ,robot, ROBOT")
    assert set(value(spark, L.label_set(cell))) == {"space opera", "robot", "desert"}
    assert value(spark, L.genre_list(cell)) == ["Space Opera", "robot", "Desert", "robot", "ROBOT"]
    for nothing in (None, "", ",\t,\u00a0"):
        given = F.lit(nothing).cast("string")
        assert value(spark, L.label_set(given)) == []
        assert value(spark, L.genre_list(given)) is None
    assert value(spark, L.keyword_set(F.lit("p,q, R\t, p,q"))) == ["p,q", "R"]


def test_blank_of_any_kind_is_missing(spark):
    for blank in ("", " ", "\t\u00a0 "):
        assert value(spark, V.is_missing(F.lit(blank), T.StringType())) is True
    assert value(spark, V.is_missing(F.lit(" x "), T.StringType())) is False


def test_all_digits_of_a_number_count(spark):
    for number, digits in ((1.5e-14, 2), (1234.0, 4), (0.0, 1), (123456789012345.0, 15), (-0.25, 2), (1e300, 1)):
        assert value(spark, V.value_bytes(F.lit(number), T.DoubleType())) == -(-digits // 2) + 1


def test_set_scores(spark):
    a, b, none = (F.array(*map(F.lit, s)) if s else F.array().cast("array<string>") for s in ("xy", "yz", ""))
    assert math.isclose(value(spark, L.jaccard(a, b)), 1 / 3)
    assert value(spark, L.jaccard(none, none)) == 0.0
    assert value(spark, L.shares_label(a, b)) == 1.0
    assert value(spark, L.shares_label(a, none)) == 0.0
    assert value(spark, L.shared_in_order(b, a)) == ["y"]


def test_years(spark):
    cases = {"1999-03-31": (1999, 1999), "201": (None, 201), "n/a": (None, None), "19x9": (None, None), "": (None, None)}
    for text, (strict, lenient) in cases.items():
        assert value(spark, V.year_strict(F.lit(text))) == strict
        assert value(spark, V.year_lenient(F.lit(text))) == lenient
    assert value(spark, V.year_strict(F.lit(None).cast("string"))) is None


def test_record_sizes_by_hand(spark):
    # id: 8 + 1; title: 5 + 2; year 2010 has three significant digits: 4 + 3.
    df = spark.createDataFrame([("1", "Up", 2010)], "movie_id string, title string, year int")
    assert df.select(V.record_bytes(df.schema)).first()[0] == 23
    # genres: 6 + 3 + (1 + 2) + (1 + 1); é is two bytes.
    df = spark.createDataFrame([("1", ["é", "a"], None)], "movie_id string, genres array<string>, year int")
    assert df.select(V.record_bytes(df.schema)).first()[0] == 9 + 14
    # list 3 + 1 + map 3 + (1 + 2 + 1) + (1 + 5 + 2).
    df = spark.createDataFrame([("1", [("2", 0.5)])], "movie_id string, s array<struct<id string, score double>>")
    assert df.select(V.record_bytes(df.schema)).first()[0] == 9 + 1 + 3 + 1 + 3 + 4 + 8


def test_write_units_round_each_record_up(spark):
    df = spark.createDataFrame([("a" * 1019,), ("a" * 1020,)], "k string")
    sizes = df.select(V.record_bytes(df.schema).alias("n"))
    assert sorted(r.u for r in sizes.select(V.write_units(F.col("n")).alias("u")).collect()) == [1, 1]
    longer = spark.createDataFrame([("a" * 1024,)], "k string")
    assert longer.select(V.write_units(V.record_bytes(longer.schema))).first()[0] == 2


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "x double")
    assert [r.v for r in df.select(V.finite_or_null(F.col("x")).alias("v")).collect()] == [None, None, 1.5]
