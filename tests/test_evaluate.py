import pytest

from nearfold.operators import evaluate as E
from nearfold.operators import quality as Q

LABELS = "id long, keywords string, genres string, vote_count long"


@pytest.fixture
def catalog(spark):
    rows = [
        (1, "a, b, c", "x, y", 60),
        (2, "a, b", "y", 60),
        (3, "c, d", "z", 60),
        (4, None, None, 60),
        (5, "A , b", "X", 10),
    ]
    return spark.createDataFrame(rows, LABELS)


def edges(spark, *rows):
    return spark.createDataFrame(
        [(a, r, b, 0.5) for a, r, b in rows], "movie_id long, rank int, neighbour_id long, score double"
    )


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_jaccard_and_precision_by_hand(spark, catalog):
    e = edges(spark, (1, 1, 2), (1, 2, 3), (2, 1, 5), (2, 2, 4), (4, 1, 1), (4, 2, 2))
    queries = ids(spark, 1, 2, 4)
    # Film 1: (2/3 + 1/4) / 2; film 2: (1 + 0) / 2; film 4 has no labels and is left out.
    got = E.keyword_jaccard_at_k(e, catalog, queries).first()
    assert got.score == pytest.approx(((2 / 3 + 1 / 4) / 2 + 1 / 2) / 2) and got.n_scored == 2
    got = E.genre_precision_at_k(e, catalog, queries, 10).first()
    assert got.score == pytest.approx((1 / 2 + 0) / 2) and got.n_scored == 2


def test_no_labelled_query_gives_null(spark, catalog):
    e = edges(spark, (4, 1, 1))
    got = E.keyword_jaccard_at_k(e, catalog, ids(spark, 4)).first()
    assert got.score is None and got.n_scored == 0


def test_score_run_agrees_with_single_metrics(spark, catalog):
    e = edges(spark, *[(i, r, j) for i in range(1, 6) for r, j in enumerate((j for j in range(1, 6) if j != i), 1)])
    settings = {"n_queries": 10, "query_min_vote_count": 50, "seed": 42}
    rows, summary = E.score_run(catalog, {"all": e}, 4, settings)
    got = {r.method: r for r in rows.collect()}
    queries = E.sample_queries(catalog, 10, 50, 42)
    assert got["all"].keyword_jaccard_at_k == pytest.approx(E.keyword_jaccard_at_k(e, catalog, queries).first().score)
    # With k = n - 1 the random baseline is every other film as well.
    assert got["random"].keyword_jaccard_at_k == pytest.approx(got["all"].keyword_jaccard_at_k)
    assert got["random"].genre_precision_at_k == pytest.approx(got["all"].genre_precision_at_k)
    one = summary.first()
    assert (one.catalog_size, one.n_queries, one.n_keyword_queries, one.n_genre_queries) == (5, 4, 3, 3)
    assert one.warning.startswith("only 4 eligible")


def test_run_of_another_catalog_is_refused(spark, catalog):
    good = [(i, 1, i % 5 + 1) for i in range(1, 6)]
    E.check_run(edges(spark, *good), catalog, "m")
    for bad in (good[:-1], good + [(9, 1, 1)], good + [(1, 2, 9)]):
        with pytest.raises(ValueError, match="another catalog"):
            E.check_run(edges(spark, *bad), catalog, "m")


def test_query_sample_depends_on_seed_and_ids_only(spark):
    rows = [(i, None, None, 50 if i % 2 else 49) for i in range(200)]
    a = spark.createDataFrame(rows, LABELS)
    b = spark.createDataFrame(rows[::-1], LABELS).repartition(7)
    draw = [{r.id for r in E.sample_queries(df, 30, 50, seed).collect()} for df, seed in ((a, 1), (b, 1), (a, 2))]
    assert draw[0] == draw[1] != draw[2]
    assert len(draw[0]) == 30 and all(i % 2 for i in draw[0])
    assert E.sample_queries(a, 1000, 50, 1).count() == 100


def test_random_baseline_is_distinct_and_never_itself(spark):
    every = ids(spark, *range(10, 40, 2))
    got = E.random_baseline(every, every, 6, 3).collect()
    again = E.random_baseline(every.repartition(5), every, 6, 3).collect()
    assert sorted(got) == sorted(again)
    by_query = {}
    for r in got:
        by_query.setdefault(r.movie_id, []).append(r.neighbour_id)
    assert len(by_query) == 15
    for query, picked in by_query.items():
        assert len(set(picked)) == 6 and query not in picked


def test_latest_common_run(spark):
    runs = spark.createDataFrame(
        [
            ("a", "2026-01-01"), ("b", "2026-01-01"), ("a", "2026-01-02"),
            ("a", "2026-01-03-sample"), ("b", "2026-01-03-sample"), ("a", "2026-01-03"),
        ],
        "method string, run_date string",
    )
    assert E.latest_common_run(runs, ["a", "b"], False).first().run_date == "2026-01-01"
    assert E.latest_common_run(runs, ["a", "b"], True).first().run_date == "2026-01-03-sample"
    assert E.latest_common_run(runs, ["a", "c"], False).first().run_date is None


def test_comparison_rows(spark):
    one = spark.createDataFrame([("a", 5, float("inf"))], "method string, catalog_size long, fit_seconds double")
    two = spark.createDataFrame([("b", 0.1)], "method string, oov_rate double")
    got = {r.method: r for r in E.comparison_table([one, two]).collect()}
    assert got["a"].fit_seconds is None and got["a"].oov_rate is None and got["b"].oov_rate == 0.1
    assert list(E.comparison_table([one, two]).columns) == list(E.COMPARISON_COLUMNS)
    with pytest.raises(ValueError, match="duplicate"):
        E.check_methods(["a", "b", "a"])


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4] * 3], "t double")
    import numpy as np

    got = E.latency_percentiles(df, "t").first()
    want = np.percentile([1, 2, 3, 4] * 3, [50, 95])
    assert (got.p50_ms, got.p95_ms) == pytest.approx(tuple(want))


LIMITS = {
    "row_count_min": 1000,
    "row_count_drift_pct": 15,
    "catalog_count_min": 100,
    "null_rate_max": {"title": 0.001, "overview": 0.6},
    "duplicate_id_rate_max": 0.0,
    "embedding_nan_rate_max": 0.0,
    "zero_vector_rate_max": 0.02,
}


def first(df):
    return df.first().asDict()


def test_count_gates(spark):
    assert first(Q.gate_row_count_min(spark.range(1000), LIMITS))["passed"]
    assert not first(Q.gate_row_count_min(spark.range(999), LIMITS))["passed"]
    assert not first(Q.gate_catalog_count_min(spark.range(99), LIMITS))["passed"]


def test_drift_gate(spark):
    history = spark.createDataFrame([("2026-01-01", 500.0), ("2026-01-08", 1000.0)], "run_date string, observed double")
    ok = first(Q.gate_row_count_drift(spark.range(1100), history, "2026-01-15", LIMITS))
    assert ok["passed"] and ok["observed"] == pytest.approx(10)
    assert not first(Q.gate_row_count_drift(spark.range(1200), history, "2026-01-15", LIMITS))["passed"]
    # Only runs strictly before this one count.
    assert not first(Q.gate_row_count_drift(spark.range(1000), history, "2026-01-08", LIMITS))["passed"]
    new = first(Q.gate_row_count_drift(spark.range(1), history, "2026-01-01", LIMITS))
    assert new["passed"] and new["skipped_reason"] == "no previous run" and new["observed"] == 0


def test_null_rate_gate(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "title string, overview string")
    got = {r.name: r for r in Q.gate_null_rate(df, LIMITS).collect()}
    assert not got["null_rate_max.title"].passed and got["null_rate_max.overview"].passed
    assert all(r.observed == 0 and r.passed for r in Q.gate_null_rate(df.limit(0), LIMITS).collect())


def test_duplicate_gate(spark):
    got = first(Q.gate_duplicate_id_rate(ids(spark, 1, 1, 2, 3), LIMITS))
    assert not got["passed"] and got["observed"] == 0.25
    assert first(Q.gate_duplicate_id_rate(ids(spark), LIMITS))["passed"]


def test_embedding_gates(spark):
    nan = float("nan")
    dense = spark.createDataFrame([([1.0, nan],), ([0.0, 0.0],)], "vec array<double>")
    assert first(Q.gate_embedding_nan_rate(dense, LIMITS))["observed"] == 0.25
    assert first(Q.gate_zero_vector_rate(dense, LIMITS))["observed"] == 0.5
    only_nan = spark.createDataFrame([([nan, 0.0],)], "vec array<double>")
    assert first(Q.gate_zero_vector_rate(only_nan, LIMITS))["observed"] == 0
    rows = spark.createDataFrame([(1, [0.5, nan])], "id long, weights array<double>")
    vocab = spark.range(4)
    assert first(Q.gate_sparse_nan_rate(rows, ids(spark, 1, 2), vocab, LIMITS))["observed"] == 1 / 8
    assert first(Q.gate_sparse_zero_rate(rows, ids(spark, 1, 2), LIMITS))["observed"] == 0.5


def test_report_is_written_before_it_fails_and_then_replaced(spark, store):
    bad = Q.gate_row_count_min(spark.range(10), LIMITS)
    good = Q.named(Q.gate_row_count_min(spark.range(2000), LIMITS), "tfidf")
    with pytest.raises(Q.QualityGateFailed) as err:
        Q.enforce(Q.quality_report([bad, good]), store, "2026-01-01")
    assert err.value.failed == ["row_count_min"]
    assert store.read("quality", "2026-01-01").count() == 2
    assert [tuple(r) for r in store.row_counts().collect()] == [("2026-01-01", 10.0)]
    Q.enforce(good, store, "2026-01-01")
    assert [r.name for r in store.read("quality", "2026-01-01").collect()] == ["tfidf.row_count_min"]
