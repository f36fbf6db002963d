import pytest
from pyspark.sql import functions as F

from nearfold.operators.quality import QualityGateFailed
from nearfold.operators.tfidf import TfidfEmbedder
from nearfold.plans.compare import compare_methods, word_vectors_after_tfidf
from nearfold.plans.publish import publish_run
from nearfold.plans.rollback import RollbackRefused, rollback_run
from nearfold.plans.score import score_existing_run
from nearfold.settings import with_changes

SETTINGS = with_changes(
    {
        "catalog": {"min_overview_chars": 5},
        "tfidf": {"min_df": 1, "max_df": 1.0},
        "index": {"k": 3},
        "eval": {"n_queries": 5, "query_min_vote_count": 10},
        "quality": {"row_count_min": 5, "catalog_count_min": 5, "zero_vector_rate_max": 0.5},
    },
)
WORDS = ["space", "war", "love", "paris", "robot", "dog", "sea", "city"]


@pytest.fixture
def words(spark):
    rows = [(w, [float(i == j) for j in range(8)]) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "token string, vec array<double>")


def films(spark, n=12, first=0):
    rows = [
        (
            i, f"Film {i}", None, f"{WORDS[i % 8]} {WORDS[(i * 3 + 1) % 8]} story", "Drama" if i % 2 else "Comedy",
            f"{WORDS[i % 8]}, common", "2001-01-01", 7.5, 20 + i, "Released", False, "/p",
        )
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(
        rows,
        "id long, title string, tagline string, overview string, genres string, keywords string, "
        "release_date string, vote_average double, vote_count long, status string, adult boolean, poster_path string",
    )


def test_publish_then_roll_back(spark, words, store):
    metrics = publish_run(films(spark), words, store, "2026-01-01", SETTINGS, [])
    got = {r.method: r for r in metrics.collect()}
    assert set(got) == {"tfidf", "word2vec", "random"}
    assert got["tfidf"].artifact_mb > 0 and got["random"].artifact_mb is None
    assert store.pointer() == ("2026-01-01", "tfidf")
    served = store.served().read()
    assert served.count() == 12
    assert served.select(F.size("similar_tfidf"), F.size("similar_word2vec")).distinct().collect() == [(3, 3)]
    names = {r.name for r in store.read("quality", "2026-01-01").collect()}
    assert {"row_count_min", "tfidf.zero_vector_rate_max", "word2vec.embedding_nan_rate_max"} <= names
    assert store.read("metrics_summary", "2026-01-01").first().catalog_size == 12

    # A later run with one more film; the earlier records it lacks stay served.
    publish_run(films(spark, 13, 1), words, store, "2026-01-08", SETTINGS, [])
    assert store.pointer()[0] == "2026-01-08"
    assert store.served().read().count() == 14

    dry = rollback_run(store, "2026-01-01", SETTINGS, dry_run=True).first()
    assert (dry.run_date, dry.records, dry.write_units) == ("2026-01-01", 12, 12)
    assert store.pointer()[0] == "2026-01-08"
    rollback_run(store, "2026-01-01", SETTINGS)
    assert store.pointer()[0] == "2026-01-01"
    assert store.served().read().count() == 14
    # Publishing the served date again replaces it.
    publish_run(films(spark, 13, 0), words, store, "2026-01-01", SETTINGS, [])
    assert store.served().read().count() == 14

    rows, summary = score_existing_run(store.read("catalog", "2026-01-08"), store, 3, SETTINGS["eval"])
    assert rows.count() == 3 and summary.first().n_queries == 5

    with pytest.raises(RollbackRefused, match="catalog not stored"):
        rollback_run(store, "2025-01-01", SETTINGS)
    failed = store.read("quality", "2026-01-08").withColumn("passed", F.lit(False)).checkpoint()
    store.write(failed, "quality", "2026-01-08")
    with pytest.raises(RollbackRefused, match="gate .* failed"):
        rollback_run(store, "2026-01-08", SETTINGS)


def test_failed_gate_leaves_only_the_report(spark, words, store, tmp_path):
    tight = with_changes({"quality": {"catalog_count_min": 100}}, SETTINGS)
    with pytest.raises(QualityGateFailed, match="catalog_count_min"):
        publish_run(films(spark), words, store, "2026-01-01", tight, [])
    assert [p.name for p in (tmp_path / "store").iterdir()] == ["quality"]
    assert store.pointer() is None

    strict = with_changes({"quality": {"zero_vector_rate_max": 0.0}}, SETTINGS)
    with pytest.raises(QualityGateFailed, match="word2vec.zero_vector_rate_max"):
        publish_run(films(spark), words.where("token = 'dog'"), store, "2026-01-01", strict, [])
    assert [p.name for p in (tmp_path / "store").iterdir()] == ["quality"]
    with pytest.raises(ValueError, match="default method"):
        publish_run(films(spark), words, store, "d", with_changes({"publish": {"default_method": "x"}}, SETTINGS), [])


def test_a_run_written_again_without_rows_is_empty(spark, store):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    store.write(rows, "thing", "2026-01-01")
    store.write(rows, "thing", "2026-01-02")
    store.write(rows.limit(0), "thing", "2026-01-01")
    assert store.read("thing", "2026-01-01").count() == 0
    assert store.read("thing", "2026-01-02").count() == 2
    store.write(rows.limit(0), "other", "2026-01-01")
    assert store.read("other", "2026-01-01").columns == ["id", "v"]


def test_settings_refuse_unknown_keys():
    assert with_changes({"index": {"k": 3}})["index"] == {"k": 3}
    for bad in ({"indx": {}}, {"index": {"kk": 1}}):
        with pytest.raises(KeyError):
            with_changes(bad)


def test_compare_methods(spark, words, store):
    docs = films(spark).select("id", F.lower("overview").alias("document"))
    methods = [TfidfEmbedder(SETTINGS["tfidf"], []), word_vectors_after_tfidf(words)]
    got = {r.method: r for r in compare_methods(methods, docs, store, "2026-01-01", 3).collect()}
    assert got["tfidf"].catalog_size == 12 and got["tfidf"].oov_rate is None and got["tfidf"].fit_seconds > 0
    # "story" is the one word of three without a vector.
    assert got["word2vec"].oov_rate == pytest.approx(1 / 3)
    assert got["word2vec"].artifact_mb > 0 and got["word2vec"].peak_rss_mb is None
    with pytest.raises(ValueError, match="duplicate"):
        compare_methods([methods[0], methods[0]], docs, store, "2026-01-02", 3)


def test_command_line(spark, words, tmp_path):
    import json

    from nearfold.__main__ import main
    from nearfold.sources import files
    from nearfold.sources.store import RunStore

    raw, out = str(tmp_path / "films.csv"), str(tmp_path / "out")
    files.write_csv(films(spark).withColumn("runtime", F.lit(90)).withColumn("budget", F.lit(1)), raw)
    vectors = str(tmp_path / "words")
    words.write.parquet(vectors)
    settings = str(tmp_path / "settings.json")
    with open(settings, "w") as f:
        json.dump(SETTINGS, f)
    common = ["--root", str(tmp_path / "runs"), "--input", raw, "--settings", settings]
    assert main(["publish", *common, "--words", vectors, "--run-date", "2026-01-01"], spark) == 0
    assert RunStore(spark, str(tmp_path / "runs")).pointer() == ("2026-01-01", "tfidf")
    assert main(["score", *common], spark) == 0
    assert main(["rollback", *common, "--run-date", "2026-01-01", "--dry-run"], spark) == 0
    assert main(["rollback", *common, "--run-date", "2020-01-01"], spark) == 1
    assert main(["titles", *common, "--out", out], spark) == 0
    assert files.read_title_index(spark, out).count() == 12
    for job in ("sample", "top"):
        assert main([job, *common, "--out", out, "--rows", "7"], spark) == 0
        text = files.scan_text_csv(spark, out)
        assert text.count() == 7 and "budget" in text.columns and "__row" not in text.columns
    assert {r.id for r in text.collect()} == {str(i) for i in range(5, 12)}
    with open(settings, "w") as f:
        json.dump({"quality": {"row_count_min": 10**9}}, f)
    assert main(["publish", *common, "--words", vectors, "--run-date", "2026-01-08"], spark) == 1


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("|").split("|") if "shuffle_" in f}


def test_shuffles_are_released(spark, tmp_path):
    """They stayed until the driver collected its garbage, all those of a run at once."""
    import time

    from nearfold.scale import RELEASE, shuffles_released

    setting = spark.conf.get(RELEASE)
    before = shuffle_files(spark)
    with pytest.raises(KeyError), shuffles_released(spark):
        spark.range(1000).groupBy(F.col("id") % 10).count().write.parquet(str(tmp_path / "t"))
        raise KeyError
    for _ in range(40):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(RELEASE) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_roll_back_releases_its_shuffles(spark, words, store):
    import time

    publish_run(films(spark), words, store, "2026-01-01", SETTINGS, [])
    before = shuffle_files(spark)
    totals = rollback_run(store, "2026-01-01", SETTINGS)
    for _ in range(40):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= before
    assert (totals.first().records, store.served().read().count()) == (12, 12)


def test_a_run_leaves_only_its_store(spark, words, store, tmp_path):
    """Blocks of both searches stayed; drafts go whether the run passes its gates or not."""
    from pathlib import Path

    from nearfold.scale import shared_dir

    def left():
        names = Path(shared_dir(spark).removeprefix("file:")).iterdir()
        return {p.name for p in names if p.name.startswith(("blocks-", "catalog-", "gates-", "tfidf-", "word2vec-"))}

    before = left()
    publish_run(films(spark), words, store, "2026-01-01", SETTINGS, [])
    assert left() == before
    strict = with_changes({"quality": {"zero_vector_rate_max": 0.0}}, SETTINGS)
    with pytest.raises(QualityGateFailed):
        publish_run(films(spark), words.where("token = 'dog'"), store, "2026-01-08", strict, [])
    assert left() == before
    assert store.read("rows", "2026-01-01", "tfidf").inputFiles()[0].endswith(".zstd.parquet")
