"""Time the stages of a run at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each stage reads what the stage before it wrote, as a scheduled run does.
"""

from __future__ import annotations

import json
import os
import time


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from pyspark.sql import functions as F

    from checks.similarity import word_table
    from checks.serving import asked, job_settings
    from checks.sql import STOP
    from nearfold import adapters as A
    from nearfold.operators import quality as Q
    from nearfold.operators.catalog import prepare
    from nearfold.operators.dense_knn import knn_dense
    from nearfold.operators.evaluate import score_run
    from nearfold.operators.records import assemble_records, hydrate_batch, similar_lookup
    from nearfold.operators.search import title_search
    from nearfold.operators.sparse_knn import knn_sparse
    from nearfold.operators.tfidf import TfidfEmbedder, unigram_idf
    from nearfold.operators.vectors import WordVectorEmbedder
    from nearfold.scale import scratch_path
    from nearfold.session import local_session
    from nearfold.sources.store import RunStore

    spark = local_session(cpus)
    store = RunStore(spark, scratch_path(spark, "bench"))
    day, k, settings = "2026-01-01", 10, job_settings()
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        out = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()
    raw = A.films(spark, sf_dir)
    timed("catalog", lambda: store.write(prepare(raw, A.EVERY_DOCUMENT, A.DOCUMENT_FIELDS), "catalog", day))
    catalog = store.read("catalog", day)
    docs = catalog.select("id", "document")

    def gates():
        report = [
            Q.raw_gates(raw, store.row_counts(), day, settings["quality"]),
            Q.gate_catalog_count_min(catalog, settings["quality"]),
            Q.gate_duplicate_id_rate(catalog, settings["quality"]),
        ]
        Q.enforce(Q.quality_report(report), store, day)

    timed("data_gates", gates)
    model = TfidfEmbedder(stop_words=STOP)
    timed("tfidf_fit", lambda: model.fit(docs).save(store, day))
    spark.catalog.clearCache()
    saved = TfidfEmbedder.load(store, day, stop_words=STOP)
    words, n_words = word_table(spark, sf_dir, docs)
    words.write.parquet(store.path("words"))
    words = spark.read.parquet(store.path("words"))
    dense = WordVectorEmbedder(unigram_idf(saved.vocab), words, STOP, n_words, 50_000)
    timed("doc_vectors", lambda: dense.fit(docs).save(store, day))
    timed("knn_sparse", lambda: store.write(knn_sparse(saved.rows, saved.ids, k), "neighbours", day, "tfidf"))
    rows = store.read("rows", day, "word2vec")
    timed("knn_dense", lambda: store.write(knn_dense(rows, k), "neighbours", day, "word2vec"))
    edges = {m: store.read("neighbours", day, m) for m in ("tfidf", "word2vec")}
    scores = timed("score_run", lambda: score_run(catalog, edges, k)[0].collect())
    timed("records", lambda: store.write(assemble_records(catalog, edges), "served", day))
    served = store.read("served", day)
    ids = served.select(F.col("movie_id").alias("request"), "similar_tfidf.id").toDF("request", "ids")
    timed("hydrate_batch", lambda: noop(hydrate_batch(ids, served)))
    timed("similar_lookup", lambda: noop(similar_lookup(served.select("movie_id"), served, "tfidf")))
    timed("title_search", lambda: noop(title_search(asked(spark, sf_dir), A.titles(spark, sf_dir))))

    print(
        json.dumps(
            {
                "metric": "run_stages_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "n_documents": catalog.count(),
                "scores": {r.method: [r.keyword_jaccard_at_k, r.genre_precision_at_k] for r in scores},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
