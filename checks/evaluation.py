"""Labels, metrics, gates and run selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.similarity import K, fitted, places
from checks.sources_and_text import every_film, flat
from nearfold import adapters as A
from nearfold.operators import dense_knn
from nearfold.operators import evaluate as E
from nearfold.operators import quality as Q
from nearfold.scale import scratch_path
from nearfold.sources.store import RunStore

QUERIES = {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return keep


def dense_edges(spark, sf):
    """Neighbours among the vectors that belong to a film."""
    ids = A.vector_films(spark, sf).select("id")
    return dense_knn.knn_dense(A.dense_vectors(spark, sf).join(ids, "id", "left_semi"), K)


def labelled(spark, sf):
    """Films with vectors, their edges, and all that may be asked."""
    catalog = A.vector_films(spark, sf)
    return catalog, dense_edges(spark, sf), catalog.where("vote_count >= 50").select("id")


LABELLED = f"WITH {S.FILM_EDGES}, {S.VECTOR_FILMS}, {S.QUERIES}"
KEYWORDS = f"keys AS (SELECT id, {S.label_set('keywords')} AS l FROM vfilms)"
GENRES = f"kinds AS (SELECT id, {S.label_set('genres')} AS l FROM vfilms)"
JACCARD = "CASE WHEN len(list_distinct(list_concat(q.l, t.l))) = 0 THEN 0.0 ELSE len(list_intersect(q.l, t.l)) / len(list_distinct(list_concat(q.l, t.l))) END"
SHARES = "CASE WHEN list_has_any(q.l, t.l) THEN 1.0 ELSE 0.0 END"


def mean_score(edges: str, labels: str, score: str) -> str:
    return f"""(SELECT avg(s) AS score, count(*) AS n_scored FROM (
      SELECT e.movie_id, avg({score}) AS s FROM {edges} e JOIN queries ON queries.id = e.movie_id
      JOIN {labels} q ON q.id = e.movie_id JOIN {labels} t ON t.id = e.neighbour_id
      WHERE len(q.l) > 0 GROUP BY 1))"""


@query(
    "edges_x_labels",
    f"""{LABELLED}, {KEYWORDS} SELECT e.movie_id, e.neighbour_id, {S.joined('q.l')} AS query_labels,
      {S.joined('t.l')} AS labels FROM dense_edges e JOIN queries ON queries.id = e.movie_id
      JOIN keys q ON q.id = e.movie_id JOIN keys t ON t.id = e.neighbour_id WHERE len(q.l) > 0""",
)
def edges_x_labels(spark, sf):
    catalog, edges, queries = labelled(spark, sf)
    pairs = E.edges_x_labels(edges, E.label_table(catalog, "keywords"), queries, None)
    return pairs.select("movie_id", "neighbour_id", flat("query_labels").alias("query_labels"), flat("labels").alias("labels"))


@query(
    "run_matches_catalog",
    f"""WITH {S.FILM_EDGES}, {S.FILMS}, cat AS (SELECT id FROM films WHERE status = 'Released')
    SELECT 'query not in catalog' AS problem, id FROM (SELECT DISTINCT movie_id AS id FROM dense_edges) WHERE id NOT IN (SELECT id FROM cat)
    UNION ALL SELECT 'catalog id without edges', id FROM cat WHERE id NOT IN (SELECT movie_id FROM dense_edges)
    UNION ALL SELECT 'neighbour not in catalog', id FROM (SELECT DISTINCT neighbour_id AS id FROM dense_edges) WHERE id NOT IN (SELECT id FROM cat)""",
)
def run_matches_catalog(spark, sf):
    catalog = A.films(spark, sf).where(F.col("status") == "Released")
    return E.run_mismatches(dense_edges(spark, sf), catalog)


RANDOM = """numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS num FROM vfilms),
others AS (SELECT count(*) - 1 AS n FROM vfilms),
drawn AS (
  SELECT id, num AS own, 0 AS slot, CAST([] AS BIGINT[]) AS picked FROM queries JOIN numbered USING (id)
  UNION ALL
  SELECT id, own, slot + 1, list_append(picked, CASE WHEN list_contains(picked, pick) THEN top ELSE pick END)
  FROM (SELECT d.*, n - 10 + slot AS top, """ + S.draw(42, "id", "slot", "n - 10 + slot + 1") + """ AS pick
        FROM drawn d, others) WHERE slot < 10),
random_edges AS (SELECT d.id AS movie_id, CAST(r.rank AS INTEGER) AS rank, m.id AS neighbour_id
  FROM (SELECT id, own, unnest(picked) AS pick, generate_subscripts(picked, 1) AS rank FROM drawn WHERE slot = 10) r
  JOIN (SELECT id, own FROM drawn WHERE slot = 10) d ON d.id = r.id
  JOIN numbered m ON m.num = CASE WHEN r.pick >= r.own THEN r.pick + 1 ELSE r.pick END)"""
LABELLED_RANDOM = LABELLED.replace("WITH ", "WITH RECURSIVE ", 1) + f", {RANDOM}"


@query("random_baseline", f"{LABELLED_RANDOM} SELECT * FROM random_edges")
def random_baseline(spark, sf):
    catalog, _, queries = labelled(spark, sf)
    return E.random_baseline(queries, catalog, K, 42)


@query(
    "sample_queries",
    f"WITH {S.FILMS} SELECT id FROM films WHERE vote_count >= 50 ORDER BY {S.seeded(42, 'id')}, id LIMIT 2000",
)
def sample_queries(spark, sf):
    return E.sample_queries(A.films(spark, sf), 2000, 50, 42)


@query(
    "mean_label_score",
    f"""{LABELLED}, {KEYWORDS} SELECT round(score, 6) AS score, n_scored FROM
    {mean_score('dense_edges', 'keys', "CASE WHEN len(q.l) = len(t.l) AND len(list_intersect(q.l, t.l)) = len(q.l) THEN 1.0 ELSE 0.0 END")}""",
)
def mean_label_score(spark, sf):
    """A pair score of one's own: equal label sets."""
    catalog, edges, queries = labelled(spark, sf)

    def same(a, b):
        return (F.sort_array(a) == F.sort_array(b)).cast("double")

    labels = E.label_table(catalog, "keywords")
    return E.mean_label_score(edges, labels, queries, same, None).select(places("score"), "n_scored")


@query(
    "keyword_jaccard_at_k",
    f"{LABELLED}, {KEYWORDS} SELECT round(score, 6) AS score, n_scored FROM {mean_score('dense_edges', 'keys', JACCARD)}",
)
def keyword_jaccard_at_k(spark, sf):
    catalog, edges, queries = labelled(spark, sf)
    return E.keyword_jaccard_at_k(edges, catalog, queries, None).select(places("score"), "n_scored")


@query(
    "genre_precision_at_k",
    f"{LABELLED}, {GENRES} SELECT round(score, 6) AS score, n_scored FROM {mean_score('dense_edges', 'kinds', SHARES)}",
)
def genre_precision_at_k(spark, sf):
    catalog, edges, queries = labelled(spark, sf)
    return E.genre_precision_at_k(edges, catalog, queries, None).select(places("score"), "n_scored")


@query(
    "latency_percentiles",
    """SELECT round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) / 1000, 6) AS p50_ms,
      round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value) / 1000, 6) AS p95_ms FROM events""",
)
def latency_percentiles(spark, sf):
    events = A.table(spark, sf, "events")
    return E.latency_percentiles(events, "value", 1000.0).select(places("p50_ms"), places("p95_ms"))


@query(
    "neighbour_lists",
    f"WITH {S.FILM_EDGES} SELECT movie_id, string_agg(CAST(neighbour_id AS VARCHAR), '|' ORDER BY rank) AS neighbours FROM dense_edges GROUP BY 1",
)
def neighbour_lists(spark, sf):
    lists = E.neighbour_lists(dense_edges(spark, sf))
    return lists.select("movie_id", F.array_join("neighbours", "|").alias("neighbours"))


SCORE_ROWS = f"""{LABELLED_RANDOM.replace(S.QUERIES, S.SAMPLED)}, {KEYWORDS}, {GENRES}
SELECT 'dense' AS method, round(k.score, 6) AS keyword_jaccard_at_k, round(g.score, 6) AS genre_precision_at_k
FROM {mean_score('dense_edges', 'keys', JACCARD)} k, {mean_score('dense_edges', 'kinds', SHARES)} g
UNION ALL SELECT 'random', round(k.score, 6), round(g.score, 6)
FROM {mean_score('random_edges', 'keys', JACCARD)} k, {mean_score('random_edges', 'kinds', SHARES)} g"""

EVAL = {"n_queries": 2000, "query_min_vote_count": 50, "seed": 42}


@query("score_run", SCORE_ROWS)
def score_run(spark, sf):
    catalog = A.vector_films(spark, sf).persist()
    rows, _ = E.score_run(catalog, {"dense": dense_edges(spark, sf).persist()}, K, EVAL)
    return rows.select("method", places("keyword_jaccard_at_k"), places("genre_precision_at_k"))


@query("score_existing_run", SCORE_ROWS)
def score_existing_run(spark, sf):
    """Stored edges of the latest run, scored without fitting."""
    from nearfold.plans.score import score_existing_run as job

    store = RunStore(spark, scratch_path(spark, "runs"))
    edges = dense_edges(spark, sf)
    store.write(edges.where(F.col("rank") <= 5), "neighbours", "2026-01-01", "dense")
    store.write(edges, "neighbours", "2026-01-08", "dense")
    rows, _ = job(A.vector_films(spark, sf), store, K, EVAL, ["dense"])
    return rows.select("method", places("keyword_jaccard_at_k"), places("genre_precision_at_k"))


@query(
    "comparison_table",
    """SELECT event_type AS method, count(*) AS catalog_size, CAST(round(avg(value), 6) AS DOUBLE) AS fit_seconds,
      CAST(NULL AS DOUBLE) AS peak_rss_mb, CAST(NULL AS DOUBLE) AS artifact_mb,
      CASE WHEN event_type = 'view' THEN round(min(value), 6) END AS oov_rate,
      CAST(NULL AS DOUBLE) AS median_idf_fallback_rate FROM events GROUP BY 1""",
)
def comparison_table(spark, sf):
    """Each event type stands for a method; one of them has more columns."""
    events = A.table(spark, sf, "events")
    base = events.groupBy(F.col("event_type").alias("method")).agg(
        F.count(F.lit(1)).alias("catalog_size"),
        F.round(F.avg("value"), 6).alias("fit_seconds"),
        F.lit(float("nan")).alias("artifact_mb"),
    )
    more = events.where(F.col("event_type") == "view").groupBy(F.col("event_type").alias("method")).agg(
        F.round(F.min("value"), 6).alias("oov_rate")
    )
    wide = base.where(F.col("method") == "view").join(more, "method")
    return E.comparison_table([base.where(F.col("method") != "view"), wide])


@query(
    "latest_common_run",
    """WITH runs AS (SELECT DISTINCT event_type AS method, strftime(ts, '%Y-%m-%d') AS run_date FROM events
      WHERE event_type <> 'click' OR strftime(ts, '%d') < '20'
      UNION SELECT event_type, strftime(ts, '%Y-%m-%d') || '-sample' FROM events WHERE event_type <> 'error')
    SELECT max(run_date) AS run_date FROM (SELECT run_date FROM runs
      WHERE method IN ('view', 'click', 'error') AND regexp_matches(run_date, '^\\d{4}-\\d{2}-\\d{2}$')
      GROUP BY 1 HAVING count(DISTINCT method) = 3)""",
)
def latest_common_run(spark, sf):
    events = A.table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    full = events.where((F.col("event_type") != "click") | (F.date_format("ts", "dd") < "20"))
    sample = events.where(F.col("event_type") != "error")
    runs = full.select(F.col("event_type").alias("method"), day.alias("run_date")).unionByName(
        sample.select(F.col("event_type").alias("method"), F.concat(day, F.lit("-sample")).alias("run_date"))
    )
    return E.latest_common_run(runs, ["view", "click", "error"], sample=False)


@query(
    "previous_run_value",
    """WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS run_date, CAST(count(*) AS DOUBLE) AS observed FROM events GROUP BY 1)
    SELECT run_date, observed, lag(observed) OVER (ORDER BY run_date) AS previous FROM days""",
)
def previous_run_value(spark, sf):
    return Q.with_previous(daily(spark, sf))


def daily(spark, sf):
    return A.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_date")).agg(
        F.count(F.lit(1)).cast("double").alias("observed")
    )


LIMITS = {
    "row_count_min": 500,
    "row_count_drift_pct": 15,
    "catalog_count_min": 10_000_000,
    "null_rate_max": {"title": 0.001, "status": 0.60},
    "duplicate_id_rate_max": 0.0,
    "embedding_nan_rate_max": 0.0,
    "zero_vector_rate_max": 0.02,
}


def gate(name, observed, threshold, test, reason="CAST(NULL AS VARCHAR)"):
    return (
        f"SELECT '{name}' AS name, o {test} {threshold} AS passed, o AS observed, "
        f"CAST({threshold} AS DOUBLE) AS threshold, {reason} AS skipped_reason "
        f"FROM (SELECT CAST({observed} AS DOUBLE) AS o)"
    )


G_ROWS = gate("row_count_min", "(SELECT count(*) FROM documents)", 500, ">=")
LAST_DAY = (
    "SELECT count(*) FROM events WHERE strftime(ts, '%Y-%m-%d') = "
    "(SELECT max(strftime(ts, '%Y-%m-%d')) FROM events WHERE strftime(ts, '%Y-%m-%d') < '2024-01-20')"
)
G_DRIFT = gate(
    "row_count_drift_pct",
    f"(SELECT abs((SELECT count(*) FROM documents) - ({LAST_DAY})) / ({LAST_DAY}) * 100)",
    15,
    "<=",
)
G_NULL = " UNION ALL ".join(
    gate(f"null_rate_max.{c}", f"(SELECT avg(CAST({c} IS NULL AS INT)) FROM films)", t, "<=")
    for c, t in LIMITS["null_rate_max"].items()
)
G_CATALOG = gate("catalog_count_min", "(SELECT count(*) FROM catalog)", 10_000_000, ">=")
G_DUP = gate(
    "duplicate_id_rate_max",
    "(SELECT (count(*) - count(DISTINCT o_custkey)) / count(*) FROM orders)",
    "0.0::DOUBLE",
    "<=",
)
ZERO = "(SELECT avg(CASE WHEN list_dot_product(embedding, embedding) = 0 THEN 1.0 ELSE 0.0 END) FROM embeddings)"
G_ZERO = gate("zero_vector_rate_max", ZERO, "0.02::DOUBLE", "<=")
SPARSE_ZERO = "(SELECT avg(CASE WHEN id IN (SELECT id FROM wrows) THEN 0.0 ELSE 1.0 END) FROM catalog)"


@query("gate_row_count_min", G_ROWS)
def gate_row_count_min(spark, sf):
    return Q.gate_row_count_min(A.films(spark, sf), LIMITS)


@query("gate_row_count_drift", G_DRIFT)
def gate_row_count_drift(spark, sf):
    return Q.gate_row_count_drift(A.films(spark, sf), daily(spark, sf), "2024-01-20", LIMITS)


@query("gate_null_rate", f"WITH {S.FILMS} {G_NULL}")
def gate_null_rate(spark, sf):
    return Q.gate_null_rate(A.films(spark, sf), LIMITS)


@query("gate_catalog_count_min", f"WITH {S.CATALOG} {G_CATALOG}")
def gate_catalog_count_min(spark, sf):
    return Q.gate_catalog_count_min(every_film(spark, sf), LIMITS)


@query("gate_duplicate_id_rate", G_DUP)
def gate_duplicate_id_rate(spark, sf):
    return Q.gate_duplicate_id_rate(A.table(spark, sf, "orders").withColumnRenamed("o_custkey", "id"), LIMITS)


NAN_CELLS = "(SELECT sum(len(list_filter(embedding, lambda x: x > 0.3))) / sum(len(embedding)) FROM embeddings)"


@query("gate_embedding_nan_rate", gate("embedding_nan_rate_max", NAN_CELLS, "0.0::DOUBLE", "<="))
def gate_embedding_nan_rate(spark, sf):
    """Large cells are turned into NaN, so there is something to find."""
    broken = F.transform("embedding", lambda x: F.when(x > 0.3, F.lit(float("nan"))).otherwise(x))
    rows = A.table(spark, sf, "embeddings").select(broken.alias("vec"))
    return Q.gate_embedding_nan_rate(rows, LIMITS)


ZEROED = "(SELECT avg(CASE WHEN label = 3 OR list_dot_product(embedding, embedding) = 0 THEN 1.0 ELSE 0.0 END) FROM embeddings)"


@query("gate_zero_vector_rate", gate("zero_vector_rate_max", ZEROED, "0.02::DOUBLE", "<="))
def gate_zero_vector_rate(spark, sf):
    """Vectors of one label are zeroed, so there is something to find."""
    zeroed = F.transform("embedding", lambda x: F.when(F.col("label") == 3, F.lit(0.0)).otherwise(x))
    rows = A.table(spark, sf, "embeddings").select(zeroed.alias("vec"))
    return Q.gate_zero_vector_rate(rows, LIMITS)


@query(
    "quality_report",
    f"""WITH {S.ROWS} {G_ROWS} UNION ALL {G_DRIFT} UNION ALL {G_NULL} UNION ALL {G_CATALOG}
    UNION ALL {gate('duplicate_id_rate_max', '0', '0.0::DOUBLE', '<=')}
    UNION ALL {gate('tfidf.embedding_nan_rate_max', '0', '0.0::DOUBLE', '<=')}
    UNION ALL {gate('tfidf.zero_vector_rate_max', SPARSE_ZERO, '0.02::DOUBLE', '<=')}
    UNION ALL {gate('word2vec.embedding_nan_rate_max', '0', '0.0::DOUBLE', '<=')}
    UNION ALL {gate('word2vec.zero_vector_rate_max', ZERO, '0.02::DOUBLE', '<=')}""",
)
def quality_report(spark, sf):
    """All gates of a run, written before the failing one stops it, read back."""
    raw = A.films(spark, sf)
    model, docs = fitted(spark, sf)
    # Read by several gates.
    model.rows = model.rows.persist()
    dense = A.dense_vectors(spark, sf)
    report = Q.quality_report(
        [
            Q.raw_gates(raw, daily(spark, sf), "2024-01-20", LIMITS),
            Q.gate_catalog_count_min(docs, LIMITS),
            Q.gate_duplicate_id_rate(docs, LIMITS),
            Q.named(Q.gate_sparse_nan_rate(model.rows, docs, model.vocab, LIMITS), "tfidf"),
            Q.named(Q.gate_sparse_zero_rate(model.rows, docs.select("id"), LIMITS), "tfidf"),
            Q.named(Q.gate_embedding_nan_rate(dense, LIMITS), "word2vec"),
            Q.named(Q.gate_zero_vector_rate(dense, LIMITS), "word2vec"),
        ]
    )
    store = RunStore(spark, scratch_path(spark, "quality"))
    try:
        Q.enforce(report, store, "2024-01-20")
    except Q.QualityGateFailed:
        pass
    return store.read("quality", "2024-01-20")
