"""Records, lookup, title search, sampling, profiling and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.evaluation import dense_edges
from checks.similarity import WORDS, K, corpus, word_model, word_table
from nearfold import adapters as A
from nearfold.operators import profile as P
from nearfold.operators import records as R
from nearfold.operators import sampling as Z
from nearfold.operators import search
from nearfold.scale import removed, scratch_path, shuffles_released, written
from nearfold.settings import with_changes
from nearfold.sources.store import RunStore

QUERIES = {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return keep


YEAR = """CASE WHEN regexp_matches(substring(release_date, 1, 4), '^[0-9]{1,4}$')
           THEN CAST(substring(release_date, 1, 4) AS INTEGER) END"""
SIMILAR = """string_agg(CAST(neighbour_id AS VARCHAR) || ':' || CAST(CAST(round(score, 4) AS DECIMAL(5, 4)) AS VARCHAR),
  ' ' ORDER BY rank)"""
SHOWN = f"""shown AS (SELECT id AS key, CAST(id AS VARCHAR) AS id, CASE WHEN trim(title) <> '' THEN title END AS title,
  {YEAR} AS year, vote_average AS rating, poster_path, genres FROM vfilms)"""


def vector_records(spark, sf):
    return R.assemble_records(A.vector_films(spark, sf), {"dense": dense_edges(spark, sf)})


@query(
    "assemble_records",
    f"""WITH {S.FILM_EDGES}, {S.VECTOR_FILMS}, {SHOWN},
    lists AS (SELECT movie_id, {SIMILAR} AS neighbours FROM dense_edges GROUP BY 1)
    SELECT id AS movie_id, title, year, rating AS vote_average, poster_path, genres, neighbours
    FROM shown LEFT JOIN lists ON movie_id = key""",
)
def assemble_records(spark, sf):
    entries = F.transform("similar_dense", lambda e: F.concat_ws(":", e["id"], e["score"].cast("string")))
    return vector_records(spark, sf).select(
        "movie_id",
        "title",
        "year",
        "vote_average",
        "poster_path",
        F.array_join("genres", "|").alias("genres"),
        F.array_join(entries, " ").alias("neighbours"),
    )


HYDRATED = f"""WITH {S.FILM_EDGES}, {S.VECTOR_FILMS}, {SHOWN},
    asked AS (SELECT CAST(movie_id AS VARCHAR) AS request, list_concat(
      list(CAST(neighbour_id AS VARCHAR) ORDER BY rank), ['none', CAST(movie_id AS VARCHAR), CAST(movie_id AS VARCHAR)]) AS ids
      FROM dense_edges GROUP BY movie_id),
    wanted AS (SELECT request, unnest(ids) AS movie_id, generate_subscripts(ids, 1) - 1 AS pos FROM asked)
    SELECT request, CAST(pos AS INTEGER) AS pos, movie_id, title, year FROM wanted JOIN shown ON id = movie_id"""


def neighbour_requests(spark, sf):
    """Neighbour lists with an unknown id and a repeated one at the end."""
    edges = dense_edges(spark, sf)
    own = F.col("movie_id").cast("string")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour_id").cast("string").alias("id"))))
    return edges.groupBy("movie_id").agg(listed.alias("l")).select(
        own.alias("request"), F.concat("l.id", F.array(F.lit("none"), own, own)).alias("ids")
    )


@query("hydrate_batch", HYDRATED)
def hydrate_batch(spark, sf):
    records = R.display_columns(A.vector_films(spark, sf)).drop("key")
    found = R.hydrate_batch(neighbour_requests(spark, sf), records)
    return found.select("request", "pos", "movie_id", "title", "year")


def served_in_loads(spark, records, bucket_rows=200):
    """The records as a served table that two loads made: first all without titles, then every third as it is."""
    from nearfold.sources.served import ServedTable

    served = ServedTable(spark, scratch_path(spark, "served"), bucket_rows=bucket_rows)
    later = F.pmod(F.xxhash64(F.lit(3), "movie_id"), F.lit(3)) == 0
    served.load(records.withColumn("title", F.when(~later, F.col("title"))), "first")
    served.load(records.where(later), "second")
    return served


@query("served_hydrate", HYDRATED)
def served_hydrate(spark, sf):
    """The same requests from a served table of two loads."""
    records = R.display_columns(A.vector_films(spark, sf)).drop("key")
    found = R.served_hydrate(neighbour_requests(spark, sf), served_in_loads(spark, records))
    return found.select("request", "pos", "movie_id", "title", "year")


LOOKED_UP = f"""WITH {S.FILM_EDGES}, {S.VECTOR_FILMS}, {SHOWN}, asked AS (SELECT DISTINCT doc_id FROM labels)
    SELECT CAST(movie_id AS VARCHAR) AS query_id, rank, id, title, year, rating, coalesce(genres, '') AS genres,
      CAST(CAST(round(score, 4) AS DECIMAL(5, 4)) AS VARCHAR) AS score
    FROM dense_edges JOIN shown ON key = neighbour_id WHERE rank <= 6 AND movie_id IN (SELECT doc_id FROM asked)"""


@query("similar_lookup", LOOKED_UP)
def similar_lookup(spark, sf):
    """Neighbours of every labelled film; ids without a record give nothing."""
    return shown(R.similar_lookup(labelled(spark, sf), vector_records(spark, sf), "dense", 6))


@query("served_similar", LOOKED_UP)
def served_similar(spark, sf):
    """The same from a served table of two loads."""
    return shown(R.served_similar(labelled(spark, sf), served_in_loads(spark, vector_records(spark, sf)), "dense", 6))


def labelled(spark, sf):
    return A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("movie_id"))


def shown(found):
    return found.select(
        "query_id",
        "rank",
        "id",
        "title",
        "year",
        "rating",
        F.array_join("genres", "|").alias("genres"),
        F.col("score").cast("string").alias("score"),
    )


# Names with their words swapped, five-letter heads, and part types.
ASKED = """asked AS (SELECT DISTINCT q AS query FROM (
  SELECT ' ' || upper(split_part(p_name, ' ', 2)) || '  ' || split_part(p_name, ' ', 1) AS q FROM part
  UNION ALL SELECT substring(p_name, 1, 5) FROM part
  UNION ALL SELECT upper(p_name) FROM part WHERE p_size < 25
  UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT 'x'
  UNION ALL SELECT substring(p_name, 2, 1) || substring(p_name, 1, 1) || substring(p_name, 3, 2) FROM part
  UNION ALL SELECT substring(p_name, 1, 2) || substring(p_name, 4, 1) FROM part))"""


def asked(spark, sf):
    part = A.table(spark, sf, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    parts = [
        part.select(F.concat(F.lit(" "), F.upper(second), F.lit("  "), first).alias("query")),
        part.select(F.substring("p_name", 1, 5).alias("query")),
        part.where(F.col("p_size") < 25).select(F.upper("p_name").alias("query")),
        part.select(F.lower("p_type").alias("query")),
        part.select(F.lit("x").alias("query")),
        # Misspelt heads: two letters exchanged, one left out.
        part.select(F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.substring("p_name", 3, 2)).alias("query")),
        part.select(F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1)).alias("query")),
    ]
    return Z.union_samples(parts).distinct()


TITLES = "titles AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size + 1950 AS INTEGER) AS year, p_partkey AS position FROM part)"
EXACT = f"""{ASKED}, {TITLES},
keyed AS (SELECT query, {S.clean('lower(query)')} AS key FROM asked),
exact AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY year DESC NULLS LAST, position) AS place
  FROM keyed JOIN titles ON key = {S.clean('lower(title)')} WHERE key <> '')"""


@query(
    "title_exact_match",
    f"WITH {EXACT} SELECT query, id, title, year, CAST(place AS INTEGER) AS rank FROM exact WHERE place <= 10",
)
def title_exact_match(spark, sf):
    found = search.title_exact_match(asked(spark, sf), A.titles(spark, sf), 10)
    return found.select("query", "id", "title", "year", "rank")


@query(
    "newest_first",
    """SELECT p_name, p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_name ORDER BY
      CASE WHEN p_size > 5 THEN p_size END DESC NULLS LAST, p_partkey) AS INTEGER) AS rank FROM part""",
)
def newest_first(spark, sf):
    from pyspark.sql.window import Window

    part = A.table(spark, sf, "part").select(
        "p_name",
        "p_partkey",
        "p_size",
        F.when(F.col("p_size") > 5, F.col("p_size")).alias("year"),
        F.col("p_partkey").alias("position"),
    )
    order = Window.partitionBy("p_name").orderBy(*search.newest_first())
    return part.withColumn("rank", F.row_number().over(order)).drop("year", "position")


SIM = "((1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)) * 100)"


def window(a, b):
    s = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END"
    g = f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    return (
        f"list_max(list_transform(range(1, length({g}) - length({s}) + 2), lambda i: "
        f"(1 - levenshtein({s}, substring({g}, i, length({s}))) / greatest(length({s}), 1)) * 100))"
    )


FUZZY = f"""{EXACT},
q AS (SELECT query, key, trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS text FROM keyed WHERE length(key) >= 2),
t AS (SELECT DISTINCT trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS tt,
  length({S.clean('lower(title)')}) AS len FROM titles),
met AS (SELECT query, key, text, tt, len, array_to_string(list_sort(string_split(text, ' ')), ' ') AS sq,
    array_to_string(list_sort(string_split(tt, ' ')), ' ') AS st,
    list_sort(list_intersect(string_split(text, ' '), string_split(tt, ' '))) AS common_words,
    list_sort(list_distinct(list_filter(string_split(text, ' '), lambda w: NOT list_contains(string_split(tt, ' '), w)))) AS own_q,
    list_sort(list_distinct(list_filter(string_split(tt, ' '), lambda w: NOT list_contains(string_split(text, ' '), w)))) AS own_t,
    greatest(length(text), length(tt)) / greatest(least(length(text), length(tt)), 1) AS ratio
  FROM q, t WHERE len >= length(key) * 0.4::DOUBLE),
words AS (SELECT *, array_to_string(common_words, ' ') AS s0,
    trim(array_to_string(common_words, ' ') || ' ' || array_to_string(own_q, ' ')) AS s1,
    trim(array_to_string(common_words, ' ') || ' ' || array_to_string(own_t, ' ')) AS s2 FROM met),
scored AS (SELECT query, tt, len, CASE WHEN least(length(text), length(tt)) = 0 THEN 0.0 ELSE round(CASE WHEN ratio < 1.5
    THEN greatest({SIM.format('text', 'tt')}, {SIM.format('sq', 'st')} * 0.95::DOUBLE, {SIM.format('s1', 's2')} * 0.95::DOUBLE,
      CASE WHEN len(common_words) > 0 THEN greatest({SIM.format('s0', 's1')}, {SIM.format('s0', 's2')}) * 0.95::DOUBLE ELSE 0.0 END)
    ELSE greatest({SIM.format('text', 'tt')}, {window('text', 'tt')} * (CASE WHEN ratio < 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END),
      {window('sq', 'st')} * (CASE WHEN ratio < 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) * 0.95::DOUBLE,
      CASE WHEN len(common_words) > 0 THEN 100 * (CASE WHEN ratio < 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) * 0.95::DOUBLE ELSE 0.0 END) END, 6) END AS score FROM words),
every AS (SELECT query, id, title, year, 0 AS tier, 100.0::DOUBLE AS score, place FROM exact
  UNION ALL SELECT s.query, x.id, x.title, x.year, 1, s.score, x.position FROM scored s JOIN titles x
    ON trim(regexp_replace(lower(x.title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) = s.tt
    AND length({S.clean('lower(x.title)')}) = s.len
    WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query = s.query AND e.id = x.id))"""


@query(
    "title_fuzzy_match",
    f"""WITH {FUZZY} SELECT query, CAST(rank AS INTEGER) AS rank, id, title, year, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, place) AS rank FROM every)
    WHERE rank <= 10""",
)
def title_fuzzy_match(spark, sf):
    return search.title_search(asked(spark, sf), A.titles(spark, sf), 10)


@query(
    "top_voted",
    "SELECT doc_id AS id, n_chars AS vote_count FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100",
)
def top_voted(spark, sf):
    return Z.top_voted(A.films(spark, sf), 100).select("id", "vote_count")


def bin_sql(table: str, column: str, key: str) -> str:
    probs = ", ".join(f"{i / 10}" for i in range(11))
    return f"""edges AS (SELECT list_distinct(e) AS e FROM (
      SELECT quantile_cont(CAST({column} AS DOUBLE), [{probs}]) AS e FROM {table})),
    binned AS (SELECT {key} AS id, greatest(len(list_filter(e, lambda x: x < {column})), 1) AS bin FROM {table}, edges)"""


@query(
    "quantile_bins",
    f"""WITH {bin_sql('lineitem', 'l_quantity', "l_orderkey || '-' || l_linenumber")}
    SELECT id, CAST(bin AS INTEGER) AS bin FROM binned""",
)
def quantile_bins(spark, sf):
    items = A.table(spark, sf, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return Z.quantile_bins(items.select(key.alias("id"), "l_quantity"), "l_quantity").select("id", "bin")


@query(
    "stratified_sample",
    f"""WITH {bin_sql('orders', 'o_totalprice', 'o_orderkey')},
    shares AS (SELECT bin, least(round_even(count(*) / sum(count(*)) OVER () * 777, 0), count(*)) AS wanted FROM binned GROUP BY bin),
    part AS (SELECT id, bin, 0 AS late FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {S.seeded(42, 'id')}, id) AS n
      FROM binned) JOIN shares USING (bin) WHERE n <= wanted),
    rest AS (SELECT id, bin, 1 AS late FROM binned WHERE id NOT IN (SELECT id FROM part)
      ORDER BY {S.seeded(43, 'id')}, id LIMIT 777)
    SELECT id, CAST(bin AS INTEGER) AS bin FROM (SELECT * FROM part UNION ALL SELECT * FROM rest)
    ORDER BY late, {S.seeded(44, 'id')}, id LIMIT 777""",
)
def stratified_sample(spark, sf):
    orders = A.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return Z.stratified_sample(orders, "o_totalprice", 777, 42)


@query(
    "union_samples",
    f"""SELECT * FROM (SELECT o_orderkey AS id, 'F' AS part FROM orders WHERE o_orderstatus = 'F' ORDER BY {S.seeded(1, 'id')}, id LIMIT 50)
    UNION ALL SELECT * FROM (SELECT o_orderkey AS id, 'O' AS part FROM orders WHERE o_orderstatus = 'O' ORDER BY {S.seeded(1, 'id')}, id LIMIT 50)""",
)
def union_samples(spark, sf):
    from nearfold.operators.evaluate import seeded_order

    orders = A.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return Z.union_samples(
        [
            orders.where(F.col("o_orderstatus") == part)
            .orderBy(*seeded_order(1))
            .limit(50)
            .select("id", F.lit(part).alias("part"))
            for part in ("F", "O")
        ]
    )


@query(
    "anti_remainder",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def anti_remainder(spark, sf):
    taken = A.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    customer = A.table(spark, sf, "customer").select("c_custkey", "c_name")
    return Z.anti_remainder(customer, taken.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


NULLABLE = ["title", "tagline", "release_date", "status", "poster_path"]


@query(
    "profile_null_rates",
    f"WITH {S.FILMS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INT)), 6) AS null_rate FROM films"
        for c in NULLABLE
    ),
)
def profile_null_rates(spark, sf):
    rates = P.null_rates(A.films(spark, sf), NULLABLE)
    return rates.select("column", F.round("null_rate", 6).alias("null_rate"))


@query(
    "profile_thresholds",
    " UNION ALL ".join(
        f"SELECT CAST({t} AS BIGINT) AS threshold, count(*) FILTER (n_chars >= {t}) AS n FROM documents"
        for t in (0, 5, 10, 50, 100)
    ),
)
def profile_thresholds(spark, sf):
    counts = P.threshold_counts(A.films(spark, sf), "vote_count", [0, 5, 10, 50, 100])
    return counts.select(F.col("threshold").cast("bigint").alias("threshold"), "n")


RULES = {
    "votes": "vote_count >= 10",
    "status": "coalesce(status IN ('Released'), false)",
    "adult": "NOT coalesce(adult, false)",
    "overview": f"length({S.clean('overview')}) >= 40",
}


@query(
    "profile_filters",
    f"WITH {S.FILMS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER ({rule}) AS n FROM films"
        for name, rule in {**RULES, "all": " AND ".join(RULES.values())}.items()
    ),
)
def profile_filters(spark, sf):
    return P.filter_counts(A.films(spark, sf))


@query(
    "profile_label_coverage",
    f"WITH {S.FILMS} "
    + " UNION ALL ".join(
        f"SELECT CAST({t} AS BIGINT) AS threshold, count(*) AS n, "
        f"round(avg(CAST(poster_path IS NOT NULL AS INT)), 6) AS coverage FROM films WHERE vote_count >= {t}"
        for t in (10, 50)
    ),
)
def profile_label_coverage(spark, sf):
    found = P.label_coverage(A.films(spark, sf), "poster_path", "vote_count", [10, 50])
    return found.select(
        F.col("threshold").cast("bigint").alias("threshold"), "n", F.round("coverage", 6).alias("coverage")
    )


@query(
    "distinct_label_vocabulary",
    "SELECT count(*) AS n_labels FROM (SELECT lang AS l FROM documents UNION SELECT source FROM documents)",
)
def distinct_label_vocabulary(spark, sf):
    return P.distinct_labels(A.films(spark, sf), "keywords")


@query(
    "random_pair_jaccard",
    f"""WITH pool AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS at,
        list_distinct([lang, source]) AS l FROM documents WHERE n_chars >= 50),
    n AS (SELECT count(*) AS n FROM pool),
    pairs AS (SELECT p, {S.draw(42, 'p', "'0'", 'n')} AS i, {S.draw(42, 'p', "'1'", 'n - 1')} AS j FROM range(1000) r(p), n)
    SELECT count(*) AS n_pairs, round(avg(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))), 6) AS mean_jaccard
    FROM pairs JOIN pool a ON a.at = i JOIN pool b ON b.at = CASE WHEN j >= i THEN j + 1 ELSE j END""",
)
def random_pair_jaccard(spark, sf):
    found = P.random_pair_jaccard(A.films(spark, sf), "keywords", 1000, 42, votes="vote_count")
    return found.select("n_pairs", F.round("mean_jaccard", 6).alias("mean_jaccard"))


def job_settings():
    return with_changes(
        {
            "catalog": A.EVERY_DOCUMENT,
            "quality": {
                "row_count_min": 100,
                "catalog_count_min": 100,
                "row_count_drift_pct": 60,
                "null_rate_max": {"title": 0.001, "overview": 0.6},
            },
        },
    )


def published(spark, sf, run_date="2026-01-01"):
    from nearfold.plans.publish import publish_run

    with shuffles_released(spark):
        docs, path = written(corpus(spark, sf), "corpus")
        words, n = word_table(spark, sf, docs)
        # The words are numbered by now, and no longer read from texts.
        words, word_path = written(words, "words")
        removed(spark, path)
    store = RunStore(spark, scratch_path(spark, "publish"))
    try:
        metrics = publish_run(
            A.films(spark, sf), words, store, run_date, job_settings(), S.STOP, A.DOCUMENT_FIELDS, n
        )
    finally:
        removed(spark, word_path)
    return store, metrics


@query("publish_run")
def publish_run(spark, sf):
    """Raw films to served records; the metric rows of the run."""
    return published(spark, sf)[1].select("method", "keyword_jaccard_at_k", "genre_precision_at_k")


@query("rollback_run")
def rollback_run(spark, sf):
    """Publish, then serve the same run again; counts of the reloaded records."""
    from nearfold.plans.rollback import rollback_run as job

    store, _ = published(spark, sf)
    return job(store, "2026-01-01", job_settings())


@query(
    "compare_methods",
    f"""WITH {WORDS} SELECT 'tfidf' AS method, (SELECT count(*) FROM catalog) AS catalog_size, CAST(NULL AS DOUBLE) AS oov_rate
    UNION ALL SELECT 'word2vec', (SELECT count(*) FROM catalog), round(sum(CASE WHEN v IS NULL THEN tf ELSE 0 END) / sum(tf), 6)
    FROM word_counts LEFT JOIN words USING (term)""",
)
def compare_methods(spark, sf):
    """Both embedders over one catalog, word vectors weighted by the first's IDF."""
    from nearfold.operators.tfidf import TfidfEmbedder
    from nearfold.plans.compare import compare_methods as job
    from nearfold.plans.compare import word_vectors_after_tfidf

    _, docs, words, n = word_model(spark, sf)
    store = RunStore(spark, scratch_path(spark, "compare"))
    methods = [TfidfEmbedder(stop_words=S.STOP), word_vectors_after_tfidf(words, n)]
    table = job(methods, docs, store, "2026-01-01", K)
    return table.select("method", "catalog_size", F.round("oov_rate", 6).alias("oov_rate"))
