"""TF-IDF, document vectors and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.sources_and_text import every_film
from nearfold import adapters as A
from nearfold.operators import catalog as C
from nearfold.operators import dense_knn, sparse_knn, tfidf, vectors
from nearfold.scale import scratch_path, with_offsets
from nearfold.settings import DEFAULTS
from nearfold.sources.store import RunStore

QUERIES = {}
K = DEFAULTS["index"]["k"]
CAP = DEFAULTS["tfidf"]["max_features"]


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return keep


def corpus(spark, sf):
    return every_film(spark, sf).select("id", "document")


def fitted(spark, sf):
    docs = corpus(spark, sf).persist()
    return tfidf.TfidfEmbedder(stop_words=S.STOP).fit(docs, clustered=True), docs


def places(c, n=6):
    return F.round(c, n).alias(c)


@query("term_doc_freq", f"WITH {S.VOCAB} SELECT term, df, cf FROM freq")
def term_doc_freq(spark, sf):
    return tfidf.term_doc_freq(tfidf.term_counts(corpus(spark, sf), S.STOP, clustered=True, unique=True))


@query("vocabulary", f"WITH {S.VOCAB} SELECT term, CAST(term_no AS INTEGER) AS term_no, df, cf FROM vocab")
def vocabulary(spark, sf):
    return fitted(spark, sf)[0].vocab.select("term", "term_no", "df", "cf")


@query("smoothed_idf", f"WITH {S.VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab")
def smoothed_idf(spark, sf):
    return fitted(spark, sf)[0].vocab.select("term", places("idf"))


@query("tfidf_rows", f"WITH {S.ROWS} SELECT id, term, round(w, 6) AS weight FROM wrows")
def tfidf_rows(spark, sf):
    model, _ = fitted(spark, sf)
    return tfidf.unpack_rows(model.rows, model.vocab, CAP).select("id", "term", places("weight"))


@query(
    "tfidf_transform",
    f"""WITH {S.VOCAB},
    new_tokens AS (SELECT item_id AS id, list_filter(regexp_extract_all(lower(text), '{S.TOKEN}'),
      lambda t: NOT list_contains({S.STOP_LIST}, t)) AS t FROM benchmark),
    new_grams AS (SELECT id, unnest(t) AS term FROM new_tokens UNION ALL
      SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM new_tokens),
    new_counts AS (SELECT id, term, count(*) AS tf FROM new_grams GROUP BY ALL),
    new_raw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM new_counts JOIN vocab USING (term)),
    new_norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM new_raw GROUP BY id)
    SELECT r.id, r.term, round(r.w / n.norm, 6) AS weight FROM new_raw r JOIN new_norms n ON r.id = n.id""",
)
def tfidf_transform(spark, sf):
    """Text of another table under a saved and loaded model."""
    model, _ = fitted(spark, sf)
    store = RunStore(spark, scratch_path(spark, "model"))
    model.save(store, "2026-01-01")
    loaded = tfidf.TfidfEmbedder.load(store, "2026-01-01", stop_words=S.STOP)
    new = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("document"))
    return tfidf.unpack_rows(loaded.transform(new), loaded.vocab, CAP).select("id", "term", places("weight"))


@query(
    "unigram_idf",
    f"WITH {S.VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab WHERE term NOT LIKE '% %'",
)
def unigram_idf(spark, sf):
    idf = tfidf.unigram_idf(fitted(spark, sf)[0].vocab)
    return tfidf.checked_unigram_idf(idf).select("term", places("idf"))


@query(
    "median_idf",
    f"WITH {S.VOCAB} SELECT round(median(idf), 6) AS median_idf FROM vocab WHERE term NOT LIKE '% %'",
)
def median_idf(spark, sf):
    idf = tfidf.unigram_idf(fitted(spark, sf)[0].vocab)
    return tfidf.median_idf(idf).select(places("median_idf"))


# Word vectors: the r-th most frequent word takes the embedding of that number,
# so words past the table are out of vocabulary. Words are the corpus' own, so
# frequent ones without a weight of their own occur too.
WORDS = S.VOCAB + """,
ranked AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) - 1 AS r FROM freq WHERE term NOT LIKE '% %'),
words AS (SELECT term, CAST(embedding AS DOUBLE[]) AS v FROM ranked JOIN embeddings ON vec_id = r),
word_counts AS (SELECT id, term, tf FROM counts WHERE term NOT LIKE '% %'),
uni AS (SELECT term, idf FROM vocab WHERE term NOT LIKE '% %'),
med AS (SELECT median(idf) AS m FROM uni)"""


def word_counts(docs):
    """(id, term, tf) of single words; `docs` are as `prepare` leaves them, cached or not."""
    return tfidf.term_counts(docs, S.STOP, 1, clustered=True, unique=True)


def word_table(spark, sf, docs):
    """(token, vec): words numbered by frequency, joined to the embeddings."""
    freq = tfidf.term_doc_freq(word_counts(docs))
    ordered = freq.select((-F.col("cf")).alias("order"), F.col("term").alias("token"))
    numbered = with_offsets(ordered, ["order", "token"], name="id")
    vectors_ = A.dense_vectors(spark, sf)
    return numbered.join(vectors_, "id").select("token", "vec"), vectors_.count()


def word_model(spark, sf):
    model, docs = fitted(spark, sf)
    words, n = word_table(spark, sf, docs)
    return model, docs, words.persist(), n


@query(
    "tokens_x_idf",
    f"""WITH {WORDS} SELECT id, term, tf, round(coalesce(idf, m), 6) AS idf
    FROM word_counts LEFT JOIN uni USING (term), med""",
)
def tokens_x_idf(spark, sf):
    model, docs = fitted(spark, sf)
    counts = word_counts(docs)
    idf = tfidf.unigram_idf(model.vocab)
    return vectors.tokens_x_idf(counts, idf, CAP).select("id", "term", "tf", places("idf"))


@query(
    "tokens_x_vectors",
    f"""WITH {WORDS} SELECT id, term, tf, round(v[1], 6) AS first, len(v) AS width
    FROM word_counts JOIN words USING (term)""",
)
def tokens_x_vectors(spark, sf):
    _, docs, words, n = word_model(spark, sf)
    joined = vectors.tokens_x_vectors(word_counts(docs), words, n)
    return joined.select(
        "id",
        "term",
        "tf",
        F.round(F.get("vec", F.lit(0)), 6).alias("first"),
        F.size("vec").cast("bigint").alias("width"),
    )


DOC_VECTORS = WORDS + """,
weighed AS (SELECT id, tf * coalesce(idf, m) AS w, v
  FROM word_counts JOIN words USING (term) LEFT JOIN uni USING (term), med),
cells AS (SELECT id, w, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM weighed),
means AS (SELECT id, d, sum(w * x) / sum(w) AS x FROM cells GROUP BY id, d),
lengths AS (SELECT id, sqrt(sum(x * x)) AS len FROM means GROUP BY id),
dims AS (SELECT unnest(range(1, 65)) AS d),
doc_cells AS (SELECT c.id, dims.d, coalesce(m.x / nullif(l.len, 0), 0) AS x FROM catalog c CROSS JOIN dims
  LEFT JOIN means m ON m.id = c.id AND m.d = dims.d LEFT JOIN lengths l ON l.id = c.id)"""


@query("doc_vectors", f"WITH {DOC_VECTORS} SELECT id, d AS dim, round(x, 6) + 0.0 AS x FROM doc_cells")
def doc_vectors(spark, sf):
    model, docs, words, n = word_model(spark, sf)
    embedder = vectors.WordVectorEmbedder(tfidf.unigram_idf(model.vocab), words, S.STOP, n, CAP)
    rows = embedder.transform(docs, clustered=True).select("id", F.posexplode("vec").alias("pos", "x"))
    # Adding zero turns a negative zero into a plain one.
    return rows.select(
        "id", (F.col("pos") + 1).cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("x")
    )


@query(
    "coverage_stats",
    f"""WITH {WORDS} SELECT
      round(sum(CASE WHEN v IS NULL THEN tf ELSE 0 END) / sum(tf), 6) AS oov_rate,
      round(sum(CASE WHEN v IS NOT NULL AND idf IS NULL THEN tf ELSE 0 END)
            / sum(CASE WHEN v IS NOT NULL THEN tf ELSE 0 END), 6) AS median_idf_fallback_rate
    FROM word_counts LEFT JOIN words USING (term) LEFT JOIN uni USING (term)""",
)
def coverage_stats(spark, sf):
    model, docs, words, n = word_model(spark, sf)
    counts = word_counts(docs)
    stats = vectors.coverage_stats(counts, words, tfidf.unigram_idf(model.vocab), n, CAP)
    return stats.select(places("oov_rate"), places("median_idf_fallback_rate"))


EDGE = "movie_id, rank, neighbour_id, score"


@query(
    "knn_sparse_cosine",
    f"""WITH {S.SPARSE_PAIRS} SELECT a AS movie_id, CAST(rank AS INTEGER) AS rank, b AS neighbour_id, s AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM listed) WHERE rank <= {K}""",
)
def knn_sparse_cosine(spark, sf):
    model, _ = fitted(spark, sf)
    return sparse_knn.knn_sparse(model.rows, model.ids, K, pad=False)


@query("knn_pad_to_k", f"WITH {S.SPARSE_EDGES} SELECT {EDGE} FROM tfidf_edges")
def knn_pad_to_k(spark, sf):
    return fitted(spark, sf)[0].neighbours(K)


@query("knn_dense_cosine", f"WITH {S.DENSE_EDGES} SELECT {EDGE} FROM dense_edges")
def knn_dense_cosine(spark, sf):
    return dense_knn.knn_dense(A.dense_vectors(spark, sf), K)


@query(
    "top_k_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10""",
)
def top_k_per_group(spark, sf):
    items = A.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return C.top_k_per_group(items, "l_suppkey", K, order)


@query(
    "dedup_keep_max",
    """SELECT o_custkey AS id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
      PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def dedup_keep_max(spark, sf):
    orders = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    return C.dedup_keep_max(orders, "id", "o_totalprice", [-F.col("o_orderkey")])
