"""Retrieval metrics of neighbour edges against held-out labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.labels import jaccard, label_set, shares_label
from nearfold.functions.values import finite_or_null
from nearfold.scale import bounded_broadcast, exact_quantiles, skewed_join, with_offsets
from nearfold.settings import DEFAULTS

RANDOM_METHOD = "random"
# A query without labels is left out; a neighbour without labels scores 0.
EMPTY_LABEL_RULE = "skip"

METRIC_COLUMNS = {
    "method": "string",
    "keyword_jaccard_at_k": "double",
    "genre_precision_at_k": "double",
    "latency_p50_ms": "double",
    "latency_p95_ms": "double",
    "fit_seconds": "double",
    "artifact_mb": "double",
}
COMPARISON_COLUMNS = {
    "method": "string",
    "catalog_size": "bigint",
    "fit_seconds": "double",
    "peak_rss_mb": "double",
    "artifact_mb": "double",
    "oov_rate": "double",
    "median_idf_fallback_rate": "double",
}

PairScore = Callable[[Column, Column], Column]


def draw(seed: int, key: Column, turn: Column | int, below: Column) -> Column:
    """A number in [0, below) fixed by seed, key and turn."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), turn.cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return number % below


def seeded_order(seed: int, key: str = "id") -> list[Column]:
    """A shuffled order that depends on the seed and the keys alone."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def sample_queries(
    catalog: DataFrame, n: int, min_vote_count: int, seed: int
) -> DataFrame:
    """(id): min(n, eligible) ids drawn without regard to row order."""
    eligible = catalog.where(F.col("vote_count") >= min_vote_count).select("id")
    return eligible.orderBy(*seeded_order(seed)).limit(n)


def random_baseline(queries: DataFrame, ids: DataFrame, k: int, seed: int) -> DataFrame:
    """(movie_id, rank, neighbour_id): k distinct random ids per query, never itself.

    Ids are numbered 0..n-1 and each query draws k distinct numbers of the n-1
    others (Floyd's sampling, one draw per slot), so nothing is compared with
    the whole catalog.
    """
    numbered = with_offsets(ids.select("id"), ["id"], name="at")
    n_others = numbered.select(F.count(F.lit(1)) - 1).scalar()
    others = F.col("others")

    def add(picked: Column, slot: Column) -> Column:
        top = others - k + slot
        pick = draw(seed, F.col("id"), slot, top + 1)
        return F.array_append(picked, F.when(F.array_contains(picked, pick), top).otherwise(pick))

    slots = F.sequence(F.lit(0), F.lit(k - 1))
    picks = F.aggregate(slots, F.array().cast("array<bigint>"), add)
    drawn = (
        queries.select("id")
        .join(numbered, "id")
        .withColumn("others", n_others)
        .select("id", F.col("at").alias("own"), F.posexplode(picks).alias("slot", "pick"))
        .select(
            F.col("id").alias("movie_id"),
            (F.col("slot") + 1).cast("int").alias("rank"),
            # Step over the query's own number.
            F.when(F.col("pick") >= F.col("own"), F.col("pick") + 1)
            .otherwise(F.col("pick"))
            .alias("at"),
        )
    )
    named = numbered.select("at", F.col("id").alias("neighbour_id"))
    return drawn.join(named, "at").select("movie_id", "rank", "neighbour_id")


def edges_x_labels(
    edges: DataFrame, labels: DataFrame, queries: DataFrame, n_queries: int | None = None
) -> DataFrame:
    """(movie_id, neighbour_id, query_labels, labels): edges of the queries that
    have labels; a neighbour without labels has an empty array."""
    own = labels.join(queries.select("id"), "id", "left_semi").where(F.size("labels") > 0)
    own = own.select(F.col("id").alias("movie_id"), F.col("labels").alias("query_labels"))
    if n_queries is not None:
        own = bounded_broadcast(own, n_queries)
    theirs = labels.select(F.col("id").alias("neighbour_id"), "labels")
    asked = edges.select("movie_id", "neighbour_id").join(own, "movie_id")
    # A film may be a neighbour of very many others.
    return (
        skewed_join(asked, theirs, "neighbour_id", "left")
        .withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
        .select("movie_id", "neighbour_id", "query_labels", "labels")
    )


def mean_label_score(
    edges: DataFrame,
    labels: DataFrame,
    queries: DataFrame,
    pair_score: PairScore,
    n_queries: int | None = None,
) -> DataFrame:
    """One row (score, n_scored): mean over queries of the mean pair score."""
    pairs = edges_x_labels(edges, labels, queries, n_queries)
    per_query = pairs.groupBy("movie_id").agg(
        F.avg(pair_score(F.col("query_labels"), F.col("labels"))).alias("score")
    )
    return per_query.agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_scored"))


def label_table(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.select("id", label_set(F.col(column)).alias("labels"))


def keyword_jaccard_at_k(edges, catalog, queries, n_queries=None) -> DataFrame:
    """Main metric. Keywords are never part of the document text."""
    return mean_label_score(edges, label_table(catalog, "keywords"), queries, jaccard, n_queries)


def genre_precision_at_k(edges, catalog, queries, n_queries=None) -> DataFrame:
    """Share of neighbours with at least one genre of the query."""
    return mean_label_score(edges, label_table(catalog, "genres"), queries, shares_label, n_queries)


def run_mismatches(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(problem, id): query ids not in the catalog, catalog ids without edges, and
    neighbours not in the catalog. Empty when the run fits the catalog."""
    ids = catalog.select("id")
    asked = edges.select(F.col("movie_id").alias("id")).distinct()
    named = edges.select(F.col("neighbour_id").alias("id")).distinct()

    def missing(a: DataFrame, b: DataFrame, problem: str) -> DataFrame:
        return a.join(b, "id", "left_anti").select(F.lit(problem).alias("problem"), "id")

    return (
        missing(asked, ids, "query not in catalog")
        .unionByName(missing(ids, asked, "catalog id without edges"))
        .unionByName(missing(named, ids, "neighbour not in catalog"))
    )


def check_run(edges: DataFrame, catalog: DataFrame, method: str) -> None:
    first = run_mismatches(edges, catalog).first()
    if first is not None:
        raise ValueError(f"{method} edges were built from another catalog: {first.problem} {first.id}")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(movie_id, neighbours): neighbour ids in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "neighbour_id")))
    return (
        edges.groupBy("movie_id")
        .agg(pairs.alias("p"))
        .select("movie_id", F.col("p.neighbour_id").alias("neighbours"))
    )


def latency_percentiles(timings: DataFrame, column: str, unit_per_ms: float = 1.0) -> DataFrame:
    """One row (p50_ms, p95_ms), linearly interpolated."""
    q = exact_quantiles(timings, column, [0.5, 0.95])
    return q.select(
        (F.get("quantiles", F.lit(0)) / unit_per_ms).alias("p50_ms"),
        (F.get("quantiles", F.lit(1)) / unit_per_ms).alias("p95_ms"),
    )


def comparison_table(rows: list[DataFrame], columns: dict[str, str] | None = None) -> DataFrame:
    """One row per method with every column; cells without a finite value are null."""
    columns = columns or COMPARISON_COLUMNS
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more, allowMissingColumns=True)
    cells = []
    for name, kind in columns.items():
        cell = F.col(name).cast(kind) if name in table.columns else F.lit(None).cast(kind)
        cells.append((finite_or_null(cell) if kind == "double" else cell).alias(name))
    return table.select(*cells)


def check_methods(names: list[str]) -> None:
    for name in names:
        if names.count(name) > 1:
            raise ValueError(f"duplicate method name {name!r}")


def score_run(
    catalog: DataFrame,
    edges_by_method: dict[str, DataFrame],
    k: int,
    settings: dict | None = None,
    costs: DataFrame | None = None,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Score each method and a random baseline. Edges are read several times:
    pass stored or cached ones.

    Returns (rows, summary): one row per method with METRIC_COLUMNS, and one row
    of run-level counts. `costs` holds (method, fit_seconds, artifact_mb, ...).
    """
    s = settings or DEFAULTS["eval"]
    if check:
        for method, edges in edges_by_method.items():
            check_run(edges, catalog, method)
    queries = sample_queries(catalog, s["n_queries"], s["query_min_vote_count"], s["seed"])
    queries = queries.persist()
    scored = dict(edges_by_method)
    scored[RANDOM_METHOD] = random_baseline(queries, catalog, k, s["seed"])
    table = score_methods(scored, catalog, queries, k, s["n_queries"])
    # One row per method.
    table = table.persist()
    if costs is not None:
        table = table.join(F.broadcast(costs), "method", "left")
    rows = comparison_table([table], METRIC_COLUMNS)
    counts = queries.agg(F.count(F.lit(1)).alias("n_queries"))
    summary = table.agg(
        F.max("n_keyword_queries").alias("n_keyword_queries"),
        F.max("n_genre_queries").alias("n_genre_queries"),
    ).select(
        catalog.select(F.countDistinct("id")).scalar().alias("catalog_size"),
        F.lit(k).alias("k"),
        F.lit(s["seed"]).alias("seed"),
        F.lit(s["query_min_vote_count"]).alias("query_min_vote_count"),
        F.lit(s["n_queries"]).alias("n_queries_target"),
        counts.scalar().alias("n_queries"),
        "n_keyword_queries",
        "n_genre_queries",
        F.lit(EMPTY_LABEL_RULE).alias("empty_label_rule"),
    )
    return rows, summary.withColumn(
        "warning",
        F.when(
            F.col("n_queries") < F.col("n_queries_target"),
            F.concat(F.lit("only "), F.col("n_queries"), F.lit(" eligible queries")),
        ),
    )


def score_methods(
    edges_by_method: dict[str, DataFrame],
    catalog: DataFrame,
    queries: DataFrame,
    k: int,
    n_queries: int,
) -> DataFrame:
    """(method, both metrics, queries scored by each): every method and both
    label columns in one pass over the edges and one over the catalog."""
    asked = bounded_broadcast(queries.select(F.col("id").alias("movie_id")), n_queries)
    edges = None
    for method, rows in edges_by_method.items():
        part = rows.select(F.lit(method).alias("method"), "movie_id", "neighbour_id")
        part = part.join(asked, "movie_id", "left_semi")
        edges = part if edges is None else edges.unionByName(part)
    # At most k edges per method and query, so these ids are few.
    named = edges.select(F.col("neighbour_id").alias("id")).unionByName(queries.select("id")).distinct()
    named = bounded_broadcast(named, n_queries * (k * len(edges_by_method) + 1))
    labels = catalog.join(named, "id", "left_semi").select(
        "id", label_set(F.col("keywords")).alias("keywords"), label_set(F.col("genres")).alias("genres")
    )
    own = labels.toDF("movie_id", "own_keywords", "own_genres")
    theirs = labels.toDF("neighbour_id", "keywords", "genres")
    none = F.array().cast("array<string>")
    keyword = jaccard(F.col("own_keywords"), F.coalesce("keywords", none))
    genre = shares_label(F.col("own_genres"), F.coalesce("genres", none))
    per_query = (
        edges.join(own, "movie_id")
        .join(theirs, "neighbour_id", "left")
        .groupBy("method", "movie_id")
        .agg(
            F.avg(F.when(F.size("own_keywords") > 0, keyword)).alias("keyword"),
            F.avg(F.when(F.size("own_genres") > 0, genre)).alias("genre"),
        )
    )
    return per_query.groupBy("method").agg(
        F.avg("keyword").alias("keyword_jaccard_at_k"),
        F.count("keyword").alias("n_keyword_queries"),
        F.avg("genre").alias("genre_precision_at_k"),
        F.count("genre").alias("n_genre_queries"),
    )


def latest_common_run(runs: DataFrame, methods: list[str], sample: bool) -> DataFrame:
    """One row (run_date): the latest run of the wanted kind that every method has."""
    pattern = r"^\d{4}-\d{2}-\d{2}-sample$" if sample else r"^\d{4}-\d{2}-\d{2}$"
    return (
        runs.where(F.col("method").isin(methods) & F.col("run_date").rlike(pattern))
        .groupBy("run_date")
        .agg(F.count_distinct("method").alias("n"))
        .where(F.col("n") == len(set(methods)))
        .agg(F.max("run_date").alias("run_date"))
    )
