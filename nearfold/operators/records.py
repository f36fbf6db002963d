"""Nested records per film, keyed lookup and hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions import values as V
from nearfold.functions.labels import genre_list
from nearfold.scale import skewed_join, stable

MAX_RESULTS = 20


def title_index(catalog: DataFrame) -> DataFrame:
    """(id, title, year), one row per film."""
    return catalog.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        V.year_strict(F.col("release_date")).alias("year"),
    )


def similar_lists(edges: DataFrame, method: str) -> DataFrame:
    """(movie_id, similar_<method>): neighbours in rank order with 4-place scores."""
    entry = F.struct(
        "rank",
        F.col("neighbour_id").cast("string").alias("id"),
        V.score_decimal(F.col("score")).alias("score"),
    )
    entries = F.array_sort(F.collect_list(entry))
    return (
        edges.groupBy("movie_id")
        .agg(entries.alias("e"))
        .select(
            "movie_id",
            F.transform(
                "e", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))
            ).alias(f"similar_{method}"),
        )
    )


def record_violations(catalog: DataFrame, edges_by_method: dict[str, DataFrame]) -> DataFrame:
    """(problem, id): repeated ids, films a method has no neighbours for, NaN scores."""
    repeated = catalog.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = repeated.select(F.lit("duplicate id").alias("problem"), "id")
    for method, edges in edges_by_method.items():
        covered = edges.select(F.col("movie_id").alias("id")).distinct()
        bare = catalog.select("id").join(covered, "id", "left_anti")
        nan = edges.where(F.isnan("score") | F.col("score").isNull())
        found = found.unionByName(
            bare.select(F.lit(f"no {method} neighbours").alias("problem"), "id")
        ).unionByName(
            nan.select(F.lit(f"{method} score is NaN").alias("problem"), F.col("movie_id").alias("id"))
        )
    return found


def display_columns(catalog: DataFrame) -> DataFrame:
    """Attributes of a record apart from its neighbours; missing ones are null."""
    kinds = {f.name: f.dataType for f in catalog.schema.fields}

    def value(name: str):
        return V.present(F.col(name), kinds[name])

    return catalog.select(
        F.col("id").alias("key"),
        F.col("id").cast("string").alias("movie_id"),
        value("title").alias("title"),
        V.year_lenient(F.col("release_date")).alias("year"),
        value("poster_path").alias("poster_path"),
        value("vote_average").cast("double").alias("vote_average"),
        V.overview_short(value("overview")).alias("overview_short"),
        genre_list(F.col("genres")).alias("genres"),
    )


def assemble_records(
    catalog: DataFrame, edges_by_method: dict[str, DataFrame], check: bool = True
) -> DataFrame:
    """One nested record per film with a `similar_<method>` list per method.

    Refuses repeated ids, films without neighbours and NaN scores; a record over
    the size limit fails the job that reads it.
    """
    if check:
        first = record_violations(catalog, edges_by_method).first()
        if first is not None:
            raise ValueError(f"cannot build records: {first.problem} (id {first.id})")
    records = display_columns(catalog)
    for method, edges in edges_by_method.items():
        lists = similar_lists(edges, method).withColumnRenamed("movie_id", "key")
        records = records.join(lists, "key", "left")
    records = records.drop("key")
    return limit_record_size(records) if check else records


def limit_record_size(records: DataFrame) -> DataFrame:
    """The records; any over the limit raises when it is read."""
    text = F.concat(F.lit("record over the size limit: "), F.col("movie_id"))
    too_big = V.record_bytes(records.schema) > V.MAX_RECORD_BYTES
    # The check sits on the key, which every reader asks for.
    checked = F.when(too_big, F.raise_error(text).cast("string")).otherwise(F.col("movie_id"))
    return records.withColumn("movie_id", checked)


def record_sizes(records: DataFrame) -> DataFrame:
    """(movie_id, size_bytes)."""
    return records.select("movie_id", V.record_bytes(records.schema).alias("size_bytes"))


def write_unit_total(records: DataFrame) -> DataFrame:
    """One row (records, write_units) for a full load."""
    sizes = record_sizes(records)
    return sizes.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(V.write_units(F.col("size_bytes"))), F.lit(0)).alias("write_units"),
    )


def records_json(records: DataFrame) -> DataFrame:
    """(movie_id, json): attributes that are missing are left out."""
    return records.select("movie_id", F.to_json(F.struct(*records.columns)).alias("json"))


def display_projection(records: DataFrame) -> DataFrame:
    """Fields a page shows; missing genres become an empty list."""
    return records.select(
        F.col("movie_id").alias("id"),
        "title",
        "year",
        F.col("vote_average").alias("rating"),
        "poster_path",
        F.col("overview_short").alias("overview"),
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
    )


def hydrate_batch(requests: DataFrame, records: DataFrame) -> DataFrame:
    """`requests` is (request, ids ARRAY<STRING>). One row per known id with its
    `pos` in the request: order and repeats kept, unknown ids skipped."""
    wanted = requests.select("request", F.posexplode("ids").alias("pos", "movie_id"))
    # Ids come many to a request and records once per id, so the records side is
    # first cut to the ids asked for.
    asked = wanted.select("movie_id").distinct()
    found = records.join(asked, "movie_id", "left_semi")
    joined = skewed_join(wanted, found, "movie_id")
    return joined.select("request", "pos", *records.columns)


def missing_ids(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(movie_id): ids asked for that no record has."""
    asked = requests.select(F.explode("ids").alias("movie_id")).distinct()
    return asked.join(records.select("movie_id"), "movie_id", "left_anti")


def listed_neighbours(asked: DataFrame, records: DataFrame, method: str, n: int = 10) -> DataFrame:
    """(query_id, pos, id, score): the first n (1..20) of each asked film's list."""
    n = max(1, min(MAX_RESULTS, n))
    lists = records.join(asked.select("movie_id").distinct(), "movie_id", "left_semi").select(
        F.col("movie_id").alias("query_id"),
        F.posexplode(F.slice(f"similar_{method}", 1, n)).alias("pos", "e"),
    )
    return lists.select("query_id", "pos", F.col("e.id").alias("id"), F.col("e.score").alias("score"))


def shown_neighbours(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """Listed neighbours with their display fields."""
    # Only records that are listed leave the table.
    listed = records.join(wanted.select(F.col("id").alias("movie_id")).distinct(), "movie_id", "left_semi")
    shown = display_projection(listed)
    # A film may be a neighbour of very many others.
    return skewed_join(wanted, shown, "id").select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), *shown.columns, "score"
    )


def similar_lookup(asked: DataFrame, records: DataFrame, method: str, n: int = 10) -> DataFrame:
    """Display fields and score of each asked film's first n neighbours (1..20).

    `asked` is (movie_id); films without a record give no rows.
    """
    return shown_neighbours(listed_neighbours(asked, records, method, n), records)


def served_hydrate(requests: DataFrame, served) -> DataFrame:
    """`hydrate_batch` on a served table; only the buckets of the asked ids are read."""
    asked = requests.select(F.explode("ids").alias("movie_id"))
    return hydrate_batch(requests, served.near(asked))


def served_similar(asked: DataFrame, served, method: str, n: int = 10) -> DataFrame:
    """`similar_lookup` on a served table; lists, then what they name, from their buckets alone."""
    wanted = stable(listed_neighbours(asked, served.near(asked), method, n))
    return shown_neighbours(wanted, served.near(wanted.select(F.col("id").alias("movie_id"))))


def keyed_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of `new`, and rows of `old` whose key is not among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
