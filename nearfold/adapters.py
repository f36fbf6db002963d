"""The given test tables in the shape of a film catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# All documents of at least 40 characters; status and adult flags not asked for.
EVERY_DOCUMENT = {
    "min_overview_chars": 40,
    "min_vote_count": 10,
    "exclude_adult": False,
    "status": None,
}
# Here the overview holds the whole text and `genres` is a held-out label.
DOCUMENT_FIELDS = ("title", "overview")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw films; unlabelled ones have no status and no adult flag.

    The event of the same number lends a release date (a date, a bare number or
    nothing) and a rating.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    events = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return (
        docs.join(labels, "doc_id", "left")
        .join(events.withColumnRenamed("event_id", "doc_id"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.substring("text", 1, 60).alias("title"),
            F.lit(None).cast("string").alias("tagline"),
            F.col("text").alias("overview"),
            F.col("lang").alias("genres"),
            F.concat("lang", F.lit(", "), "source").alias("keywords"),
            F.when(F.col("event_type") == "error", F.col("user_id").cast("string"))
            .when(F.col("event_type") != "click", day)
            .alias("release_date"),
            F.col("user_id").alias("runtime"),
            F.col("value").alias("vote_average"),
            F.col("n_chars").alias("vote_count"),
            F.when(F.col("quality") == 1, "Released")
            .when(F.col("quality") == 0, "Rumored")
            .alias("status"),
            (F.col("toxic") == 1).alias("adult"),
            F.when(F.col("quality") == 1, F.concat(F.lit("/"), "source")).alias("poster_path"),
        )
    )


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )


def vector_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films that have a dense vector; keywords are missing for unlabelled ones."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return (
        films(spark, sf_dir)
        .join(vectors, "id", "left_semi")
        .withColumn("keywords", F.when(F.col("status").isNotNull(), F.col("keywords")))
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a title index; many rows share one name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        (F.col("p_size") + 1950).cast("int").alias("year"),
        F.col("p_partkey").alias("position"),
    )
