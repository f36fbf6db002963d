"""Reading raw CSV and writing text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.values import null_tokens

# The columns a run reads, with their types.
FILM_TYPES = {
    "id": "bigint",
    "title": "string",
    "tagline": "string",
    "overview": "string",
    "genres": "string",
    "keywords": "string",
    "release_date": "string",
    "runtime": "bigint",
    "vote_average": "double",
    "vote_count": "bigint",
    "status": "string",
    "adult": "boolean",
    "poster_path": "string",
}


def read_films(spark: SparkSession, path: str) -> DataFrame:
    """Raw films from a CSV, or from anything else as Parquet, which splits into tasks by size."""
    return scan_typed_csv(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)


def scan_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; blank cells stay ''."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("inferSchema", False)
        # A value no cell holds, so blanks are not turned into nulls.
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
        .na.fill("")
    )


def scan_typed_csv(
    spark: SparkSession,
    path: str,
    types: dict[str, str] | None = None,
    tokens: list[str] | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """The named columns only, typed; missing-value tokens become null.

    Quoted cells may hold doubled quotes and, with `line_breaks`, line breaks,
    which keeps each file in one task. Large files without any split better with
    it off; others are best converted to Parquet once.
    """
    types = types or FILM_TYPES
    raw = (
        spark.read.option("header", True)
        .option("multiLine", line_breaks)
        .option("escape", '"')
        .csv(path)
    )
    return raw.select(
        *[null_tokens(F.col(c), tokens).cast(kind).alias(c) for c, kind in types.items()]
    )


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_title_index(titles: DataFrame, path: str) -> None:
    titles.write.mode("overwrite").option("compression", "gzip").json(path)


def read_title_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, title string, year int").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def artifact_size(spark: SparkSession, path: str) -> DataFrame:
    """One row (artifact_mb): size of everything under a folder. Only file
    lengths are read, not their content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / 1048576).alias("artifact_mb"))
