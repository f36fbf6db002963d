"""Catalog build: filter raw films, clean text, keep one row per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nearfold.functions.text import collapse_whitespace, collapsed_length_at_least, document_text
from nearfold.settings import DEFAULTS

DOCUMENT_FIELDS = ("title", "tagline", "overview", "genres")


def clean_fields(df: DataFrame, fields=DOCUMENT_FIELDS) -> DataFrame:
    return df.withColumns({f: collapse_whitespace(F.col(f)) for f in fields})


def filter_conditions(settings: dict | None = None) -> dict[str, Column]:
    """The catalog rules by name. A null adult flag is not adult; `status: None`
    skips the status rule."""
    s = settings or DEFAULTS["catalog"]
    rules = {"votes": F.col("vote_count") >= s["min_vote_count"]}
    if s["status"] is not None:
        rules["status"] = F.coalesce(F.col("status").isin(s["status"]), F.lit(False))
    if s["exclude_adult"]:
        rules["adult"] = ~F.coalesce(F.col("adult"), F.lit(False))
    rules["overview"] = collapsed_length_at_least(F.col("overview"), s["min_overview_chars"])
    return rules


def catalog_filter(raw: DataFrame, settings: dict | None = None) -> DataFrame:
    """Rows passing every rule, the cheap ones first."""
    for rule in filter_conditions(settings).values():
        raw = raw.where(rule)
    return raw


def build_document(df: DataFrame, fields=DOCUMENT_FIELDS, cleaned: bool = False) -> DataFrame:
    """Add `document`. Held-out label columns must never be among `fields`."""
    parts = [F.col(f) if cleaned else collapse_whitespace(F.col(f)) for f in fields]
    return df.withColumn("document", document_text(*parts))


def dedup_keep_max(
    df: DataFrame, key: str = "id", best: str = "vote_count", tie: list[Column] | None = None
) -> DataFrame:
    """One row per key: the highest `best`, ties settled by `tie` (or a hash of the row).

    Built on max_by so map-side aggregation shrinks a hot key before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in rest])
    order = F.struct(F.col(best).alias("best"), *(tie or [F.xxhash64(*rest)]))
    picked = df.groupBy(key).agg(F.max_by(row, order).alias("row"))
    return picked.select(key, "row.*").select(*df.columns)


def prepare(
    raw: DataFrame, settings: dict | None = None, fields=DOCUMENT_FIELDS
) -> DataFrame:
    """Raw films to the catalog: filter, clean, document, one row per id."""
    kept = clean_fields(catalog_filter(raw, settings))
    return build_document(dedup_keep_max(kept), fields, cleaned=True)


def top_k_per_group(
    df: DataFrame, group: str, k: int, order: list[Column], rank: str = "rank"
) -> DataFrame:
    """First k rows of each group with a rank from 1.

    Catalyst limits each group before and after the shuffle, so a hot group
    moves k rows per task.
    """
    window = W.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_k_of_large_groups(
    df: DataFrame, group: str, k: int, order: list[Column], salt_by: str, rank: str = "rank"
) -> DataFrame:
    """`top_k_per_group` for k beyond what Catalyst limits map-side (1000 rows).

    Each group is first cut to k rows in every salt, so no task sorts a whole
    hot group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(parts)))
    within = W.partitionBy(group, "__salt").orderBy(*order)
    cut = salted.withColumn("__n", F.row_number().over(within)).where(F.col("__n") <= k)
    return top_k_per_group(cut.drop("__salt", "__n"), group, k, order, rank)
