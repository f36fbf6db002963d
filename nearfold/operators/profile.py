"""Profiling of a raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.labels import jaccard, keyword_set
from nearfold.operators.catalog import filter_conditions
from nearfold.operators.evaluate import draw
from nearfold.scale import bounded_broadcast, with_offsets


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate), all columns in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns]
    return one.select(F.inline(F.array(*cells)))


def threshold_counts(df: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n): rows at or above each threshold."""
    one = df.agg(*[F.count_if(F.col(column) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    cells = [
        F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n"))
        for i, t in enumerate(thresholds)
    ]
    return one.select(F.inline(F.array(*cells)))


def filter_counts(raw: DataFrame, settings: dict | None = None) -> DataFrame:
    """(rule, n): rows passing each catalog rule alone, and `all` of them."""
    rules = filter_conditions(settings)
    every = F.lit(True)
    for rule in rules.values():
        every = every & rule
    tests = {**rules, "all": every}
    one = raw.agg(*[F.count_if(rule).alias(name) for name, rule in tests.items()])
    cells = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in tests]
    return one.select(F.inline(F.array(*cells)))


def label_coverage(df: DataFrame, labels: str, column: str, thresholds: list[int]) -> DataFrame:
    """(threshold, n, coverage): share of rows at or above it that have labels."""
    has = F.coalesce(F.col(labels) != "", F.lit(False)).cast("int")
    parts = []
    for i, t in enumerate(thresholds):
        kept = F.when(F.col(column) >= t, has)
        parts += [F.count(kept).alias(f"n{i}"), F.avg(kept).alias(f"c{i}")]
    cells = [
        F.struct(
            F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("coverage")
        )
        for i, t in enumerate(thresholds)
    ]
    return df.agg(*parts).select(F.inline(F.array(*cells)))


def distinct_labels(df: DataFrame, labels: str) -> DataFrame:
    """One row (n_labels)."""
    exploded = df.select(F.explode(keyword_set(F.col(labels))).alias("label"))
    return exploded.agg(F.count_distinct("label").alias("n_labels"))


def random_pair_jaccard(
    df: DataFrame, labels: str, n_pairs: int, seed: int, key: str = "id", votes: str | None = None, least: int = 50
) -> DataFrame:
    """One row (n_pairs, mean_jaccard) over seeded pairs of distinct rows that have labels
    (and, where a vote column is named, `least` votes). Pairs are drawn as row numbers, then looked up."""
    if votes is not None:
        df = df.where(F.col(votes) >= least)
    pool = df.select(key, keyword_set(F.col(labels)).alias("labels")).where(F.size("labels") > 0)
    numbered = with_offsets(pool, [key], name="at")
    n = numbered.select(F.count(F.lit(1))).scalar()
    pairs = df.sparkSession.range(n_pairs).select(F.col("id").alias("pair"))
    first = draw(seed, F.col("pair"), 0, n)
    second = draw(seed, F.col("pair"), 1, n - 1)
    pairs = pairs.select("pair", first.alias("i"), second.alias("j")).select(
        "pair", "i", F.when(F.col("j") >= F.col("i"), F.col("j") + 1).otherwise(F.col("j")).alias("j")
    )
    left = numbered.select(F.col("at").alias("i"), F.col("labels").alias("a"))
    right = numbered.select(F.col("at").alias("j"), F.col("labels").alias("b"))
    scored = bounded_broadcast(pairs, n_pairs).join(left, "i")
    scored = scored.join(right, "j").select(jaccard(F.col("a"), F.col("b")).alias("s"))
    return scored.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("s").alias("mean_jaccard"))
