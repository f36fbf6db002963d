"""Seeded samples and quantile bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from nearfold.functions.text import WHITESPACE
from nearfold.operators.catalog import top_k_of_large_groups
from nearfold.operators.evaluate import seeded_order
from nearfold.scale import bounded_broadcast, exact_quantiles


def top_voted(df: DataFrame, n: int, position: str | None = None) -> DataFrame:
    """n rows by vote_count descending, then id, then their place in the file.

    Both may be text, as when a file is copied cell by cell.
    """
    order = [F.col("vote_count").cast("bigint").desc(), F.col("id").cast("bigint").asc()]
    if position:
        order.append(F.asc(position))
    return df.orderBy(*order).limit(n)


def bin_edges(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row (edges): quantile edges with repeats dropped."""
    probs = [i / bins for i in range(bins + 1)]
    return exact_quantiles(df, column, probs).select(F.array_distinct("quantiles").alias("edges"))


def bin_number(value: Column, edges: Column) -> Column:
    """Right-closed bin from 1; the lowest edge belongs to the first bin."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.greatest(below, F.lit(1))


def quantile_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    edges = bin_edges(df, column, bins).scalar()
    return (
        df.withColumn("__edges", edges)
        .withColumn("bin", bin_number(F.col(column).cast("double"), F.col("__edges")))
        .drop("__edges")
    )


def bin_allocation(binned: DataFrame, n: int) -> DataFrame:
    """(bin, size, wanted): shares of n by bin size, halves to even."""
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(W.partitionBy(F.lit(1)))
    wanted = F.bround(F.col("size") / total * n, 0)
    return sizes.withColumn("wanted", F.least(wanted, F.col("size")).cast("bigint"))


def stratified_sample(
    df: DataFrame, column: str, n: int, seed: int, key: str = "id", bins: int = 10
) -> DataFrame:
    """Exactly min(n, rows) keys (key, bin), in proportion to bin sizes.

    Rounding may miss n by a few: the rest is topped up from keys not yet drawn,
    or trimmed, both in seeded order. Ranks are cut at n per bin before they are
    compared with the bin's share, so a bin holding most rows is never sorted
    in one task.
    """
    binned = quantile_bins(df.select(key, column), column, bins).select(key, "bin")
    drawn = top_k_of_large_groups(binned, "bin", n, seeded_order(seed, key), key, "place")
    # One row per bin.
    shares = F.broadcast(bin_allocation(binned, n).select("bin", "wanted"))
    part = drawn.join(shares, "bin").where(F.col("place") <= F.col("wanted")).select(key, "bin")
    rest = anti_remainder(binned, part, key)
    topped = union_samples(
        [
            part.withColumn("late", F.lit(0)),
            rest.orderBy(*seeded_order(seed + 1, key)).limit(n).withColumn("late", F.lit(1)),
        ]
    )
    order = [F.asc("late"), *seeded_order(seed + 2, key)]
    return topped.orderBy(*order).limit(n).select(key, "bin")


def anti_remainder(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been taken."""
    return df.join(taken.select(key), key, "left_anti")


def union_samples(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_rows(
    df: DataFrame, column: str, n: int, seed: int, key: str = "id", bins: int = 10
) -> DataFrame:
    """Whole rows of a stratified sample, white space in text columns collapsed.

    `key` must be unique: where ids repeat, pass a column that numbers the rows.
    """
    keys = stratified_sample(df, column, n, seed, key, bins).select(key)
    sample = df.join(bounded_broadcast(keys, n), key, "left_semi")
    # Runs become one space; a missing cell stays missing.
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return sample.withColumns({c: F.regexp_replace(c, WHITESPACE, " ") for c in texts})
