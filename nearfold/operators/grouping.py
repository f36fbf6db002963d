"""Equal vectors as one group, so copies are compared once.

A group keeps its K+1 smallest ids: no neighbour list ever needs more of them.
Neighbour lists are found between groups, turned into lists of ids once per
group, and handed to every member through one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nearfold.operators.catalog import top_k_per_group
from nearfold.scale import skewed_join

PLACES = 6


def group_equal(rows: DataFrame, content: list[str]) -> DataFrame:
    """(id, group): `group` is a digest of 128 bits of the vector's exact content.

    Two hashes of the numbers as they are: written out as text they would cost more than the search.
    """
    return rows.select("id", F.concat_ws(":", *[F.xxhash64(F.lit(i), *content) for i in (1, 2)]).alias("group"))


def first_members(grouped: DataFrame, k: int) -> DataFrame:
    """(group, rep, members): the K+1 smallest ids of each group."""
    window = W.partitionBy("group").orderBy("id")
    first = grouped.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= k + 1)
    return first.groupBy("group").agg(
        F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members")
    )


def ranked(score: str = "score", neighbour: str = "neighbour_id") -> list[Column]:
    """Best score first; ties to the smaller id."""
    return [F.desc(score), F.asc(neighbour)]


def best_pairs(found: DataFrame, k: int) -> DataFrame:
    """The K best (a, b, score) of each a. Scores have `PLACES` places and travel as whole numbers."""
    unit = float(10**PLACES)
    whole = found.withColumn("score", F.rint(F.col("score") * unit).cast("int"))
    best = top_k_per_group(whole, "a", k, ranked(neighbour="b")).drop("rank")
    return best.withColumn("score", F.col("score") / unit)


def expand_groups(
    edges: DataFrame, members: DataFrame, grouped: DataFrame, k: int, own_score: Column
) -> DataFrame:
    """Edges between group representatives (a, b, score) to edges between ids.

    Returns (movie_id, rank, neighbour_id, score) with at most k rows per id.
    """
    lists = members.select(F.col("rep").alias("b"), F.col("members").alias("ids"))
    across = edges.join(lists, "b").select("a", "score", F.explode("ids").alias("neighbour_id"))
    own = members.select(
        F.col("rep").alias("a"), own_score.alias("score"), F.explode("members").alias("neighbour_id")
    )
    best = W.partitionBy("a").orderBy(*ranked())
    picked = (
        across.unionByName(own)
        .withColumn("__n", F.row_number().over(best))
        .where(F.col("__n") <= k + 1)
        .groupBy("a")
        .agg(F.sort_array(F.collect_list(F.struct("__n", "neighbour_id", "score"))).alias("best"))
        .join(members.select(F.col("rep").alias("a"), "group"), "a")
        .select("group", "best")
    )
    mine = skewed_join(grouped, picked, "group")
    others = F.slice(F.filter("best", lambda e: e["neighbour_id"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("pos", "e")).select(
        F.col("id").alias("movie_id"),
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("e.neighbour_id").alias("neighbour_id"),
        F.col("e.score").alias("score"),
    )
