"""Exact top-K cosine over dense vectors.

Vectors are cut into blocks of bounded size (`blocks`); each pair of blocks is one
matrix product in a task that returns each row's K best.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.operators.blocks import Margin, block_neighbours, cells_reaching, number_blocks
from nearfold.operators.grouping import (
    PLACES,
    best_pairs,
    expand_groups,
    first_members,
    group_equal,
)
from nearfold.scale import removed, scratch_path, shuffles_released, stable

# Tasks get this module's search code with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows and numbers of one block, at most.
BLOCK_ROWS = 16_384
BLOCK_CELLS = 1_048_576
# Pairs of vectors that are multiplied on their own at a time.
PAIRS = 16_384


def unit_vector(vec: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    norms = F.array_repeat(norm, F.size(vec))
    return F.zip_with(vec, norms, lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


class VectorBlock:
    def __init__(self, ids, columns):
        self.ids = ids
        self.matrix = np.stack(columns[0])
        self.matrix32, self.margin = self.matrix.astype(np.float32), margin(self.matrix)

    def scores(self, columns: list) -> np.ndarray:
        """Rounded scores of some query rows against every row of the block."""
        return np.round(np.stack(columns[0]) @ self.matrix.T, PLACES)

    def reaching(self, columns: list, floors: np.ndarray, own_floors: np.ndarray | None, k: int):
        """(query rows, the block's rows, rounded scores) of all pairs that reach either one's floor; those
        that do by 32 bits, with a margin for what they lose, are worked out in 64."""
        matrix = np.stack(columns[0])
        theirs = margin(matrix)
        scores = matrix.astype(np.float32) @ self.matrix32.T
        queries, rows = cells_reaching(scores, k, floors, theirs, own_floors, self.margin)
        found = np.empty(len(rows))
        for at in range(0, len(rows), PAIRS):
            part = slice(at, at + PAIRS)
            found[part] = np.einsum("ij,ij->i", matrix[queries[part]], self.matrix[rows[part]])
        return queries, rows, np.round(found, PLACES)


def margin(matrix: np.ndarray) -> Margin:
    n, width = matrix.shape
    return Margin(np.repeat(np.arange(n), width), matrix.reshape(-1), np.full(n, width))


def vector_edges(rows: DataFrame, k: int, block_rows: int, folder: str | None = None) -> DataFrame:
    """(a, b, score): among them the K best other rows of every non-zero row."""
    blocked, n_blocks = number_blocks(rows, ["id"], F.size("vec"), block_rows, BLOCK_CELLS)
    return block_neighbours(blocked, n_blocks, {"vec": "<f8"}, VectorBlock, k, -np.inf, folder)


def zero_edges(reps: DataFrame, zeros: DataFrame, k: int) -> DataFrame:
    """A zero vector scores 0 with everything; copies were grouped, so there is
    at most one: every row may take it, and it takes the smallest ids."""
    zero = zeros.select(F.min("id")).scalar()
    first = reps.orderBy("id").limit(k + 1).agg(F.collect_list("id")).scalar()
    to_zero = reps.select(F.col("id").alias("a"), zero.alias("b"), F.lit(0.0).alias("score"))
    from_zero = zeros.select(
        F.col("id").alias("a"), F.explode(first).alias("b"), F.lit(0.0).alias("score")
    )
    both = to_zero.where(F.col("b").isNotNull()).unionByName(from_zero)
    return both.where(F.col("a") != F.col("b"))


def knn_dense(
    vectors: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, stored: bool = False
) -> DataFrame:
    """(movie_id, rank, neighbour_id, score): exact top-K cosine, score to 6 places.

    `vectors` is (id, vec). Every row gets min(k, n-1) neighbours; ties go to the
    smaller id. Pass `stored` for vectors read from a store: they are scaled each time they are read, not copied.
    """
    is_zero = F.forall("vec", lambda x: x == 0)
    with shuffles_released(vectors.sparkSession):
        rows = vectors.select("id", unit_vector(F.col("vec").cast("array<double>")).alias("vec"))
        rows = rows if stored else stable(rows)
        grouped = stable(group_equal(rows, ["vec"]))
        members = stable(first_members(grouped, k))
        reps = stable(rows.join(members.select(F.col("rep").alias("id"), "group"), "id"))
        zeros = reps.where(is_zero).select("id")
        folder = scratch_path(vectors.sparkSession, "blocks")
        pairs = vector_edges(reps.where(~is_zero).select("id", "vec"), k, block_rows, folder)
        pairs = pairs.unionByName(zero_edges(reps, zeros, k))
        # Kept: a reader that asks for the edges twice does not compare all vectors twice.
        pairs = stable(best_pairs(pairs, k))
        removed(vectors.sparkSession, folder)
    own = F.when(F.col("zero"), F.lit(0.0)).otherwise(F.lit(1.0))
    flags = reps.select("group", is_zero.alias("zero"))
    return expand_groups(pairs, members.join(flags, "group"), grouped, k, own)
