"""Exact top-K cosine over sparse unit rows.

Rows whose common terms are led by the same one are neighbours in the numbering that makes the blocks
(`blocks`), so a block tends to hold rows of one kind, whose terms are dense in it. A task holds one block
as an inverted index, with common terms as a dense matrix, and returns only each row's K best, so pairs are
never written out. Scores are made in 32 bits; those that may count by them are worked out in 64.

Equal rows are compared once (`grouping`), and rows with fewer than K
neighbours are completed with zero scores (`pad_to_k`).
"""

from __future__ import annotations

import sys
from functools import cached_property

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.blocks import Margin, block_neighbours, cells_reaching, number_blocks
from nearfold.operators.grouping import (
    PLACES,
    best_pairs,
    expand_groups,
    first_members,
    group_equal,
)
from nearfold.scale import fits_broadcast, removed, scratch_path, shuffles_released, stable

# Tasks get this module's search code with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Rows and (term, weight) entries of one block, at most.
BLOCK_ROWS = 8192
BLOCK_ENTRIES = 2_000_000
# Terms in more than one of this many rows of a block are multiplied densely.
HEAVY_SHARE = 64
# Products of light terms that are made at a time.
PORTION = 120_000
# Where scores are only approximated, a light product takes the time of so many dense ones.
LIGHT_COST = 400
# The most common terms of a row, which decide where it is numbered.
LEADING = 4
# Query rows that are laid out at a time where single scores are worked out.
LAID_ROWS = 8


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all places of some spans, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def portions(counts: np.ndarray):
    """Slices of spans that hold PORTION places together, or one span."""
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PORTION, "right")))
        yield slice(first, last)
        first = last


class BlockIndex:
    """Inverted index over one block of packed rows."""

    def __init__(self, ids, columns):
        terms, weights = columns
        self.ids = ids
        self.sizes = np.array([len(t) for t in terms], dtype=np.int64)
        flat = np.concatenate(terms).astype(np.int64)
        weight = np.concatenate(weights).astype(np.float64)
        row = np.repeat(np.arange(len(ids)), self.sizes)
        by_term = np.argsort(flat, kind="stable")
        self.row, self.weight = row[by_term], weight[by_term].astype(np.float32)
        self.terms, self.start, self.count = np.unique(
            flat[by_term], return_index=True, return_counts=True
        )
        # Where each term stands among the block's; -1 for others.
        self.place = np.full(self.terms[-1] + 2, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        # The rows again as they came, to work out single scores.
        self.own_place, self.own_weight = self.place[flat].astype(np.int64), weight
        self.margin = Margin(row, weight, self.sizes)

    @cached_property
    def heavy(self) -> tuple[np.ndarray, np.ndarray]:
        """Terms in many rows, and the matrix of their weights."""
        heavy = np.flatnonzero(self.count * HEAVY_SHARE > len(self.ids))
        matrix = np.zeros((len(heavy), len(self.ids)), np.float32)
        at = spread(self.start[heavy], self.count[heavy])
        matrix[np.repeat(np.arange(len(heavy)), self.count[heavy]), self.row[at]] = self.weight[at]
        return heavy, matrix

    def known(self, columns: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places of terms and weights of the entries whose terms the block has."""
        terms, weights = columns
        flat, weight = np.concatenate(terms).astype(np.int64), np.concatenate(weights)
        row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        at = self.place[np.minimum(flat, len(self.place) - 1)]
        known = at >= 0
        return row[known], at[known].astype(np.int64), weight[known]

    def light(self, out: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        """Add the products of these entries with the block's."""
        count, cells = self.count[at], out.reshape(-1)
        for part in portions(count):
            times = count[part]
            span = spread(self.start[at[part]], times)
            cell = self.row[span]
            cell += np.repeat(row[part] * len(self.ids), times)
            product = self.weight[span]
            product *= np.repeat(weight[part], times)
            np.add.at(cells, cell, product)

    def scores(self, columns: list) -> np.ndarray:
        """Rounded scores of some query rows against every row of the block."""
        n = len(columns[0])
        queries, rows = np.divmod(np.arange(n * len(self.ids)), len(self.ids))
        return np.round(self.products(queries, rows, *self.known(columns), n), PLACES).reshape(n, -1)

    def reaching(self, columns: list, floors: np.ndarray, own_floors: np.ndarray | None, k: int):
        """(query rows, the block's rows, rounded scores) of all pairs that reach either one's floor.

        Scores are made in 32 bits first, with a margin that covers what that loses; the pairs left
        are worked out in 64. Terms go through the dense product where many rows of both sides have them.
        """
        row, at, weight = self.known(columns)
        n = len(columns[0])
        common = np.bincount(at, minlength=len(self.terms))
        chosen, matrix = self.heavy
        dense = LIGHT_COST * self.count[chosen] * common[chosen] > len(self.ids) * n
        slot = np.full(len(self.terms), -1)
        slot[chosen[dense]] = np.arange(np.count_nonzero(dense))
        heavy = slot[at] >= 0
        head = np.zeros((n, np.count_nonzero(dense)), np.float32)
        head[row[heavy], slot[at[heavy]]] = weight[heavy]
        out = head @ matrix[dense]
        self.light(out, row[~heavy], at[~heavy], weight[~heavy].astype(np.float32))
        theirs = Margin(row, weight, np.bincount(row, minlength=n))
        queries, rows = cells_reaching(out, k, floors, theirs, own_floors, self.margin)
        return queries, rows, np.round(self.products(queries, rows, row, at, weight, n), PLACES)

    def products(self, queries, rows, row, at, weight, n: int) -> np.ndarray:
        """Scores of single pairs, in order: query rows of the given entries, and the block's rows."""
        query = Entries(row, at, weight, n)
        own = Entries(np.repeat(np.arange(len(self.ids)), self.sizes), self.own_place, self.own_weight, len(self.ids))
        if own.sizes[rows].sum() <= query.sizes[queries].sum():
            return products(query, queries, own, rows, len(self.terms))
        by_row = np.argsort(rows, kind="stable")
        out = np.empty(len(rows))
        out[by_row] = products(own, rows[by_row], query, queries[by_row], len(self.terms))
        return out


class Entries:
    """Rows as flat entries: the row, the place of the term and the weight of each, row by row."""

    def __init__(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int):
        self.row, self.at, self.weight = row, at, weight
        self.sizes = np.bincount(row, minlength=n)
        self.first = np.cumsum(self.sizes) - self.sizes


def products(laid: Entries, laid_rows: np.ndarray, walked: Entries, rows: np.ndarray, width: int) -> np.ndarray:
    """Scores of pairs of a row of `laid` and one of `walked`, sorted by the first.

    Some rows at a time are laid out, met by the entries of the others, and taken away again.
    """
    out = np.zeros(len(rows))
    table = np.zeros(LAID_ROWS * width)
    n = len(laid.sizes)
    edges = np.searchsorted(laid_rows, np.arange(0, n + LAID_ROWS, LAID_ROWS))
    for turn in np.flatnonzero(np.diff(edges)):
        base = turn * LAID_ROWS
        last = min(n, base + LAID_ROWS) - 1
        own = slice(laid.first[base], laid.first[last] + laid.sizes[last])
        cell = (laid.row[own] - base) * width + laid.at[own]
        table[cell] = laid.weight[own]
        low, high = edges[turn], edges[turn + 1]
        counts = walked.sizes[rows[low:high]]
        for part in portions(counts):
            pairs, times = slice(low + part.start, low + part.stop), counts[part]
            span = spread(walked.first[rows[pairs]], times)
            place = walked.at[span]
            place += np.repeat((laid_rows[pairs] - base) * width, times)
            product = table[place]
            product *= walked.weight[span]
            some = np.flatnonzero(times)
            if len(some):
                out[low + part.start + some] = np.add.reduceat(product, (np.cumsum(times) - times)[some])
        table[cell] = 0.0
    return out


def group_edges(rows: DataFrame, k: int, block_rows: int, block_entries: int) -> DataFrame:
    """(a, b, score), kept: K best other rows of every row, positive scores only."""
    # By the common term that weighs most in a row, then by size: what is dense in a row is in those next to it.
    n = F.greatest(F.least(F.size("terms"), F.lit(LEADING)), F.lit(1))
    terms, weights = (F.slice(c, -n, n) for c in ("terms", "weights"))
    anchored = rows.withColumns(
        {"anchor": F.element_at(terms, F.array_position(weights, F.array_max(weights)).cast("int")), "size": F.size("terms")}
    )
    order = ["anchor", "size", "id"]
    blocked, n_blocks = number_blocks(anchored, order, F.size("terms"), block_rows, block_entries)
    folder = scratch_path(rows.sparkSession, "blocks")
    found = block_neighbours(
        blocked, n_blocks, {"terms": "<i4", "weights": "<f8"}, BlockIndex, k, 10.0**-PLACES / 2, folder
    )
    pairs = stable(best_pairs(found, k))
    removed(rows.sparkSession, folder)
    return pairs


def representatives(rows: DataFrame, grouped: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose id stands for a group. Copies are few as a rule: then rows stay where they are."""
    reps = members.select(F.col("rep").alias("id"))
    copies = stable(grouped.select("id").distinct().join(reps, "id", "left_anti"))
    if fits_broadcast(copies.count()):
        return rows.where(F.col("id").isNotNull()).join(F.broadcast(copies), "id", "left_anti")
    return rows.join(reps, "id", "left_semi")


def pad_to_k(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Complete every id to min(k, n-1) neighbours with zero scores, smallest ids first.

    The K+1 smallest ids always suffice: at most one is the row itself and the
    rest of the overlap is already listed.
    """
    have = edges.groupBy("movie_id").agg(F.collect_list("neighbour_id").alias("have"))
    first = ids.select("id").orderBy("id").limit(k + 1)
    first = first.agg(F.sort_array(F.collect_list("id")).alias("first")).scalar()
    short = (
        ids.select(F.col("id").alias("movie_id"))
        .join(have, "movie_id", "left")
        .withColumn("have", F.coalesce("have", F.array().cast("array<bigint>")))
        .where(F.size("have") < k)
        .withColumn("first", first)
    )
    free = F.filter(F.array_except("first", "have"), lambda x: x != F.col("movie_id"))
    zeros = short.select(
        "movie_id",
        F.size("have").alias("n"),
        F.posexplode(F.slice(free, 1, k - F.size("have"))).alias("pos", "neighbour_id"),
    ).select(
        "movie_id",
        (F.col("n") + F.col("pos") + 1).cast("int").alias("rank"),
        "neighbour_id",
        F.lit(0.0).alias("score"),
    )
    return edges.unionByName(zeros)


def knn_sparse(
    rows: DataFrame,
    ids: DataFrame,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    block_entries: int = BLOCK_ENTRIES,
    pad: bool = True,
    stored: bool = False,
) -> DataFrame:
    """(movie_id, rank, neighbour_id, score): exact top-K cosine, score to 6 places.

    `rows` is (id, terms, weights) as `tfidf.packed_rows` makes it; `ids` lists
    every id, with or without a row. Ties go to the smaller id. Pass `stored` for rows
    read from a store: they are not copied.
    """
    with shuffles_released(rows.sparkSession):
        rows = rows if stored else stable(rows)
        grouped = stable(group_equal(rows, ["terms", "weights"]))
        members = stable(first_members(grouped, k))
        pairs = group_edges(representatives(rows, grouped, members), k, block_rows, block_entries)
    edges = expand_groups(pairs, members, grouped, k, F.lit(1.0))
    return pad_to_k(edges, ids, k) if pad else edges
