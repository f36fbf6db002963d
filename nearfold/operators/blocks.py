"""Nearest neighbours between blocks of rows: one plan at every size.

Rows are numbered and cut where the running sum of their entries fills a block,
so no block holds more than its share and one row. A block is packed into
one row of binary columns. It first searches itself, which gives each of its
rows a floor, the score its K-th neighbour must reach. Then each unordered pair of
blocks is compared once and yields neighbours for both. Packed blocks are written once, and tasks read
those they compare from the shared folder (`parts`): a block meets all others, and copies of it would grow with
the square of the rows. A task compares one group of blocks with another, in strips of bounded size, and
keeps the K best of every row of both; as there are few groups, a row has candidates from few tasks.

The comparison is exhaustive, as an exact answer needs on data without structure: work
grows with the square of the number of blocks, what is written and moved with the rows.
Searches are a class built from one block, `Index(ids, columns)`, whose `scores(columns)` gives
the scores of other rows against it.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.parts import parts, read_part, write_parts
from nearfold.scale import scratch_path, stable, with_offsets

# Tasks get this module's search code with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fewer blocks would leave cores idle; small tables are cut as well.
LEAST_BLOCKS = 16
# Shares of the blocks that are packed one after the other, so that only one is on disk as shuffled rows too.
PORTIONS = 4
# Groups the blocks are compared in; more where a group would have more than so many blocks.
GROUPS = 8
GROUP_BLOCKS = 64
# Partitions of the comparisons, at most.
MOST_TASKS = 10_000
# Scores that are made at a time, and candidates that wait for being cut to the K best.
STRIP_CELLS = 4_000_000
WAITING = 50_000
# So many times the K best of all rows are left to be worked out before floors are raised.
MANY = 4
# Half a rounding step and floating-point noise.
SLACK = 1e-6
PACKED = "block int, ids binary, sizes binary, floors binary"
PAIR_SCHEMA = "a long, b long, score double"


def number_blocks(rows: DataFrame, order: list[str], entries, most_rows: int, most_entries: int) -> tuple[DataFrame, int]:
    """Add `block`, and say how many there are.

    A row weighs its entries, or a row's share of a block if that is more; a block's rows
    but the last weigh no more than the block may hold. Only `order` and weights are sorted; rows find
    their block among the first keys of all blocks, so they need not move for it.
    """
    weight = F.greatest(entries, F.lit(max(1, most_entries // most_rows))).cast("long")
    weights = stable(rows.select(*order, weight.alias("__entries")))
    total = weights.agg(F.sum("__entries")).first()[0] or 0
    share = max(1, min(most_entries, -(-total // LEAST_BLOCKS)))
    placed = with_offsets(weights, order, F.col("__entries"), "first_entry")
    numbered = placed.select(F.struct(*order).alias("key"), F.floor(F.col("first_entry") / share).cast("int").alias("block"))
    # One short row a block.
    firsts = stable(numbered.groupBy("block").agg(F.min("key").alias("key")))
    firsts = firsts.agg(F.collect_list(F.struct("key", "block"))).scalar()
    key = F.struct(*order)
    reached = F.filter("__firsts", lambda first: first["key"] <= key)
    block = F.array_max(F.transform(reached, lambda first: first["block"]))
    return rows.withColumn("__firsts", firsts).withColumn("block", block).drop("__firsts"), -(-total // share)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray):
    """Of each row of `scores` the k best at or above its floor, the smaller id first among equals.

    Returns row numbers, ids, scores, and each row's floor raised to its k-th best, if it has so
    many. `ids` ascend.
    """
    reached = (scores >= floors[:, None]) & np.isfinite(scores)
    counts = np.count_nonzero(reached, axis=1)
    raised = floors.copy()
    full = np.flatnonzero(counts >= k)
    if len(full):
        inside = np.where(reached[full], scores[full], -np.inf)
        kth = -np.partition(-inside, k - 1, axis=1)[:, k - 1]
        raised[full] = np.maximum(floors[full], kth - 2 * SLACK)
        reached[full] = inside >= kth[:, None]
        # Too many only where others equal the k-th; the last of them go.
        tied = np.count_nonzero(reached[full], axis=1) > k
        for i, least in zip(full[tied], kth[tied]):
            equal = np.flatnonzero(reached[i] & (scores[i] == least))
            reached[i, equal[k - (np.count_nonzero(reached[i]) - len(equal)) :]] = False
    rows, at = np.nonzero(reached)
    return rows, ids[at], scores[rows, at], raised


class Margin:
    """How far the score of two rows may be off where it was made in 32 bits."""

    def __init__(self, row: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        # Twice the rounding of each factor and of each sum.
        self.share = (sizes + 8) * 2.0**-23
        self.signed = bool(len(values) and values.min() < 0)
        self.norms = np.sqrt(np.bincount(row, values * values, len(sizes)))

    def least(self, floors: np.ndarray, other: Margin) -> np.ndarray:
        """What such a score with rows of `other` has at least if the true one reaches the floor."""
        if self.signed or other.signed:
            off = self.share * self.norms * other.norms.max(initial=0.0)
        else:
            off = self.share * np.maximum(floors, 0.0)
        # Rows that have no floor yet take all.
        bound = np.maximum(floors - off, np.finfo(np.float32).min / 2)
        return np.nextafter(bound.astype(np.float32), np.float32(-np.inf), dtype=np.float32)


def cells_reaching(scores: np.ndarray, k: int, floors: np.ndarray, margin: Margin, column_floors: np.ndarray | None, column_margin: Margin):
    """Row and column numbers, in order, of the 32-bit scores that may reach their row's or their column's floor.

    Where floors are low yet, the K-th scores among these raise them first.
    """

    def reached() -> np.ndarray:
        found = scores >= margin.least(floors, column_margin)[:, None]
        if column_floors is not None:
            found |= scores >= column_margin.least(column_floors, margin)
        return found

    found = reached()
    if np.count_nonzero(found) > MANY * k * sum(scores.shape):
        numbers = [np.arange(n) for n in scores.shape]
        raised = best_of(scores, numbers[1], k, margin.least(floors, column_margin))[3]
        floors = np.maximum(floors, margin.least(raised, column_margin))
        if column_floors is not None:
            raised = best_of(scores.T, numbers[0], k, column_margin.least(column_floors, margin))[3]
            column_floors = np.maximum(column_floors, column_margin.least(raised, margin))
        found = reached()
    return np.divmod(np.flatnonzero(found), scores.shape[1])


class Block:
    """Rows as they travel: flat columns and each row's length."""

    def __init__(self, ids: np.ndarray, columns: list[list], floors: np.ndarray):
        self.ids, self.columns, self.floors = ids, columns, floors

    def sorted_by(self, *keys: np.ndarray) -> Block:
        order = np.lexsort(keys)
        return Block(self.ids[order], [[c[i] for i in order] for c in self.columns], self.floors[order])

    def packed(self, number: int, kinds: list[str]) -> dict:
        flat = {
            f"c{i}": np.concatenate([np.asarray(x, kind) for x in c]).tobytes()
            for i, (c, kind) in enumerate(zip(self.columns, kinds))
        }
        sizes = np.array([len(x) for x in self.columns[0]], np.int64)
        return {
            "block": number, "ids": self.ids.astype(np.int64).tobytes(), "sizes": sizes.tobytes(),
            "floors": self.floors.tobytes(), **flat,
        }

    @classmethod
    def unpacked(cls, row, kinds: list[str]) -> Block:
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))[:-1]
        columns = [np.split(np.frombuffer(row[f"c{i}"], kind), ends) for i, kind in enumerate(kinds)]
        return cls(np.frombuffer(row["ids"], np.int64), columns, np.frombuffer(row["floors"], np.float64))

    def strips(self, against: int):
        """Its rows, as many at a time as make a bounded number of scores with `against` rows."""
        step = max(16, STRIP_CELLS // max(1, against))
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            yield part, [c[part] for c in self.columns]


class Found:
    """Neighbours as they are found, as one frame at the end."""

    def __init__(self):
        self.a, self.b, self.score = [], [], []

    def add(self, a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.score.append(scores)

    def frame(self) -> pd.DataFrame:
        if not self.a:
            return pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64"})
        return pd.DataFrame({c: np.concatenate(getattr(self, c)) for c in ("a", "b", "score")})


class Held:
    """The K best of each row of the held block, over all that it has met."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.n = floors.copy(), k, 0
        self.parts: list[tuple] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """`scores` has a row for each of `ids` and a column for each held row."""
        others, rows = np.nonzero(scores >= self.floors)
        self.put(rows, ids[others], scores[others, rows])

    def put(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of the rows of these numbers; those below a row's floor are left out."""
        able = (scores >= self.floors[rows]) & np.isfinite(scores)
        rows, ids, scores = rows[able], ids[able], scores[able]
        self.parts.append((rows, ids, scores))
        self.n += len(rows)
        if self.n > WAITING:
            self.cut()

    def cut(self) -> tuple:
        """Keep the K best, the smaller id first among equals; raise the floors of rows that have so many."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, ids, scores = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.floors[rows[last]] = np.maximum(self.floors[rows[last]], scores[last] - 2 * SLACK)
        best = place < self.k
        self.parts = [(rows[best], ids[best], scores[best])]
        # What is kept does not wait.
        self.n = 0
        return self.parts[0]


def block_neighbours(
    rows: DataFrame, n_blocks: int, columns: dict[str, str], index, k: int, lowest: float, folder: str | None = None
) -> DataFrame:
    """(a, b, score): among them each row's K best others; scores below `lowest` do not count.

    `rows` is (id, block, columns); `columns` names arrays of numbers and their numpy kinds. The
    packed blocks are written to `folder`, which the caller may remove once the result is kept. `rows` are
    read once for each portion of the blocks.
    """
    rows = rows.select("id", "block", *columns)
    kinds = list(columns.values())
    names = [f"c{i}" for i in range(len(columns))]
    schema = f"{PACKED}, {', '.join(f'{c} binary' for c in names)}, near_a binary, near_b binary, near_s binary"

    def neighbours(ids: np.ndarray, kept: Held) -> pd.DataFrame:
        found = Found()
        own, others, best = kept.cut()
        found.add(ids[own], others, best)
        return found.frame()

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        block = Block(ids, [pdf[c].tolist() for c in columns], np.full(len(ids), lowest)).sorted_by(ids)
        held, kept = index(block.ids, block.columns), Held(block.floors, k)
        for part, values in block.strips(len(ids)):
            # A row is the first of its own neighbours.
            rows, others, scores = held.reaching(values, block.floors[part], None, k + 1)
            other = part.start + rows != others
            kept.put(part.start + rows[other], block.ids[others[other]], scores[other])
        near = neighbours(block.ids, kept)
        block.floors = kept.floors
        # Rows of like size lie together, so that a strip has many entries or few.
        sizes = np.array([len(x) for x in block.columns[0]])
        row = block.sorted_by(block.ids, sizes).packed(int(pdf["block"].iloc[0]), kinds)
        row |= {f"near_{n}": near[c].to_numpy().tobytes() for n, c in (("a", "a"), ("b", "b"), ("s", "score"))}
        return pd.DataFrame([row])

    def packed(some: DataFrame) -> DataFrame:
        return some.groupBy("block").applyInPandas(alone, schema)

    folder = folder or scratch_path(rows.sparkSession, "blocks")
    for portion in range(PORTIONS):
        write_parts(packed(rows.where(F.col("block") % PORTIONS == portion)), "blocks", folder)

    def unfold(pdfs):
        for pdf in pdfs:
            for a, b, s in zip(pdf["near_a"], pdf["near_b"], pdf["near_s"]):
                yield pd.DataFrame(
                    {"a": np.frombuffer(a, np.int64), "b": np.frombuffer(b, np.int64), "score": np.frombuffer(s)}
                )

    near = parts(packed(rows), folder).select("near_a", "near_b", "near_s").mapInPandas(unfold, PAIR_SCHEMA)
    if n_blocks < 2:
        return near
    n_groups = min(n_blocks, max(GROUPS, -(-n_blocks // GROUP_BLOCKS)))
    # Every two groups, and a group of several blocks with itself.
    pairs = [
        (p, q) for p in range(n_groups) for q in range(p, n_groups) if p < q or n_blocks > n_groups
    ]

    def block(number: int) -> Block | None:
        """A block's rows; numbers may be left out, as one row can fill several blocks' share."""
        found = read_part(folder, number, ["ids", "sizes", "floors", *names]).to_pylist()
        return Block.unpacked(found[0], kinds) if found else None

    def met(pdfs):
        for pdf in pdfs:
            for at in pdf["id"]:
                yield from together(*pairs[at])

    def together(p: int, q: int):
        """Neighbours among the pairs of two groups' blocks."""
        first, second = ([i for i in range(n_blocks) if i * n_groups // n_blocks == g] for g in (p, q))
        guests: dict[int, tuple[np.ndarray, Held]] = {}
        for i in first:
            mine = block(i)
            if mine is None:
                continue
            held, kept = index(mine.ids, mine.columns), Held(mine.floors, k)
            for j in second:
                guest = block(j) if j > i else None
                if guest is None:
                    continue
                theirs = guests.setdefault(j, (guest.ids, Held(guest.floors, k)))[1]
                for part, values in guest.strips(len(mine.ids)):
                    rows, others, scores = held.reaching(values, theirs.floors[part], kept.floors, k)
                    theirs.put(part.start + rows, mine.ids[others], scores)
                    kept.put(others, guest.ids[part][rows], scores)
            yield neighbours(mine.ids, kept)
        for ids, kept in guests.values():
            yield neighbours(ids, kept)

    # A task for each two groups, which weigh alike.
    tasks = rows.sparkSession.range(0, len(pairs), 1, min(len(pairs), MOST_TASKS))
    return near.unionByName(tasks.mapInPandas(met, PAIR_SCHEMA))
