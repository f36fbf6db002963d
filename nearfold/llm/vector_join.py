"""Exact near-duplicate vectors: a metric range join over pivots.

The angle between two vectors is a metric, and cosine >= c means angle <= e.

1. Equal vectors are one class, found by hash; only classes are compared.
2. A bounded number of classes, drawn by hash, are pivots. A vector's home is the cell of
   its nearest pivot.
3. Let x have its home at pivot h. A vector y of cell c can only be within e of x if
   angle(x, c) <= angle(x, h) + 2e (else y would be nearer to h) and angle(x, c) <= e + radius(c).
   Where both hold, x is copied to c; of two cells only the lower gets the copy, so
   each pair is compared once.
4. A cell's residents are cut into blocks and its copies into chunks, so a cell
   that holds a third of all vectors is many tasks of bounded size, which run independently.
5. A task multiplies its residents with the rest in double precision and returns a count for
   each vector and a spanning forest of its links, never all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
rows without an id. Shorter vectors count as ending in zeros. Rows that share an id share their links.
In spaces where angles to pivots are all alike nothing can be excluded, and the work is
that of comparing all classes; it stays cut into tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import ship
from nearfold.llm.components import components
from nearfold.scale import stable

ship(__name__)

COSINE = 0.95
# Classes for each pivot, and the most pivots: they are sent to every task.
CELL_ROWS, MOST_PIVOTS = 2_048, 1_024
# Residents of a block and copies of a chunk, on average.
BLOCK_ROWS, CHUNK_ROWS = 2_048, 8_192
STRIP = 512
# More than the rounding of an angle; bounds are widened by it.
SLACK = 1e-6


def _matrix(raw, dim: int) -> np.ndarray:
    rows = [np.frombuffer(r, "<f8") for r in raw]
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _units(m: np.ndarray) -> np.ndarray:
    """Scaled first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Links:
    """Counts and a spanning forest of the links between residents and others."""

    def __init__(self, cosine: float, ids: np.ndarray, weights: np.ndarray, units: np.ndarray):
        self.cosine, self.ids, self.weights, self.units = cosine, ids, weights.astype(float), units
        self.label = np.arange(len(ids))
        self.counts = np.zeros(len(ids))

    def _join_rows(self, linked: np.ndarray) -> None:
        """Unite the residents that a row of `linked` has in common."""
        for row in np.flatnonzero(linked.any(axis=1)):
            here = self.label[linked[row]]
            least = here.min()
            if here.max() != least:
                self.label[np.isin(self.label, here)] = least

    def within(self) -> None:
        for at in range(0, len(self.ids), STRIP):
            linked = self.units[at : at + STRIP] @ self.units.T >= self.cosine
            rows = np.arange(len(linked))
            linked[rows, at + rows] = False
            self.counts[at : at + STRIP] += linked @ self.weights
            linked[rows, at + rows] = linked.any(axis=1)
            self._join_rows(linked)

    def against(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, list]:
        """Counts of the others, and a link for each of them that has any."""
        counts, edges = np.zeros(len(ids)), []
        for at in range(0, len(ids), STRIP):
            linked = units[at : at + STRIP] @ self.units.T >= self.cosine
            counts[at : at + STRIP] = linked @ self.weights
            self.counts += weights[at : at + STRIP].astype(float) @ linked
            self._join_rows(linked)
            some = np.flatnonzero(linked.any(axis=1))
            edges += zip(ids[at + some].tolist(), self.ids[linked[some].argmax(axis=1)].tolist())
        return counts, edges

    def forest(self) -> list:
        moved = np.flatnonzero(self.label != np.arange(len(self.ids)))
        return list(zip(self.ids[moved].tolist(), self.ids[self.label[moved]].tolist()))


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    key: str = "vec_id",
    vector: str = "embedding",
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = (
        F.col(key).isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = stable(
        vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
        .select("id", F.when(F.col("fine"), F.col("v")).alias("v"), "fine")
        .withColumn("h", F.when(F.col("fine"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    )
    classes = stable(
        rows.where("fine").groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    )
    reps = rows.where("fine").join(
        classes.select("h", F.col("rep").alias("id"), "weight"), ["h", "id"]
    ).dropDuplicates(["h"])
    seen = reps.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, dim = seen[0], seen[1] or 1
    if not n:
        return rows.select(
            F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"),
        )
    n_pivots = max(1, min(MOST_PIVOTS, -(-n // cell_rows)))
    drawn = reps.orderBy(F.xxhash64(F.lit(5), "h"), "h").select("v").limit(n_pivots).collect()  # bounded
    pivots = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        pivots[i, : len(r["v"])] = r["v"]
    pivots = _units(pivots)
    reach = float(np.arccos(cosine)) + SLACK

    def angles(raw: list, step: int = 2_000) -> Iterator[np.ndarray]:
        for at in range(0, len(raw), step):
            yield np.arccos(np.clip(_units(_matrix(raw[at : at + step], dim)) @ pivots.T, -1, 1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(x, "<f8").tobytes() for x in batch.column(2).to_pylist()]
            found = np.concatenate([*angles(raw), np.zeros((0, len(pivots)))])
            home = found.argmin(axis=1) if len(found) else np.zeros(0, np.int64)
            near = found[np.arange(len(found)), home]
            # Lower cells the triangle inequality of the bisector does not rule out.
            others = [np.flatnonzero(f[:h] <= d + 2 * reach) for f, h, d in zip(found, home, near)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(home.astype(np.int64)),
                    pa.array(near), pa.array([o.astype(np.int64) for o in others], pa.list_(pa.int64())),
                    pa.array([f[o] for f, o in zip(found, others)], pa.list_(pa.float64())),
                ],
                names=["rep", "weight", "raw", "home", "near", "others", "far"],
            )

    settled = stable(
        reps.select(F.col("id").alias("rep"), "weight", "v").mapInArrow(
            settle, "rep long, weight long, raw binary, home long, near double, others array<long>, far array<double>"
        )
    )
    # One row for each cell, at most MOST_PIVOTS.
    homes = {r["home"]: r for r in settled.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("radius")).collect()}
    limit = F.create_map(*[x for c, r in homes.items() for x in (F.lit(c), F.lit(r["radius"] + reach))])
    placed = settled.withColumn(
        "others",
        F.transform(
            F.filter(F.arrays_zip("others", "far"), lambda o: o["far"] <= limit[o["others"]]), lambda o: o["others"]
        ),
    )
    arrivals = {r["c"]: r["count"] for r in placed.select(F.explode("others").alias("c")).groupBy("c").count().collect()}
    cells = []
    for c, r in sorted(homes.items()):
        blocks = -(-r["n"] // block_rows)
        # A block meets the cell's copies and the residents of the blocks after it.
        others = arrivals.get(c, 0) + r["n"] * (blocks > 1)
        cells += [F.lit(c), F.struct(F.lit(blocks).alias("blocks"), F.lit(max(1, -(-others // chunk_rows))).alias("chunks"))]
    plan = F.create_map(*cells)

    def spot(salt: int, n):
        return F.pmod(F.xxhash64(F.lit(salt), "rep"), n).cast("int")

    at_home = placed.withColumn("p", plan[F.col("home")]).withColumn("block", spot(8, F.col("p.blocks")))
    residents = at_home.select(
        "rep", "weight", "raw", F.col("home").alias("cell"), "block",
        F.explode(F.sequence(F.lit(0), F.col("p.chunks") - 1)).alias("chunk"), F.lit(True).alias("resident"),
    )
    later = at_home.where("block > 0").select(
        "rep", "weight", "raw", F.col("home").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"),
        spot(9, F.col("p.chunks")).alias("chunk"), F.lit(False).alias("resident"),
    )
    guests = (
        placed.select("rep", "weight", "raw", F.explode("others").alias("cell"))
        .withColumn("p", plan[F.col("cell")])
        .select(
            "rep", "weight", "raw", "cell", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("block"),
            spot(9, F.col("p.chunks")).alias("chunk"), F.lit(False).alias("resident"),
        )
    )

    def compare(where: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        here = frame["resident"].to_numpy(bool)
        units = _units(_matrix(frame["raw"], dim))
        ids, weights = frame["rep"].to_numpy(), frame["weight"].to_numpy()
        links = Links(cosine, ids[here], weights[here], units[here])
        if where[2] == 0:
            links.within()
        counts, edges = links.against(ids[~here], weights[~here], units[~here])
        edges += links.forest()
        some, own = np.flatnonzero(counts), np.flatnonzero(links.counts)
        nodes = np.concatenate([ids[~here][some], links.ids[own]])
        sums = np.concatenate([counts[some], links.counts[own]]).astype(np.int64)
        a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        return pd.DataFrame(
            {
                "a": np.concatenate([nodes, a]),
                "b": np.concatenate([nodes, b]),
                "n": np.concatenate([sums, np.zeros(len(edges), np.int64)]),
            }
        )

    met = residents.unionByName(later).unionByName(guests)
    found = stable(met.groupBy("cell", "block", "chunk").applyInPandas(compare, "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    linked = components(found.where("a != b")).select(F.col("node").alias("rep"), "component")
    known = classes.join(counts, "rep", "left").join(linked, "rep", "left").select(
        "h", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        F.coalesce("component", "rep").alias("component"),
    )
    return rows.select("id", "h").join(known, "h", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
