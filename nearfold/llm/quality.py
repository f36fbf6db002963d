"""Document quality by a factorisation machine.

A document is a sparse vector: its words hashed to buckets, its structure
statistics (shares of capitals, signs, repeats, line shapes ...) put in bins, and the bin of
each metadata column. The machine scores it by a bias, a weight for each feature and
low-rank pairwise terms; by the sum-of-squares identity
    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]
a score takes time linear in the document's features.

It is fitted on at most `MOST_ROWS` labelled rows (those with the least hash of the
key, one row a key; the bound is a parameter). Only their sparse vectors reach the driver. Scoring
is one pass over all whole texts with no shuffle. Null and empty texts have all-zero
statistics and are scored like any other. Without labelled rows every score is 0.5. Repeated rows
and null keys are scored like others; a key with both labels counts as 1; other columns are
left out of scores and kept by `keep_good`; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import portions, received, send, ship

ship(__name__)

MOST_ROWS = 8_000
BUCKETS = 8_192
RANK = 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.02, 1e-5, 11
WORD_WEIGHT = 0.5  # the length of a document's word vector; each statistic has length 1

# Statistics and the bounds of their bins.
SHARES = (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8)
SIZES = (1, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384)
STATISTICS = {
    "words": SIZES,
    "lines": SIZES,
    "mean word length": (1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 30),
    "longest word": (5, 10, 15, 20, 30, 50, 100),
    "distinct words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "most frequent word": SHARES,
    "word repeated at once": SHARES,
    "capitals": SHARES,
    "digits": SHARES,
    "signs": SHARES,
    "words ending in a letter": SHARES,
    "words without letters": SHARES,
    "words ending in two signs": SHARES,
    "words in capitals": SHARES,
    "lines repeated": SHARES,
    "mean line length": (5, 10, 20, 40, 80, 160, 320, 640),
    "lines without a stop": SHARES,
    "letters beyond ASCII": SHARES,
}
_NAMES = list(STATISTICS)
METADATA_BINS = tuple(4**i for i in range(12))

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = ~(_LETTER | _DIGIT | _SPACE)


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """In the order of STATISTICS; all zero for a text without words."""
    if not words:
        return [0.0] * len(_NAMES)
    codes = np.frombuffer(raw, np.uint8)
    n, size = len(words), len(codes)
    shape = np.bincount(codes, minlength=256)
    letters = max(1, int(shape[_LETTER].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    space = _SPACE[codes]
    # Positions of each word's last character.
    ends = np.flatnonzero(~space & np.append(space[1:], True))
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    last = codes[ends]
    before = codes[np.maximum(ends - 1, 0)]
    lettered = np.add.reduceat(_LETTER[codes].astype(np.int64), starts)
    capital = np.add.reduceat(_UPPER[codes].astype(np.int64), starts)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        n,
        len(lines),
        float(lengths.mean()),
        float(lengths.max()),
        len(counts) / n,
        max(counts.values()) / n if n > 1 else 0.0,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        int(shape[_UPPER].sum()) / letters,
        int(shape[_DIGIT].sum()) / size,
        int(shape[_SIGN].sum()) / size,
        float(_LETTER[last].mean()),
        float((lettered == 0).mean()),
        float((_SIGN[last] & _SIGN[before] & (lengths > 2)).mean()),
        float(((capital > 1) & (capital == lettered)).mean()),
        1 - len(set(lines)) / len(lines),
        size / len(lines),
        sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        int(shape[128:].sum()) / size,
    ]


class Features:
    """Sparse vectors; feature numbers are fixed by the layout, not by the data."""

    def __init__(self, metadata: int):
        sizes = [len(b) + 1 for b in STATISTICS.values()] + [len(METADATA_BINS) + 2] * metadata
        self.bounds = [np.asarray(b, float) for b in STATISTICS.values()]
        self.starts = (BUCKETS + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(np.int64)
        self.size = BUCKETS + int(sum(sizes))
        self.metadata_bounds = np.asarray(METADATA_BINS, float)

    def of(self, text: str, metadata: list) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode()
        words = raw.lower().split()
        distinct = set(words)
        hashed = np.unique(np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % BUCKETS)
        values = statistics(raw, raw.split())
        bins = [int(np.searchsorted(b, v, "right")) for b, v in zip(self.bounds, values)]
        for m in metadata:
            bins.append(0 if m is None else 1 + int(np.searchsorted(self.metadata_bounds, float(m), "right")))
        at = np.concatenate([hashed, self.starts + bins])
        x = np.ones(len(at))
        x[: len(hashed)] = WORD_WEIGHT / np.sqrt(max(1, len(hashed)))
        return at, x


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        pairs = (x @ v) ** 2 - (x * x) @ (v * v)
        return self.bias + float(x @ self.weights[at]) + 0.5 * float(pairs.sum())


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> Machine:
    """Adam on the log loss, a fixed seed, and the rows in a fixed order."""
    draw = np.random.default_rng(SEED)
    share = (labels.sum() + 1) / (len(labels) + 2)
    weights, factors = np.zeros(size), draw.normal(0, 0.02, (size, RANK))
    if not len(rows):
        return Machine(0.0, weights, np.zeros((size, RANK)))
    theta = [np.array([np.log(share / (1 - share))]), weights, factors]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(EPOCHS):
        for part in np.array_split(draw.permutation(len(rows)), -(-len(rows) // BATCH)):
            x = np.zeros((len(part), size))
            for i, r in enumerate(part):
                x[i, rows[r][0]] = rows[r][1]
            sums, squares = x @ theta[2], x * x
            z = theta[0] + x @ theta[1] + 0.5 * (sums**2 - squares @ theta[2] ** 2).sum(axis=1)
            g = (sigmoid(z) - labels[part]) / len(part)
            slopes = [
                np.array([g.sum()]),
                x.T @ g + DECAY * theta[1],
                x.T @ (g[:, None] * sums) - theta[2] * (squares.T @ g)[:, None] + DECAY * theta[2],
            ]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                theta[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2])


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    metadata: tuple[str, ...] = (),
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_rows: int = MOST_ROWS,
) -> Machine:
    """Fit on at most `most_rows` labelled rows for which `usable` (over the key) holds."""
    asked = labels.where(F.col(label).isin(0, 1))
    if usable is not None:
        asked = asked.where(usable)
    chosen = (
        asked.groupBy(F.col(key).alias("__key"))
        .agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(most_rows)
    )
    layout = Features(len(metadata))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            columns = [c.to_pylist() for c in batch.columns]
            found = [layout.of(t, list(m)) for t, *m in zip(columns[1], *columns[3:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2),
                    pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                    pa.array([len(a) - len(layout.starts) for a, _ in found], pa.int32()),
                ],
                names=["key", "label", "at", "words"],
            )

    kind = docs.schema[key].dataType.simpleString()
    # At most `most_rows` keys with their labels, so the side that is broadcast is bounded.
    chosen = F.broadcast(chosen)
    metas = [f"__meta{i}" for i in range(len(metadata))]
    rows = docs.select(
        F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"),
        *[F.col(m).cast("double").alias(name) for m, name in zip(metadata, metas)],
    ).join(chosen, "__key")
    # Of rows that share a key the one with the least hash stays: a key is a row. Hashes travel, texts do not.
    hashed = rows.withColumn("__hash", F.xxhash64("__text", *metas))
    least = hashed.groupBy("__key").agg(F.min("__hash").alias("__hash"))
    rows = hashed.join(F.broadcast(least), ["__key", "__hash"])
    rows = rows.select("__key", "__text", "__label", *metas)
    got = rows.mapInArrow(extract, f"key {kind}, label int, at array<int>, words int")
    # Rows that are wholly the same are one.
    got = got.groupBy("key", "label").agg(F.min(F.struct("at", "words")).alias("v")).select("key", "label", "v.at", "v.words")
    sample = sorted(((str(r["key"]), list(r["at"]), r["label"], r["words"]) for r in got.toLocalIterator()))
    vectors = []
    for _, at, _, n in sample:
        x = np.ones(len(at))
        x[:n] = WORD_WEIGHT / np.sqrt(max(1, n))
        vectors.append((np.asarray(at, np.int64), x))
    return fit(vectors, np.array([s[2] for s in sample], float), layout.size)


def score_quality(
    docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = (), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id and score, 0 to 1; higher means label 1 is likelier."""
    layout = Features(len(metadata))
    sent = send(docs.sparkSession, machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in portions(batches):
            columns = [c.to_pylist() for c in batch.columns]
            margins = [model.margin(*layout.of(t, list(m))) for t, *m in zip(*columns[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sigmoid(np.array(margins, float)))], names=["doc_id", "score"]
            )

    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *[F.col(m).cast("double").alias(f"meta{i}") for i, m in enumerate(metadata)],
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double")


def keep_good(
    docs: DataFrame, machine: Machine, least: float = 0.5, metadata: tuple[str, ...] = (), text: str = "text"
) -> DataFrame:
    """The rows, as they are, with a score of at least `least`."""
    layout, schema = Features(len(metadata)), docs.schema
    sent = send(docs.sparkSession, machine)
    at, more = docs.columns.index(text), [docs.columns.index(m) for m in metadata]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in portions(batches, at):
            columns = [batch.column(i).to_pylist() for i in (at, *more)]
            margins = [model.margin(*layout.of(t or "", list(m))) for t, *m in zip(*columns)]
            yield batch.filter(pa.array(sigmoid(np.array(margins, float)) >= least))

    return docs.mapInArrow(keep, schema)
