"""Secrets: known forms, and strings that look more random than like an identifier.

First-order Markov models over characters, one for random strings of each common alphabet and
two for ordinary ones, give a candidate's log-likelihood ratio: the best random model against
the mean of the ordinary ones. From `LEAST_TOTAL` in all and `LEAST_MEAN` a step it
is reported as `random`.

The models are trained from labelled samples: random are seeded strings over each alphabet;
ordinary are identifiers and paths (`secret_samples`), and all runs of the corpus's texts outside
known secrets. Pairs of characters that the sample hardly has are judged by their
kinds (lower case, upper case, digits, signs), those that the corpus hardly has by the sample. Each task sums its texts to one small matrix of
counts, so what is gathered does not grow with a text, a key or the corpus
beyond one matrix a task, which Spark adds up.

Scanning is one pass; a row in, a row out. Null and empty texts have no spans; repeated rows and null keys are
rows like others; other columns are left out; an empty table gives no rows, and models from the samples alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import id_and_text, portions, ship
from nearfold.llm.secret_samples import ALPHABETS, ordinary_sample, random_sample
from nearfold.llm.spans import ARROW_SPANS, SPANS, Taken

ship(__name__)

BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("random",)
# The known forms.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.6
# How many times a pair's kinds count as against the pair itself.
PRIOR = 20.0

_CODES = np.full(256, SIZE, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i


def base_matches(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and non-overlapping for each kind."""
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                yield "assign", m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= LEAST_ACCESS:
                yield "access", m.start(), m.end(), m[0]
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end(), m[0]


def transitions(raw: bytes) -> np.ndarray:
    """Counts of neighbouring characters of the alphabet, as one flat matrix."""
    codes = _CODES[np.frombuffer(raw, np.uint8)]
    here, after = codes[:-1], codes[1:]
    both = (here < SIZE) & (after < SIZE)
    return np.bincount(here[both] * SIZE + after[both], minlength=SIZE * SIZE)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


KINDS = np.eye(4)[[_kind(c) for c in ALPHABET]]


def log_probabilities(counts: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Of the next character: what was seen, and `PRIOR` times what is expected.

    That is, if nothing else is given, what is seen after such a kind of character.
    """
    table = counts.reshape(SIZE, SIZE).astype(float)
    if expected is None:
        expected = _by_kinds(table)
    return np.log((table + PRIOR * expected) / (table.sum(axis=1, keepdims=True) + PRIOR))


def _by_kinds(table: np.ndarray) -> np.ndarray:
    kinds = KINDS.T @ table @ KINDS + 1
    kinds /= kinds.sum(axis=1, keepdims=True)
    within = table.sum(axis=0) + 1
    within /= KINDS @ (KINDS.T @ within)
    return (KINDS @ kinds @ KINDS.T) * within


def uniform_log_probabilities(alphabet: str) -> np.ndarray:
    """Trained on random strings of one alphabet; other characters are a tenth of a percent."""
    counts = transitions(" ".join(random_sample(alphabet)).encode()).reshape(SIZE, SIZE)
    inside = np.array([c in alphabet for c in ALPHABET])
    table = counts + PRIOR * inside / inside.sum()
    table = 0.999 * table / table.sum(axis=1, keepdims=True) + 0.001 / SIZE
    return np.log(table)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The log-likelihood ratio of each transition for each alphabet, random over ordinary, from all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = np.zeros(SIZE * SIZE, np.int64)
        for batch in portions(batches):
            for t in batch.column(1).to_pylist():
                values = [m[3] for m in base_matches(t)]
                ordinary += transitions(t.encode())
                if values:
                    ordinary -= transitions(" ".join(values).encode())
        at = np.flatnonzero(ordinary > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ordinary[at])], names=["step", "n"])

    rows = id_and_text(docs, key, text).mapInArrow(count, "step int, n long")
    seen = np.zeros(SIZE * SIZE)
    for r in rows.groupBy("step").agg(F.sum("n").alias("n")).collect():  # at most one row for each pair of characters
        seen[r["step"]] = r["n"]
    return ratios_against(seen)


def ratios_against(seen: np.ndarray) -> np.ndarray:
    """Each alphabet's log-likelihood ratios against the ordinary models, one of them of these counts."""
    sampled = log_probabilities(transitions(" ".join(ordinary_sample()).encode()))
    ordinary = np.logaddexp(sampled, log_probabilities(seen, np.exp(sampled))) - np.log(2)
    return np.stack([uniform_log_probabilities(a) - ordinary for a in ALPHABETS.values()])


def judged(candidate: str, ratios: np.ndarray) -> tuple[float, float]:
    """Log-likelihood ratio in all and a step, under the alphabet that fits best."""
    codes = _CODES[np.frombuffer(candidate.encode(), np.uint8)]
    total = float(ratios[:, codes[:-1], codes[1:]].sum(axis=1).max())
    return total, total / (len(codes) - 1)


def secret_spans(text: str, ratios: np.ndarray) -> list[dict]:
    """All spans, by start, then kind as listed."""
    found = [
        {"kind": kind, "start": start, "end": end, "text": text[start:end], "score": 1.0}
        for kind, start, end, _ in base_matches(text)
    ]
    taken = Taken(found)
    for m in CANDIDATE.finditer(text):
        if taken.free(m.start(), m.end()):
            total, mean = judged(m[0], ratios)
            if total >= LEAST_TOTAL and mean >= LEAST_MEAN:
                score = round(float(1 - np.exp(-mean)), 6)
                found.append({"kind": "random", "start": m.start(), "end": m.end(), "text": m[0], "score": score})
    place = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
    return sorted(found, key=lambda s: (s["start"], place[s["kind"]]))


def find_secrets(docs: DataFrame, ratios: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and `spans` (kind, start, end, text, score), by start, then kind as listed."""
    ratios = train(docs, key, text) if ratios is None else ratios

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            spans = [secret_spans(t, ratios) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, ARROW_SPANS)], names=["doc_id", "spans"]
            )

    rows = id_and_text(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans {SPANS}")
