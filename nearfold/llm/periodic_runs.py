"""Periodic runs of words, from longest common extensions on suffix trees.

A run is a stretch of words with a smallest period q that no neighbouring word
extends; reported are those of at least `LEAST_LENGTH` words and `LEAST_TURNS` periods.

For a stretch of words, Ukkonen's algorithm builds the suffix trees of the words and of their
reversal. The common extension of two places, forwards or backwards, is the
depth of the lowest common ancestor of two leaves, which is a range minimum on
the tree's Euler tour. The longest Lyndon word at each place, under the order of the words and its
inverse, ends before the next smaller suffix; every run has one of these as its
root. Each candidate root is extended both ways, and what is long enough is a run.

Trees are only built where runs can be. In a run of length L all but the last q words recur
within q words, so such words stand in an unbroken stretch of at least (turns - 1) * q.
Words that recur too late for the stretch they stand in are left out until
nothing changes; most texts have nothing left. This loses no run.

A row in is a row out and nothing is shuffled. Time is linear in the text (but for sorting words and the range
minima); memory is some 400 bytes for each word of the longest such stretch of one text. Null and empty texts
have no words and no runs; repeated rows and null keys are rows like others; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm.common import id_and_text, portions, ship

ship(__name__)

LEAST_LENGTH, LEAST_TURNS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
ARROW_RUNS = pa.list_(
    pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())])
)


class SuffixTree:
    """Of a sequence of numbers from 1; an end mark 0, less than all, is added."""

    def __init__(self, sequence: list[int]):
        self.text = [*sequence, 0]
        self.n = len(self.text)
        self._build()
        self._children()

    def _build(self) -> None:
        """Ukkonen: `edges` leads from node * width + first symbol to the node below.

        A node's incoming edge is text[start : end]; leaves are open until the end.
        """
        text, n = self.text, self.n
        self.width = width = max(text) + 1
        start, end, link, edges = [0], [0], [0], {}
        node = edge = length = left = 0
        for i, c in enumerate(text):
            left += 1
            waiting = 0
            while left:
                if not length:
                    edge = i
                at = node * width + text[edge]
                child = edges.get(at)
                if child is None:
                    edges[at] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                    waiting = 0
                else:
                    size = min(end[child], i + 1) - start[child]
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if text[start[child] + length] == c:
                        if waiting:
                            link[waiting] = node
                        length += 1
                        break
                    # The edge is split: a new node, with a new leaf and the old child below.
                    split = len(start)
                    edges[at] = split
                    start.append(start[child])
                    end.append(start[child] + length)
                    link.append(0)
                    edges[split * width + c] = split + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[child] += length
                    edges[split * width + text[start[child]]] = child
                    if waiting:
                        link[waiting] = split
                    waiting = split
                left -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.edges = start, end, edges

    def _children(self) -> None:
        """Children of each node, ordered by first symbol, and the depth of each node."""
        n_nodes = len(self.start)
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        below = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        self.edges = {}
        order = np.argsort(keys)
        counts = np.bincount(keys[order] // self.width, minlength=n_nodes)
        self.first_child = np.concatenate([[0], np.cumsum(counts)]).tolist()
        self.child = below[order].tolist()

    def tour(self) -> None:
        """Euler tour: the depth at each step, and the step at which each suffix's leaf is met."""
        n, start, end, first, child = self.n, self.start, self.end, self.first_child, self.child
        depths, met = [], [0] * n
        depth = [0] * len(start)
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                depths.append(depth[~v])
                continue
            here = depth[v]
            a, b = first[v], first[v + 1]
            if a == b:
                met[n - here] = len(depths)
            else:
                for c in child[a:b][::-1]:
                    depth[c] = here + end[c] - start[c]
                    stack.append(~v)
                    stack.append(c)
            depths.append(here)
        self.depths, self.met = np.array(depths, np.int32), np.array(met, np.int64)

    def inverse_ranks(self) -> np.ndarray:
        """Of each suffix under the inverse order of symbols; the end mark stays the least."""
        n, text, start, end, first, child = self.n, self.text, self.start, self.end, self.first_child, self.child
        ranks, count = [0] * n, 0
        stack = [(0, 0)]
        while stack:
            v, here = stack.pop()
            a, b = first[v], first[v + 1]
            if a == b:
                ranks[n - here] = count
                count += 1
                continue
            # The last on the stack comes first: ascending symbols, but the end mark on top.
            below = child[a:b]
            if text[start[below[0]]] == 0:
                below = below[1:] + below[:1]
            for c in below:
                stack.append((c, here + end[c] - start[c]))
        return np.array(ranks, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes a and b (a != b), each in constant time.

        The table of range minima is made level by level; each level answers the
        queries of its length and is then replaced by the next.
        """
        low, high = np.minimum(self.met[a], self.met[b]), np.maximum(self.met[a], self.met[b]) + 1
        level = np.floor(np.log2(np.maximum(high - low, 1))).astype(np.int64)
        out, table, k = np.zeros(len(a), np.int64), self.depths, 0
        while True:
            asked = np.flatnonzero(level == k)
            if len(asked):
                out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k)])
            if not len(level) or k >= level.max():
                return out
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
            k += 1


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each place the next one with a lower rank; the end, if there is none."""
    values, n = ranks.tolist(), len(ranks)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, v = i + 1, values[i]
        while j < n and values[j] > v:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(sequence: list[int], least_length: int = LEAST_LENGTH, least_turns: int = LEAST_TURNS) -> np.ndarray:
    """(start, length, period) of each run of a sequence of numbers from 1, by start, then period."""
    n = len(sequence)
    if n < least_length:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(sequence)
    tree.tour()
    places = np.arange(n)
    # The end mark's suffix is the least under both orders and ends the last Lyndon words.
    roots = [(places, next_smaller(r[:n]) - places) for r in (tree.met, tree.inverse_ranks())]
    at, period = np.concatenate([r[0] for r in roots]), np.concatenate([r[1] for r in roots])
    fit = period * least_turns <= n
    both = np.unique(at[fit] * (n + 1) + period[fit])
    at, period = both // (n + 1), both % (n + 1)
    forward, backward = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    inner = at + period < n
    forward[inner] = tree.common(at[inner], at[inner] + period[inner])
    del tree
    turned = SuffixTree(sequence[::-1])
    turned.tour()
    inner = at > 0
    backward[inner] = turned.common(n - at[inner] - period[inner], n - at[inner])
    start, length = at - backward, period + forward + backward
    long = length >= np.maximum(least_length, least_turns * period)
    found = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    return found[:, [0, 2, 1]]


def stretches(nearest: np.ndarray, least_length: int, least_turns: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches that may hold all but the last period of a run.

    `nearest` is how far on each word stands again, or a large number. In a run of period q such a stretch has
    at least max(least_length - q, (least_turns - 1) * q) words and each recurs within q words.
    """
    factor = least_turns - 1
    least = min(max(least_length - q, factor * q) for q in range(1, least_length + 1))
    at = np.flatnonzero(nearest < 1 << 30)
    while len(at):
        new = np.append(True, at[1:] != at[:-1] + 1)
        number = np.cumsum(new) - 1
        size = np.bincount(number)[number]
        keep = (size >= least) & (factor * nearest[at] <= size)
        if keep.all():
            first = np.flatnonzero(new)
            return at[first], at[np.append(first[1:], len(at)) - 1] + 1
        at = at[keep]
    return at, at


def document_runs(
    codes: np.ndarray, sizes: np.ndarray, least_length: int = LEAST_LENGTH, least_turns: int = LEAST_TURNS
) -> list[np.ndarray]:
    """The runs of each document; `codes` are all documents' words as numbers, `sizes` their counts."""
    n, ends = len(codes), np.cumsum(sizes)
    nothing = np.zeros((0, 3), np.int64)
    out = [nothing] * len(sizes)
    if not n:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    same = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(same, kind="stable")
    again = same[order[1:]] == same[order[:-1]]
    nearest = np.full(n, 1 << 40, np.int64)
    nearest[order[:-1][again]] = (order[1:] - order[:-1])[again]
    first, last = stretches(nearest, least_length, least_turns)
    found: dict[int, list[np.ndarray]] = defaultdict(list)
    # A run goes on for one period after its stretch; stretches that then meet are searched as one.
    reach = np.minimum(last + (last - first) // (least_turns - 1), ends[owner[first]] if len(first) else last)
    i = 0
    while i < len(first):
        start, end, doc = int(first[i]), int(reach[i]), int(owner[first[i]])
        i += 1
        while i < len(first) and first[i] < end and owner[first[i]] == doc:
            end = max(end, int(reach[i]))
            i += 1
        _, numbers = np.unique(codes[start:end], return_inverse=True)
        runs = runs_of((numbers + 1).tolist(), least_length, least_turns)
        runs[:, 0] += start
        begin, stop, period = runs[:, 0], runs[:, 0] + runs[:, 1], runs[:, 2]
        # Parts of runs that go on beyond what was searched are found whole elsewhere.
        low, high = int(ends[doc] - sizes[doc]), int(ends[doc])
        before, after = np.maximum(begin - 1, low), np.minimum(stop, high - 1)
        longer = (begin > low) & (codes[before] == codes[before + period])
        longer |= (stop < high) & (codes[after] == codes[after - period])
        whole = runs[~longer]
        whole[:, 0] -= low
        found[doc].append(whole)
    for doc, parts in found.items():
        every = np.unique(np.concatenate(parts)[:, [0, 2, 1]], axis=0)
        out[doc] = every[:, [0, 2, 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words are in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def find_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_turns: int = LEAST_TURNS,
) -> DataFrame:
    """Per row: doc_id, n_words, `runs` (start, length, period; by start, then period) and `collapsed`.

    Words are what stands between ASCII white space. `collapsed` has the words that are in no run
    after its first period, joined by single spaces.
    """
    if least_turns < 2 or least_length < 2:
        raise ValueError("runs have at least two words and two turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            split = [t.encode().split() for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            codes = np.fromiter((number[w] for words in split for w in words), np.int64, int(sizes.sum()))
            runs = document_runs(codes, sizes, least_length, least_turns)
            collapsed = []
            for words, found in zip(split, runs):
                if len(found):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                collapsed.append(b" ".join(words).decode())
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            every = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            items = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=list(ARROW_RUNS.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = id_and_text(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
