"""Byte-level BPE by corpus-level merge replay, and back.

A task takes its texts in portions of bounded size. The distinct words of a portion lie in one
array of symbols, at first their bytes. An inverted index leads from each
mergeable pair (by the rank of what it merges to) to the positions where it stands. The merges are
replayed in rank order, each one for all its positions at once; only the two
pairs next to a merged one are looked up again and filed. A document's ids are
then gathered from its words'.

That gives what merging each word by itself gives, unless a merge makes a pair of a lower
rank than its own; words where that happens are merged once more by themselves.
A word that is a token is that token, whatever the merges would make of it.

Nothing is shuffled, a row in is a row out, and work grows with the texts. A task holds
the distinct words of one portion (`PORTION` characters of text, or one longer text).
Null and empty texts have no ids, null ids no bytes; repeated rows and null keys are
rows like others, other columns are left out, an empty table gives no rows. An id
that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm.common import gathered, give_back_memory, id_and_text, portions, received, send, ship

ship(__name__)

# Characters whose distinct words are merged together, and after which a long text may be cut.
PORTION, PIECE = 8_000_000, 1_000_000
# Ids in a batch that leaves a task.
BATCH_IDS = 1_000_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: each line has a token in base64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary's tokens and which pairs of them merge to which."""

    def __init__(self, ranks: dict[bytes, int]):
        single = [ranks.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("the ranks lack a single byte")
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_ids = np.array(single, np.int32)
        pairs = [
            (a * self.size + b, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None
        ]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs] + [2**62], np.int64)
        self.merged = np.array([r for _, r in pairs] + [NONE], np.int32)
        grid = np.repeat(self.bytes_ids, 256), np.tile(self.bytes_ids, 256)
        self.byte_pairs = self.rank_of(*grid)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair merges to, or NONE; -1 stands for no symbol."""
        asked = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pairs, asked)
        return np.where((self.pairs[at] == asked) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def word(self, word: bytes) -> list[int]:
        """One word merged by itself: again and again the first pair of the least rank."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's begin (one more at the end)."""
        known = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        rest = [w for w, k in zip(words, known.tolist()) if k < 0]
        ids, starts = self._merge_all(rest)
        sizes = np.ones(len(words), np.int64)
        sizes[known < 0] = np.diff(starts)
        out_starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        out = np.empty(out_starts[-1], np.int32)
        is_known = np.repeat(known >= 0, sizes)
        out[is_known] = known[known >= 0]
        out[~is_known] = ids
        return out, out_starts

    def _merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, ends = len(raw), np.cumsum(sizes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        # Position n stands for no neighbour.
        symbol = np.append(self.bytes_ids[raw], np.int32(-1))
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends[sizes > 0] - 1] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[(ends - sizes)[sizes > 0]] = n
        live = np.ones(n + 1, bool)
        pair = np.full(n + 1, NONE, np.int32)
        pair[: n - 1] = self.byte_pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        pair[ends[sizes > 0] - 1] = NONE

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(spots: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist()
            for rank, start, end in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(spots)]):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(spots[start:end])

        filed = np.flatnonzero(pair != NONE).astype(np.int32)
        if len(filed):
            file(filed, pair[filed])
        odd: list[np.ndarray] = []
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            spots = lists[0] if len(lists) == 1 else np.concatenate(lists)
            spots = spots[pair[spots] == rank]
            if not len(spots):
                continue
            spots.sort()
            gone = after[spots]
            chained = spots[1:] == gone[:-1]
            if chained.any():
                # Of pairs that overlap in a row the first, the third ... are merged.
                first = np.append(True, ~chained)
                place = np.arange(len(spots))
                turn = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
                spots, gone = spots[turn], gone[turn]
            then = after[gone]
            # Merged one at a time, the first of two neighbours would meet the second's left part.
            close = np.flatnonzero(then[:-1] == spots[1:])
            if len(close):
                meets = self.rank_of(np.full(len(close), rank), symbol[then[close]])
                if meets.min() < rank:
                    odd.append(spots[close[meets < rank]])
            symbol[spots] = rank
            after[spots] = then
            before[then] = spots
            prior = before[spots]
            live[gone], pair[gone] = False, NONE
            touched = np.concatenate([spots, prior[(prior < n) & (symbol[prior] != rank)]])
            ranks = self.rank_of(symbol[touched], symbol[after[touched]])
            pair[touched] = ranks
            there = ranks != NONE
            if there.any():
                touched, ranks = touched[there], ranks[there]
                if ranks.min() < rank:
                    odd.append(touched[ranks < rank])
                file(touched, ranks)

        live[n] = False
        counts = np.add.reduceat(live[:n].astype(np.int64), (ends - sizes)[sizes > 0])
        kept = np.zeros(len(words), np.int64)
        kept[sizes > 0] = counts
        ids, starts = symbol[:n][live[:n]], np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        if not odd:
            return ids, starts
        again = np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist()
        each = np.split(ids, starts[1:-1])
        for w in again:
            each[w] = np.array(self.word(words[w]), np.int32)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)


def pieces(text: str, cut) -> Iterator[str]:
    """A long text in parts that end between two words, where the pattern surely has an end too."""
    at = 0
    while len(text) - at > PIECE:
        found = cut.search(text, at + PIECE)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and `ids ARRAY<INT>`. `pattern` (of the regex library) cuts texts into words.

    The vocabulary is broadcast; its size does not depend on the texts. `pattern` must end a word
    where a letter, a space and a letter follow each other.
    """
    sent = send(docs.sparkSession, Merges(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        merges, words, cut = received(sent), regex.compile(pattern), regex.compile(r"\p{L}(?= \p{L})")
        number: defaultdict[str, int] = defaultdict()
        keys: list[pa.Array] = []
        texts: list[np.ndarray] = []
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            flat, starts = merges.replay([w.encode() for w in number])
            known, at = pa.concat_arrays(keys), 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= BATCH_IDS):
                    n += len(texts[end])
                    end += 1
                ids, sizes = gathered(flat, starts, np.concatenate(texts[at:end]))
                total = np.concatenate([[0], np.cumsum(sizes)])
                ends = np.cumsum([0, *map(len, texts[at:end])])
                lists = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([known.slice(at, end - at), lists], names=["doc_id", "ids"])
                at = end

        number.default_factory = number.__len__
        for batch in portions(batches):
            keys.append(batch.column(0))
            for t in batch.column(1).to_pylist():
                found = [np.fromiter(map(number.__getitem__, part), np.int32, len(part))
                         for part in map(words.findall, pieces(t, cut))]
                texts.append(np.concatenate(found) if len(found) > 1 else found[0])
                size += len(t)
            if size >= PORTION:
                yield from merged()
                number.clear()
                keys, texts, size = [], [], 0
        if keys:
            yield from merged()
        give_back_memory()

    rows = id_and_text(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """The rows with one more column `decoded BINARY`, the bytes of the ids."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    sent, at = send(encoded.sparkSession, pa.array(tokens, pa.binary())), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = received(sent)
        for whole in batches:
            lists = whole.column(at)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < whole.num_rows:
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + BATCH_IDS, "right")))
                batch = whole.slice(start, end - start)
                part = batch.column(at)
                found = vocabulary.take(part.flatten())
                offsets = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4)
                sizes = np.concatenate([[0], ends[start:end] - before]).astype(np.int64)
                data = found.buffers()[2] or pa.py_buffer(b"")
                decoded = pa.Array.from_buffers(
                    pa.binary(), len(batch), [None, pa.py_buffer(offsets[sizes].astype(np.int32)), data]
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])
                start = end

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")
