"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Index. Test items are cut into units of at most UNIT words, and units with the same common words are put side by side. A term's contribution to a unit is
its BM25 weight over the unit's own score, so a passage that holds all of a unit's
terms scores 1 and one threshold serves all. Units are put in blocks of BLOCK. A term has a list of the blocks that
hold it, with its largest contribution in each, and behind each block its contributions to the units; its largest contribution
of all is known too. All are flat arrays over what occurs, so an index takes some 40 bytes for each word of the items.

Search, block-max WAND over many passages at once. Passages are 2 * UNIT words, one from every
UNIT words on, so each run of UNIT words is whole in one. A passage's terms are put in the order of their largest contributions; those before the pivot, where
their sum reaches the threshold, cannot lift a unit over it by themselves. Only blocks in the lists from the pivot on are met; a
block goes on if its maxima and all that lies before the pivot could reach the threshold, the lists before the pivot are
opened for passages that have such blocks, and where the sum of the block's maxima still reaches it, the units are scored. All
units that reach the threshold are retrieved. Passages go in strips of bounded numbers of list entries and sums.

Check. An item's answer is given in a column of its own, or is its last sentence (with one
sentence: its last third). A hit stands when the passage and its surroundings hold enough of the word
triples of both question and answer.

Documents are read once and not shuffled. The index is collected only behind a check of its size: above
MOST_INDEX bytes of item text it is built and applied in several parts. BM25 counts (documents, frequencies, mean
length) are over all units. Null and empty texts and items match nothing. Equal items are all reported, also
those without an id. Ids of documents and items may be of any simple type; other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfold.llm.common import portions, received, send, ship
from nearfold.scale import stable

ship(__name__)

UNIT, BLOCK = 64, 8
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
TRIPLE = 3
# Bytes of item text in one part of the index.
MOST_INDEX = 8_000_000
# List entries, and sums of a passage and a block, that a strip of passages may take.
MOST_ENTRIES = 2_000_000
# Sums of rounded maxima may lie this much too low.
SLACK = 1e-4

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str, answer: str | None = None) -> tuple[list[str], list[str]]:
    """Words of both. A single sentence is split two thirds to one."""
    if answer is not None:
        return words_of(text), words_of(answer)
    parts = [w for w in map(words_of, SENTENCE.findall(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def triples(words: list[str]) -> set[tuple]:
    """All runs of three words; the whole of fewer."""
    if not words:
        return set()
    n = min(TRIPLE, len(words))
    return set(zip(*(words[i:] for i in range(n))))


def spans(starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lists with these numbers one after the other, and the size of each."""
    sizes = starts[numbers + 1] - starts[numbers]
    ends = np.cumsum(sizes)
    return np.repeat(starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


@dataclass
class Index:
    """One part. Terms are numbered by `tops`, their largest contributions.

    Term t's list is at lists[t] to lists[t + 1] of `blocks` and `maxima`; what the list's entry e holds
    for single units is at inner[e] to inner[e + 1] of `units` and `weights`.
    """

    terms: dict[str, int]
    tops: np.ndarray
    lists: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    inner: np.ndarray
    units: np.ndarray
    weights: np.ndarray
    owners: list[int]
    items: list[tuple]

    @classmethod
    def build(cls, items: list[tuple], frequencies: dict[str, int], n_units: int, mean: float) -> "Index":
        """`items`: (id, text, answer). `frequencies`: units that hold each term, over all parts."""
        units, owners = [], []
        for i, (_, text, answer) in enumerate(items):
            question, reply = question_and_answer(text, answer)
            words = question + reply
            for at in range(0, len(words), UNIT):
                units.append(Counter(words[at : at + UNIT]))
                owners.append(i)
        # Units of one language share their most common words; in blocks of like units maxima are tight.
        common = [sorted(u, key=lambda t: (-frequencies[t], t))[:3] for u in units]
        order = sorted(range(len(units)), key=lambda u: (common[u], u))
        names = {t: k for k, t in enumerate(sorted({t for u in units for t in u}))}
        term, weight = array("q"), array("d")
        for u in order:
            size = K1 * (1 - B + B * sum(units[u].values()) / mean)
            share = {t: _idf(frequencies[t], n_units) * f * (K1 + 1) / (f + size) for t, f in units[u].items()}
            whole = sum(share.values())
            term.extend(names[t] for t in share)
            weight.extend(s / whole for s in share.values())
        term, weight = np.array(term, np.int64), np.array(weight, np.float64)
        unit = np.repeat(np.arange(len(order)), [len(units[u]) for u in order])
        tops = np.zeros(len(names))
        np.maximum.at(tops, term, weight)
        by_top = np.argsort(tops, kind="stable")
        number = np.empty_like(by_top)
        number[by_top] = np.arange(len(by_top))
        placed = np.lexsort((unit, number[term]))
        term, unit, weight = number[term][placed], unit[placed], weight[placed]
        block = unit // BLOCK
        entry = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        return cls(
            {t: int(number[k]) for t, k in names.items()},
            tops[by_top],
            np.searchsorted(term[entry], np.arange(len(names) + 1)),
            block[entry].astype(np.int32),
            np.maximum.reduceat(weight, entry).astype(np.float32),
            np.append(entry, len(term)).astype(np.int64),
            unit.astype(np.int32),
            weight,
            [owners[u] for u in order],
            items,
        )

    def search(self, numbers: np.ndarray, threshold: float, opens: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
        """(passage, unit, score) of all that reach the threshold; -1 is a word of no item.

        `numbers` may hold several texts, each filled up to a multiple of UNIT; `opens` then tells
        of each UNIT words whether a text begins there.
        """
        known = np.flatnonzero(numbers >= 0)
        if not len(known):
            return
        size = len(self.terms)
        # A word is in the passage that begins with its half and in the one before; each term once for each passage.
        half, held_by = known // UNIT, numbers[known]
        second = half > 0 if opens is None else ~opens[half]
        pairs = np.concatenate([half * size + held_by, (half[second] - 1) * size + held_by[second]])
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        passage, term = pairs // size, pairs % size
        starts = np.append(np.flatnonzero(np.append(True, passage[1:] != passage[:-1])), len(passage))
        # Terms ascend by their largest contribution, so a running sum finds the pivot.
        reach = np.append(0.0, np.cumsum(self.tops[term]))
        past = reach[1:] - np.repeat(reach[starts[:-1]], np.diff(starts)) >= threshold - SLACK
        n_blocks = -(-len(self.owners) // BLOCK)
        work = np.append(0, np.cumsum(self.lists[term + 1] - self.lists[term]))[starts]
        at, last = 0, len(starts) - 1
        while at < last:
            by_work = int(np.searchsorted(work, work[at] + MOST_ENTRIES, "right")) - 1
            end = min(last, max(at + 1, min(by_work, at + MOST_ENTRIES // n_blocks)))
            mine = slice(starts[at], starts[end])
            sizes = np.diff(starts[at : end + 1])
            for p, unit, score in self._strip(term[mine], past[mine], sizes, n_blocks, threshold):
                yield int(passage[starts[at + p]]), unit, score
            at = end

    def _strip(self, term: np.ndarray, past: np.ndarray, sizes: np.ndarray, n_blocks: int, threshold: float):
        """Hits of some passages, whose terms follow one another; `past` tells those from the pivot on."""
        if not past.any():
            return
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)

        def sums(chosen: np.ndarray) -> np.ndarray:
            entries, lengths = spans(self.lists, term[chosen])
            at = np.repeat(owner[chosen] * n_blocks, lengths) + self.blocks[entries]
            return np.bincount(at, self.maxima[entries], n * n_blocks).reshape(n, n_blocks)

        found = sums(past)
        before = np.bincount(owner[~past], self.tops[term[~past]], n)
        live = (found > 0) & (found + before[:, None] >= threshold - SLACK)
        going = live.any(axis=1)
        if not going.any():
            return
        early = ~past & going[owner]
        if early.any():
            live &= found + sums(early) >= threshold - SLACK
        ends = np.cumsum(sizes)
        for p in np.flatnonzero(live.any(axis=1)).tolist():
            entries, _ = spans(self.lists, term[ends[p] - sizes[p] : ends[p]])
            inside, _ = spans(self.inner, entries[live[p, self.blocks[entries]]])
            units, at = np.unique(self.units[inside], return_inverse=True)
            scores = np.bincount(at, self.weights[inside])
            for k in np.flatnonzero(scores >= threshold - 1e-9).tolist():
                yield p, int(units[k]), float(scores[k])


def _idf(frequency: int, n: int) -> float:
    return float(np.log(1 + (n - frequency + 0.5) / (frequency + 0.5)))


def hits_of(index: Index, texts: list[str], threshold: float, overlap: float) -> list[list[dict]]:
    """Confirmed hits of each text, the best passage for each item."""
    words = [words_of(t) for t in texts]
    firsts = np.append(0, np.cumsum([-(-len(w) // UNIT) for w in words]))
    numbers = np.full(firsts[-1] * UNIT, -1, np.int64)
    get = index.terms.get
    for at, w in zip(firsts.tolist(), words):
        numbers[at * UNIT : at * UNIT + len(w)] = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
    opens = np.zeros(firsts[-1], bool)
    opens[firsts[:-1][np.diff(firsts) > 0]] = True
    found: list[list[tuple]] = [[] for _ in texts]
    for p, u, score in index.search(numbers, threshold, opens):
        i = int(np.searchsorted(firsts, p, "right")) - 1
        found[i].append((p - int(firsts[i]), u, score))
    return [confirmed(index, w, f, overlap) if f else [] for w, f in zip(words, found)]


def confirmed(index: Index, words: list[str], found: list[tuple], overlap: float) -> list[dict]:
    """Of one text's (passage, unit, score) those whose question and answer are there, the best for each item."""
    best: dict[int, dict] = {}
    for p, u, score in found:
        i = index.owners[u]
        if i in best and best[i]["score"] >= score:
            continue
        name, item, answer = index.items[i]
        question, reply = question_and_answer(item, answer)
        reach = len(question) + len(reply)
        near = words[max(0, p * UNIT - reach) : (p + 2) * UNIT + reach]
        around = triples(near)
        shares = []
        for part in (question, reply):
            wanted = triples(part)
            if 0 < len(part) < TRIPLE:
                n = len(part)
                shares.append(float(any(near[k : k + n] == part for k in range(len(near)))))
            else:
                shares.append(len(wanted & around) / len(wanted) if wanted else 1.0)
        if min(shares) >= overlap:
            best[i] = {"item": name, "score": round(score, 6), "question_overlap": round(shares[0], 6),
                       "answer_overlap": round(shares[1], 6), "first_word": p * UNIT}
    return [best[i] for i in sorted(best)]


def indexes(items: DataFrame, item: str = "item_id", text: str = "text", answer: str | None = None, most: int = MOST_INDEX) -> Iterator[Index]:
    """The index, in as many parts as its size asks for; the counts behind it are over all items."""
    given = items.select(
        F.col(item).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, units, total = Counter(), 0, 0
            for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                question, reply = question_and_answer(t, r)
                words = question + reply
                for at in range(0, len(words), UNIT):
                    part = words[at : at + UNIT]
                    seen.update(set(part))
                    units += 1
                    total += len(part)
            names = ["", *seen]
            counts = [units, *seen.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(counts, pa.int64()), pa.array([total] + [0] * len(seen), pa.int64())],
                names=["term", "units", "words"],
            )

    # The row of the empty term counts all units and words.
    counted = stable(
        given.mapInArrow(count, "term string, units long, words long").groupBy("term").agg(
            F.sum("units").alias("units"), F.sum("words").alias("words")
        )
    )
    whole = counted.where("term = ''").first()
    size = given.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    if whole is None or not whole["units"]:
        return
    parts = -(-size // most)
    for k in range(parts):
        mine = given.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).orderBy("item", "text")
        rows = [(r["item"], r["text"], r["answer"]) for r in mine.collect()]  # bounded by `most`
        terms = {t for _, x, a in rows for t in words_of(x) + words_of(a or "")}
        if terms:
            asked = items.sparkSession.createDataFrame(pa.table({"term": sorted(terms)}))
            frequencies = {r["term"]: r["units"] for r in counted.join(asked, "term").collect()}
            yield Index.build(rows, frequencies, whole["units"], whole["words"] / whole["units"])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    key: str = "doc_id",
    text: str = "text",
    answer: str | None = None,
    most_index: int = MOST_INDEX,
) -> DataFrame:
    """A row for each document and test item it holds: doc_id, item_id, score, overlaps, first_word."""
    spark, named = docs.sparkSession, items.schema["item_id"].dataType
    hit = pa.struct(
        [("item", to_arrow_type(named)), ("score", pa.float64()), ("question_overlap", pa.float64()),
         ("answer_overlap", pa.float64()), ("first_word", pa.int64())]
    )
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {named.simpleString()}, score double, question_overlap double, answer_overlap double, first_word long"
    found = spark.createDataFrame([], schema)
    for index in indexes(items, answer=answer, most=most_index):
        sent = send(spark, index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = received(sent)
            for batch in portions(batches):
                at, hits = [], []
                for i, mine in enumerate(hits_of(index, batch.column(1).to_pylist(), threshold, overlap)):
                    hits += mine
                    at += [i] * len(mine)
                flat = pa.array(hits, hit).flatten()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *flat],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        found = found.unionByName(rows.mapInArrow(search, schema))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text") -> DataFrame:
    """The rows, as they are, that hold no test item."""
    spark, at, schema = docs.sparkSession, docs.columns.index(text), docs.schema
    for index in indexes(items):
        sent = send(spark, index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = received(sent)
            for batch in portions(batches, at):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                clean = [not hits for hits in hits_of(index, texts, threshold, overlap)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
