"""Jaccard join of documents on word shingles, by token-combination prefixes.

A document is the set of its distinct five-word shingles (with fewer words, all of them
as one). Two link when 100 * |A and B| >= 75 * |A or B|. The result is the number of
shingles and the connected component of each document; links inside are found by the
following steps, none of which writes out all pairs of a group.

1. Shingles are 64-bit hashes. Documents with equal sets are one class, by a 128-bit digest.
2. Tokens have two classes, rare and frequent: a first pass counts shingles in each task's
   memory in turns and marks those seen often in a bitmap of fixed size. The order of tokens is rare before
   frequent, then by hash; any order and any classes give right results, these only save work.
3. A set x with r rare tokens needs at least ceil(0.75 |x|) in common with a partner, so it may lack
   at most d = floor(|x| / 4) tokens.
   * r > d: the first d + 1 tokens are single signatures, the usual prefix.
   * else: all rare tokens are single signatures, and the prefix is extended over the frequent
     ones to combinations of k = 2 tokens that follow one another in the order. With
     i = |x and y|, J >= 3/4 gives 4|x - y| + 3|y - x| <= |x|, so if no rare token is
     shared at most floor(|x| / 2) - 2r combinations of x's frequent tokens are broken (a token
     only x has breaks two, one only y has breaks one); one more than that are indexed.
   Of a linked pair the one whose prefix ends first shares a signature with the other.
4. Each signature's group first compares every member with its most typical one (fewest rare tokens):
   as many pairs as members. Linked classes are merged. Only groups that then still hold
   different components are looked at again (those of near copies, which share a centre, as one group), and
   only across components: a task holds a group, or
   two blocks of a long one, as bitmaps of the sets, which bound from below what each of two
   sets has alone, and passes on the pairs that may still reach the threshold.
5. Pairs are verified on the whole texts.

Empty and null texts have no shingles and link with nothing. A null id takes no part in links, and
gets a null component. Rows that share an id share their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import id_and_text, portions, ship, written
from nearfold.llm.components import components
from nearfold.scale import stable

ship(__name__)

WORDS = 5
# A shingle counted so often in one turn of one task is frequent.
OFTEN = 4
# Shingles counted at a time, and bits of the map of frequent ones: both fixed.
TURN, MAP_BITS = 2_000_000, 1 << 22
# Members of a group that are compared in one task, and the least bits of a set's bitmap.
BLOCK, LEAST_BITS = 4_096, 512

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z lower-cased white-space words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    rows = len(words) - width + 1
    total = np.full(rows, width, np.uint64)
    for i in range(width):
        total *= np.uint64(_MIX[0])
        total += hashes[i : i + rows]
    total = _scramble(total)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = tokens.tobytes()
    return tuple(np.array([xxhash.xxh64_intdigest(raw, s) for s in (1, 2)], np.uint64).view(np.int64).tolist())


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set and its rare tokens; `frequent` is the map, as bytes of 0 and 1."""
    n = len(tokens)
    often = frequent[(tokens % np.uint64(MAP_BITS)).astype(np.int64)] > 0
    rare = tokens[~often]
    may_lack = n // 4
    if len(rare) > may_lack:
        return _scramble(rare[: may_lack + 1] + np.uint64(1)), len(rare)
    common = tokens[often][: n // 2 - 2 * len(rare) + 2]
    pairs = _scramble(_scramble(common[:-1] * np.uint64(_MIX[0])) + common[1:])
    return np.concatenate([_scramble(rare + np.uint64(1)), pairs]), len(rare)


def bitmap(tokens: np.ndarray) -> bytes:
    """At least two bits for each token, a power of two of them, so that a wide map can be folded to a narrow one."""
    width = max(LEAST_BITS, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Maps:
    """Bitmaps and sizes of some sets, compared in pairs.

    Sets whose sizes allow a link have maps of equal width or of twice the width, which is folded.
    """

    def __init__(self, bits: list[bytes], n: np.ndarray):
        self.n = n
        self.width = np.fromiter(map(len, bits), np.int64, len(bits))
        self.at, self.words = {}, {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            flat = [np.frombuffer(bits[r], np.uint64) for r in rows.tolist()]
            narrow = [x if len(x) * 8 == w else x[: w // 8] | x[w // 8 :] for x in flat]
            self.at[w] = np.full(len(bits), -1)
            self.at[w][rows] = np.arange(len(rows))
            self.words[w] = np.stack(narrow)

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether two sets can reach the threshold: a bit only one of them has is a token only it has."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        fit = small * 100 >= large * percent
        narrow = np.minimum(self.width[i], self.width[j])
        for w in np.unique(narrow[fit]).tolist():
            words, at = self.words[w], self.at[w]
            of_width = np.flatnonzero(fit & (narrow == w))
            step = max(1, 4_000_000 // w)
            for pairs in (of_width[k : k + step] for k in range(0, len(of_width), step)):
                x, y = words[at[i[pairs]]], words[at[j[pairs]]]
                n_x, n_y = self.n[i[pairs]], self.n[j[pairs]]
                only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
                only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
                most = np.minimum(n_x - only_x, n_y - only_y)
                fit[pairs] = 100 * most >= percent * (n_x + n_y - most)
        return fit


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = _in_common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _raw(texts: pa.Array) -> list[bytes]:
    return pc.cast(texts, pa.binary()).to_pylist()


def frequent_map(rows: DataFrame) -> np.ndarray:
    """Marks of shingles seen OFTEN in one turn of TURN shingles, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, kept, size = np.zeros(MAP_BITS, np.uint8), [], 0

        def turn() -> None:
            tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
            marks[(tokens[counts >= OFTEN] % np.uint64(MAP_BITS)).astype(np.int64)] = 1

        for batch in portions(batches):
            for raw in _raw(batch.column(1)):
                kept.append(shingles(raw))
                size += len(kept[-1])
                if size >= TURN:
                    turn()
                    kept, size = [], 0
        if size:
            turn()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(marks).astype(np.int32))], names=["bit"])

    marked = rows.mapInArrow(count, "bit int").distinct()
    out = np.zeros(MAP_BITS, np.uint8)
    for r in marked.toLocalIterator():  # at most MAP_BITS small numbers
        out[r["bit"]] = 1
    return out


def signed_rows(rows: DataFrame) -> DataFrame:
    """A row for each signature of each set (once in a task), and a row for each document.

    Both kinds share one layout, so that one pass and one shuffle carry them: sign, a (the set's digest),
    sizes (n and the number of rare tokens), and for a document its id, the rest of the digest and the bitmap.
    """
    marks = rows.sparkSession.sparkContext.broadcast(np.packbits(frequent_map(rows)).tobytes())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = np.unpackbits(np.frombuffer(marks.value, np.uint8)), set()
        for batch in portions(batches):
            signs, digests, sizes, times, bits = [], [], [], [], []
            for raw in _raw(batch.column(1)):
                tokens = shingles(raw)
                digests.append(_digest(tokens))
                found, rare, map_of_set = np.zeros(0, np.uint64), 0, None
                if len(tokens) and digests[-1] not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digests[-1])
                    found, rare = signatures(tokens, frequent)
                    map_of_set = bitmap(tokens)
                signs.append(found)
                sizes.append(len(tokens) << 32 | rare)
                times.append(len(found))
                bits.append(map_of_set)
            a, b = (np.array(x, np.int64) for x in zip(*digests))
            sizes = np.array(sizes, np.int64)
            flat = np.concatenate(signs).view(np.int64)
            # Documents go to any task, copies too.
            anywhere = _scramble(a.view(np.uint64) + np.arange(len(a), dtype=np.uint64)).view(np.int64)
            if len(flat):
                none = pa.nulls(len(flat), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat), pa.array(np.repeat(a, times)), pa.array(np.repeat(sizes, times)), none, none,
                     pa.nulls(len(flat), pa.binary())],
                    names=NAMES,
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(anywhere), pa.array(a), pa.array(sizes), batch.column(0), pa.array(b), pa.array(bits, pa.binary())],
                names=NAMES,
            )

    return rows.mapInArrow(sign, "sign long, a long, sizes long, doc_id long, b long, bits binary")


NAMES = ["sign", "a", "sizes", "doc_id", "b", "bits"]


def shared_signatures(signed: DataFrame) -> DataFrame:
    """The rows of documents, and those of signatures that more than one set has, with the group's centre.

    Groups come sorted and are read as a stream; a group longer than TURN takes the centre of its first part.
    Columns: sign (null: a document), a, n, centre, doc_id, b, bits.
    """
    schema = pa.schema(
        [(c, pa.int64()) for c in ("sign", "a", "n", "centre", "doc_id", "b")] + [("bits", pa.binary())]
    )

    def emit(signs: np.ndarray, a: np.ndarray, sizes: np.ndarray, held: dict) -> pa.RecordBatch:
        """All rows of some whole groups, or of a part of the long one named in `held`."""
        n, rare = sizes >> 32, sizes & 0xFFFFFFFF
        at = np.lexsort((a, rare, signs))
        signs, a, n = signs[at], a[at], n[at]
        # A set that several tasks signed counts once: its rows are neighbours.
        fresh = np.append(True, (signs[1:] != signs[:-1]) | (a[1:] != a[:-1]))[: len(signs)]
        signs, a, n = signs[fresh], a[fresh], n[fresh]
        start = np.flatnonzero(np.append(True, signs[1:] != signs[:-1])[: len(signs)])
        sizes = np.diff(np.append(start, len(signs)))
        centre = np.repeat(a[start], sizes)
        many = np.repeat(sizes, sizes) > 1
        for sign, c in held.items():
            centre[signs == sign] = c
            many |= signs == sign
        none = pa.nulls(int(many.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x[many]) for x in (signs, a, n, centre)), none, none, pa.nulls(len(none), pa.binary())],
            schema=schema,
        )

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        tail, held = (empty, empty, empty), {}
        for batch in batches:
            is_document = pc.is_valid(batch.column(4))
            documents = batch.filter(is_document)
            none = pa.nulls(documents.num_rows, pa.int64())
            n = pc.shift_right(documents.column(2), 32)
            yield pa.RecordBatch.from_arrays(
                [none, documents.column(1), n, none, *documents.columns[3:]], schema=schema
            )
            rest = batch.filter(pc.invert(is_document))
            columns = tuple(np.concatenate([t, c.to_numpy()]) for t, c in zip(tail, rest.columns))
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            if cut:
                yield emit(*(c[:cut] for c in columns), held)
                held = {}
            tail = tuple(c[cut:] for c in columns)
            if len(tail[0]) > TURN:
                part = emit(*tail, held)
                held = {int(tail[0][0]): held.get(int(tail[0][0])) or int(tail[1][np.argmin(tail[2] & 0xFFFFFFFF)])}
                if part.num_rows:
                    yield part
                tail = (empty, empty, empty)
        if len(tail[0]):
            yield emit(*tail, held)

    return signed.repartition("sign").sortWithinPartitions("sign").mapInArrow(
        star, "sign long, a long, n long, centre long, doc_id long, b long, bits binary"
    )


def possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule out a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 3, 8_000_000):
            n = np.concatenate([batch.column(i).to_numpy() for i in (2, 4)])
            held = Maps(batch.column(3).to_pylist() + batch.column(5).to_pylist(), n)
            here = np.arange(batch.num_rows)
            fit = held.may_link(here, here + batch.num_rows, percent)
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    def side(name: str) -> DataFrame:
        return maps.select(F.col("a").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(test, "a long, b long")


def _drawn(ids: np.ndarray) -> np.ndarray:
    return (_scramble(ids.view(np.uint64) + np.uint64(3)) % np.uint64(MAP_BITS)).astype(np.int64)


def texts_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(a, text) of each member (doc_id, a): a text whose set has that digest.

    A map of fixed size over the ids wanted keeps most other texts out of the shuffle.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_drawn(batch.column(0).to_numpy())))], names=["bit"])

    wanted = np.zeros(MAP_BITS, np.uint8)
    for r in members.select("doc_id").mapInArrow(marks, "bit long").distinct().toLocalIterator():  # at most MAP_BITS
        wanted[r["bit"]] = 1
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(sent.value, np.uint8))
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            yield batch.filter(pa.array(wanted[_drawn(batch.column(0).to_numpy())] > 0))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in portions(batches):
            kept = []
            for a, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1))):
                kept.append(a != last and _digest(shingles(raw))[0] == a)
                last = a if kept[-1] else last
            yield batch.filter(pa.array(kept, pa.bool_()))

    few = rows.mapInArrow(asked, rows.schema)
    # A sort merge join brings the rows of an id together, of which one is kept.
    return few.join(members.hint("merge"), "doc_id").select("a", "text").mapInArrow(same, "a long, text string")


def regrouped(groups: DataFrame) -> DataFrame:
    """(sign, a, n): groups with the same centre as one where that makes fewer pairs than they have apart.

    Near copies share most signatures and so most groups; together each pair of them is met once.
    Members of one group stay in one group, so no pair is lost.
    """
    apart = groups.groupBy("centre", "sign").agg(F.count(F.lit(1)).alias("m")).groupBy("centre").agg(
        F.sum(F.col("m").cast("double") * F.col("m")).alias("apart")
    )
    together = groups.select("centre", "a").distinct().groupBy("centre").agg(F.count(F.lit(1)).cast("double").alias("u"))
    plan = apart.join(together, "centre").select("centre", (F.col("u") * F.col("u") <= F.col("apart")).alias("whole"))
    key = F.when(F.col("whole"), F.col("centre")).otherwise(F.col("sign"))
    return groups.join(plan, "centre").select(key.alias("sign"), "a", "n").distinct()


def across_parts(left: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one group and different parts that their bitmaps do not rule out.

    A group of more than BLOCK members is cut into blocks, and each two of them are a task's work.
    """
    counts = left.groupBy("sign").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    dealt = (
        left.join(counts, "sign").withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(maps.select("a", "bits"), "a")
        .select(
            F.when(F.col("blocks") == 1, F.col("sign"))
            .otherwise(F.xxhash64("sign", F.least("own", "other"), F.greatest("own", "other"))).alias("task"),
            "a", "n", "part",
            # In a task of two blocks only members of different blocks meet.
            F.when(F.col("own") == F.col("other"), F.lit(0)).when(F.col("own") < F.col("other"), F.lit(1)).otherwise(F.lit(2)).alias("side"),
            "bits",
        )
    )

    def meet(task, a, n, part, side, bits) -> pa.RecordBatch:
        held = Maps(list(bits), n)
        here, found = np.arange(len(a)), set()
        for step in range(1, len(a)):
            here = here[here + step < len(a)]
            here = here[task[here] == task[here + step]]
            if not len(here):
                break
            for at in range(0, len(here), 20_000):
                i = here[at : at + 20_000]
                j = i + step
                fit = (part[i] != part[j]) & ((side[i] != side[j]) | (side[i] == 0))
                i, j = i[fit], j[fit]
                fit = held.may_link(i, j, percent)
                one, two = a[i[fit]], a[j[fit]]
                found.update(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist()))
        one, two = zip(*sorted(found)) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64) for _ in range(5)] + [np.zeros(0, object)]
        for batch in portions(batches, 5, 8_000_000):
            columns = [np.concatenate([t, c.to_numpy(zero_copy_only=False)]) for t, c in zip(tail, batch.columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            if cut:
                yield meet(*(c[:cut] for c in columns))
            tail = [c[cut:] for c in columns]
        if len(tail[0]):
            yield meet(*tail)

    met = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(stream, "a long, b long")
    return met.distinct()


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, from whole texts. The set of `a` is kept while it stays the same."""
    ends = pairs.select("a").union(pairs.select("b")).distinct()
    members = written(ends.join(classes, "a").select(F.col("rep").alias("doc_id"), "a").distinct())
    texts = written(texts_of(rows, members))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for batch in portions(batches, 2):
            kept = []
            for a, one, two in zip(batch.column(0).to_pylist(), _raw(batch.column(3)), _raw(batch.column(2))):
                if a != last:
                    last, tokens = a, shingles(one)
                kept.append(linked(tokens, shingles(two), percent))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    met = pairs.join(texts.select(F.col("a").alias("b"), F.col("text").alias("two")), "b").join(
        texts.select("a", F.col("text").alias("one")), "a"
    )
    return met.select("a", "b", "two", "one").mapInArrow(compare, "a long, b long")


def near_documents(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id. `percent` is at least 75: the prefixes are made for it."""
    if percent < 75:
        raise ValueError("prefixes are long enough for 75 percent and more")
    rows = id_and_text(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    all_rows = written(shared_signatures(signed_rows(rows)))
    sets = all_rows.where("sign IS NULL").select("doc_id", "n", "a", "b", "bits")
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = stable(usable.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    # Every set has its bitmap at least once; copies in other tasks bring equal ones.
    maps = sets.where("bits IS NOT NULL").select("a", "n", "bits").dropDuplicates(["a"])
    groups = all_rows.where("sign IS NOT NULL").select("sign", "a", "n", "centre")

    tried = written(
        groups.where("a <> centre").select(F.least("a", "centre").alias("a"), F.greatest("a", "centre").alias("b")).distinct()
    )
    first = stable(verified(written(possible(tried, maps, percent)), classes, rows, percent))
    merged = components(first)
    parts = regrouped(groups).join(merged.select(F.col("node").alias("a"), "component"), "a", "left").select(
        "sign", "a", "n", F.coalesce("component", "a").alias("part")
    )
    mixed = parts.groupBy("sign").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    left = written(parts.join(mixed.select("sign"), "sign", "left_semi"))
    across = across_parts(left, maps, percent).join(tried, ["a", "b"], "left_anti")
    second = stable(verified(written(across), classes, rows, percent))
    joined = components(first.unionByName(second)).select(F.col("node").alias("a"), "component")
    rooted = classes.join(joined, "a", "left").withColumn("root", F.coalesce("component", "a")).drop("component")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("a", "b", "component_id")
    return sets.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )



def one_of_each(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, as they are, of one document of each component: the least id. Rows without an id stay.

    Of rows that share an id one stays.
    """
    found = near_documents(docs, percent, key, text)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    stay = docs.join(kept, key, "left_semi").dropDuplicates([key])
    return stay.unionByName(docs.where(F.col(key).isNull())).select(*docs.columns)
