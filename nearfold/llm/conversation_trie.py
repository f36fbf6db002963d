"""The prefix trie of conversations, with subtree totals by time-forward processing.

1. `mark_turns` turns each role and text into a 128-bit mark and a length; texts go no further.
2. A conversation's marks are chained, so that a prefix has a 128-bit name: a node. A conversation
   yields a row for each node it passes, from the root on.
3. Conversations are dealt to shards of bounded size by a place made of their
   names at depths 1, 2, 4 ..., then by id: those with a common prefix lie together, but no prefix,
   however frequent, keeps them in one shard.
4. A shard's rows are sorted outside memory by reverse level order. Each node takes what its children
   sent from a priority queue that spills, and sends its totals to its parent.
5. Copies of a node in several shards are added up. Such nodes are the roots of
   the shards' forests; a node or leaf they counted twice is corrected by a
   second pass of the same kind over them alone (some for each shard).

Turns with equal order come by mark; rows without a conversation id are left
out; null roles and texts are empty; repeated rows are turns of their own; other columns are
left out; ids are whole numbers. Without conversations there is no node. A queue's
memory is bounded; the members that end at one node are hashed from sorted pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import ship, written
from nearfold.llm.files import SharedFile
from nearfold.scale import scratch_path

ship(__name__)

# Rows of a shard, messages a queue keeps in memory, ids hashed as one piece.
SHARD_ROWS, QUEUE_SIZE, PIECE_IDS = 50_000, 200_000, 4_096
ROOT = bytes(16)
LADDER = (1, 2, 4, 8, 16, 32, 64, 128)
BATCH_ROWS = 20_000

PATH = "conv_id long, depth long, node binary, parent binary, size long, is_end boolean, place binary"
TOTALS = (
    "node binary, parent binary, conv_id long, depth long, size long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long"
)


def mark_turns(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turn, mark (of role and text) and size (code points of the text) of each turn."""
    role_text, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role_text).cast("string"), F.lit(":"), role_text, said)))
    return turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(order).alias("turn"), mark.alias("mark"),
        F.length(said).cast("long").alias("size"),
    )


def numbered(marked: DataFrame) -> DataFrame:
    """`place` of each turn in its conversation, from 1: by turn, null first, then mark."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return marked.withColumn("place", F.row_number().over(order))


class SpillingQueue:
    """Messages (level, node, counts) taken in ascending order; runs beyond `limit` go to shared files.

    `level` is -depth. Messages to one node are added up when they are taken or spilled.
    """

    ENTRY = ">q16sqqq"

    def __init__(self, open_run: Callable[[], SharedFile], limit: int = QUEUE_SIZE):
        self.open_run, self.limit = open_run, limit
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # the next message of each run, and the rest of it
        self.runs: list[SharedFile] = []

    def send(self, level: int, node: bytes, *counts: int) -> None:
        heapq.heappush(self.heap, (level, node, *counts))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        run = self.open_run()
        with run.writing() as out:
            for (level, node), same in groupby(self.heap, key=lambda m: m[:2]):
                out.write(struct.pack(self.ENTRY, level, node, *map(sum, zip(*(m[2:] for m in same)))))
        self.heap = []
        self.runs.append(run)
        self._advance(len(self.runs) - 1, self._read(run))

    def _read(self, run: SharedFile) -> Iterator[tuple]:
        size = struct.calcsize(self.ENTRY) * 4096
        with run.reading() as f:
            while part := f.read(size):
                yield from struct.iter_unpack(self.ENTRY, part)

    def _advance(self, number: int, rest: Iterator[tuple]) -> None:
        head = next(rest, None)
        if head is not None:
            heapq.heappush(self.heads, (head, number, rest))

    def take(self, level: int, node: bytes) -> tuple[int, int, int]:
        """The sums of the messages to this node, which must be the next that has any."""
        to, a, b, c = (level, node), 0, 0, 0
        while self.heap and self.heap[0][:2] == to:
            _, _, x, y, z = heapq.heappop(self.heap)
            a, b, c = a + x, b + y, c + z
        while self.heads and self.heads[0][0][:2] == to:
            (_, _, x, y, z), number, rest = heapq.heappop(self.heads)
            a, b, c = a + x, b + y, c + z
            self._advance(number, rest)
        return a, b, c

    def close(self) -> None:
        for _, _, rest in self.heads:
            rest.close()
        for run in self.runs:
            run.remove()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*kept) if kept else ([] for _ in schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for row in rows:
        kept.append(row)
        if len(kept) == BATCH_ROWS:
            yield made()
            kept.clear()
    yield made()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _paths(turns: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each node of each conversation; turns come by conversation, in order, a turnless row first.

    A conversation waits until its place is known: its end, or the last depth of the ladder.
    """
    for conv, own in groupby(turns, key=lambda r: r[0]):
        node, depth, place, waiting = ROOT, 0, bytearray(2 * len(LADDER)), []
        row = (conv, 0, ROOT, None, 0)
        for _, is_turn, mark, size in own:
            if not is_turn:
                continue
            if depth > LADDER[-1]:
                yield (*row, False, bytes(place))
            else:
                waiting.append(row)
                if depth == LADDER[-1]:
                    yield from ((*w, False, bytes(place)) for w in waiting)
                    waiting = []
            above, node, depth = node, hashlib.md5(node + mark).digest(), depth + 1
            if depth in LADDER:
                at = 2 * LADDER.index(depth)
                place[at : at + 2] = node[:2]
            row = (conv, depth, node, above, size)
        yield from ((*w, False, bytes(place)) for w in waiting)
        yield (*row, True, bytes(place))


def _local_totals(paths: Iterator[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Nodes of a shard, deepest first; rows come by depth downwards, node, conversation."""
    for (depth, node), copies in groupby(paths, key=lambda r: (r[0], r[1])):
        _, _, conv, parent, size = next(copies)
        n = 1 + sum(1 for _ in copies)
        children, leaves, saved = queue.take(-depth, node)
        leaves = leaves if children else 1
        saved += (n - 1) * size
        yield node, parent, conv, depth, size, n, children, leaves, saved
        if parent is not None:
            queue.send(1 - depth, parent, 1, leaves, saved)


def _corrected(nodes: Iterator[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Nodes with several copies, deepest first: what was counted for each copy is counted once.

    A node is a leaf if no copy has a child; its length was left out once for each copy;
    as a child it was counted once for each copy.
    """
    for node, parent, conv, depth, size, n, children, leaves, saved, copies, childless in nodes:
        fewer_children, leaf_change, saved_change = queue.take(-depth, node)
        leaf_change += (1 if childless == copies else 0) - childless
        saved_change += (copies - 1) * size
        yield node, parent, conv, depth, size, n, children + fewer_children, leaves + leaf_change, saved + saved_change
        if parent is not None:
            queue.send(1 - depth, parent, 1 - copies, leaf_change, saved_change)


def _ends(pieces: Iterator[tuple]) -> Iterator[tuple]:
    for node, own in groupby(pieces, key=lambda r: r[0]):
        found = hashlib.sha256()
        for i, (_, ids) in enumerate(own):
            found.update((("," if i else "") + ids).encode())
        yield node, found.hexdigest()


def _streamed(rows: DataFrame, work: Callable, ddl: str, queue_size: int | None = None) -> DataFrame:
    """Rows of each partition in their order through `work`, with a queue of its own if it needs one."""
    schema, folder = _schema(ddl), scratch_path(rows.sparkSession, "queue") if queue_size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not queue_size:
            yield from _batches(work(_rows(batches)), schema)
            return
        queue = SpillingQueue(lambda: SharedFile.new(folder), queue_size)
        try:
            yield from _batches(work(_rows(batches), queue), schema)
        finally:
            queue.close()

    return rows.mapInArrow(run, ddl)


def prefix_trie(
    marked: DataFrame,
    members: DataFrame | None = None,
    shard_rows: int = SHARD_ROWS,
    queue_size: int = QUEUE_SIZE,
) -> DataFrame:
    """A row for each node of the trie of `marked` turns (conv_id, turn, mark, size).

    conv_id (the least member), depth, parent_conv_id (of the parent; null at the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, (n_convs - 1) times the
    last turn's size), ends_sha256 (of the ids of members without further turns, ascending, comma-joined).
    `members` may name conversations without turns (conv_id).
    """
    starts = marked.select("conv_id") if members is None else members.select("conv_id").unionByName(marked.select("conv_id"))
    none = F.lit(None)
    starts = starts.where("conv_id IS NOT NULL").distinct().select(
        "conv_id", F.lit(False).alias("is_turn"), none.cast(marked.schema["turn"].dataType).alias("turn"),
        none.cast("binary").alias("mark"), none.cast("long").alias("size"),
    )
    turns = marked.where("conv_id IS NOT NULL").select("conv_id", F.lit(True).alias("is_turn"), "turn", "mark", "size")
    ordered = (
        starts.unionByName(turns)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "is_turn", F.col("turn").asc_nulls_first(), "mark")
        .select("conv_id", "is_turn", "mark", "size")
    )
    paths = written(_streamed(ordered, _paths, PATH))

    shards = max(1, -(-paths.count() // shard_rows))
    in_shards = (
        paths.repartitionByRange(shards, "place", "conv_id")
        .sortWithinPartitions(F.col("depth").desc(), "node", "conv_id")
        .select("depth", "node", "conv_id", "parent", "size")
    )
    local = _streamed(in_shards, _local_totals, TOTALS, queue_size)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    added = written(
        local.groupBy("node").agg(
            F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
            F.max("size").alias("size"), *sums, F.count(F.lit(1)).alias("copies"),
            F.sum((F.col("n_children") == 0).cast("long")).alias("childless"),
        )
    )
    roots = added.where("copies > 1").repartition(1).sortWithinPartitions(F.col("depth").desc(), "node")
    names = [f.split()[0] for f in TOTALS.split(", ")]
    once = added.where("copies = 1").select(*names)
    nodes = written(once.unionByName(_streamed(roots, _corrected, TOTALS, queue_size)))

    ending = paths.where("is_end").groupBy("node", F.floor(F.col("conv_id") / PIECE_IDS).alias("piece"))
    pieces = ending.agg(_joined(F.sort_array(F.collect_list("conv_id"))).alias("ids"))
    ends = _streamed(
        pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids"),
        _ends, "node binary, ends_sha256 string",
    )
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(above, "parent", "left")
        .join(ends, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")
