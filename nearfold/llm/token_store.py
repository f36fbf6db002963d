"""Token ids in binary shards, found by key through a minimal perfect hash.

A store is a folder:

* `shards/00012.ids`: a 16-byte head (magic, version, bytes per id), then raw
  little-endian ids of documents in ascending key order, with nothing between.
* `manifest/`: Parquet, a row for each document: key, shard, offset, n, copy.
* `index/00003.mph`: the keys whose hash falls in that bucket: the bit levels of
  a minimal perfect hash, and for each slot a fingerprint, shard, offset and n.

A lookup hashes the key, opens one bucket, walks about 1.6 levels, ranks one bit,
compares the fingerprint and reads one span of one shard.

Null text is empty and holds the end id alone. Documents with a null key are
stored first and are not in the index; a key that repeats is indexed by its first
copy (by the text's hash) and the manifest numbers the others. An empty table gives a
store without shards' ids, in which every lookup misses.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold.llm.common import gathered, give_back_memory, id_and_text, portions, ship
from nearfold.llm.files import file_system

ship(__name__)

MAGIC = b"TOKENIDS"
HEAD, HEAD_BYTES = "<8sII", 16
# Keys in one index bucket, on average; a bucket is built in one task.
BUCKET_KEYS = 65_536
# Bits of a level for each key that is left.
BITS_PER_KEY = 2
# Each level keeps more than half of the keys, so distinct ones never need so many.
MOST_LEVELS = 200
# Bytes of text whose distinct words are encoded together, and words whose ids are gathered at once.
PORTION, PART_WORDS = 16_000_000, 1_000_000


# --- encoding -----------------------------------------------------------------


class WordTokenizer:
    """Ids of texts; the library encodes each distinct word of a portion once.

    Texts are cut at ASCII white space, which the tokenizer drops. Chunks of plain letters, digits
    and signs are cut once more as the tokenizer's own pattern does, so that
    their words are shared by chunks; any other chunk is given to the library as it is.
    Nothing is kept from one portion to the next.
    """

    PLAIN = re.compile(r"[ !-~À-ÖØ-öø-ÿ]+")
    # Fixed value: the splitting pattern in the tokenizer's file, for plain chunks; a space ends a chunk.
    WORD = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.inner = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.splits = self._is_word_bpe()
        vocab = self.inner.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def _is_word_bpe(self) -> bool:
        """Whether white space is dropped and letters and signs are words of their own."""
        probe = "It's a\x0bTest,\tof_ 42\x0c\r(words)!\nÇa"
        whole = self.inner.encode(probe, add_special_tokens=False).ids
        apart = [
            i
            for c in re.split("[ \t-\r]+", probe)
            for w in self.WORD.findall(c.lower())
            for i in self.inner.encode(w, add_special_tokens=False).ids
        ]
        return whole == apart

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other, and how many each text has."""
        found = [f.ids for f in self.inner.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for f in found for i in f], self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `_encode_each`, many words in one text where each ends with a token that ends a word."""
        ids, sizes = [], []
        for at in range(0, len(words), 65_536):
            groups = [words[i : i + 256] for i in range(at, min(at + 65_536, len(words)), 256)]
            for group, found in zip(groups, self.inner.encode_batch(list(map(" ".join, groups)), add_special_tokens=False)):
                got = np.array(found.ids, self.dtype)
                cuts = np.flatnonzero(self.ends[got]) + 1
                if len(cuts) == len(group) and cuts[-1] == len(got):
                    ids.append(got)
                    sizes.append(np.diff(cuts, prepend=0))
                else:
                    each, n = self._encode_each(group)
                    ids.append(each)
                    sizes.append(n)
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _encode_plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of plain chunks that are joined by spaces."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        number[" "]
        found = self.WORD.findall(f"{joined.lower()} ")
        codes = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
        del found
        ids, sizes = self._encode_words(list(number)[1:])
        starts = np.concatenate([[0, 0], np.cumsum(sizes)]).astype(np.int64)  # the space is empty
        out, each = gathered(ids, starts, codes)
        ends = np.cumsum(each)[codes == 0]
        return out, np.diff(ends, prepend=0)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(chunks)
        if not chunks or (self.PLAIN.fullmatch(joined) and "<|" not in joined):
            return self._encode_plain(joined) if chunks else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        plain = np.array([self.PLAIN.fullmatch(c) is not None and "<|" not in c for c in chunks], bool)
        parts = [c for c, p in zip(chunks, plain) if p], [c for c, p in zip(chunks, plain) if not p]
        (a, n), (b, m) = self._encode_chunks(parts[0]), self._encode_each(parts[1])
        sizes = np.empty(len(chunks), np.int64)
        sizes[plain], sizes[~plain] = n, m
        is_plain = np.repeat(plain, sizes)
        ids = np.empty(len(is_plain), self.dtype)
        ids[is_plain], ids[~is_plain] = a, b
        return ids, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
        """How many ids each text has with its end, and all those ids in parts of bounded size."""
        if self.splits:
            chunks = pc.ascii_split_whitespace(texts)
            words = chunks.flatten().dictionary_encode()
            ids, sizes = self._encode_chunks(words.dictionary.to_pylist())
            ends = np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False))
            codes = words.indices.to_numpy()
        else:
            ids, sizes = self._encode_each(texts.to_pylist())
            codes = np.arange(len(texts), dtype=np.int32)
            ends = codes + 1
        # The end is one more word, the last of each text.
        codes = np.insert(codes, ends, len(sizes))
        ids, sizes = np.append(ids, self.dtype.type(end_id)), np.append(sizes, 1)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        each = np.diff(total[np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])])
        parts = (gathered(ids, starts, codes[i : i + PART_WORDS])[0] for i in range(0, len(codes), PART_WORDS))
        return each, parts


# --- minimal perfect hash -----------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of both key hashes and the level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mix(b, a, 255) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct keys, each a pair of 64-bit hashes, to 0 .. n-1.

    At each level the keys that are left are hashed into twice as many bits; a key
    alone on its bit stays there, the others go on. A key's slot is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.bitwise_count(words).astype(np.int64) for words in levels]
        self.starts = np.concatenate([[0], np.cumsum([o.sum() for o in ones])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(o)[:-1]]).astype(np.int64) for o in ones]

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        levels, left = [], np.arange(len(a))
        while len(left):
            n_words = -(-BITS_PER_KEY * len(left) // 64)
            spot = _mix(a[left], b[left], len(levels)) % np.uint64(n_words * 64)
            alone = np.bincount(spot.astype(np.int64), minlength=n_words * 64) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            levels.append(words)
            left = left[~alone[spot.astype(np.int64)]]
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{len(left)} keys share their hashes with others")
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where a key is surely not among those of the build."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            spot = _mix(a[left], b[left], level) % np.uint64(len(words) * 64)
            word, bit = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.starts[level] + self.ranks[level][word] + below)[hit]
            left = left[~hit]
        return out


ENTRY = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def _dump_index(frame: pd.DataFrame) -> bytes:
    a, b = (frame[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    hashed = PerfectHash.build(a, b)
    entries = np.zeros(len(frame), ENTRY)
    at = hashed.slots(a, b)
    entries["mark"][at] = _fingerprint(a, b)
    for c in ("shard", "offset", "n"):
        entries[c][at] = frame[c].to_numpy()
    sizes = np.array([len(frame), len(hashed.levels), *map(len, hashed.levels)], "<u8")
    return b"".join([sizes.tobytes(), *(w.tobytes() for w in hashed.levels), entries.tobytes()])


class IndexFile:
    """One bucket of the index, read whole."""

    def __init__(self, raw: bytes):
        n, depth = np.frombuffer(raw, "<u8", 2)
        sizes = np.frombuffer(raw, "<u8", int(depth), 16)
        at, levels = 16 + 8 * int(depth), []
        for size in sizes.tolist():
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        self.hashed, self.entries = PerfectHash(levels), np.frombuffer(raw, ENTRY, int(n), at)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the entries of those."""
        slots = self.hashed.slots(a, b)
        there = slots >= 0
        there[there] = self.entries["mark"][slots[there]] == _fingerprint(a[there], b[there])
        return there, self.entries[slots[there]]


# --- files --------------------------------------------------------------------


def _read(path: str) -> bytes:
    store, at = file_system(path)
    with store.open_input_file(at) as f:
        return f.read()


class _Replacing:
    """A file that takes its name when it is whole; a repeated task replaces it by the same."""

    def __init__(self, path: str):
        self.store, self.path = file_system(path)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.store.open_output_stream(self.draft)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.move(self.draft, self.path)
        else:
            self.store.delete_file(self.draft)


def _shard(path: str, number: int) -> str:
    return f"{path}/shards/{number:05d}.ids"


def _bucket(path: str, number: int) -> str:
    return f"{path}/index/{number:05d}.mph"


# --- writing ------------------------------------------------------------------


def _key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1).cast("long"), key).alias("b")]


def _number_copies(drafts: DataFrame) -> DataFrame:
    """Copies are numbered in each shard; go on where the shard before ended with the same key."""
    last = F.max_by(F.struct("key", F.col("copy") + 1), "offset")
    ends = drafts.groupBy("shard").agg(F.min_by(F.struct("key"), "offset").alias("first"), last.alias("last"))
    ends = ends.select("shard", F.col("first.key").alias("first"), F.col("last.key").alias("last"), F.col("last.col2").alias("n"))
    # One row for each shard.
    held = ends.withColumn("held", F.sum("n").over(Window.partitionBy("last").orderBy("shard")))
    before = Window.orderBy("shard")
    carried = held.select(
        "shard", "first",
        F.when(F.lag("last").over(before).eqNullSafe(F.col("first")) & (F.row_number().over(before) > 1), F.lag("held").over(before))
        .otherwise(0).alias("carried"),
    )
    more = F.when(F.col("key").eqNullSafe(F.col("first")), F.col("carried")).otherwise(0)
    return drafts.join(carried, "shard").withColumn("copy", F.col("copy") + more).drop("first", "carried")


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    width: int = 2,
) -> None:
    """Encode every text, append `end_id`, and write the store to the shared folder `path`.

    Texts are range-partitioned by key and one task writes one shard. `width` is the
    bytes of an id, 2 or 4; the vocabulary must fit. The index is built from hashes and
    positions alone, in buckets of bounded size.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        try:
            yield from encoded(batches, shard)
        finally:
            give_back_memory()

    def encoded(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer, width)
        if len(coder.ends) > 1 << 8 * width or end_id >= 1 << 8 * width:
            raise ValueError(f"ids do not fit {width} bytes")
        offset, last, copy = 0, None, -1
        with _Replacing(_shard(path, shard)) as out:
            out.write(struct.pack(HEAD, MAGIC, 1, width))
            for batch in portions(batches, size=PORTION):
                sizes, parts = coder.encode(batch.column(1), end_id)
                for ids in parts:
                    out.write(ids.tobytes())
                starts = offset + np.cumsum(sizes) - sizes
                offset += int(sizes.sum())
                copies = []
                for k in batch.column(0).to_pylist():
                    copy = copy + 1 if copy >= 0 and (k == last or k != k and last != last) else 0
                    last = k
                    copies.append(copy)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(sizes), shard, np.int64)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(copies, pa.int64()),
                    ],
                    names=["key", "shard", "offset", "n", "copy"],
                )

    # A key that many rows hold, null among them, is dealt to shards by the hash of the text.
    rows = id_and_text(docs, key, text).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(
        encode, f"key {kind}, shard long, offset long, n long, copy long"
    ).write.mode("overwrite").parquet(f"{path}/drafts")
    _number_copies(spark.read.parquet(f"{path}/drafts")).write.mode("overwrite").parquet(f"{path}/manifest")

    manifest = spark.read.parquet(f"{path}/manifest")
    keyed = manifest.where("copy = 0 AND key IS NOT NULL")
    buckets = max(1, -(-keyed.count() // BUCKET_KEYS))

    def build(number: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        with _Replacing(_bucket(path, int(number[0]))) as out:
            out.write(_dump_index(frame))
        return pd.DataFrame({"bucket": [number[0]], "n_keys": [len(frame)]})

    hashed = keyed.select(*_key_hashes(F.col("key")), "shard", "offset", "n")
    hashed.withColumn("bucket", F.pmod("a", F.lit(buckets))).groupBy("bucket").applyInPandas(
        build, "bucket long, n_keys long"
    ).write.mode("overwrite").parquet(f"{path}/buckets")
    manifest.groupBy("shard").agg(F.sum("n").alias("n_ids")).withColumn(
        "n_buckets", F.lit(buckets)
    ).write.mode("overwrite").parquet(f"{path}/shard_sizes")


# --- reading ------------------------------------------------------------------


def _n_buckets(spark: SparkSession, path: str) -> int:
    first = spark.read.parquet(f"{path}/shard_sizes").select("n_buckets").take(1)
    return first[0][0] if first else 0


def find(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, shard, offset, n) of each key the index holds; others and nulls have no row."""
    spark, n = keys.sparkSession, _n_buckets(keys.sparkSession, path)
    kind = keys.schema[key].dataType.simpleString()

    def look(number: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            index = IndexFile(_read(_bucket(path, int(number[0]))))
        except FileNotFoundError:
            return pd.DataFrame({"key": [], "shard": [], "offset": [], "n": []})
        there, got = index.find(*(frame[c].to_numpy().view(np.uint64) for c in ("a", "b")))
        return pd.DataFrame({"key": frame["key"][there]} | {c: got[c].astype(np.int64) for c in ("shard", "offset", "n")})

    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    hashed = asked.select("key", *_key_hashes(F.col("key")))
    schema = f"key {kind}, shard long, offset long, n long"
    if not n:
        return spark.createDataFrame([], schema)
    return hashed.withColumn("bucket", F.pmod("a", F.lit(n))).groupBy("bucket").applyInPandas(look, schema)


def _with_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows by shard and offset, with the bytes there; each shard is opened once."""
    at, file, width = None, None, 0
    for batch in batches:
        spans = []
        for shard, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n"))):
            if shard != at:
                if file is not None:
                    file.close()
                store, name = file_system(_shard(path, shard))
                file, at = store.open_input_file(name), shard
                magic, _, width = struct.unpack(HEAD, file.read_at(HEAD_BYTES, 0))
                if magic != MAGIC:
                    raise ValueError(f"shard {shard} is no file of token ids")
            spans.append(file.read_at(n * width, HEAD_BYTES + offset * width))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([width] * len(spans), pa.int32()), pa.array(spans, pa.binary())],
            names=[*batch.schema.names, "width", "ids"],
        )


def _by_shard(found: DataFrame) -> DataFrame:
    return found.repartition("shard").sortWithinPartitions("shard", "offset")


def fetch(found: DataFrame, path: str) -> DataFrame:
    """Add `width` and `ids BINARY`, the raw little-endian ids of each position, read from the shards."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return _by_shard(found).mapInArrow(lambda batches: _with_ids(batches, path), f"{kinds}, width int, ids binary")


def with_starts(found: DataFrame, path: str) -> DataFrame:
    """Add `start`, the ids of all documents stored before. One row for each shard is summed."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.sparkSession.read.parquet(f"{path}/shard_sizes")
    bases = sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def unindexed(spark: SparkSession, path: str) -> DataFrame:
    """Positions of the documents no key leads to: null keys and further copies of a key."""
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.where("copy > 0 OR key IS NULL").select("key", "shard", "offset", "n")


def token_digests(found: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as 32-bit integers, from the shards' bytes."""
    import zlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_ids(batches, path):
            sums, counts = [], []
            for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist()):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                sums.append(zlib.crc32(wide.tobytes()))
                counts.append(len(wide))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = found.schema["key"].dataType.simpleString()
    return _by_shard(with_starts(found, path)).mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


class TokenStore:
    """Constant-time reads of single documents, without Spark. Keys are integers or strings."""

    def __init__(self, path: str, n_buckets: int, long_keys: bool = True):
        self.path, self.n_buckets, self.long_keys = path, n_buckets, long_keys
        self.indexes: dict[int, IndexFile] = {}

    def get(self, key) -> np.ndarray | None:
        import xxhash

        if not self.n_buckets:
            return None

        raw = struct.pack("<q" if self.long_keys else "<i", key) if isinstance(key, int) else key.encode()
        a = xxhash.xxh64_intdigest(raw, 42)
        b = xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(struct.pack("<q", 1), 42))
        signed = a - (1 << 64) if a >> 63 else a
        number = signed % self.n_buckets
        if number not in self.indexes:
            try:
                self.indexes[number] = IndexFile(_read(_bucket(self.path, number)))
            except FileNotFoundError:  # no key has this bucket
                return None
        there, got = self.indexes[number].find(np.array([a], np.uint64), np.array([b], np.uint64))
        if not there[0]:
            return None
        store, name = file_system(_shard(self.path, int(got["shard"][0])))
        with store.open_input_file(name) as f:
            _, _, width = struct.unpack(HEAD, f.read_at(HEAD_BYTES, 0))
            raw = f.read_at(int(got["n"][0]) * width, HEAD_BYTES + int(got["offset"][0]) * width)
        return np.frombuffer(raw, f"<u{width}")
