import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfold.llm import token_store as ts
from nearfold.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_round_trip(spark, awkward, tokenizer, tmp_path):
    path = f"file://{tmp_path}/store"
    ts.write_store(awkward, path, tokenizer_file())
    found = ts.find(awkward.select("doc_id").distinct(), path)
    got = ts.token_digests(found.unionByName(ts.unindexed(spark, path)), path).toPandas()
    rows = sorted(awkward.toPandas().itertuples(), key=lambda r: (-1 if np.isnan(r.doc_id) else r.doc_id, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = np.array(plain(tokenizer, r.text), "<u4")
        want.append((-1 if np.isnan(r.doc_id) else int(r.doc_id), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    have = sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples())
    assert have == sorted(want)


def test_single_reads_and_misses(spark, awkward, tokenizer, tmp_path):
    path = f"file://{tmp_path}/store"
    ts.write_store(awkward, path, tokenizer_file())
    store = ts.TokenStore(path, ts._n_buckets(spark, path))
    assert store.get(4).tolist() == plain(tokenizer, "one two three four five six seven")
    assert store.get(10).tolist() == plain(tokenizer, "ça été où 𝒳 <|endoftext|> it's 42_a\x1c!")
    assert store.get(999) is None


def test_text_keys_and_four_bytes(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(f"k{i}", f"text number {i}") for i in range(50)], "name string, body string")
    path = f"file://{tmp_path}/store"
    ts.write_store(docs, path, tokenizer_file(), key="name", text="body", width=4)
    assert ts.TokenStore(path, ts._n_buckets(spark, path)).get("k7").tolist() == plain(tokenizer, "text number 7")


def test_portions_and_words_apart(tokenizer):
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab É'st  \n\t\r\x0b\x0c\x1c\xa0,1_中𝒳<|>") for _ in range(draw.randrange(60))) for _ in range(500)]
    texts += ["plain words, only: 'tis 42!", "", "<|endoftext|>", "a" * 3000]
    coder = ts.WordTokenizer(tokenizer_file(), 2)
    for some in (texts, texts[-4:-2], [""], ["it's plain", "and Plain"]):
        sizes, parts = coder.encode(pa.array(some, pa.string()), 1)
        ids = np.concatenate(list(parts)).tolist()
        want = [plain(tokenizer, t) for t in some]
        assert sizes.tolist() == list(map(len, want)) and ids == [i for w in want for i in w]


def test_one_key_in_many_shards(spark, tokenizer, tmp_path):
    """A key with most rows, and rows without a key, are dealt to shards; one copy is indexed."""
    rows = [(None, f"none {i}") for i in range(300)] + [(7, f"hot {i}") for i in range(400)] + [(i, f"text {i}") for i in range(8, 100)]
    path = f"file://{tmp_path}/store"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ts.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), path, tokenizer_file())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.where("key = 7").select("shard").distinct().count() > 1
    for key, n in ((7, 400), (None, 300), (50, 1)):
        same = manifest.where(F.col("key").eqNullSafe(F.lit(key))).orderBy("shard", "offset")
        assert [r["copy"] for r in same.collect()] == list(range(n))
    found = ts.find(spark.createDataFrame([(7,), (50,), (1000,)], "doc_id long"), path).unionByName(ts.unindexed(spark, path))
    digests = ts.token_digests(found, path).collect()
    assert len(digests) == 300 + 400 + 1 and len({r["start"] for r in digests}) == 701
    assert len({r["ids_crc32"] for r in digests}) > 600


def test_keys_that_are_not_numbers(spark, tmp_path):
    rows = [(float("nan"), "a"), (float("nan"), "b"), (1.5, "c")]
    path = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame(rows, "doc_id double, text string"), path, tokenizer_file())
    assert spark.read.parquet(f"{path}/manifest").where("copy > 0").count() == 1
    with pytest.raises(ValueError, match="share their hashes"):
        ts.PerfectHash.build(*np.array([[5, 5, 6], [7, 7, 8]], np.uint64))


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, (2, 20_000)).astype(np.uint64)
    hashed = ts.PerfectHash.build(a, b)
    assert sorted(hashed.slots(a, b)) == list(range(20_000))


def test_empty_table(spark, no_docs, tmp_path):
    path = f"file://{tmp_path}/store"
    ts.write_store(no_docs, path, tokenizer_file())
    assert ts.find(spark.createDataFrame([(1,)], "doc_id long"), path).count() == 0
    assert ts.TokenStore(path, ts._n_buckets(spark, path)).get(1) is None
    assert ts.TokenStore(path, 3).get(1) is None


def test_a_vocabulary_too_wide_is_refused(awkward, tmp_path):
    with pytest.raises(Exception, match="do not fit"):
        ts.write_store(awkward, f"file://{tmp_path}/store", tokenizer_file(), width=1)
