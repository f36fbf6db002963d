import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from nearfold.llm import byte_bpe
from nearfold.llm.common import gathered
from nearfold.llm.queries import op11_byte_bpe, tokenizer_file

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_library_for_each_word(ranks, library):
    draw = random.Random(3)
    words = {"".join(draw.choice("aabeehinorst 's!?0123é中\n") for _ in range(draw.randrange(1, 30))) for _ in range(20_000)}
    words |= {"a" * n for n in range(1, 70)} | {" the", "z" * 5000, "é" * 300}
    words = [w.encode() for w in sorted(words)]
    ids, starts = byte_bpe.Merges(ranks).replay(words)
    for i, w in enumerate(words):
        assert ids[starts[i] : starts[i + 1]].tolist() == library._core_bpe.encode_single_piece(w), w


def test_a_merge_that_makes_a_pair_of_a_lower_rank():
    """`bc` + `b` makes a token that ranks before `bc` itself, so one at a time differs from all at once."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bcb": 256, b"bc": 257, b"cb": 300, b"bcbcb": 400}
    merges = byte_bpe.Merges(ranks)
    words = [b"bcbc", b"bcbcbc", b"bc", b"abcbcbcbcb", b"xyz", b"bcbcb"]
    ids, starts = merges.replay(words)
    plain = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    for i, w in enumerate(words):
        assert ids[starts[i] : starts[i + 1]].tolist() == plain.encode_ordinary(w.decode()) == (
            [ranks[w]] if w in ranks else merges.word(w)
        )


def test_no_words(ranks):
    ids, starts = byte_bpe.Merges(ranks).replay([])
    assert len(ids) == 0 and starts.tolist() == [0]


def test_patterns_agree_on_every_character():
    every = "".join(f"a{chr(c)}b {chr(c)}1 " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranks = {bytes([i]): i for i in range(256)}
    single = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bytes(single.encode_ordinary(every[:10_000])) == every[:10_000].encode()
    space = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.match(r"\s", chr(c))]
    assert space == [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 50)
    words, cut = regex.compile(PATTERN), regex.compile(r"\p{L}(?= \p{L})")
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("ab é's  \n\t1!中") for _ in range(draw.randrange(400)))
        parts = list(byte_bpe.pieces(text, cut))
        assert "".join(parts) == text
        assert [w for p in parts for w in words.findall(p)] == words.findall(text)


@pytest.mark.parametrize("portion, ids", [(byte_bpe.PORTION, byte_bpe.BATCH_IDS), (2_000, 300)])
def test_documents_equal_the_library(spark, ranks, library, monkeypatch, portion, ids):
    monkeypatch.setattr(byte_bpe, "PORTION", portion)
    monkeypatch.setattr(byte_bpe, "BATCH_IDS", ids)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in op11_byte_bpe(spark, folder).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        want = library.encode_ordinary(text)
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == (
            len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )


def test_awkward_rows(spark, ranks, library, awkward, no_docs):
    decoded = byte_bpe.decode(byte_bpe.encode(awkward, ranks, PATTERN), ranks).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in awkward.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in decoded) == want
    assert all(list(r["ids"]) == library.encode_ordinary(bytes(r["decoded"]).decode()) for r in decoded)
    assert byte_bpe.decode(byte_bpe.encode(no_docs, ranks, PATTERN), ranks).count() == 0


def test_decoding_of_given_ids(spark, ranks):
    given = spark.createDataFrame([("a", [1, 2, 300]), ("b", []), ("c", None)], "name string, ids array<int>")
    tokens = {r: t for t, r in ranks.items()}
    got = {r["name"]: bytes(r["decoded"]) for r in byte_bpe.decode(given, ranks).collect()}
    assert got == {"a": tokens[1] + tokens[2] + tokens[300], "b": b"", "c": b""}
    with pytest.raises(Exception, match="out of bounds"):
        byte_bpe.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), ranks).collect()


def test_gathering():
    flat, sizes = gathered(np.arange(10), np.array([0, 3, 3, 10]), np.array([2, 1, 0, 0]))
    assert flat.tolist() == [3, 4, 5, 6, 7, 8, 9, 0, 1, 2, 0, 1, 2] and sizes.tolist() == [7, 0, 3, 3]
    assert pa.array(flat).null_count == 0
