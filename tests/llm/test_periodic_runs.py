import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from nearfold.llm import periodic_runs as pr
from nearfold.llm.queries import op13_periodic_runs, repeating_texts


def plain_runs(words, least_length=6, least_turns=4):
    """Every period, every stretch of words equal to those one period on."""
    n, out = len(words), []
    for q in range(1, n // least_turns + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i - start + q
                if length >= max(least_length, least_turns * q):
                    part = words[start : start + length]
                    if not any(part[r:] == part[: length - r] for r in range(1, q)):
                        out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(draw):
    symbols = draw.choice([1, 2, 3, 6, 40])
    words = [draw.randrange(symbols) for _ in range(draw.randrange(60))]
    for _ in range(draw.randrange(4)):
        at, root = draw.randrange(len(words) + 1), [draw.randrange(symbols) for _ in range(draw.randrange(1, 6))]
        words[at:at] = (root * 12)[: draw.randrange(4, 40)]
    return words


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (3, 5), (10, 3)])
def test_runs_equal_plain_search(least):
    draw = random.Random(str(least))
    for _ in range(400):
        docs = [drawn(draw) for _ in range(draw.randrange(1, 4))]
        codes = np.array([c for d in docs for c in d], np.int64)
        got = pr.document_runs(codes, np.array([len(d) for d in docs], np.int64), *least)
        for d, runs in zip(docs, got):
            want = plain_runs(d, *least)
            assert [tuple(r) for r in runs.tolist()] == want
            # The same without leaving words out first.
            assert [tuple(r) for r in pr.runs_of([c + 1 for c in d], *least).tolist()] == want


def test_common_extensions_and_ranks():
    draw = random.Random(2)
    for _ in range(200):
        s = [draw.randrange(1, 4) for _ in range(draw.randrange(2, 40))]
        tree = pr.SuffixTree(s)
        tree.tour()
        n = len(s)
        suffixes = [s[i:] for i in range(n)]
        assert sorted(range(n), key=lambda i: tree.met[i]) == sorted(range(n), key=lambda i: suffixes[i])
        inverse = tree.inverse_ranks()
        assert sorted(range(n), key=lambda i: inverse[i]) == sorted(range(n), key=lambda i: [-c for c in suffixes[i]])
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        a, b = np.array(pairs).T
        common = [next((k for k in range(n) if i + k == n or j + k == n or s[i + k] != s[j + k]), n) for i, j in pairs]
        assert tree.common(a, b).tolist() == common


def plain_text(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_row(doc_id, text):
    words = plain_text(doc_id, text)
    runs = plain_runs(words)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = best[1] and 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in lost)))


def test_query_equals_plain_version(spark, tmp_path):
    """Whole texts of up to 400 words, many of them made periodic by the query."""
    draw = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [r["text"] or "" for r in docs]
    rows = [(i, " ".join(draw.choice(texts).split()[: draw.randrange(400)])) for i in range(400)]
    rows += [(400 + i, draw.choice(["so it goes on and ", "x ", "a b\n"]) * draw.randrange(30)) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \n\x0b"), (1003, "one"), (1004, "é\x1c " * 9)]
    rows += [(i, t) for i in range(2000, 2060) for t in [None, "", "a"][i % 3 : i % 3 + 1]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got.collect()) > 30


def test_awkward_rows(spark, awkward, no_docs):
    rows = pr.find_runs(awkward).collect()
    assert len(rows) == 12
    long = [r for r in rows if r["n_words"] == 60_000]
    assert [tuple(x) for x in long[0]["runs"]] == [(0, 60_000, 1)] and long[0]["collapsed"] == "word"
    assert sum(len(r["runs"]) for r in rows) == 1
    assert {r["collapsed"] for r in rows if r["doc_id"] == 7} == {""}
    assert pr.find_runs(no_docs).count() == 0
    assert repeating_texts(awkward).count() == 12
    with pytest.raises(ValueError):
        pr.find_runs(awkward, least_turns=1)


def test_text_keys_and_other_limits(spark):
    docs = spark.createDataFrame([("k", "x y x y x y z")], "name string, body string")
    row = pr.find_runs(docs, key="name", text="body", least_length=4, least_turns=3).first()
    assert (row["doc_id"], [tuple(r) for r in row["runs"]], row["collapsed"]) == ("k", [(0, 6, 2)], "x y z")
