import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfold.operators.dense_knn import knn_dense
from nearfold.operators.sparse_knn import knn_sparse
from nearfold.operators.tfidf import TfidfEmbedder, checked_unigram_idf, median_idf, unpack_rows
from nearfold.operators.vectors import WordVectorEmbedder, coverage_stats

SETTINGS = {"max_features": 100, "ngram_max": 2, "min_df": 1, "max_df": 1.0}


def brute(ids, matrix, k):
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    scores = np.round(unit @ unit.T, 6)
    out = []
    for i, a in enumerate(ids):
        best = sorted((-scores[i, j], b) for j, b in enumerate(ids) if b != a)[:k]
        out += [(a, rank, b, -s) for rank, (s, b) in enumerate(best, 1)]
    return pd.DataFrame(out, columns=["movie_id", "rank", "neighbour_id", "score"])


def sorted_edges(df):
    return df.toPandas().sort_values(["movie_id", "rank"]).reset_index(drop=True)


def same(got, want):
    assert got[["movie_id", "rank", "neighbour_id"]].values.tolist() == (
        want[["movie_id", "rank", "neighbour_id"]].values.tolist()
    )
    assert np.abs(got.score - want.score).max() < 1e-9


def packed(spark, ids, matrix):
    norm = np.linalg.norm(matrix, axis=1)
    rows = [
        (i, np.flatnonzero(row).tolist(), (row[row > 0] / n).tolist())
        for i, row, n in zip(ids, matrix, norm)
        if n > 0
    ]
    return spark.createDataFrame(rows, "id long, terms array<int>, weights array<double>")


def sparse_case(n=160, width=60, seed=1):
    rng = np.random.default_rng(seed)
    # Rare terms first, the last columns held by most rows.
    share = np.concatenate([np.full(width - 6, 0.04), np.full(6, 0.7)])
    matrix = (rng.random((n, width)) < share) * rng.random((n, width)) * np.linspace(3, 0.3, width)
    matrix[20:70] = matrix[20]  # a third of all rows are copies
    matrix[90:95] = 0
    return [int(i) for i in rng.permutation(n) * 3 + 5], matrix


@pytest.mark.parametrize("block_rows,entries", [(2048, 1_000_000), (30, 1_000_000), (9, 200), (2048, 60)])
def test_sparse_equals_brute_force(spark, block_rows, entries):
    ids, matrix = sparse_case()
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = knn_sparse(packed(spark, ids, matrix), frame, 7, block_rows, entries)
    same(sorted_edges(got), brute(ids, matrix, 7).sort_values(["movie_id", "rank"]).reset_index(drop=True))


@pytest.mark.parametrize("block_rows", [2048, 40, 5])
def test_dense_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 5))
    matrix = centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.2
    matrix[10:60] = matrix[10]
    matrix[70:75] = 0
    matrix[80] = matrix[81] * 2
    ids = [int(i) for i in rng.permutation(150)]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, matrix)], "id long, vec array<double>")
    got = knn_dense(df, 6, block_rows)
    same(sorted_edges(got), brute(ids, matrix, 6).sort_values(["movie_id", "rank"]).reset_index(drop=True))


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vec array<double>")
    got = sorted_edges(knn_dense(df, 10))
    assert got.groupby("movie_id").size().tolist() == [2, 2, 2]
    assert got[got.movie_id == 1].neighbour_id.tolist() == [3, 2]


def test_no_overlap_is_padded_with_the_smallest_ids(spark):
    ids = [10, 20, 30, 40]
    matrix = np.eye(4)
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = sorted_edges(knn_sparse(packed(spark, ids, matrix), frame, 2))
    assert got[got.movie_id == 10].neighbour_id.tolist() == [20, 30]
    assert got[got.movie_id == 40].neighbour_id.tolist() == [10, 20]
    assert (got.score == 0).all()


TEXTS = [
    (10, "space battle among distant stars"),
    (20, "space battle near distant planets"),
    (30, "romantic comedy in paris"),
    (40, "romantic drama in london paris"),
    (50, ""),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, document string")


def test_tfidf_by_hand(spark, docs):
    model = TfidfEmbedder({**SETTINGS, "ngram_max": 1}, ["in"]).fit(docs)
    vocab = {r.term: r for r in model.vocab.collect()}
    assert vocab["space"].df == 2 and vocab["paris"].cf == 2
    assert math.isclose(vocab["space"].idf, math.log(6 / 3) + 1)
    assert math.isclose(vocab["stars"].idf, math.log(6 / 2) + 1)
    rows = unpack_rows(model.rows, model.vocab, 100).where("id = 30").collect()
    weights = {r.term: r.weight for r in rows}
    raw = {"romantic": math.log(2) + 1, "comedy": math.log(3) + 1, "paris": math.log(2) + 1}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    assert weights == pytest.approx({t: w / norm for t, w in raw.items()})
    edges = sorted_edges(model.neighbours(1))
    assert edges.set_index("movie_id").neighbour_id.to_dict() == {10: 20, 20: 10, 30: 40, 40: 30, 50: 10}


def test_vocabulary_bounds_come_before_the_cap(spark):
    texts = [(i, "aa " * 5 + "bb " + ("cc" if i < 2 else "dd")) for i in range(4)]
    docs = spark.createDataFrame(texts, "id long, document string")
    model = TfidfEmbedder({"max_features": 1, "ngram_max": 1, "min_df": 2, "max_df": 0.6}, []).fit(docs)
    # aa and bb are in every document; of cc and dd the cap keeps the first by name.
    assert [r.term for r in model.vocab.collect()] == ["cc"]
    free = TfidfEmbedder({"max_features": None, "ngram_max": 1, "min_df": 1, "max_df": 1.0}, []).fit(docs)
    numbers = {r.term: r.term_no for r in free.vocab.collect()}
    assert numbers == {"cc": 0, "dd": 1, "aa": 2, "bb": 3}


def test_sublinear_counts_and_unseen_terms(spark, docs):
    model = TfidfEmbedder({**SETTINGS, "ngram_max": 1}, []).fit(docs)
    new = spark.createDataFrame([(1, "paris paris paris space martians")], "id long, document string")
    rows = unpack_rows(model.transform(new), model.vocab, 100).collect()
    weights = {r.term: r.weight for r in rows}
    assert set(weights) == {"paris", "space"}
    assert weights["paris"] / weights["space"] == pytest.approx(math.log(3) + 1)


def test_saved_model_transforms_alike(spark, docs, store):
    model = TfidfEmbedder(SETTINGS, ["in"]).fit(docs)
    model.save(store, "2026-01-01")
    again = TfidfEmbedder.load(store, "2026-01-01", SETTINGS, ["in"])
    a = {r.id: (r.terms, r.weights) for r in model.transform(docs).collect()}
    b = {r.id: (r.terms, r.weights) for r in again.transform(docs).collect()}
    assert a == b and len(a) == 4
    with pytest.raises(RuntimeError):
        TfidfEmbedder(SETTINGS, []).save(store, "2026-01-02")


WORDS = [("space", [1.0, 0.0, 0.0]), ("paris", [0.0, 1.0, 0.0]), ("drama", [0.0, 0.0, 1.0]), ("anti", [-1.0, 0.0, 0.0])]


def test_word_vectors_by_hand(spark):
    words = spark.createDataFrame(WORDS, "token string, vec array<double>")
    idf = spark.createDataFrame([("space", 2.0), ("paris", 1.0), ("anti", 2.0), ("zoo", 9.0)], "term string, idf double")
    docs = spark.createDataFrame(
        [(1, "space paris paris unknown"), (2, "drama"), (3, "nothing known"), (4, "space anti")],
        "id long, document string",
    )
    embedder = WordVectorEmbedder(idf, words, [])
    got = {r.id: r.vec for r in embedder.transform(docs).collect()}
    # 2 x space and 1 + 1 x paris weigh the same.
    assert got[1] == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), 0.0])
    assert got[2] == pytest.approx([0.0, 0.0, 1.0])
    assert got[3] == [0.0, 0.0, 0.0]
    assert got[4] == [0.0, 0.0, 0.0]
    assert median_idf(idf).first().median_idf == 2.0
    stats = embedder.coverage(docs).first()
    assert stats.oov_rate == pytest.approx(3 / 9)
    assert stats.median_idf_fallback_rate == pytest.approx(1 / 6)
    capped = WordVectorEmbedder(idf, words, [], 4, 4)
    assert {r.id: r.vec for r in capped.transform(docs).collect()} == got


def test_coverage_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "id long, term string, tf long")
    words = spark.createDataFrame(WORDS, "token string, vec array<double>")
    idf = spark.createDataFrame([("space", 2.0)], "term string, idf double")
    assert tuple(coverage_stats(empty, words, idf).first()) == (None, None)


def test_idf_table_is_checked(spark):
    with pytest.raises(ValueError, match="single words"):
        checked_unigram_idf(spark.createDataFrame([("a b", 1.0)], "term string, idf double"))
    with pytest.raises(ValueError, match="empty"):
        checked_unigram_idf(spark.createDataFrame([], "term string, idf double"))


def test_counting_needs_one_exchange_at_most(spark):
    from nearfold.operators.catalog import dedup_keep_max
    from nearfold.operators.tfidf import packed_rows, term_counts, vocabulary

    docs = spark.createDataFrame([(i, "aa bb", i) for i in range(8)], "id long, document string, vote_count long")
    unique = dedup_keep_max(docs).persist()
    unique.count()

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        return plan.count("Exchange hashpartitioning")

    assert exchanges(term_counts(unique, [], 2, clustered=True)) == 0
    counts = term_counts(docs, [], 2)
    assert exchanges(counts) == 1
    counts = counts.persist()
    counts.count()
    from pyspark.sql import functions as F

    vocab = vocabulary(counts, F.lit(8), SETTINGS).persist()
    vocab.count()
    assert exchanges(packed_rows(counts, vocab, 100)) == 0


def test_blocks_are_bounded_and_many(spark):
    """Even where long rows gather under one term."""
    from pyspark.sql import functions as F

    from nearfold.operators.blocks import LEAST_BLOCKS, number_blocks

    rows = spark.range(900).select("id", F.lit(1).alias("anchor"), F.expr("CAST(1 + id % 50 AS INT) AS n"))
    for most_rows, most_entries in ((2048, 10**6), (40, 500), (7, 10**6)):
        blocked, n_blocks = number_blocks(rows, ["anchor", "id"], F.col("n"), most_rows, most_entries)
        sizes = blocked.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("entries")).collect()
        assert LEAST_BLOCKS <= len(sizes) <= n_blocks
        assert max(r["rows"] for r in sizes) <= most_rows + 1
        assert max(r["entries"] for r in sizes) <= most_entries + 50


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_rows_equals_sorting(k):
    from nearfold.operators.blocks import best_of

    rng = np.random.default_rng(k)
    scores = rng.integers(-3, 4, (60, 40)) / 10.0
    scores[rng.random(scores.shape) < 0.1] = -np.inf
    scores[5], scores[6, 3], scores[7, 2] = np.nan, np.inf, np.nan
    ids = np.sort(rng.choice(1000, 40, replace=False))
    floors = np.where(rng.random(60) < 0.5, -np.inf, 0.1)
    rows, others, best, raised = best_of(scores, ids, k, floors)
    for i in range(60):
        able = [(-s, j) for s, j in zip(scores[i], ids) if np.isfinite(s) and s >= floors[i]]
        want = sorted(able)[:k]
        assert sorted(zip(-best[rows == i], others[rows == i])) == want
        assert raised[i] == (max(floors[i], -want[-1][0] - 2e-6) if len(want) == k else floors[i])


def test_portions_of_light_terms_change_nothing(monkeypatch):
    from nearfold.operators import sparse_knn

    rng = np.random.default_rng(1)
    terms = [np.sort(rng.choice(300, rng.integers(1, 30), replace=False)) for _ in range(90)]
    weights = [rng.random(len(t)) for t in terms]
    whole = np.zeros((90, 300))
    for i, (t, w) in enumerate(zip(terms, weights)):
        whole[i, t] = w
    beyond = [np.append(t, 999) for t in terms], [np.append(w, 1.0) for w in weights]
    for portion in (1, 50, 2_000_000):
        monkeypatch.setattr(sparse_knn, "PORTION", portion)
        index = sparse_knn.BlockIndex(np.arange(90), [terms, weights])
        assert np.allclose(index.scores(list(beyond)), whole @ whole.T, atol=1e-6)


def test_vectors_are_compared_once_for_all_readers(spark):
    """Edges are read from what was kept; each reader compared all blocks again."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id long, vec array<double>")
    plan = knn_dense(df, 3, 10)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_held_rows_keep_their_best_while_strips_go_by(monkeypatch):
    from nearfold.operators import blocks

    monkeypatch.setattr(blocks, "WAITING", 50)
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((400, 7)), 1)
    scores[3, 2] = np.nan
    ids = rng.permutation(400)
    held = blocks.Held(np.full(7, 0.2), 4)
    for at in range(0, 400, 16):
        held.add(scores[at : at + 16], ids[at : at + 16])
        assert sum(len(p[0]) for p in held.parts) <= 7 * 4 + 50 + 16 * 7
    got = sorted(zip(*(c.tolist() for c in held.cut())))
    want = []
    for row in range(7):
        best = sorted((-s, i) for s, i in zip(scores[:, row], ids) if s >= 0.2)[:4]
        want += [(row, int(i), -s) for s, i in best]
    assert got == sorted(want)


def test_vectors_travel_in_large_blocks():
    """What is moved falls with the rows of a block: 50,000 vectors of 64 numbers are few blocks."""
    from nearfold.operators import dense_knn, sparse_knn

    assert dense_knn.BLOCK_CELLS // max(64, dense_knn.BLOCK_CELLS // dense_knn.BLOCK_ROWS) >= 16_000
    assert sparse_knn.BLOCK_ENTRIES // max(200, sparse_knn.BLOCK_ENTRIES // sparse_knn.BLOCK_ROWS) >= 8_000


def test_rows_of_one_id_are_counted_without_an_aggregate(spark, docs):
    """Counting all (id, term) in one hash table spilled; a unique document is counted in its row."""
    from nearfold.operators.tfidf import term_counts

    more = docs.unionByName(spark.createDataFrame([(60, "a1 a1 a1 b2 a1 b2"), (None, "zz zz"), (70, None)], docs.schema))
    fast, slow = (term_counts(more, ["in"], 3, unique=u) for u in (True, False))
    assert fast.schema == slow.schema or [f.dataType for f in fast.schema] == [f.dataType for f in slow.schema]
    assert sorted(map(tuple, fast.collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)
    assert "Aggregate" not in fast._jdf.queryExecution().toString()


def test_fit_keeps_no_counts(spark, docs):
    model = TfidfEmbedder(SETTINGS, ["in"]).fit(docs)
    assert model.held == [model.vocab]


def test_vectors_are_not_joined_to_tokens(spark, monkeypatch):
    """A vector for each token was shuffled and spilled; numbers of words are joined, and vectors read in parts."""
    from nearfold.operators import vectors

    monkeypatch.setattr(vectors, "PART_CELLS", 12)
    monkeypatch.setattr(vectors, "KEPT_CELLS", 24)
    monkeypatch.setattr(vectors, "STRIP_CELLS", 16)
    rng = np.random.default_rng(11)
    table = [(f"w{i % 37}", rng.normal(size=4).tolist()) for i in range(40)] + [(None, [1.0] * 4)]
    words = spark.createDataFrame(table, "token string, vec array<double>")
    idf = spark.createDataFrame([(f"w{i}", 1.0 + i % 5) for i in range(0, 37, 2)], "term string, idf double")
    median = float(np.median([1.0 + i % 5 for i in range(0, 37, 2)]))
    texts = {i: [f"w{j}" for j in rng.integers(0, 45, 30)] for i in range(60)}
    # A repeated id counts both texts, on both of its rows.
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(70, None), (71, "other"), (5, "w1 w1 w2"), (72, " ".join(texts[3]))]
    texts[5] = texts[5] + ["w1", "w1", "w2"]
    made = WordVectorEmbedder(idf, words, []).transform(spark.createDataFrame(rows, "id long, document string"))
    got = made.collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    vec = {r.id: r.vec for r in got}
    for i, text in texts.items():
        total = np.zeros(4)
        for token, v in table[:40]:
            n = int(token[1:])
            total += text.count(token) * (1.0 + n % 5 if n % 2 == 0 else median) * np.array(v)
        assert np.allclose(vec[i], total / np.linalg.norm(total))
    assert vec[70] == vec[71] == [0.0] * 4
    # Bit-equal, as `knn_dense` groups equal vectors.
    assert vec[72] == vec[3]
    plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if ("Aggregate" in x or "Join" in x or "Exchange" in x) and "vec" in x]


@pytest.mark.parametrize("groups", [2, 5, 16])
def test_blocks_are_read_not_copied(spark, monkeypatch, groups):
    """Each block was shuffled once for every stripe of others; now it is written once and read by number."""
    from nearfold.operators import blocks

    monkeypatch.setattr(blocks, "GROUPS", groups)
    monkeypatch.setattr(blocks, "STRIP_CELLS", 40)
    monkeypatch.setattr(blocks, "WAITING", 10)
    rng = np.random.default_rng(groups)
    matrix = np.round(rng.normal(size=(160, 5)), 1)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    rows = spark.createDataFrame([(i, i // 8, v.tolist()) for i, v in enumerate(matrix)], "id long, block int, vec array<double>")
    # One number is left out.
    rows = rows.where("block != 7")
    from nearfold.operators.dense_knn import VectorBlock

    found = blocks.block_neighbours(rows, 20, {"vec": "<f8"}, VectorBlock, 3, -np.inf)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas().drop_duplicates()
    # Each row has candidates from its own block and from one task for each group at most.
    assert len(got) <= 160 * 3 * (1 + 20) and got.groupby("a").size().max() <= 3 * (2 + min(groups, 20))
    scores = np.round(matrix @ matrix.T, 6)
    keep = [i for i in range(160) if i // 8 != 7]
    for i in keep:
        want = sorted((-scores[i, j], j) for j in keep if j != i)[:3]
        mine = got[got["a"] == i]
        assert sorted(zip(-mine["score"], mine["b"]))[:3] == want


def shared(spark):
    from pathlib import Path

    from nearfold.scale import shared_dir

    return Path(shared_dir(spark).removeprefix("file:"))


def test_numbering_blocks_copies_no_rows(spark):
    """Whole rows were sorted and kept for it."""
    from pyspark.sql import functions as F

    from nearfold.operators.blocks import number_blocks

    size = lambda: sum(p.stat().st_size for p in shared(spark).rglob("*") if p.is_file())
    wide = F.expr("transform(sequence(1, 512), x -> rand(7))")
    rows = spark.range(2000).select("id", F.lit(1).alias("anchor"), wide.alias("w"))
    before = size()
    blocked, n_blocks = number_blocks(rows, ["anchor", "id"], F.size("w"), 100, 10**6)
    assert size() - before < 1_000_000
    got = [r.block for r in blocked.select("id", "block").orderBy("id").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == n_blocks - 1


def test_searches_remove_their_blocks(spark):
    ids, matrix = sparse_case()
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, matrix)], "id long, vec array<double>")
    before = set(shared(spark).glob("blocks-*"))
    assert knn_sparse(packed(spark, ids, matrix), frame, 3).count() == 160 * 3
    assert knn_dense(vectors, 3).count() == 160 * 3
    assert set(shared(spark).glob("blocks-*")) == before


@pytest.mark.parametrize("few", [True, False])
def test_stored_rows_and_many_copies(spark, monkeypatch, few):
    """A third of the rows are copies, left out with and without moving the others."""
    from nearfold.operators import sparse_knn

    monkeypatch.setattr(sparse_knn, "fits_broadcast", lambda n: few)
    ids, matrix = sparse_case()
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    rows = packed(spark, ids, matrix).persist()
    want = brute(ids, matrix, 7).sort_values(["movie_id", "rank"]).reset_index(drop=True)
    same(sorted_edges(knn_sparse(rows, frame, 7, 30, stored=True)), want)


def test_stored_vectors(spark):
    ids, matrix = sparse_case()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, matrix)], "id long, vec array<double>").persist()
    want = brute(ids, matrix, 7).sort_values(["movie_id", "rank"]).reset_index(drop=True)
    same(sorted_edges(knn_dense(rows, 7, 30, stored=True)), want)


def test_vocabulary_in_portions(spark):
    from pyspark.sql import functions as F

    from nearfold.operators.tfidf import vocabulary

    counts = spark.range(4000).select(
        (F.col("id") % 97).alias("id"), F.concat(F.lit("t"), F.col("id") % 301).alias("term"), (F.col("id") % 5 + 1).alias("tf")
    ).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    settings = {"max_features": 40, "ngram_max": 1, "min_df": 3, "max_df": 0.9}
    whole = vocabulary(counts, F.lit(97), settings).orderBy("term_no").collect()
    assert len(whole) == 40
    for portions in (2, 7):
        assert vocabulary(counts, F.lit(97), settings, portions).orderBy("term_no").collect() == whole


def searched(kind, rng, n, signed=False):
    """A block's index over rows of a kind, the rows as columns, and as a matrix."""
    from nearfold.operators import dense_knn, sparse_knn

    matrix = rng.normal(size=(n, 40)) if signed else rng.random((n, 40))
    if kind == "sparse":
        matrix *= rng.random((n, 40)) < np.linspace(0.05, 0.8, 40)
        matrix[:, 7] = 0.5
        columns = [np.flatnonzero(row) for row in matrix], [row[row != 0] for row in matrix]
        matrix /= np.linalg.norm(matrix, axis=1)[:, None]
        columns = columns[0], [row[row != 0] for row in matrix]
        return sparse_knn.BlockIndex(np.arange(n), columns), columns, matrix
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    return dense_knn.VectorBlock(np.arange(n), [list(matrix)]), [list(matrix)], matrix


@pytest.mark.parametrize("kind", ["sparse", "dense"])
@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("many", [1, 10**6])
def test_pairs_that_reach_a_floor_are_found_and_few_worked_out(monkeypatch, kind, signed, many):
    """Every score was made in 64 bits; now 32 tell which pairs can count, and only these are."""
    from nearfold.operators import blocks, sparse_knn

    monkeypatch.setattr(blocks, "MANY", many)
    monkeypatch.setattr(sparse_knn, "PORTION", 60)
    monkeypatch.setattr(sparse_knn, "LIGHT_COST", 3)
    rng = np.random.default_rng(8)
    index, _, matrix = searched(kind, rng, 150, signed)
    _, columns, others = searched(kind, rng, 70, signed)
    # Rows and queries that are equal, and more ties.
    others[3], others[4] = matrix[5], matrix[6]
    for at, c in enumerate(columns):
        for i in (3, 4):
            row = others[i]
            c[i] = row if kind == "dense" else [np.flatnonzero(row), row[row != 0]][at]
    true = np.round(others @ matrix.T, 6)
    floors, own = np.sort(true, axis=1)[:, -6] - 2e-6, np.sort(true, axis=0)[-4] - 2e-6
    found = index.reaching(columns, floors, own, 5)
    cells = {(q, r): s for q, r, s in zip(*(c.tolist() for c in found))}
    need = np.argwhere((true >= floors[:, None]) | (true >= own))
    if many > 1:
        assert set(map(tuple, need.tolist())) <= set(cells)
    assert all(abs(cells[q, r] - true[q, r]) < 1.1e-6 for q, r in cells)
    assert len(cells) < len(need) + 50 < true.size / 4
    # Without floors the K best of each query are there nonetheless, and no more than that where floors are raised.
    found = index.reaching(columns, np.full(70, -np.inf if signed or kind == "dense" else 5e-7), None, 5)
    queries, rows, scores = found
    for q in range(70):
        got = sorted(zip(-scores[queries == q], rows[queries == q].tolist()))[:5]
        want = sorted(zip(-true[q], range(150)))[:5]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1.1e-6)
    if many == 1:
        assert len(rows) < 70 * 5 + 70


def test_rows_are_weighed_without_joining_terms(spark, docs):
    """Every (id, term) was joined with the vocabulary and gathered again; a unique document is weighed in its row."""
    from nearfold.operators.tfidf import packed_rows, term_counts

    texts = ["a1 a1 a1 b2 a1 b2", "zz zz", None, "", "nowhere", "a1 a1 a1 b2 a1 b2"]
    more = docs.unionByName(spark.createDataFrame([(60 + i, t) for i, t in enumerate(texts)], docs.schema))
    more = more.unionByName(more.select((F.col("id") + 100).alias("id"), "document")).unionByName(
        spark.createDataFrame([(None, "b2 zz")], docs.schema)
    )
    model = TfidfEmbedder({**SETTINGS, "min_df": 2, "max_df": 0.9}, ["in"]).fit(more)
    assert not [x for x in ("Join", "Aggregate", "Exchange") if x in model.rows._jdf.queryExecution().executedPlan().toString()]
    want = packed_rows(term_counts(more, ["in"], 2), model.vocab, 100)
    assert [f.dataType for f in model.rows.schema] == [f.dataType for f in want.schema]
    got, want = ({r.id: r for r in rows.collect()} for rows in (model.rows, want))
    assert set(got) == set(want) and None in got and 62 not in got and len(got) > 8
    for i, row in got.items():
        assert row.terms == want[i].terms and np.allclose(row.weights, want[i].weights, rtol=1e-12)
    # Bit-equal, as `knn_sparse` groups equal rows.
    assert got[60][1:] == got[65][1:] == got[160][1:]
