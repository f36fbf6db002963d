import itertools
import random

import numpy as np
import pytest

from nearfold.llm import shingle_join as sj
from nearfold.llm import vector_join as vj
from nearfold.llm.components import components


def closure(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (500, 501)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == closure({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def set_of(text):
    words = [bytes(w).decode("utf-8") for w in (text or "").encode().lower().split()]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(5))))


def brute(rows):
    sets = [(i, set_of(t)) for i, t in rows]
    links = [
        (a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
        if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    least = closure([i for i, _ in rows], links)
    return {i: (len(x), least[i]) for i, x in sets}


def family(rng, n, length, edits, first):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"v{rng.randrange(9000)}"
        out.append((first + k, " ".join(words)))
    return out


@pytest.mark.parametrize("often", [2, 1_000_000])
def test_shingle_links_equal_brute_force(spark, monkeypatch, often):
    """With all repeated tokens frequent (pairs of tokens) and with none (single tokens)."""
    monkeypatch.setattr(sj, "OFTEN", often)
    monkeypatch.setattr(sj, "BLOCK", 16)
    rng = random.Random(5)
    rows = family(rng, 90, 60, 5, 0) + family(rng, 60, 150, 6, 1000) + family(rng, 40, 22, 2, 2000) + family(rng, 30, 9, 1, 3000)
    boiler = " ".join(f"b{k}" for k in range(30))
    rows += [(4000 + k, boiler + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(14)))) for k in range(60)]
    rows += [(5000, ""), (5001, None), (5002, "a b"), (5003, "A  b"), (5004, "a b c")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           sj.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = rng.choice(10_000, n, replace=False).astype(np.uint64)
        keep = x[rng.random(n) > rng.choice([0, 0.05, 0.1, 0.2])]
        y = np.unique(np.concatenate([keep, rng.choice(10_000, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)]))
        x = np.unique(x)
        frequent = np.zeros(sj.MAP_BITS, np.uint8)
        frequent[:10_000] = rng.random(10_000) < rng.choice([0, 0.3, 0.7, 0.95, 1])
        if len(y) and not np.array_equal(x, y) and sj.linked(x, y, 75):
            assert len(np.intersect1d(sj.signatures(x, frequent)[0], sj.signatures(y, frequent)[0]))
            held = sj.Maps([sj.bitmap(x), sj.bitmap(y)], np.array([len(x), len(y)]))
            assert held.may_link(np.array([0]), np.array([1]), 75)[0]


def test_bitmaps_of_different_widths():
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 2**63, 1100).astype(np.uint64))
    near, far = x[: 950], np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    sets = [x, near, far]
    held = sj.Maps([sj.bitmap(s) for s in sets], np.array([len(s) for s in sets]))
    assert held.width.tolist() == [512, 256, 256]
    assert held.may_link(np.array([0, 0, 1]), np.array([1, 2, 2]), 75).tolist() == [True, False, False]


def test_awkward_documents(awkward, no_docs):
    rows = awkward.select("doc_id", "text").collect()
    want = brute([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None])
    got = sj.near_documents(awkward).collect()
    assert len(got) == 12
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert sj.near_documents(no_docs).count() == 0
    kept = sj.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 8, 9, 10] or sorted(
        -1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()
    ) == [-1, *sorted({c for _, c in want.values()})]


def test_lower_thresholds_are_refused(awkward):
    with pytest.raises(ValueError):
        sj.near_documents(awkward, percent=60)


@pytest.mark.parametrize("sizes", [(2048, 2048, 8192), (15, 7, 11)])
def test_vector_links_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[rng.integers(0, 40)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.15, 0.3])).tolist()) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8),
             (404, [float("inf")] + [0.0] * 7), (405, rows[3][1]), (406, rows[3][1]), (407, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, home string, n int")
    got = {r["vec_id"]: r for r in vj.near_vectors(df, cell_rows=sizes[0], block_rows=sizes[1], chunk_rows=sizes[2]).collect()}
    fine = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    ids, m = [r[0] for r in fine], np.array([r[1] for r in fine])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    least = closure(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    counts = dict(zip(ids, near.sum(axis=1).tolist()))
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"]) == (counts.get(i, 0), least.get(i, i))
        assert got[i]["kept"] == (got[i]["component_id"] == i)


def test_vectors_without_links(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vj.near_vectors(none).count() == 0
    bad = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in vj.near_vectors(bad).collect()} == {(1, 0, True), (None, 0, False)}
