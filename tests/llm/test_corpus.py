import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm import decontaminate as dc
from nearfold.llm import mixing, quality, url_rules


# --- mixing -------------------------------------------------------------------


def plain_targets(sizes):
    """Deal out by weight, stop at three times the size, share what is over again."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, targets = sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > 3 * sizes[s]]
        if not full:
            targets.update({s: left * weights[s] / total for s in open_})
            break
        for s in full:
            targets[s] = 3 * sizes[s]
            open_.remove(s)
        left -= sum(targets[s] for s in full)
    return targets


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = rng.choice(["hot"] * 8 + ["a", "b", None, "Z", "é", "tiny"])
        if source != "tiny" or i < 40:
            rows.append((i, " ".join(["w"] * rng.randrange(1 if source == "tiny" else 60)), source))
    rows += [(1000, None, "empty"), (1001, "", "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_mix_meets_its_targets(mixed_docs):
    rows = mixing.mix_sources(mixed_docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size and abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix_sources(mixed_docs.repartition(2)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_repeated_documents_follow_the_plan(mixed_docs):
    plan = {r["doc_id"]: r for r in mixing.mix_sources(mixed_docs).collect()}
    out = mixing.repeat_documents(mixed_docs)
    assert out.columns == mixed_docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    for i, r in plan.items():
        if r["size"]:
            assert copies[i] == -(-r["taken"] // r["size"])


def test_mix_of_awkward_rows(awkward, no_docs):
    rows = mixing.mix_sources(awkward).collect()
    assert len(rows) == 12
    assert mixing.repeat_documents(awkward).columns == awkward.columns
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.repeat_documents(no_docs).count() == 0


# --- quality ------------------------------------------------------------------


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = np.array([3, 9, 20, 41]), rng.normal(size=4)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.margin(at, x), 0.3 + x @ m.weights[at] + pairs)


def test_held_out_accuracy(spark):
    from nearfold.llm.queries import op10_quality

    folder = "/root/testdata/sf0.01"
    got = op10_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    assert got.count() == 1000
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.95
    first, second = (r.orderBy("doc_id").collect() for r in (got, op10_quality(spark, folder)))
    assert first == second


def test_quality_of_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(4, 1), (8, 0), (9, 0), (77, 1), (3, None)], "doc_id long, quality int")
    machine = quality.train_quality(awkward, labels, metadata=("size",))
    scores = quality.score_quality(awkward, machine, metadata=("size",)).collect()
    assert len(scores) == 12 and all(0 <= r["score"] <= 1 for r in scores)
    kept = quality.keep_good(awkward, machine, metadata=("size",))
    assert kept.columns == awkward.columns and kept.count() == sum(r["score"] >= 0.5 for r in scores)
    untrained = quality.train_quality(awkward, labels.where("quality > 1"))
    assert {r["score"] for r in quality.score_quality(awkward, untrained).collect()} == {0.5}
    assert quality.score_quality(no_docs, machine).count() == 0


def test_one_training_row_for_each_key(spark, monkeypatch):
    rows = [(1, f"text number {i % 50}") for i in range(2_000)] + [(i, "other words") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels, size: seen.append(len(rows)))
    quality.train_quality(docs, labels, most_rows=100)
    quality.train_quality(docs, labels)
    assert seen == [100, 199]


# --- URL rules ----------------------------------------------------------------


def test_url_verdicts(spark):
    urls = [
        "http://A.Example.ORG/x", "https://example.org/es/1", "http://sub.example.org/en/12?q", "http://example.com/de/", "ftp://x.com/fr/a#b",
        "http://example.com?x", "no scheme", None, "http://casino-win.example.net/en/", "http://occasino.net/", "://h/p", "http://notexample.org.net/",
        "http://example.org:80/es/", "http://casino-win.example.org/en/9", "http://example.org?u=http://b.com/c",
        "https://example.org#x://y/es/", "http://example.org/" + "long/" * 20_000, "http://a.example.org/x\n/y",
    ]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    df = df.union(df.where("page_id < 3"))
    rules = url_rules.DOMAIN_RULES + url_rules.PATTERN_RULES
    assert len(rules) > 200
    rows = url_rules.judge_urls(df, rules).collect()
    assert len(rows) == len(urls) + 3
    got = {r["page_id"]: r for r in rows}
    joined = url_rules.judge_urls(df, url_rules.rules_table(spark, rules)).collect()
    assert sorted(map(str, joined)) == sorted(map(str, rows))
    assert {r["verdict"] for r in url_rules.judge_urls(df, []).collect()} == {"allow"}
    want = [
        ("a.example.org", "/x", "org/", "allow"), ("example.org", "/es/1", "example.org/es/", "block"),
        ("sub.example.org", "/en/12", "example.org/en/1", "block"), ("example.com", "/de/", "com/de/", "block"),
        ("x.com", "/fr/a", "com/fr/", "allow"), ("example.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("casino-win.example.net", "/en/", None, "block"), ("occasino.net", "/", None, "allow"), ("h", "/p", None, "allow"),
        ("notexample.org.net", "/", None, "allow"), ("example.org:80", "/es/", None, "allow"), ("casino-win.example.org", "/en/9", "org/", "allow"),
        ("example.org", "", None, "allow"), ("example.org", "", None, "allow"), ("example.org", "/" + "long/" * 20_000, "org/", "allow"),
        ("a.example.org", "/x\n/y", "org/", "allow"),
    ]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == want
    assert url_rules.judge_urls(df.limit(0), url_rules.DOMAIN_RULES).count() == 0


def test_more_rules_than_a_plan_holds(spark):
    rules = [url_rules.domain_rule(f"h{i}.net/", ("allow", "block")[i % 2]) for i in range(url_rules.MOST_RULES + 1)]
    df = spark.createDataFrame([(i, f"http://www.h{i}.net/x") for i in (3, 4, 5_000, 9_999)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()}
    assert got == {3: ("h3.net/", "block"), 4: ("h4.net/", "allow"), 5000: ("h5000.net/", "allow"), 9999: (None, "allow")}


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_rules.domain_rule("example.org/es/", "block")]
    assert url_rules.file_rules(rules, {"example": 90, "org": 30, "es": 4}) == {"es": [0]}
    assert url_rules.domain_rule("example.org/en/1", "block").tokens == ("example", "org", "en")


# --- decontamination ----------------------------------------------------------


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{text(rng.randrange(8, 40))}. {text(rng.randrange(3, 12))}.") for i in range(60)]
    items += [(100, text(180) + ". " + text(9)), (101, ""), (102, None), (103, items[0][1])]
    docs = []
    for i in range(120):
        words = text(rng.randrange(5, 600)).split()
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(items[:61])[1].upper().split()
        docs.append((i, " ".join(words)))
    return docs, items


def test_search_retrieves_all_units_over_the_threshold(leaky):
    docs, items = leaky
    known = [(i, t, None) for i, t in items if t]
    units, frequencies = [], Counter()
    for _, t, _ in known:
        q, a = dc.question_and_answer(t)
        units += [(q + a)[k : k + dc.UNIT] for k in range(0, len(q + a), dc.UNIT)]
    for u in units:
        frequencies.update(set(u))
    mean = sum(map(len, units)) / len(units)
    index = dc.Index.build(known, frequencies, len(units), mean)

    def share(unit, passage):
        counts = Counter(unit)
        size = dc.K1 * (1 - dc.B + dc.B * len(unit) / mean)
        part = {t: dc._idf(frequencies[t], len(units)) * f * (dc.K1 + 1) / (f + size) for t, f in counts.items()}
        return sum(v for t, v in part.items() if t in passage) / sum(part.values())

    ordered = sorted(units, key=lambda u: (sorted(set(u), key=lambda t: (-frequencies[t], t))[:3], units.index(u)))
    for _, t in docs[:40]:
        words = dc.words_of(t)
        numbers = np.array([index.terms.get(w, -1) for w in words], np.int64)
        want = {
            (p, u): share(unit, set(words[p * dc.UNIT : (p + 2) * dc.UNIT]))
            for p in range((len(words) - 1) // dc.UNIT + 1) for u, unit in enumerate(ordered)
        }
        got = {(p, u): s for p, u, s in index.search(numbers, 0.3)}
        assert set(got) == {k for k, s in want.items() if s >= 0.3 - 1e-9}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("most", [8_000_000, 2_000])
def test_leaks_are_found_and_nothing_else(spark, leaky, most):
    docs, items = leaky
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(frame, tests, most_index=most).collect()}
    flat = {i: " ".join(dc.words_of(t)) for i, t in docs}
    want = {(d, i) for d, t in flat.items() for i, x in items if x and " ".join(dc.words_of(x)) in t}
    assert got == want and want
    kept = dc.drop_leaks(frame, tests)
    assert {r["doc_id"] for r in kept.collect()} == set(flat) - {d for d, _ in want}


@pytest.mark.parametrize("most", [2_000_000, 200])
def test_strips_of_passages_change_nothing(leaky, monkeypatch, most):
    docs, items = leaky
    known = [(i, t, None) for i, t in items if t]
    frequencies = Counter(w for _, t, _ in known for w in dc.words_of(t))
    index = dc.Index.build(known, frequencies, len(known), 40.0)
    words = [w for _, t in docs for w in dc.words_of(t)]
    numbers = np.array([index.terms.get(w, -1) for w in words], np.int64)
    whole = list(index.search(numbers, 0.4))
    monkeypatch.setattr(dc, "MOST_ENTRIES", most)
    assert list(index.search(numbers, 0.4)) == whole and whole


def test_an_index_grows_with_its_text_only():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(150_000)]
    cuts = [int(150_000 * rng.random() ** 3) for _ in range(1_000_000)]
    items = [(i, " ".join(vocabulary[c] for c in cuts[i * 500 : i * 500 + 500]), None) for i in range(2000)]
    assert sum(len(t) for _, t, _ in items) > 8_000_000
    index = dc.Index.build(items, Counter(vocabulary[c] for c in cuts), 1_000_000, 62.5)
    arrays = [v for v in vars(index).values() if isinstance(v, np.ndarray)]
    names = sum(map(sys.getsizeof, index.terms)) + sys.getsizeof(index.terms)
    assert sum(a.nbytes for a in arrays) + names + sys.getsizeof(index.owners) < 100_000_000
    numbers = np.array([index.terms[w] for w in dc.words_of(items[7][1])])
    assert {index.owners[u] for _, u, s in index.search(numbers, 0.95)} == {7}


def test_leaks_with_ids_of_text_and_without_ids(spark):
    passage = "the quick brown fox jumps over the lazy dog. and it lands on soft ground"
    docs = spark.createDataFrame([("a", f"first {passage} last"), (None, passage), ("c", "nothing of it")], "doc_id string, text string")
    tests = spark.createDataFrame([("q1", passage), (None, passage)], "item_id string, text string")
    got = dc.find_leaks(docs, tests)
    assert dict(got.dtypes)["item_id"] == "string"
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, i) for d in ("a", None) for i in ("q1", None)}
    assert [r["doc_id"] for r in dc.drop_leaks(docs, tests).collect()] == ["c"]


def test_leaks_of_awkward_rows(spark, awkward, no_docs):
    tests = spark.createDataFrame([(1, "one two three four. five six seven"), (2, "it")], "item_id long, text string")
    hits = dc.find_leaks(awkward, tests).collect()
    assert Counter(r["doc_id"] for r in hits if r["item_id"] == 1) == {4: 1, 5: 2, 6: 1}
    assert dc.find_leaks(awkward, tests.limit(0)).count() == 0
    assert dc.find_leaks(no_docs, tests).count() == 0
    assert dc.drop_leaks(awkward, tests.limit(0)).count() == 12


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as cp
    from nearfold.llm.common import table, written

    from llm.test_joins import brute

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    assert [name for name, _ in cp.STAGES] and len(cp.STAGES) == 5
    (_, good), (_, distinct), (_, clean), (_, mixed), (_, tokens) = cp.STAGES
    one = written(good(spark, docs, folder))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    kept = {r["doc_id"] for r in one.collect()}
    known = [r["doc_id"] for r in docs.collect() if r["doc_id"] in labels]
    assert np.mean([(i in kept) == (labels[i] == 1) for i in known]) > 0.95
    two = written(distinct(spark, one, folder))
    want = {c for _, c in brute([(r["doc_id"], r["text"]) for r in one.collect()]).values()}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(want)
    three = written(clean(spark, two, folder))
    items = [r["text"] for r in table(spark, folder, "benchmark").collect()]
    flat = {r["doc_id"]: " ".join(dc.words_of(r["text"])) for r in two.collect()}
    leaks = {i for i, t in flat.items() if any(" ".join(dc.words_of(x)) in t for x in items)}
    assert {r["doc_id"] for r in three.collect()} == set(flat) - leaks
    four = written(mixed(spark, three, folder))
    plan = {r["doc_id"]: r for r in mixing.mix_sources(three).collect()}
    copies = Counter(r["doc_id"] for r in four.collect())
    assert all(copies[i] == -(-r["taken"] // r["size"]) for i, r in plan.items() if r["size"])
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = tokens(spark, four, folder)
    assert five.count() == four.count()
