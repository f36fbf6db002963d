import hashlib
import random

import pytest

from checks.compare import connect, differences
from nearfold.llm import conversation_trie as ct
from nearfold.llm import oracle
from nearfold.llm.files import SharedFile, file_system
from nearfold.llm.queries import op12_conversation_trie


def plain_trie(conversations):
    """{prefix: members} over dictionaries; conversations are {id: [(role, text), ...]}."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in ids if len(conversations[c]) == len(prefix))
        rows.append((min(ids), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(ids), len(children),
                     len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(9)
    texts = ["", "a", "bb", "ccc", "é𝒳"]
    made = {i: [(draw.choice(["user", "bot"]), draw.choice(texts)) for _ in range(draw.choice([0, 1, 2, 5, 9]))] for i in range(-5, 60)}
    made |= {100 + i: [("user", "hello"), ("bot", "hi")] for i in range(40)}  # one conversation, many times
    made |= {200 + i: [("user", "hello"), ("bot", f"{i}")] for i in range(40)}  # a node with many children
    made |= {300: [("user", "deep")] * 150, 301: [("user", "deep")] * 140 + [("bot", "x")], 302: [("user", "deep")] * 160}
    return made


def frame(spark, talks):
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("shard_rows, queue_size", [(ct.SHARD_ROWS, ct.QUEUE_SIZE), (30, 3), (400, 2)])
def test_trie_equals_plain_version(spark, talks, shard_rows, queue_size):
    members = spark.createDataFrame([(c,) for c in talks], "conv_id long")
    got = ct.prefix_trie(ct.mark_turns(frame(spark, talks)), members, shard_rows, queue_size)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(talks)


def test_ends_in_several_pieces(spark, talks, monkeypatch):
    monkeypatch.setattr(ct, "PIECE_IDS", 7)
    got = ct.prefix_trie(ct.mark_turns(frame(spark, talks)), spark.createDataFrame([(c,) for c in talks], "conv_id long"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(talks)


def test_query_equals_sql(spark, tmp_path):
    draw = random.Random(4)
    rows = []
    for c in [*range(0, 90), *range(100, 160), 201, 330, 331]:
        for t in draw.sample([None, *range(12)], draw.randrange(9)):
            rows.append((c, t, draw.choice(["user", "bot", None]), draw.choice(["a", "bb", None, ""]), 1.0))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size double").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    got = op12_conversation_trie(spark, str(tmp_path)).toPandas()
    db = connect("/root/testdata/sf0.001")
    db.execute(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert differences(got, db.execute(oracle.conversation_trie()).df()) == ""
    assert len(got) > 100


def test_awkward_rows(spark):
    rows = [(1, None, None, None, "x"), (1, 0, "user", "long " * 50_000, "x"), (1, 0, "user", "long " * 50_000, "x"),
            (None, 0, "user", "nobody's", "x"), (2, None, "", "", "x"), (3, 5, "us", "er", "x"), (4, 5, "user", "", "x")]
    docs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, node string")
    got = {(r["conv_id"], r["depth"]): r for r in ct.prefix_trie(ct.mark_turns(docs)).collect()}
    # Conversations 1 and 2 begin with an empty turn; role and text are kept apart.
    assert {k: r["n_convs"] for k, r in got.items()} == {(1, 0): 4, (1, 1): 2, (1, 2): 1, (1, 3): 1, (3, 1): 1, (4, 1): 1}
    assert got[1, 0]["n_leaves"] == 3 and got[1, 0]["saved_tokens"] == 0
    assert ct.prefix_trie(ct.mark_turns(docs.limit(0))).count() == 0
    assert ct.prefix_trie(ct.mark_turns(docs.limit(0)), spark.createDataFrame([(9,)], "conv_id long")).collect()[0][:4] == (9, 0, None, 1)


def test_queue_spills_and_adds_up(tmp_path):
    draw = random.Random(7)
    queue = ct.SpillingQueue(lambda: SharedFile.new(f"file://{tmp_path}/runs"), 10)
    sent = [(draw.randrange(-4, 0), bytes([draw.randrange(9)]) * 16, 1, draw.randrange(5), draw.randrange(5)) for _ in range(500)]
    for m in sent:
        queue.send(*m)
    assert len(queue.runs) > 5 and len(queue.heap) <= 10
    for to in sorted({m[:2] for m in sent} | {(-2, bytes([77]) * 16)}):
        same = [m[2:] for m in sent if m[:2] == to]
        assert queue.take(*to) == (tuple(map(sum, zip(*same))) if same else (0, 0, 0))
    queue.close()
    assert list((tmp_path / "runs").iterdir()) == []


def test_a_store_that_tasks_cannot_open_is_named():
    with pytest.raises(ValueError, match="cannot open abcfs"):
        file_system("abcfs://bucket/folder")
