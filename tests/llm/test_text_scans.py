import hashlib
import random
import re

import numpy as np
import pytest

from nearfold.llm import license_scan, pii, secret_samples, secret_scan
from nearfold.llm.license_rules import RULES, keyword, parse


def luhn(s):
    digits = [int(c) for c in s][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def plain_pii(text):
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(bare(m)) <= 19 and luhn(bare(m))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(bare(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


CASES = [
    "", "a@b", "a@b.c d@e.f.g@h.i", "x.y+z@mail.example.com,", "@a.b", "é.a@b.co 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0001",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12 34 5", "+1 555 123 4567.", "4" * 40, "7.8.9 .1.2.3.4",
    "𝒳 4111111111111111 +49 30 1234567", "a@b.c@d.e", "1" * 3000 + ".1.1.1", "..@..a", "-@-.-",
]


@pytest.mark.parametrize("text", CASES)
def test_base_personal_data_equals_plain_search(text):
    assert list(pii.base_spans(text)) == plain_pii(text)


def test_personal_data_of_the_method():
    kinds = lambda t: [s["kind"] for s in pii.pii_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("DE89 3704 0044 0532 0130 01") == []
    assert kinds("my social security number is 123-45-6789") == ["social"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call (555) 123-4567") == ["local_phone"]
    low, high = (pii.pii_spans(t)[0]["score"] for t in ("order 10.0.0.1", "server 10.0.0.1"))
    assert low < high


def test_personal_data_of_awkward_rows(awkward, no_docs):
    rows = pii.find_pii(awkward).collect()
    assert len(rows) == 12 and all(r["spans"] == [] for r in rows)
    assert pii.find_pii(no_docs).count() == 0


def test_base_secrets_equal_plain_search(spark):
    texts = [
        'token = "abcdef123" and PASSWORD:hunter2x', "passwd=ab", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + " x", "f" * 23 + " " + "0" * 24,
        "toKen:" + "ſecret=abcdefgh", "Secret Key=zzzzzzzz apikey: 'q.w-e=r_t'", "é token=ab12cd34", "x" * 100_000 + "=secret",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = ("assign", "access", "hex")
    for r in secret_scan.find_secrets(docs).collect():
        t = texts[r["doc_id"]]
        want = [("assign", m) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
        want += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want = sorted(((k, m.start(), m.end()) for k, m in want), key=lambda s: (s[1], order.index(s[0])))
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in order] == want


def test_random_strings_stand_out(spark):
    words = "ordinary words that people write in long texts about many things and their identifiers_like_this_one"
    docs = spark.createDataFrame([(i, words) for i in range(50)], "doc_id long, text string")
    ratios = secret_scan.train(docs)
    random_one = "kX9vQ2mZr7TbW4nLp8YsD3fG"
    assert [s["text"] for s in secret_scan.secret_spans(f"see {random_one} here", ratios)] == [random_one]
    assert secret_scan.secret_spans("identifiers_like_this_one_about_many_things", ratios) == []


def plain_judgement(candidate, ratios):
    """The same sums, one step at a time, over probabilities looked up by character."""
    place = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    best = max(sum(r[place[a]][place[b]] for a, b in zip(candidate, candidate[1:])) for r in ratios)
    return best, best / (len(candidate) - 1)


# Words that the models' own sample lacks.
HELD_OUT = (
    "account balance chart driver engine filter gateway history icon journal kernel layout matrix network offset pixel query router "
    "schema token union vector widget yield zone apple bridge copper dragon eagle forest garden harbor island jacket kitchen ladder"
).split()


@pytest.mark.parametrize("corpus", ["none", "a sentence", "documents"])
def test_held_out_strings(spark, corpus):
    texts = {
        "none": [], "a sentence": ["ordinary words that people write in long texts"] * 50,
        "documents": [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()],
    }[corpus]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = secret_scan.train(docs)
    ordinary = [x for x in secret_samples.identifiers(HELD_OUT, 2400, 99) if secret_scan.CANDIDATE.fullmatch(x)]
    random_ones = [x for a in secret_samples.ALPHABETS.values() for n in (20, 32, 64) for x in secret_samples.random_sample(a, 100, n, 123)]
    is_found = lambda x: bool(secret_scan.secret_spans(x, ratios))
    true, false = sum(map(is_found, random_ones)), sum(map(is_found, ordinary))
    assert len(ordinary) > 1500
    assert true / len(random_ones) >= 0.99 and true / (true + false) >= 0.97
    plain = ["getElementByIdAndClassName", "https/www_example_com_path_index", *(r * 2 for r in secret_samples.RUNS), "=" * 40, secret_scan.ALPHABET]
    assert not any(map(is_found, plain))
    for x in ordinary[:200] + random_ones[:200]:
        assert np.allclose(secret_scan.judged(x, ratios), plain_judgement(x, ratios))


def test_spans_equal_plain_version(spark):
    """Every run of candidate characters that no known form touches, judged step by step."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ratios = secret_scan.train(docs)
    for r in secret_scan.find_secrets(docs, ratios).join(docs, "doc_id").collect():
        text = r["text"] or ""
        known = [(a, b) for _, a, b, _ in secret_scan.base_matches(text)]
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            total, mean = plain_judgement(m[0], ratios)
            if total >= 12 and mean >= 0.6 and not any(a < m.end() and m.start() < b for a, b in known):
                want.append((m.start(), m.end()))
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] == want


def test_secrets_of_awkward_rows(awkward, no_docs):
    assert {len(r["spans"]) for r in secret_scan.find_secrets(awkward).collect()} == {0}
    assert secret_scan.find_secrets(no_docs).count() == 0


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}


def test_license_rules_have_keywords_that_matches_hold():
    assert len(RULES) > 200
    assert keyword("non ?commercial license(?: version)?") == "license"
    assert keyword("creative commons attribution share ?alike") == "attribution"
    assert parse("a | name | the b license")[0].pattern == " the  b  license "
    with pytest.raises(ValueError):
        keyword("(?:a|b)c")


def test_licenses(spark):
    got = scan(spark, [
        "Released under the MIT License, mit license.", "GNU Lesser General Public License", None, "", "permit licenses MIT.License",
        "SPDX-License-Identifier: Apache-2.0", "the Mitigate license", "Licensed under CC BY-NC 4.0.",
    ])
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (7, 2, 3, 5)
    assert got[0]["base_labels"] == "mit" and "mit" in got[0]["labels"].split(",")
    # The wider span suppresses the narrower one's label; the base label stays.
    assert got[1]["labels"] == "gpl,lgpl" and got[1]["base_labels"] == "gpl" and len(got[1]["spans"]) == 1
    for i in (2, 3):
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["labels"], got[i]["score"]) == (0, 0, None, "", 0.0)
    assert got[4]["n_base"] == 1
    assert got[5]["labels"] == "apache" and got[5]["score"] == 1.0
    assert got[6]["n_base"] == 0
    assert got[7]["labels"] == "cc-by-nc"


def test_specific_licenses_before_generic_ones(spark):
    got = scan(spark, [
        "released under the isc license", "the boost software license", "released under the GNU Lesser General Public License",
        "released under the very own license", "released under the foo license or the isc license",
    ])
    assert got[0]["labels"] == "isc" and got[2]["labels"] == "gpl,lgpl"
    assert got[1]["labels"] not in ("", "generic")
    assert got[3]["labels"] == "generic"
    assert got[4]["labels"] == "isc"


def test_spans_are_resolved_as_in_the_plain_version(spark):
    """Every span against every other, on texts made of the rules' own words."""
    draw = random.Random(6)
    plain = [r for r in RULES if not set("(?.[") & set(r.pattern)]
    texts = [" ".join(" ".join(draw.choice(plain).pattern.split()[draw.randrange(3):][: draw.randrange(3, 9)]) for _ in range(6)) for _ in range(60)]
    for i, r in scan(spark, texts).items():
        words, spans = texts[i].split(), []
        wide = " " + "  ".join(words) + " "
        starts = np.cumsum([0, *(len(w) + 2 for w in words)]).tolist()
        for rule in RULES:
            for m in re.finditer(rule.pattern, wide):
                spans.append((starts.index(m.start()), starts.index(m.end()), rule.priority, rule.number, rule.label))
        bare = [o for o in spans if not any(x[2] < o[2] and o[0] <= x[0] and x[1] <= o[1] for x in spans)]
        kept = [x for x in bare if not any(
            o[0] <= x[0] and x[1] <= o[1] and o[2] <= x[2] and (o[:2] != x[:2] or o[2:4] < x[2:4]) for o in bare)]
        want = sorted((s, e, number, label) for s, e, _, number, label in kept)
        assert sorted((x["start"], x["end"], x["rule"], x["label"]) for x in r["spans"]) == want


def test_licenses_of_awkward_rows(awkward, no_docs):
    rows = license_scan.scan_licenses(awkward).collect()
    assert len(rows) == 12 and max(r["n_words"] for r in rows) == 60_000
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_digest_of_spans(spark):
    from nearfold.llm.queries import _span_digests

    docs = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1"), (2, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in _span_digests(pii.find_pii(docs), pii.BASE_KINDS).collect()}
    assert got[1]["spans"] == "email:5:11,ip:15:23"
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:5:11,ip:15:23").hexdigest()
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert np.array([got[1][f"n_{k}"] for k in pii.BASE_KINDS]).tolist() == [1, 1, 0, 0]
