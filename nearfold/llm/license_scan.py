"""License scan: ordered signature rules behind a keyword prefilter, in DataFrame functions.

1. A-Z are lower-cased and words taken (`WORD`); the text becomes its words, each
   with a space on either side, so a rule's match always covers whole words.
2. The words a text shares with the rules' keywords choose the few rules that run.
3. A rule marks its matches in the text; marked words give word positions.
4. Overlapping spans are resolved by priority and containment. A span that contains one of
   higher priority gives way to it: "released under the ... license" to the license that is named there.
   Of the others, a span within one of equal or higher priority is suppressed (of equal spans
   with equal priority the later rule's). The labels of the rest stay.

Base phrases are looked for everywhere and their labels are never suppressed.
Everything happens within a row: no shuffle, no Python. Work grows with the text's
length and its matches. Null and empty texts have no words, spans or labels and score 0; repeated
rows and null keys are rows like others; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import ascii_lower
from nearfold.llm.license_rules import RULES, LicenseRule, over_words

# What is no word, and the phrases every report counts.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MARK = "\x01"


def _marked(text: Column, pattern: Column) -> Column:
    """Positions of the matches: (first word, last word + 1) alternating, words from 0."""
    inside = F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f" {MARK} $1 {MARK} "))
    words = F.split(F.trim(inside), " +")
    at = F.filter(
        F.transform(words, lambda w, i: F.when(w == MARK, i)), lambda i: i.isNotNull()
    )
    return F.transform(at, lambda i, k: i - k)


def _pairs(bounds: Column) -> Column:
    starts = F.filter(bounds, lambda _, k: k % 2 == 0)
    ends = F.filter(bounds, lambda _, k: k % 2 == 1)
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def _updated(ends: Column, priority: Column, choose, end: Column) -> Column:
    return F.transform(ends, lambda e, i: F.when(i == priority, choose(e, end)).otherwise(e))


def scan_licenses(
    docs: DataFrame,
    rules: list[LicenseRule] = RULES,
    phrases: dict[str, str] = PHRASES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    `spans` are the spans that stay, in order: start, end (words, end exclusive), label, rule
    number and weight. `score` is the largest weight among them, or 0.
    """
    keywords = sorted({r.keyword for r in rules} | {p.split()[-1] for p in phrases})
    table = F.array(
        *[
            F.struct(
                F.lit(r.number).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(r.pattern).alias("pattern"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.weight).alias("weight"),
            )
            for r in rules
        ]
    )
    lowered = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    spaced = F.trim(F.regexp_replace(lowered, BETWEEN, " "))
    words = F.when(F.col("spaced") == "", F.array().cast("array<string>")).otherwise(F.split("spaced", " "))
    found = docs.select(F.col(key), spaced.alias("spaced")).select(
        key,
        F.size(words).cast("long").alias("n_words"),
        F.array_intersect(words, F.array(*map(F.lit, keywords))).alias("keys"),
        "spaced",
    )
    wide = F.concat(F.lit(" "), F.replace("spaced", F.lit(" "), F.lit("  ")), F.lit(" "))
    gated = found.select(
        key, "n_words", "keys", F.when(F.size("keys") > 0, wide).alias("wide")
    )

    base = "|".join(over_words(p).strip() for p in phrases)
    ends = {p.split()[-1] for p in phrases}
    may_hold = F.arrays_overlap("keys", F.array(*map(F.lit, sorted(ends))))
    starts = F.transform(
        _pairs(_marked(F.col("wide"), F.lit(f" (?:{base}) "))), lambda p: p["start"].cast("long")
    )
    none = F.array().cast("array<bigint>")
    based = gated.withColumn("base", F.when(may_hold, starts).otherwise(none))
    phrase_labels = F.filter(
        F.array(*[F.when(F.contains("wide", F.lit(over_words(p))), F.lit(label)) for p, label in phrases.items()]),
        lambda x: x.isNotNull(),
    )
    running = F.filter(table, lambda r: F.array_contains(F.col("keys"), r["keyword"]))

    def spans_of(r: Column) -> Column:
        return F.transform(
            _pairs(_marked(F.col("wide"), r["pattern"])),
            lambda p: F.struct(
                p["start"].cast("long").alias("start"),
                (-p["end"]).cast("long").alias("minus_end"),
                r["priority"].alias("priority"),
                r["rule"].alias("rule"),
                r["label"].alias("label"),
                r["weight"].alias("weight"),
            ),
        )

    span = "struct<start:bigint,minus_end:bigint,priority:int,rule:int,label:string,weight:double>"
    ordered = F.array_sort(F.flatten(F.transform(running, spans_of)))
    ordered = F.when(F.size("keys") > 0, ordered).otherwise(F.array().cast(f"array<{span}>"))
    spread = based.withColumn("ordered", ordered)
    none_yet = F.array().cast(f"array<{span}>")
    levels = max((r.priority for r in rules), default=0) + 1
    # From the last start on: the first end seen so far of the spans of each priority. A span is left out
    # if one of higher priority that starts no earlier ends no later.
    bare = F.aggregate(
        F.reverse("ordered"),
        F.struct(F.array_repeat(F.lit(1 << 62).cast("long"), levels).alias("ends"), none_yet.alias("spans")),
        lambda a, s: F.struct(
            _updated(a["ends"], s["priority"], F.least, -s["minus_end"]).alias("ends"),
            F.when(
                (s["priority"] > 0) & (F.array_min(F.slice(a["ends"], F.lit(1), F.greatest(s["priority"], F.lit(1)))) <= -s["minus_end"]),
                a["spans"],
            ).otherwise(F.concat(a["spans"], F.array(s))).alias("spans"),
        ),
    )
    # From the first start on: the last end so far of each priority. A span is suppressed if one of equal or
    # higher priority that came before ends no earlier.
    reach = F.aggregate(
        F.reverse("bare.spans"),
        F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("ends"), F.array().cast("array<string>").alias("labels"),
                 F.lit(0.0).alias("weight"), none_yet.alias("spans")),
        lambda a, s: F.when(F.array_max(F.slice(a["ends"], F.lit(1), s["priority"] + 1)) >= -s["minus_end"], a).otherwise(
            F.struct(
                _updated(a["ends"], s["priority"], F.greatest, -s["minus_end"]).alias("ends"),
                F.array_union(a["labels"], F.array(s["label"])).alias("labels"),
                F.greatest(a["weight"], s["weight"]).alias("weight"),
                F.concat(a["spans"], F.array(s)).alias("spans"),
            )
        ),
    )
    kept = spread.withColumn("bare", bare).withColumn("kept", reach).withColumn(
        "phrase_labels", F.when(F.size("base") > 0, phrase_labels).otherwise(F.array().cast("array<string>"))
    )
    return kept.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("phrase_labels")), ",").alias("base_labels"),
        F.transform(
            "kept.spans",
            lambda s: F.struct(s["start"].alias("start"), (-s["minus_end"]).alias("end"), s["label"].alias("label"),
                               s["rule"].alias("rule"), s["weight"].alias("weight")),
        ).alias("spans"),
        F.array_join(
            F.array_sort(F.array_union("kept.labels", F.array_distinct("phrase_labels"))), ","
        ).alias("labels"),
        F.col("kept.weight").alias("score"),
    )
