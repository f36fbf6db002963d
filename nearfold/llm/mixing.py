"""Mix sources to target weights: each source gives whole documents in a random order until its budget is met.

1. A source's weight comes from its rank; `share` of all words is dealt out by weight. A
   target stops at `most` times the source's words, and what is over goes to the others
   by weight until none is above (water filling, solved from sorted prefix sums).
2. Each document has a hash-random key. Rows are range-sorted by (source, key), so one
   source may fill many ranges, and prefix sums of sizes run over the ranges.
3. With budget b = floor(target), size s of the source and p the words before a
   document: it is taken b // s times, and where p < b % s once more, the last
   one only as far as the budget reaches.

Ties of keys are settled by id, then by size; equal rows are alike. Null texts have size 0, and a
source without words has target 0. A null source is a source, ranked last. Only ids, sizes
and sources are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.scale import bounded_broadcast, stable, with_offsets

WORDS = r"[^\x20\x09-\x0D]+"
SEED = 20
# More than a source's row takes: its name and some numbers.
SOURCE_BYTES = 1_000
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cycle_123(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, for ranks from 0."""
    return rank % 3 + 1


def source_targets(sizes: DataFrame, weight=cycle_123, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """(source, n_docs, source_size, weight, target) from (source, size) rows; `weight` maps a rank to a weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    totals = totals.withColumn("last", F.col("source").isNull())
    ranked = with_offsets(totals, ["last", "source"], name="rank")
    weighed = stable(ranked.withColumn("weight", weight(F.col("rank")).cast("long")).withColumn(
        "cap", F.lit(most) * F.col("source_size")
    ))
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    all_words, all_weight = whole["size"] or 0, whole["weight"] or 0
    # From the source that is full first to the one that is full last.
    fill = weighed.withColumn("full_at", F.col("cap") / F.col("weight"))
    by_cap = with_offsets(fill, ["full_at", "rank"], F.col("cap"), "full_before")
    by_weight = with_offsets(by_cap, ["full_at", "rank"], F.col("weight"), "weight_before")
    # At a source: the words left when all before it are full, and the weight they are shared by.
    levelled = stable(
        by_weight.withColumn("level", F.lit(share * all_words) - F.col("full_before"))
        .withColumn("rest", F.lit(all_weight) - F.col("weight_before"))
    )
    # The first source that does not fill up sets the level for itself and all after it.
    first = (
        levelled.where(F.col("full_at") * F.col("rest") >= F.col("level"))
        .agg(F.min_by(F.struct("level", "rest", "full_at", "rank"), F.struct("full_at", "rank")).alias("at"))
        .first()["at"]
    )
    target = F.col("cap").cast("double")
    if first is not None:
        past = (F.col("full_at") > F.lit(first["full_at"])) | (
            (F.col("full_at") == F.lit(first["full_at"])) & (F.col("rank") >= F.lit(first["rank"]))
        )
        target = F.when(past, F.col("weight") * F.lit(first["level"]) / F.lit(first["rest"])).otherwise(target)
    return levelled.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def mix_plan(
    docs: DataFrame,
    weight=cycle_123,
    share: float = 1.0,
    most: int = MOST_REPEATS,
    seed: int = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The documents placed in their random order, and a row for each source with its budget.

    Placed: doc_id, of, size, draw, words_before (from the source's start). Sources: of, source_size,
    target, turns (how often every document is taken) and rest (the words of the last turn).
    """
    sizes = stable(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
                               word_count(F.col(text).cast("string")).alias("size")))
    targets = source_targets(sizes, weight, share, most)
    placed = with_offsets(
        sizes.withColumn("last", F.col("source").isNull()).withColumn("draw", _draw(F.col("doc_id"), seed)),
        ["last", "source", "draw", "doc_id", "size"], F.col("size"), "words_before",
    )
    # The words before a source's first document: one row for each source.
    firsts = placed.groupBy("source").agg(F.min("words_before").alias("source_start"))
    turns = F.expr("CAST(floor(target) AS BIGINT) DIV greatest(source_size, 1)")
    sources = stable(
        targets.join(firsts, targets["source"].eqNullSafe(firsts["source"]))
        .select(targets["source"].alias("of"), "source_size", "target", "source_start", turns.alias("turns"))
        .withColumn("rest", F.floor("target").cast("long") - F.col("turns") * F.col("source_size"))
    )
    return placed, sources


def with_source(rows: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """Rows with their source's budget; the sources are broadcast if their number shows that they fit."""
    small = bounded_broadcast(sources, sources.count(), SOURCE_BYTES)
    return rows.join(small, rows[source].eqNullSafe(small["of"]), "left")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, and taken, the words the mix takes (repeats counted)."""
    placed, sources = mix_plan(docs, **options)
    once_more = F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("words_before") - F.col("source_start")))
    )
    return with_source(placed, sources, "source").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("turns") * F.col("size") + once_more).cast("long").alias("taken"),
    )


def repeat_documents(docs: DataFrame, seed: int = SEED, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, whole also where the budget ends in it.

    A source's last turn ends at one place of its random order, so whether a document takes part in it
    is seen from its own key: no text is shuffled.
    """
    placed, sources = mix_plan(docs, seed=seed, key=key, source=source, **options)
    inside = F.col("words_before") - F.col("source_start")
    cuts = (
        with_source(placed, sources, "source").where(inside < F.col("rest"))
        .groupBy("source").agg(F.max(F.struct("draw", "doc_id")).alias("cut"))
    )
    budgets = sources.join(cuts, sources["of"].eqNullSafe(cuts["source"]), "left").select("of", "turns", "cut")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).cast("string").alias("source"),
                        _draw(F.col(key), seed).alias("draw"), F.col(key).alias("doc_id"))
    met = with_source(keyed, stable(budgets), "source")
    again = F.coalesce((F.struct("draw", "doc_id") <= F.col("cut")).cast("int"), F.lit(0))
    times = (F.col("turns") + again).cast("int")
    return met.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")
