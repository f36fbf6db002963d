"""Title search in batch: exact matches first, then fuzzy ones.

`queries` is (query), distinct texts; `titles` is (id, title, year, position).
Results are (query, rank, id, title, year, score) with at most `limit` rows per
query. Every title that is long enough is a candidate. Titles with equal text are scored once.

The queries, a stated set, go over all distinct titles in blocks. A bound that is cheap
to tell (shared letters, lengths, a shared word) says what a score can be at most; the exact
scores of a query's most promising titles give the score the others must be able to
reach, and only those are scored. Nothing that could be listed is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nearfold.functions.text import normalize_title, process_title
from nearfold.operators.catalog import top_k_per_group
from nearfold.scale import bounded_broadcast
from nearfold.settings import DEFAULTS

# Weight of reordered words, and of partial matches by how unequal
# the lengths are.
WORD_ORDER = 0.95
PARTIAL = 0.9
PARTIAL_LONG = 0.6
PARTIAL_FROM = 1.5
PARTIAL_LONG_FROM = 8.0
# Queries of one block, and more than such a block takes in bytes.
BLOCK_QUERIES = 256
BLOCK_BYTES = 1_000_000

Scorer = Callable[[Column, Column], Column]


def sort_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def similarity(a: Column, b: Column) -> Column:
    """100 for equal texts, down to 0 as edits reach the longer length."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return (F.lit(1.0) - F.levenshtein(a, b) / longest) * 100


def best_window(a: Column, b: Column) -> Column:
    """Best similarity of the shorter text with any stretch of the longer one."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    size = F.length(shorter)
    starts = F.sequence(F.lit(1), F.length(longer) - size + 1)
    return F.array_max(
        F.transform(starts, lambda i: similarity(shorter, F.substring(longer, i, size)))
    )


def shared_words(a: Column, b: Column) -> Column:
    return F.array_intersect(F.split(a, " "), F.split(b, " "))


def word_set_similarity(a: Column, b: Column) -> Column:
    """Best similarity among the shared words, and the shared words with each text's own."""
    both = F.array_sort(shared_words(a, b))
    common = F.array_join(both, " ")

    def with_own(one: Column, other: Column) -> Column:
        own = F.array_sort(F.array_except(F.split(one, " "), F.split(other, " ")))
        return F.trim(F.concat_ws(" ", common, F.array_join(own, " ")))

    left, right = with_own(a, b), with_own(b, a)
    shared = F.greatest(similarity(common, left), similarity(common, right))
    return F.greatest(similarity(left, right), F.when(F.size(both) > 0, shared).otherwise(0.0))


def _lengths(query: Column, title: Column) -> tuple[Column, Column, Column]:
    """The shorter length, the ratio of the lengths, and the weight of a partial match."""
    short = F.least(F.length(query), F.length(title))
    ratio = F.greatest(F.length(query), F.length(title)) / F.greatest(short, F.lit(1))
    return short, ratio, F.when(ratio < PARTIAL_LONG_FROM, PARTIAL).otherwise(PARTIAL_LONG)


def title_score(query: Column, title: Column) -> Column:
    """Weighted best of whole, reordered, word-set and partial similarity, 0 to 100."""
    short, ratio, scale = _lengths(query, title)
    q, t = sort_words(query), sort_words(title)
    whole = F.greatest(
        similarity(query, title),
        similarity(q, t) * WORD_ORDER,
        word_set_similarity(query, title) * WORD_ORDER,
    )
    a_word = F.when(F.size(shared_words(query, title)) > 0, 100.0).otherwise(0.0)
    part = F.greatest(
        similarity(query, title),
        best_window(query, title) * scale,
        best_window(q, t) * scale * WORD_ORDER,
        a_word * scale * WORD_ORDER,
    )
    score = F.when(ratio < PARTIAL_FROM, whole).otherwise(part)
    return F.when(short == 0, 0.0).otherwise(F.round(score, 6))


def letters(text: Column) -> Column:
    """Each character with its number among its like, so that shared ones can be counted."""
    chars = F.split(text, "")
    return F.transform(
        chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string"))
    )


def most_score(query: Column, title: Column, query_letters: Column, title_letters: Column) -> Column:
    """No less than `title_score`: edits are at least the letters of the longer text that are not shared."""
    short, ratio, scale = _lengths(query, title)
    shared = F.size(F.array_intersect(query_letters, title_letters))
    whole = shared / F.greatest(F.length(query), F.length(title), F.lit(1)) * 100
    a_word = F.when(F.size(shared_words(query, title)) > 0, 100.0 * WORD_ORDER).otherwise(0.0)
    part = F.least(F.lit(100.0), shared / F.greatest(short, F.lit(1)) * 100) * scale
    # Words that are shared or repeated may shorten the texts a word set compares.
    sets = F.when(F.size(F.array_distinct(F.split(query, " "))) + F.size(F.array_distinct(F.split(title, " ")))
                  < F.size(F.split(query, " ")) + F.size(F.split(title, " ")), 100.0 * WORD_ORDER).otherwise(0.0)
    return F.when(ratio < PARTIAL_FROM, F.greatest(whole, a_word, sets)).otherwise(
        F.greatest(whole, part, a_word * scale)
    ) + 1e-6


def with_keys(queries: DataFrame) -> DataFrame:
    return queries.select("query").distinct().select(
        "query",
        normalize_title(F.col("query")).alias("key"),
        process_title(F.col("query")).alias("text"),
    )


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("year"), F.asc("position")]


def title_exact_match(queries: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """(query, id, title, year, position, rank): equal normalised titles, newest
    first, no year last. Each title keeps `limit` rows before the join."""
    keyed = titles.withColumn("key", normalize_title(F.col("title"))).where(F.col("key") != "")
    first = top_k_per_group(keyed, "key", limit, newest_first())
    return with_keys(queries).select("query", "key").join(first, "key").drop("key")


def all_pairs(queries: DataFrame, texts: DataFrame, min_ratio: float) -> DataFrame:
    """(query, text, title_text, length, most): every query with every title text that is long enough for it.

    Queries travel in blocks of about BLOCK_QUERIES; a row of texts meets each block once.
    """
    n_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    one = F.struct("query", "text", F.ceil(F.length("key") * min_ratio).alias("least"), letters(F.col("text")).alias("letters"))
    blocks = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(one).alias("asked")
    )
    spread = texts.withColumn("held", letters(F.col("title_text"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )
    met = spread.join(bounded_broadcast(blocks, n_blocks, BLOCK_BYTES), "block")
    pairs = met.withColumn("q", F.explode(F.filter("asked", lambda q: q["least"] <= F.col("length"))))
    return pairs.select(
        F.col("q.query").alias("query"), F.col("q.text").alias("text"), "title_text", "length",
        most_score(F.col("q.text"), F.col("title_text"), F.col("q.letters"), F.col("held")).alias("most"),
    )


def scored_titles(queries: DataFrame, texts: DataFrame, min_ratio: float, places: int, scorer: Scorer) -> DataFrame:
    """(query, title_text, length, score): at least all that may be among a query's first `places`."""
    score = scorer(F.col("text"), F.col("title_text")).alias("score")
    pairs = all_pairs(queries, texts, min_ratio)
    if scorer is not title_score:  # its bound is not known
        return pairs.select("query", "title_text", "length", score)
    likely = top_k_per_group(pairs, "query", places, [F.desc("most"), F.asc("title_text"), F.asc("length")])
    reached = likely.select("query", score).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = reached.select("query", F.when(F.col("n") == places, F.col("least")).otherwise(0.0).alias("floor"))
    return pairs.join(floors, "query").where(F.col("most") >= F.col("floor")).select("query", "title_text", "length", score)


def title_search(
    queries: DataFrame,
    titles: DataFrame,
    limit: int = 10,
    settings: dict | None = None,
    scorer: Scorer = title_score,
) -> DataFrame:
    """Exact matches, then fuzzy ones by score, then fill, `limit` (1..20) rows.

    Queries shorter than `min_query_chars` get exact matches only.
    """
    s = settings or DEFAULTS["search"]
    limit = max(1, min(s["max_results"], limit))
    ratio = s["min_fuzzy_length_ratio"]
    wanted = with_keys(queries)
    long_enough = wanted.where(F.length("key") >= s["min_query_chars"])
    shown = ["query", "id", "title", "year", "position"]
    exact = title_exact_match(queries, titles, limit).select(
        *shown, F.lit(0).alias("tier"), F.lit(100.0).alias("score"), F.col("rank").alias("place")
    )
    keyed = titles.select(
        "id",
        "title",
        "year",
        "position",
        process_title(F.col("title")).alias("title_text"),
        F.length(normalize_title(F.col("title"))).alias("length"),
    )
    texts = keyed.select("title_text", "length").distinct()
    scored = scored_titles(long_enough, texts, ratio, 2 * limit, scorer)
    # Fewer than `limit` exact matches leave the list open, and they may be
    # among the first places here, so twice the limit is always enough.
    group = F.struct("title_text", "length")
    copies = top_k_per_group(
        keyed.withColumn("group", group), "group", 2 * limit, [F.asc("position")]
    ).drop("rank", "group")
    fuzzy = scored.join(copies, ["title_text", "length"])
    fuzzy = top_k_per_group(fuzzy, "query", 2 * limit, [F.desc("score"), F.asc("position")])
    fuzzy = fuzzy.select(
        *shown, F.lit(1).alias("tier"), "score", F.col("position").alias("place")
    )
    # A title found in both ways counts once, at its best place.
    every = exact.unionByName(fuzzy)
    once = W.partitionBy("query", "id").orderBy("tier")
    kept = every.withColumn("__n", F.row_number().over(once)).where(F.col("__n") == 1)
    order = [F.asc("tier"), F.desc("score"), F.asc("place")]
    return top_k_per_group(kept, "query", limit, order).select(
        "query", "rank", "id", "title", "year", "score"
    )
