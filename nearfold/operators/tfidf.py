"""TF-IDF: term counts, vocabulary, weighted unit rows.

Documents of one row an id are tokenised by expressions and counted, weighted and normalised in
Python workers, each in its row wherever it lies. Others are hash-partitioned by id once, and all of
it stays inside those partitions. Only (term, df, cf) partial sums move between tasks, and the capped
vocabulary is broadcast.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from nearfold.functions.text import drop_stop_words, ngrams, tokenize
from nearfold.scale import fits_broadcast, lookup_join, stable, with_offsets
from nearfold.settings import DEFAULTS

# Tasks get this module's code with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tokens whose n-grams a task holds at a time, and those of one document.
MOST_TOKENS = 100_000


def token_table(docs: DataFrame, stop_words: list[str], clustered: bool = False) -> DataFrame:
    """(id, tokens), hash-partitioned by id.

    Pass `clustered` for documents that are so already, as `prepare` leaves them
    (cached or not); stored tables have lost it.
    """
    texts = docs.select("id", "document")
    if not clustered:
        texts = texts.repartition("id")
    kept = drop_stop_words(tokenize(F.col("document")), stop_words)
    return texts.select("id", kept.alias("tokens"))


def term_counts(
    docs: DataFrame, stop_words: list[str], ngram_max: int = 2, clustered: bool = False, unique: bool = False
) -> DataFrame:
    """(id, term, tf) of (id, document).

    Pass `unique` for documents of one row an id, as `prepare` leaves them: each is
    counted in its row, wherever that lies, without a table of all (id, term).
    """
    tokens = token_table(docs, stop_words, clustered or unique)
    if unique:
        kind = tokens.schema["id"].dataType.simpleString()
        return tokens.mapInArrow(lambda batches: counted(batches, ngram_max), f"id {kind}, term string, tf long")
    return (
        exploded(tokens, ngrams(F.col("tokens"), ngram_max), "term")
        .groupBy("id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """(id, `name`): a row for each element, none of which is null.

    An inner explode would be planned behind a filter on the array's size, which makes the array once more
    and its parts as often as they are named in it, tokens of whole texts among them.
    """
    return df.select("id", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def grams_of(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Ids and n-grams of some documents of (id, tokens) at a time; `ngrams` for a task's strings."""
    for batch in batches:
        lists = batch.column("tokens")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(lists):
            before = ends[at - 1] if at else 0
            last = max(at + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right")))
            texts = []
            for tokens in lists.slice(at, last - at).to_pylist():
                found = list(tokens or ())
                for n in range(2, longest + 1):
                    found += map(" ".join, zip(*(tokens[i:] for i in range(n)))) if tokens else ()
                texts.append(found)
            yield batch.column("id").slice(at, last - at), texts
            at = last


def counted(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """(id, term, tf) of (id, tokens)."""
    for ids, texts in grams_of(batches, longest):
        counts = [Counter(grams) for grams in texts]
        owner = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        terms = pa.array([term for c in counts for term in c], pa.string())
        tf = pa.array([n for c in counts for n in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), terms, tf], ["id", "term", "tf"])


def weighed(batches: Iterator[pa.RecordBatch], longest: int, vocab) -> Iterator[pa.RecordBatch]:
    """(id, terms, weights) of (id, tokens), as `packed_rows` makes them; `vocab` broadcasts term, term_no and idf."""
    table = vocab.value
    numbers = dict(zip(table["term"].to_pylist(), table["term_no"].to_pylist()))
    idf = np.zeros(max(numbers.values(), default=0) + 1)
    idf[table["term_no"].to_numpy()] = table["idf"].to_numpy()
    for ids, texts in grams_of(batches, longest):
        found = np.array([numbers.get(g, -1) for grams in texts for g in grams], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(grams) for grams in texts])[found >= 0]
        # By document, then by term.
        cells, tf = np.unique(owner * len(idf) + found[found >= 0], return_counts=True)
        owner, no = np.divmod(cells, len(idf))
        values, which = np.unique(tf, return_inverse=True)
        w = (np.array([math.log(n) for n in values.tolist()])[which] + 1) * idf[no]
        # Summed in order: equal documents get bit-equal weights.
        norms = np.sqrt(np.bincount(owner, w * w, len(texts)))
        sizes = np.bincount(owner, minlength=len(texts))
        filled = np.flatnonzero(sizes)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[filled])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (no.astype(np.int32), w / norms[owner])]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(filled)), *lists], ["id", "terms", "weights"])


def weighed_rows(docs: DataFrame, stop_words: list[str], longest: int, vocab: DataFrame) -> DataFrame:
    """`packed_rows` of documents of one row an id under a vocabulary that may be broadcast."""
    tokens = token_table(docs, stop_words, True)
    table = docs.sparkSession.sparkContext.broadcast(vocab.select("term", "term_no", "idf").toArrow())
    schema = T.StructType(
        [
            tokens.schema["id"],
            T.StructField("terms", T.ArrayType(T.IntegerType(), False)),
            T.StructField("weights", T.ArrayType(T.DoubleType())),
        ]
    )
    return tokens.mapInArrow(lambda batches: weighed(batches, longest, table), schema)


def counts_in_rows(grams: DataFrame) -> DataFrame:
    """(id, term, tf) of (id, grams), a sorted array: the lengths of its runs."""
    places = F.slice(F.sequence(F.lit(0), F.size("grams")), 1, F.size("grams"))
    first = F.filter(
        places, lambda i: (i == 0) | (F.get("grams", i) != F.get("grams", i - 1))
    )
    runs = grams.select("id", "grams", first.alias("first"))
    after = lambda n: F.coalesce(F.get("first", n + 1), F.size("grams"))
    run = F.transform("first", lambda at, n: F.struct(F.get("grams", at).alias("term"), (after(n) - at).alias("tf")))
    rows = exploded(runs, run, "run")
    return rows.select("id", F.col("run.term").alias("term"), F.col("run.tf").cast("long").alias("tf"))


def term_doc_freq(counts: DataFrame) -> DataFrame:
    """(term, df, cf): documents holding the term, and its total count."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def smoothed_idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def vocabulary(counts: DataFrame, n_docs: Column, settings: dict | None = None, portions: int = 1) -> DataFrame:
    """(term, term_no, df, cf, idf): document-frequency bounds first, then the
    most frequent `max_features`. `term_no` counts from the rarest term.

    In several `portions`, each counts the terms of its share of hashes, one after the other: with
    `shuffles_released` the disk holds one portion's sums at a time, and `counts` are made as often.
    """
    s = settings or DEFAULTS["tfidf"]

    def bounded(some: DataFrame) -> DataFrame:
        return term_doc_freq(some).where(
            (F.col("df") >= s["min_df"]) & (F.col("df") <= n_docs * F.lit(float(s["max_df"])))
        )

    def most_frequent(some: DataFrame) -> DataFrame:
        return some.orderBy(F.desc("cf"), "term").limit(s["max_features"])

    if s["max_features"] is None:
        numbered = with_offsets(bounded(counts), ["df", "term"], name="term_no")
    else:
        if portions > 1:
            share = F.pmod(F.xxhash64("term"), F.lit(portions))
            parts = [stable(most_frequent(bounded(counts.where(share == p)))) for p in range(portions)]
            kept = reduce(DataFrame.unionByName, parts)
        else:
            kept = bounded(counts)
        # Capped, so numbering it in one task is a small sort.
        kept = most_frequent(kept)
        number = F.row_number().over(W.orderBy("df", "term")) - 1
        numbered = kept.withColumn("term_no", number)
    return numbered.select(
        "term",
        F.col("term_no").cast("int").alias("term_no"),
        "df",
        "cf",
        smoothed_idf(F.col("df"), n_docs).alias("idf"),
    )


def packed_rows(counts: DataFrame, vocab: DataFrame, vocab_cap: int | None) -> DataFrame:
    """(id, terms ARRAY<INT>, weights ARRAY<DOUBLE>): unit rows, rarest term first.

    Terms outside the vocabulary are ignored; documents with none have no row.
    Equal documents get bit-equal arrays, because sums run in term order.
    """
    known = vocab.select("term", "term_no", "idf")
    weighted = lookup_join(counts, known, "term", vocab_cap).select(
        "id", "term_no", ((F.log("tf") + 1) * F.col("idf")).alias("w")
    )
    packed = weighted.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("term_no", "w"))).alias("row")
    )
    norm = F.sqrt(F.aggregate("row.w", F.lit(0.0), lambda acc, w: acc + w * w))
    # Repeated into an array, so the norm is not worked out again per element.
    norms = F.array_repeat(norm, F.size("row.w"))
    return packed.select(
        "id",
        F.col("row.term_no").alias("terms"),
        F.zip_with("row.w", norms, lambda w, n: w / n).alias("weights"),
    )


def unpack_rows(packed: DataFrame, vocab: DataFrame, vocab_cap: int | None) -> DataFrame:
    """(id, term, weight) from packed rows."""
    rows = packed.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    rows = rows.select("id", F.col("e.terms").alias("term_no"), F.col("e.weights").alias("weight"))
    names = vocab.select("term_no", "term")
    return lookup_join(rows, names, "term_no", vocab_cap).select("id", "term", "weight")


def unigram_idf(vocab: DataFrame) -> DataFrame:
    """(term, idf) without n-gram keys."""
    return vocab.where(~F.col("term").contains(" ")).select("term", "idf")


def checked_unigram_idf(idf: DataFrame) -> DataFrame:
    """The table itself; refuses an empty one and one holding n-gram keys."""
    seen = idf.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("term").contains(" "), F.col("term")))
        .alias("ngram")
    ).first()
    if seen.n == 0:
        raise ValueError("the IDF table is empty")
    if seen.ngram is not None:
        raise ValueError(f"the IDF table must hold single words only, not {seen.ngram!r}")
    return idf


def median_idf(idf: DataFrame) -> DataFrame:
    """One row: the exact median over the vocabulary."""
    return idf.agg(F.median("idf").alias("median_idf"))


class TfidfEmbedder:
    """Fit on a corpus, apply to new text, keep as two tables.

    Implements the embedder protocol of `nearfold.plans.compare`.
    """

    name = "tfidf"

    def __init__(self, settings: dict | None = None, stop_words: list[str] | None = None):
        from nearfold.functions.text import default_stop_words

        self.settings = settings or DEFAULTS["tfidf"]
        self.stop_words = default_stop_words() if stop_words is None else stop_words
        self.vocab: DataFrame | None = None
        self.rows: DataFrame | None = None
        self.ids: DataFrame | None = None
        self.held: list[DataFrame] = []

    def counts(self, docs: DataFrame, clustered: bool = False, unique: bool = False) -> DataFrame:
        return term_counts(docs, self.stop_words, self.settings["ngram_max"], clustered, unique)

    def fit(self, docs: DataFrame, clustered: bool = False, portions: int = 1) -> "TfidfEmbedder":
        """`docs` holds (id, document), one row per id; see `token_table`, and `vocabulary` for `portions`.

        Counts are made anew for the rows: kept, they are many times the texts.
        """
        # Terms are counted wherever the documents lie; only rows are put together by id.
        anywhere = self.counts(docs, True, unique=True)
        n_docs = docs.select(F.count(F.lit(1))).scalar()
        self.vocab = vocabulary(anywhere, n_docs, self.settings, portions).persist()
        if fits_broadcast(self.settings["max_features"]):
            self.rows = weighed_rows(docs, self.stop_words, self.settings["ngram_max"], self.vocab)
        else:
            self.rows = packed_rows(self.counts(docs, clustered), self.vocab, self.settings["max_features"])
        self.ids = docs.select("id")
        self.held = [self.vocab]
        return self

    def release(self) -> None:
        """Drop what `fit` cached, once rows and vocabulary are written."""
        for held in self.held:
            held.unpersist()

    def transform(self, docs: DataFrame) -> DataFrame:
        """Packed rows of new text under the fitted vocabulary."""
        return packed_rows(self.counts(docs), self.vocab, self.settings["max_features"])

    def save(self, store, run_date: str) -> None:
        if self.vocab is None:
            raise RuntimeError("fit before save")
        store.write(self.vocab, "vocabulary", run_date, self.name)
        store.write(self.rows, "rows", run_date, self.name)
        store.write(self.ids, "ids", run_date, self.name)

    @classmethod
    def load(cls, store, run_date: str, settings=None, stop_words=None) -> "TfidfEmbedder":
        out = cls(settings, stop_words)
        out.vocab = store.read("vocabulary", run_date, cls.name)
        out.rows = store.read("rows", run_date, cls.name)
        out.ids = store.read("ids", run_date, cls.name)
        return out

    def coverage(self, docs: DataFrame) -> DataFrame | None:
        return None

    def neighbours(self, k: int, stored: bool = False) -> DataFrame:
        """`stored`: the rows have been read from a store."""
        from nearfold.operators.sparse_knn import knn_sparse

        return knn_sparse(self.rows, self.ids, k, stored=stored)
