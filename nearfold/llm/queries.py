"""The operators of this package as queries over the given tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import table
from nearfold.llm import byte_bpe, conversation_trie, decontaminate, license_scan, mixing, oracle, periodic_runs, pii
from nearfold.llm import quality, secret_scan, shingle_join, token_store, url_rules, vector_join
from nearfold.llm.spans import joined, of_kinds
from nearfold.scale import scratch_path


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file; NEARFOLD_TOKENIZERS may name another folder."""
    folder = os.environ.get("NEARFOLD_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-store")
    token_store.write_store(docs, path, tokenizer_file())
    found = token_store.find(docs.select("doc_id").distinct(), path)
    return token_store.token_digests(found.unionByName(token_store.unindexed(spark, path)), path)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def _span_digests(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    counts = [F.size(of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(joined(of_kinds(F.col("spans"), base)), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.drop("spans")


def op5_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_documents(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.DOMAIN_RULES + url_rules.PATTERN_RULES
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.BASE_KINDS)


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose crc32 of the id leaves 1 when divided by 3 are held out from training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    machine = quality.train_quality(docs, labels, usable=fold != 1, metadata=("n_chars",))
    scored = quality.score_quality(docs, machine, metadata=("n_chars",))
    return scored.select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _hash(number: Column) -> Column:
    """The crc32 of a number's decimal digits."""
    return F.crc32(number.cast("string").cast("binary"))


def _let(value: Column, result) -> Column:
    """`result(value)` with the value computed once."""
    return F.transform(F.array(value), result)[0]


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def rebuilt_conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first turns of another, as marked turns; and all conversation ids.

    Conversation c begins with the first h turns of c - c % 100, h = crc32(c) % 6, and goes on with its own after its first h.
    """
    turns = conversation_trie.numbered(conversation_trie.mark_turns(table(spark, sf_dir, "conversations")))
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    shared = F.col("conv_id") - F.col("conv_id") % 100
    h = (_hash(F.col("conv_id")) % 6).cast("int")
    # At most five turns of each lender go to at most a hundred conversations.
    lent = turns.where((F.col("conv_id") == shared) & (F.col("place") <= 5)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "mark", "size"))).alias("turns")
    )
    lent = lent.select(F.col("conv_id").alias("lender"), "turns")
    borrowed = members.select("conv_id", shared.alias("lender")).join(lent, "lender").select(
        "conv_id", F.inline(F.slice("turns", F.lit(1), h))
    )
    own = turns.where(F.col("place") > h).select("conv_id", "place", "mark", "size")
    return borrowed.unionByName(own).withColumnRenamed("place", "turn"), members


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(*rebuilt_conversations(spark, sf_dir))


def repeating_texts(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the hash h of its id, goes on in periods from some word on.

    With n words, g = h / 10, a = g % n and p = 1 + (n - a) / (3 + g % 8): each word i >= a is word a + (i - a) % p.
    """
    h = _hash(F.col("doc_id"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column, a: Column, p: Column) -> Column:
        rest = F.size(w) - a
        turns = F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(turns), F.lit(1), rest)), " ")

    def from_words(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        return F.when(F.size(w) > 0, repeated(w, a, p)).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, _let(words, from_words)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeating_texts(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest)
    length, period = -F.col("best.l"), F.col("best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_token_ids": (op1_token_ids, None),
    "op2_mix_sources": (op2_mix_sources, oracle.mixing()),
    "op3_personal_data": (op3_personal_data, None),
    "op4_license_scan": (op4_license_scan, oracle.license_scan()),
    "op5_near_documents": (op5_near_documents, oracle.near_documents()),
    "op6_url_rules": (op6_url_rules, oracle.url_rules()),
    "op7_near_vectors": (op7_near_vectors, oracle.near_vectors(vector_join.COSINE)),
    "op8_secrets": (op8_secrets, None),
    "op9_benchmark_leaks": (op9_benchmark_leaks, None),
    "op10_quality": (op10_quality, None),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_conversation_trie": (op12_conversation_trie, oracle.conversation_trie()),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
