"""Text columns: whitespace, tokens, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and as a token of two or more word
# characters, in any script.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def collapse_whitespace(c: Column) -> Column:
    """Missing to '', each run of white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITESPACE, " "))


def collapsed_length_at_least(c: Column, n: int) -> Column:
    """Whether `collapse_whitespace` leaves n characters. A long text mostly shows it in its head,
    as more text never makes the result shorter; only where the head is too short the whole is read."""
    head = F.length(collapse_whitespace(F.substring(c, 1, 4 * n))) >= n
    return head | (F.length(collapse_whitespace(c)) >= n)


def strip_space(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{WHITESPACE}|{WHITESPACE}$", "")


def normalize_title(c: Column) -> Column:
    """Key for exact title matches."""
    return collapse_whitespace(F.lower(c))


def process_title(c: Column) -> Column:
    """Text compared by the fuzzy scorer: lowercase words, punctuation dropped."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD, " "))


def document_text(*cleaned: Column) -> Column:
    """Cleaned fields joined by single spaces and lowercased; blank ones leave no gap."""
    return F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in cleaned]))


def tokenize(c: Column) -> Column:
    # Possessive: nothing follows a token, so the matcher need not keep ways back.
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN + "+"), F.lit(0))


def drop_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    """Tokens not in the list; repeats and order kept."""
    if not stop_words:
        return tokens
    # A long list of literals becomes a hash set, looked up once for each token.
    words = sorted(set(stop_words))
    return F.filter(tokens, lambda t: ~t.isin(words))


def ngrams(tokens: Column, longest: int = 2) -> Column:
    """All runs of 1..longest neighbouring tokens, joined by one space."""
    parts = [tokens]
    for n in range(2, longest + 1):
        starts = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        run = F.slice(tokens, 1, starts)
        for shift in range(1, n):
            run = F.zip_with(
                run, F.slice(tokens, shift + 1, starts), lambda a, b: F.concat_ws(" ", a, b)
            )
        parts.append(run)
    return F.concat(*parts) if len(parts) > 1 else tokens


def default_stop_words() -> list[str]:
    """Spark's English list. Pass another list to match another library's."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
