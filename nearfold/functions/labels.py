"""Label cells: comma lists as arrays, and how two label sets compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfold.functions.text import strip_space


def _parts(c: Column, separator: str) -> Column:
    trimmed = F.transform(F.split(c, separator), strip_space)
    return F.filter(trimmed, lambda x: x != "")


def label_set(c: Column) -> Column:
    """Distinct lowercased labels; a missing cell is the empty set."""
    return F.array_distinct(_parts(F.lower(F.coalesce(c, F.lit(""))), ","))


def genre_list(c: Column) -> Column:
    """Labels in order with case and repeats kept; none at all is null."""
    parts = _parts(c, ",")
    return F.when(F.size(parts) > 0, parts)


def keyword_set(c: Column) -> Column:
    """Distinct labels split on ', ' with case kept, as profiling counts them."""
    return F.array_distinct(_parts(F.coalesce(c, F.lit("")), ", "))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def shares_label(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b).cast("double")


def shared_in_order(a: Column, b: Column) -> Column:
    """Labels of `a` also in `b`, in the order of `a`."""
    return F.filter(F.coalesce(a, F.array()), lambda x: F.array_contains(F.coalesce(b, F.array()), x))
