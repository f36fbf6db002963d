"""Scalar columns: missing tests, years, scores, record sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions.text import strip_space

# Field limits of an exported record and its write unit in bytes.
OVERVIEW_CHARS = 200
SCORE_PLACES = 4
WRITE_UNIT_BYTES = 1024
MAX_RECORD_BYTES = 400 * 1024

# CSV cells read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_tokens(c: Column, tokens: list[str] | None = None) -> Column:
    return F.when(~c.isin(NULL_TOKENS if tokens is None else tokens), c)


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Null, NaN or blank text."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(strip_space(c) == "", F.lit(True))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c), F.lit(True)) | c.isNull()
    return c.isNull()


def present(c: Column, dtype: T.DataType) -> Column:
    """The value, or null when it counts as missing."""
    return F.when(~is_missing(c, dtype), c)


def year_strict(c: Column) -> Column:
    """First four characters when all four are digits."""
    head = F.substring(c, 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int"))


def year_lenient(c: Column) -> Column:
    """First one to four characters when all are digits, as exported records do."""
    head = F.substring(c, 1, 4)
    return F.when(head.rlike("^[0-9]{1,4}$"), head.try_cast("int"))


def overview_short(c: Column) -> Column:
    return F.substring(c, 1, OVERVIEW_CHARS)


def score_decimal(c: Column) -> Column:
    """Rounded on the binary value, not on its shortest decimal text."""
    shift = 10.0**SCORE_PLACES
    return (F.round(c * shift) / shift).cast("decimal(5,4)")


def finite_or_null(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _digits(c: Column) -> Column:
    """Significant digits of a number, at least one."""
    text = F.regexp_replace(c.cast("string"), "E.*$|[-.]", "")
    return F.greatest(F.length(F.trim(text, F.lit("0"))), F.lit(1))


def value_bytes(c: Column, dtype: T.DataType) -> Column:
    """Stored size of one value: text as UTF-8, numbers by significant digits,
    lists and maps 3 bytes plus 1 per element."""
    if isinstance(dtype, T.StringType):
        return F.octet_length(c)
    if isinstance(dtype, T.BooleanType):
        return F.lit(1)
    if isinstance(dtype, T.NumericType):
        return F.ceil(_digits(c) / 2).cast("int") + 1
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        sizes = F.transform(c, lambda x: value_bytes(x, item) + 1)
        return F.aggregate(sizes, F.lit(3), lambda acc, x: acc + x)
    if isinstance(dtype, T.StructType):
        total = F.lit(3)
        for field in dtype.fields:
            inner = value_bytes(c.getField(field.name), field.dataType)
            total = total + 1 + len(field.name.encode()) + inner
        return total
    raise TypeError(f"no stored size for {dtype.simpleString()}")


def record_bytes(schema: T.StructType) -> Column:
    """Size of a record: attribute names plus values; null attributes are absent."""
    total = F.lit(0)
    for field in schema.fields:
        c = F.col(field.name)
        size = value_bytes(c, field.dataType) + len(field.name.encode())
        total = total + F.when(c.isNotNull(), size).otherwise(0)
    return total.cast("long")


def write_units(size: Column) -> Column:
    return F.ceil(size / WRITE_UNIT_BYTES)
