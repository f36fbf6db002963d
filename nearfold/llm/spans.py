"""Spans of a text: how operators return them, and their digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfold.llm.common import ship

ship(__name__)

# Positions are code points; `end` is past the last one.
SPANS = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
ARROW_SPANS = pa.list_(
    pa.struct(
        [
            pa.field("kind", pa.string()),
            pa.field("start", pa.int64()),
            pa.field("end", pa.int64()),
            pa.field("text", pa.string()),
            pa.field("score", pa.float64()),
        ]
    )
)


class Taken:
    """Places that are already part of a span."""

    def __init__(self, spans: list[dict]):
        self.places = [(s["start"], s["end"]) for s in spans]

    def free(self, start: int, end: int) -> bool:
        return all(end <= a or b <= start for a, b in self.places)

    def take(self, start: int, end: int) -> None:
        self.places.append((start, end))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
