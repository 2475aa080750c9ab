"""What the operators that find spans in texts have in common.

A span is (kind, start, end, base): code point offsets with an exclusive end;
``base`` tells the fixed patterns' spans from those that the method adds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, texts

Span = tuple[str, int, int, bool]
TYPE = "array<struct<kind:string,start:long,end:long,base:boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
KEYS = ("kind", "start", "end", "base")


def in_order(found: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


class Within:
    """Whether a span lies within one of many of its kind, each in logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            self.starts.setdefault(kind, []).append(a)
            ends = self.ends.setdefault(kind, [])
            ends.append(max(b, ends[-1]) if ends else b)

    def __call__(self, kind: str, a: int, b: int) -> bool:
        i = bisect_right(self.starts.get(kind, ()), a)
        return i > 0 and b <= self.ends[kind][i - 1]


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[str], list[Span]]]) -> DataFrame:
    """(doc_id, spans) of every text; an empty or null text has none."""

    def make():
        find = finder()

        def work(b):
            found = [[dict(zip(KEYS, s, strict=True)) for s in find(t)] if t else [] for t in texts(b)]
            return {"doc_id": b.column("doc_id").cast(pa.int64()), "spans": pa.array(found, ARROW)}

        return work

    return map_text(docs, ["doc_id", "text"], f"doc_id long, spans {TYPE}", make)


def digests(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256 and spans."""
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, kinds), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
