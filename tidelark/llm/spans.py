"""Finding spans of text by kind: helpers for secrets and personal data."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelark.llm.common import SPAN, SPAN_SQL, map_texts

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def marks(size: int, spans: list[Span]) -> bytearray:
    """A byte for each character: 1 within a span. mark.find(1, a, b) < 0 tells that a:b is free, however many spans there are."""
    mark = bytearray(size)
    for _, a, b in spans:
        mark[a:b] = b"\x01" * (b - a)
    return mark


def span_table(docs: DataFrame, make: Callable[[], Callable[[str], list[Span]]], id_col: str, text_col: str) -> DataFrame:
    """id and spans (kind, start, stop in code points, stop exclusive) of every row; none for null texts."""

    def make_columns():
        find = make()
        return lambda texts: [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in find(t)] if t else [] for t in texts], SPAN)]

    return map_texts(docs, make_columns, f"spans {SPAN_SQL}", id_col, text_col)
