"""Plumbing shared by the corpus operators: staged tables, Arrow maps, span columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelark.session import ship, staged, unstage

__all__ = ["map_texts", "slices", "staged", "unstage"]

#: Rows and bytes of text that are turned into Python objects at a time; a single longer text still goes through whole.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def slices(batches: Iterable[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in smaller ones, bounded by rows and by the bytes of a text column, so that long texts don't fill a worker's memory."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        i = 0
        while i < len(batch):
            fit = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES, "right"))
            n = min(max(fit, i + 1), i + BATCH_ROWS) - i
            yield batch.slice(i, n)
            i += n


def map_texts(df: DataFrame, make, schema: str, id_col: str, text_col: str, binary: bool = False) -> DataFrame:
    """One output row per input row: `make()` runs once per task and returns f(texts) -> list of Arrow arrays.

    Only the id and text columns are read; the id comes first in the result.
    """
    ship(df.sparkSession)
    text = F.col(text_col).cast("binary" if binary else "string")
    pair = df.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = dict(pair.dtypes)["id"]
    names = [id_col, *StructType.fromDDL(schema).fieldNames()]

    def run(batches):
        f = make()
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *f(batch.column(1).to_pylist())], names=names)

    return pair.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
SPAN_SQL = "array<struct<kind: string, start: bigint, stop: bigint>>"


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given; an empty string for none."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def span_digest(spans: Column, kinds: list[str]) -> dict[str, Column]:
    """The digest columns of a span contract: a count for each base kind, base_sha256 and spans."""
    base = F.filter(spans, lambda s: s["kind"].isin(kinds))

    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": of(k) for k in kinds}
    return counts | {"base_sha256": F.sha2(joined_spans(base), 256), "spans": joined_spans(spans)}
