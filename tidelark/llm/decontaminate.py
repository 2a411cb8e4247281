"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window (ten consecutive words of an item, or a whole shorter item) counts as
a hit only if all of it occurs. For full containment the necessary prefix of a
window under an order by rarity is one shingle: its rarest. Shingles here are
single words, ordered by the number of documents that hold them, counted over
all documents. A document position holding a prefix word names candidate
starts (positional bound) which must leave room for the window (length bound);
the window's words are then compared exactly.

Items are dealt into blocks of bounded size. Each block is one pass whose index
is broadcast; the passes are chained, each adding to what the last one found,
so that a benchmark of any size is joined whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm.common import slices
from tidelark.session import ship

WINDOW = 10
#: Bytes of item text in a block, about; its index takes some ten times as much in a worker.
BLOCK_BYTES = 4 << 20

#: A-Z to a-z; every byte that is no part of a word to a space.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str) -> dict[bytes, int]:
    """In how many documents each word of a block's vocabulary occurs."""
    ship(docs.sparkSession)

    def run(batches):
        counts = dict.fromkeys(vocabulary, 0)
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        seen = [(w, n) for w, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


#: Columns that a row carries between passes.
_TEXT, _SPANS, _ITEMS = "_benchmark_text", "_benchmark_spans", "_benchmark_items"


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside an occurring window) and item_ids (sorted, distinct).

    With `carry`, all columns of the documents stand before these in place of
    the id alone; those of the same names give way. Null and empty texts have
    no words, long ones are read whole. Items without words take no part;
    windows of items without an id count as hits and name nothing; an item id
    with several texts has the windows of all of them. Repeated documents are
    judged each. With no documents the result is empty, with no items nothing
    is hit. Other columns of the items aren't read.
    """
    kept = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null").distinct()
    item_kind = dict(kept.dtypes)["item"]
    total = kept.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    own = [F.col(c) for c in docs.columns if c not in ("n_words", "n_hit", "item_ids")] if carry else [F.col(id_col)]
    found = docs.select(*own, F.col(text_col).cast("binary").alias(_TEXT), F.array().cast("array<bigint>").alias(_SPANS), F.array().cast(f"array<{item_kind}>").alias(_ITEMS))
    for block in range(blocks):
        part = kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        windows: dict[tuple[bytes, ...], list] = {}
        for r in part.collect():
            for w in windows_of(words_of(r.text), size):
                windows.setdefault(w, []).append(r["item"])
        counts = document_counts(docs, frozenset(x for w in windows for x in w), text_col) if windows else {}
        prefixes: dict[bytes, set[tuple[int, int]]] = {}
        index: dict[tuple[bytes, ...], list] = {}
        for w, ids in windows.items():
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            if counts.get(w[at]):  # else no document holds that word
                index[w] = sorted(set(ids) - {None})
                prefixes.setdefault(w[at], set()).add((at, len(w)))
        found = _pass(found, docs.sparkSession.sparkContext.broadcast((index, {w: sorted(x) for w, x in prefixes.items()})), last=block + 1 == blocks)
    return found


def _pass(found: DataFrame, shared, last: bool) -> DataFrame:
    """Adds a block's hits to those so far; the last pass turns them into the result's columns."""
    ship(found.sparkSession)
    kinds = dict(found.dtypes)
    hidden = (_TEXT, _SPANS, _ITEMS)
    columns = {c: k for c, k in kinds.items() if c not in hidden} | ({"n_words": "bigint", "n_hit": "bigint", "item_ids": kinds[_ITEMS]} if last else {c: kinds[c] for c in hidden})

    def run(batches):
        index, prefixes = shared.value
        keys = frozenset(prefixes)
        for batch in slices(batches, _TEXT):
            texts, spans, items = (batch.column(c) for c in hidden)
            n_words, n_hit, all_spans, all_items = [], [], [], []
            for text, before, had in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist()):
                words, hits, named = words_of(text), list(before), set(had)
                if keys and not keys.isdisjoint(words):
                    n = len(words)
                    for i, w in enumerate(words):
                        for at, length in prefixes.get(w, ()):
                            start = i - at
                            if start >= 0 and start + length <= n and (got := index.get(tuple(words[start : start + length]))) is not None:
                                hits += (start, start + length)
                                named.update(got)
                n_words.append(len(words))
                n_hit.append(_covered(hits))
                all_spans.append(hits)
                all_items.append(sorted(named))
            named = pa.array(all_items, items.type)
            new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), named] if last else [texts, pa.array(all_spans, pa.list_(pa.int64())), named]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c not in hidden] + new, names=list(columns))

    return found.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in columns.items()))


def _covered(ends: list[int]) -> int:
    total = reach = 0
    for start, stop in sorted(zip(ends[::2], ends[1::2])):
        total += max(0, stop - max(start, reach))
        reach = max(reach, stop)
    return total
