"""Operators as filters and rewrites of a documents table (doc_id, text, lang, source, n_chars), for the corpus pipeline.

All columns of the input are carried, whatever there are; only `text` and
`n_chars` are ever changed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm import decontaminate, language, packing, pii, simhash
from tidelark.llm.common import slices, staged
from tidelark.session import release, ship, staged_paths


__all__ = ["drop_benchmark", "keep_known_languages", "keep_one_of_each", "pack", "redact_personal", "release", "staged", "staged_paths"]


def _map(docs: DataFrame, run) -> DataFrame:
    ship(docs.sparkSession)
    return docs.mapInArrow(lambda batches: run(slices(batches, "text")), docs.schema)


def _named_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under column names that no operator uses, and those names by the own ones."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), names


def _named_back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(a).alias(c) for c, a in names.items()])


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Rejects null texts, those without letters, and those that equally likely trigrams explain better than any learned language."""
    shared = docs.sparkSession.sparkContext.broadcast(language.learn(docs))

    def run(batches):
        langs, logs = shared.value
        for batch in batches:
            names, _, fits = language.predict(batch.column("text").to_pylist(), langs, logs)
            yield batch.filter(pa.array([n != language.UNKNOWN and f > 0 for n, f in zip(names, fits)], pa.bool_()))

    return _map(docs, run)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates, one row: that of the smallest id (any before none), then of the least hash of its text, then of its columns."""
    # An id can name several rows, even of several groups, or be missing, so rows go by their id and hashes. Maps have no hash.
    own, names = _named_apart(docs)
    hashed = [F.col(c) for c, k in own.dtypes if "map<" not in k]
    i, text = F.col(names["doc_id"]), F.col(names["text"])
    rows = own.withColumn("_key", F.struct(i.isNull().alias("no_id"), i.alias("id"), F.xxhash64(text).alias("text_hash"), F.xxhash64(*hashed).alias("row_hash")))
    found = simhash.near_duplicates(rows.select("_key", text.alias("text")), "_key")
    kept = staged(found.where("_key = component_id").groupBy("_key").agg(F.count("*").alias("_rows")), "kept")
    same = rows["_key"].eqNullSafe(kept["_key"])
    once = rows.join(kept.where("_rows = 1").hint("shuffle_hash"), same, "left_semi")
    often = rows.join(kept.where("_rows > 1"), same, "left_semi").dropDuplicates(["_key"])  # copies in all columns
    return _named_back(once.unionByName(often), names)


def drop_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    own, names = _named_apart(docs)
    found = decontaminate.find_benchmark(own, items, id_col=names["doc_id"], text_col=names["text"], carry=True)
    return _named_back(found.where("n_hit = 0"), names)


def redact_personal(docs: DataFrame) -> DataFrame:
    """Personal data give way to their kinds in angle brackets; n_chars follows. Other documents stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(pii.learn(docs))
    sized = "n_chars" in docs.columns

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if sized else [None] * len(texts)
            for i, text in enumerate(texts):
                if text and pii.ANY.search(text):
                    base = pii.base_spans(text)
                    if base:
                        texts[i] = pii.redact(text, base + field.added(text, base))
                        sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, batch.schema.field("text").type)} | ({"n_chars": pa.array(sizes, batch.schema.field("n_chars").type)} if sized else {})
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)

    return _map(docs, run)


def pack(docs: DataFrame, path: str) -> DataFrame:
    return packing.pack(docs, path)
