"""Language identification as inference of a document's language mixture.

Character trigrams of the lower-cased letters are hashed into a fixed number of
buckets; each language has smoothed log-probabilities for them. A document is
a sequence of units of consecutive trigrams, each written in one language.
Expectation-maximisation estimates the proportions of the languages; which
languages take part is chosen by likelihood less a penalty for each (BIC). The
prediction is the language of the largest proportion, which is also the score.

Sets are searched by size: one language, then all pairs, then the best set so
far with any further language. A document leaves the search once no larger set
can pay its penalty, even if every unit were as likely as in its best
language; so monolingual ones, nearly all, leave at once.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.llm.common import map_texts, slices
from tidelark.session import ship

UNKNOWN = "und"
#: Labelled documents for learning: about so many for each language, chosen by a hash of their id and text.
SAMPLE_DOCS = 2000
BUCKETS, UNIT, SMOOTHING = 1 << 16, 12, 0.2
ROUNDS, PENALTY = 12, 1.0
#: Log-likelihoods that are held at a time, over all languages.
HELD = 1 << 22

LATIN = re.compile("[A-Za-z]")
OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return LATIN.search(text) is not None or any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of the letters, words parted by a space; none without a letter."""
    letters = OTHER.sub(" ", text.lower()).strip()
    if not letters:
        return np.empty(0, np.uint16)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities (buckets x languages), from labelled rows that aren't held out.

    About `sample_docs` rows of each language are read, chosen by a hash of id
    and text, that of the least hash at any rate; with fewer labelled rows than
    that, all of them. What reaches the driver is a count for each language and
    bucket, whatever the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null").where(~is_held_out(F.col("id")))
    draw = F.pmod(F.xxhash64(F.lit("language"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sizes = {r["lang"]: r for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    # A row is in the sample if its draw is within its language's share.
    share = F.create_map(*[x for k, r in sorted(sizes.items()) for x in (F.lit(k), F.lit(max(min(1.0, sample_docs / r["n"]), r["least"])))])
    sample = usable.where(draw <= share[F.col("lang")]).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    at = {k: i for i, k in enumerate(langs)}
    counts[rows["bucket"].to_numpy(), [at[x] for x in rows["lang"].to_pylist()]] += rows["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def units(text: str, logs: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, int]:
    """Log-likelihood of each unit in each language, and the number of trigrams; the whole text is read, a chunk at a time."""
    out, n, chunk = [], 0, max(1 << 12, HELD // logs.shape[1])
    for i in range(0, len(text), chunk):
        grams = trigrams(text[i : i + chunk])
        if len(grams):
            out.append(np.add.reduceat(logs[grams], np.arange(0, len(grams), unit), axis=0))
            n += len(grams)
    return np.concatenate(out) if out else np.empty((0, logs.shape[1]), np.float32), n


def mixture(like: np.ndarray, owner: np.ndarray, n_docs: int, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (documents x languages) under the set of languages that BIC prefers.

    like: log-likelihoods of all units; owner: the document of each, in order.
    """
    n_langs = like.shape[1]
    starts = np.searchsorted(owner, np.arange(n_docs))
    sizes = np.bincount(owner, minlength=n_docs).astype(np.float64)
    cost = penalty * 0.5 * np.log(sizes + 1)  # of a language
    below = like - like.max(axis=1, keepdims=True)  # log-likelihoods less those under the best language of each unit
    alone = np.add.reduceat(below, starts, axis=0)
    first = alone.argmax(axis=1)
    best = alone[np.arange(n_docs), first] - cost
    out = np.zeros((n_docs, n_langs))
    out[np.arange(n_docs), first] = 1.0
    held = out > 0  # the best set of each size, in turn
    for k in range(2, n_langs + 1):
        # A set's likelihood is 0 at most: documents that can't pay the next penalty are done.
        open_ = np.flatnonzero(-k * cost > best)
        if not len(open_):
            break
        rows = np.flatnonzero(np.isin(owner, open_))
        own, local = below[rows], np.searchsorted(open_, owner[rows])
        scaled, begins = np.exp(own), np.searchsorted(local, np.arange(len(open_)))
        further = -(k + 1) * cost[open_] > best[open_] if k < n_langs else np.zeros(len(open_), bool)
        top, chosen = np.full(len(open_), -np.inf), held[open_]
        for more in combinations(range(n_langs), 2) if k == 2 else [(x,) for x in range(n_langs)]:
            sets = np.zeros((len(open_), n_langs), bool) if k == 2 else held[open_]
            fresh = ~sets[:, more].any(axis=1)
            sets[:, more] = True
            # Not more than if every unit were written in the likeliest language of the set.
            bound = np.add.reduceat(np.where(sets[local], own, -np.inf).max(axis=1), begins) - k * cost[open_]
            tried = np.flatnonzero(fresh & ((bound > np.maximum(best[open_], top)) | further & (bound > top)))
            if not len(tried):
                continue
            share, value = _maximise(scaled, local, sets, tried, rounds)
            value -= k * cost[open_[tried]]
            better = value > top[tried]
            top[tried[better]], chosen[tried[better]] = value[better], sets[tried[better]]
            wins = value > best[open_[tried]]
            at = open_[tried[wins]]
            best[at], out[at] = value[wins], share[wins]
        held[open_] = chosen
    return out


def _maximise(scaled: np.ndarray, local: np.ndarray, sets: np.ndarray, tried: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation within each tried document's set: proportions and log-likelihoods."""
    rows = np.flatnonzero(np.isin(local, tried))
    own, local = scaled[rows], np.searchsorted(tried, local[rows])
    begins = np.searchsorted(local, np.arange(len(tried)))
    sizes = np.bincount(local, minlength=len(tried))[:, None]
    share = sets[tried] / sets[tried].sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = share[local] * own
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, begins, axis=0) / sizes
    return share, np.add.reduceat(np.log(np.maximum((share[local] * own).sum(axis=1), 1e-300)), begins)


def predict(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Language, proportion and fit of each text; `und`, 0 and 0 for null ones, ones without letters, and if no language is known.

    The fit is the mean log-likelihood of a trigram in the most likely language
    less that under equally likely buckets: below 0, no language explains the text.
    """
    names, scores, fits = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not langs:
        return names, scores, fits
    at, likes = [], []

    def flush():
        owner = np.repeat(np.arange(len(at)), [len(u) for u in likes])
        shares = mixture(np.concatenate(likes).astype(np.float64), owner, len(at))
        for i, row in zip(at, shares):
            names[i], scores[i] = langs[int(row.argmax())], float(min(1.0, row.max()))
        at.clear(), likes.clear()

    held = 0
    for i, text in enumerate(texts):
        u, n = units(text, logs) if text and has_letter(text) else ((), 0)
        if n:
            at.append(i)
            likes.append(u)
            fits[i] = float(u.sum(axis=0, dtype=np.float64).max() / n + np.log(BUCKETS))
            held += u.size
            if held > HELD:
                flush()
                held = 0
    if at:
        flush()
    return names, scores, fits


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, lang_pred and score (0 to 1), learned from the labelled rows that aren't held out.

    Null and empty texts and those without a letter get `und` and score 0, as
    all do if no row is labelled; long texts are read whole, a chunk at a time.
    Ties go to the language first in order. Repeated rows and null ids are
    kept. An empty table gives an empty table. Predictions read the text alone;
    other columns, whatever their names, aren't read.
    """
    model = learn(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        langs, logs = shared.value

        def f(texts):
            names, scores, _ = predict(texts, langs, logs)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return f

    return map_texts(docs, make, "lang_pred string, score double", id_col, text_col)
