"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are small integers, so the plan is made from their histogram, whose
size doesn't grow with the corpus:

1. Large lengths, in falling order, are split into groups of equal cardinality
   and rounded up to the longest of their group (linear grouping).
2. How often each configuration (multiset of the few rounded sizes) is used is
   a linear program, solved by column generation: a knapsack over the dual
   prices makes the next configuration until none can save a sequence.
3. Actual lengths take the places of the rounded ones, the longest of a group
   first; the last place of a sequence takes the longest that fits.
4. What is left, small lengths above all, goes longest first where it leaves
   the least room (best fit); new sequences are opened only when nothing fits.

Sequences alike in every length are one class with a count. A piece finds its
place by its rank among the pieces of its length; ranks come from counts by
task and length, so no group of equal lengths meets in one task.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelark.llm.common import slices, staged
from tidelark.llm.token_count import byte_letters
from tidelark.session import ship

CAPACITY, END_ID = 1024, 2
#: Sizes after rounding, and steps of the linear program at most; any step leaves a plan that is valid, and on the test tables 44 suffice.
GROUPS, STEPS = 64, 500
#: Lengths above this share of the capacity are large.
LARGE = 0.25
GPT2_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def encoder(path: str):
    """f(text) -> token ids as the tokenizers library gives them, without added special tokens.

    A byte-level BPE whose ids follow the order of its merges is the same in
    tiktoken, which takes a quarter of the time; any other file is left to the
    library itself.
    """
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    model, letters = x["model"], byte_letters()
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    pre = x.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not x.get("normalizer") and model.get("type") == "BPE"
    added = {t["content"]: t["id"] for t in x.get("added_tokens", [])}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in x.get("added_tokens", []))
    ids = [model["vocab"].get(m, -1) for m in merges] if byte_level else []
    if byte_level and plain and ids and ids == sorted(set(ids)) and ids[0] >= 256:
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        encoding = tiktoken.Encoding("file", pat_str=GPT2_PIECES, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: encoding.encode(text, allowed_special="all")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text, add_special_tokens=False).ids


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: all of the capacity but the first, which may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Places for so many pieces of each length: rows (length, first rank, count, first sequence, offset), and the number of sequences."""
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    room[0] += [(left[capacity], (capacity,))] * (left[capacity] > 0)
    left[capacity] = 0

    # 1. Linear grouping; a length that fills several groups is one size. Lengths that are few already need no rounding.
    large = [n for n in range(capacity - 1, int(LARGE * capacity), -1) if left[n]]
    each = 1 if len(large) <= groups else -(-sum(left[n] for n in large) // groups)
    sizes: list[int] = []
    wanted: list[int] = []
    space = 0
    for n in large:
        k = min(left[n], space)
        if k:
            wanted[-1] += k
        if left[n] > k:
            sizes.append(n)
            wanted.append(left[n] - k)
        space = (space - left[n]) % each

    # 2. and 3. The fullest configurations choose first.
    there = sum(1 << n for n in large)  # lengths that are left, as bits

    def longest(limit: int) -> int:
        return (there & ((1 << (limit + 1)) - 1)).bit_length() - 1

    for times, slots in sorted(configurations(sizes, wanted, capacity), key=lambda x: -sum(x[1])):
        while times:
            lengths, free = [], capacity
            for i, size in enumerate(slots):
                n = longest(free if i + 1 == len(slots) else min(size, free))
                while n > 0 and left[n] <= lengths.count(n):
                    n = longest(n - 1)
                if n > 0:
                    lengths.append(n)
                    free -= n
            if not lengths:
                break
            m = min(times, *(left[n] // lengths.count(n) for n in lengths))
            room[free].append((m, tuple(lengths)))
            for n in lengths:
                left[n] -= m
                there &= ~(1 << n) if not left[n] else -1
            times -= m

    # 4. Best fit of what is left.
    for n in range(capacity, 0, -1):
        c = left[n]
        while c:
            free = next((r for r in range(n, capacity + 1) if room[r]), None)
            if free is None:
                room[capacity].append((max(1, c // (capacity // n)), ()))
                continue
            m, slots = room[free].pop()
            used = min(m, c)
            if used < m:
                room[free].append((m - used, slots))
            k = max(1, min(free // n, c // used))
            room[free - n * k].append((used, slots + (n,) * k))
            c -= used * k

    rank: dict[int, int] = {}
    out, sequence = [], 0
    for m, slots in (x for level in room for x in level if x[1]):
        offset = 0
        for n in slots:
            out.append((n, rank.get(n, 0), m, sequence, offset))
            rank[n] = rank.get(n, 0) + m
            offset += n
        sequence += m
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5), sequence


def configurations(sizes: list[int], wanted: list[int], capacity: int, steps: int = STEPS) -> list[tuple[int, list[int]]]:
    """How often to use which multiset of falling sizes, so that as few as possible hold what is wanted; what whole numbers leave over is left over.

    The simplex method over columns made on demand: sum x is least, with
    columns @ x = wanted. The basis begins with each size by itself.
    """
    if not sizes:
        return []
    size = np.array(sizes)
    columns = np.diag(capacity // size)
    inverse = np.diag(1.0 / (capacity // size))
    x = np.array(wanted) / (capacity // size)
    for _ in range(steps):
        value, column = _dearest(size, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        along = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > 1e-9, x / along, np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * along
        x[out] = ratio[out]
        columns[:, out] = column
        inverse[out] /= along[out]
        along[out] = 0
        inverse -= np.outer(along, inverse[out])
    return [(n, np.repeat(size, columns[:, i]).tolist()) for i, n in enumerate(np.floor(x + 1e-9).astype(int).tolist()) if n > 0]


def _dearest(size: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity whose prices sum to the most, an item more in each round."""
    room = np.arange(capacity + 1) - size[:, None]
    best, taken, all_rooms = np.zeros(capacity + 1), [], np.arange(capacity + 1)
    for _ in range(capacity // int(size.min())):
        worth = np.where(room >= 0, price[:, None] + best[np.maximum(room, 0)], -1.0)
        item = worth.argmax(axis=0)
        more = worth[item, all_rooms] > best + 1e-12
        if not more.any():
            break
        taken.append(np.where(more, item, -1))
        best = np.where(more, worth[item, all_rooms], best)
    column, at = np.zeros(len(size), int), capacity
    for chosen in reversed(taken):
        if chosen[at] >= 0:
            column[chosen[at]] += 1
            at -= size[chosen[at]]
    return float(best[capacity]), column


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with `with_ids` the ids themselves.

    Each document is its tokens and then `end_id`; only those longer than the
    capacity are cut, and long ones are read whole. Null texts are empty ones
    (a single end token). Repeated rows and null ids are packed each; pieces of
    one length are alike, so which of them stands where follows the order in
    which rows are read. An empty table gives an empty table. Other columns,
    whatever their names, aren't read. `path` must exist on every executor.
    """
    spark = docs.sparkSession
    ship(spark)
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(pair.dtypes)["id"]

    def tokenise(batches):
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, 1):
            rows, at, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.array([*encode(text or ""), end_id], dtype="<u4")
                for k, (start, n) in enumerate(pieces_of(len(tokens), capacity)):
                    own = tokens[start : start + n]
                    at.append(i)
                    rows.append((k, start, n, zlib.crc32(own.tobytes()), part, seen[n]))
                    ids.append(own.astype("i8") if with_ids else None)
                    seen[n] += 1
            columns = list(zip(*rows)) or [()] * 6
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=["id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * with_ids])

    pieces = staged(pair.mapInArrow(tokenise, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<bigint>" * with_ids), "pieces")
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    plan, _ = make_plan({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        rows = shared.value
        wide = 1 << 44
        keys = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            n, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            found = rows[np.searchsorted(keys, n * wide + rank, "right") - 1] if len(n) else rows[:0]
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("rank",)}
            columns |= {"sequence_id": pa.array(found[:, 3] + rank - found[:, 1]), "offset": pa.array(found[:, 4])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=[id_col if c == "id" else c for c in columns])

    joined = pieces.join(bases, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"), *["ids"] * with_ids)
    return joined.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids + ", sequence_id long, offset long")
