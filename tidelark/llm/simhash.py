"""SimHash near-duplicates by an inverted index of fingerprint bytes with count filtering.

Two 64-bit fingerprints with at most two differing bits share at least six of
their eight positional bytes. The index holds postings of positional bytes.
Postings of one byte hold a 256th of all fingerprints each, and tallying from
them costs the square of the corpus, so a posting is of as many positions
together as keep it small for the corpus: of any n + 2 positions a qualifying
pair shares n, so the postings of all choices of n among the first n + 2 let
every such pair meet. In each posting the shared positional bytes of every
pair are tallied, pairs with six or more are kept, and their differing bits
are counted.

Postings that are large all the same (clusters of like texts) are found by
their counts, before anything meets in a task; their members are indexed anew
by all choices of six positions, where a posting differs in two bytes alone
and has 65,536 members at most. Only distinct fingerprints enter the index, so
exact copies meet nowhere. Each posting hands on a spanning forest of its
links, from which components are found by alternating large and small stars.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.llm.common import map_texts, staged, unstage

SHINGLE, SEED, BITS = 3, 42, 2
BYTES = 8
#: Members of a posting, on average over random fingerprints, at most; and from how many on a posting is indexed anew.
MEMBERS, LARGE = 32, 512
#: Pairs that are tallied at a time.
PAIRS = 1 << 20
#: Keys with more than so many rows, and than a HOTth of all, are joined apart; there are at most HOT of them.
HOT = 10_000
#: Keys of large postings that are broadcast; more are joined by shuffling, each dealt over so many tasks.
BROADCAST_KEYS, DEALT = 200_000, 64


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the shingle hashes, as a signed 64-bit number."""
    words = text.lower().split() if text else []  # bytes: A-Z alone is lowered, white space is \\x20\\t-\\r
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = np.array([h(joined, seed)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts = stops - lengths
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), stops[size - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (long) of every row."""
    return map_texts(docs, lambda: lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())], "fp long", id_col, text_col, binary=True)


_SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def choices(n: int) -> list[tuple[int, int]]:
    """Mask and salt of each choice of n among the first n + 2 positions; the salt tells choices apart in one key."""
    masks = [sum(0xFF << 8 * p for p in c) for c in combinations(range(n + 2), n)]
    return [(_SIGNED(m), _SIGNED((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for i, m in enumerate(masks)]


def positions_for(n: int) -> int:
    """How many positions a posting is of, for n fingerprints."""
    return next((d for d in range(1, BYTES - BITS) if n <= MEMBERS << 8 * d), BYTES - BITS)


def keys(fp: Column, n: int) -> Column:
    """The key of each posting of n positions that a fingerprint is in."""
    return F.array(*[fp.bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(s)) for m, s in choices(n)])


def matches(members: np.ndarray, sizes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within postings (as places in members, which holds them one after the other) that share enough bytes and differ in few bits.

    Postings of one size are tallied together; those of a size whose pairs
    exceed the bound go through it in parts.
    """
    starts = np.cumsum(sizes) - sizes
    x = members.astype(np.uint64) if members.dtype != np.uint64 else members
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for m in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == m]
        rows = max(1, PAIRS // m)  # members that meet those after them in their posting
        blocks = [(own[:, None], 0, m)] if m * m <= PAIRS else [(own[:, None], k, min(m, k + rows)) for k in range(0, m, rows)]
        for first, low, high in blocks:
            for part in range(0, len(first), max(1, PAIRS // ((high - low) * (m - low)))):
                base = first[part : part + max(1, PAIRS // ((high - low) * (m - low)))]
                a, b = (base + np.arange(low, high))[:, :, None], (base + np.arange(low, m))[:, None, :]
                differ = x[a] ^ x[b]
                some = differ | differ >> np.uint64(4)
                some |= some >> np.uint64(2)
                some |= some >> np.uint64(1)
                shared = BYTES - np.bitwise_count(some & np.uint64(0x0101010101010101))
                at = np.nonzero((shared >= BYTES - bits) & (b > a))
                at = tuple(i[np.bitwise_count(differ[at]) <= bits] for i in at)
                out.append((a[at[0], at[1], 0], b[at[0], 0, at[2]]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def forest(members: np.ndarray, sizes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Links (n x 2) that span the components of each posting."""
    above = {}

    def top(i: int) -> int:
        while (j := above.get(i, i)) != i:
            above[i] = above.get(j, j)
            i = j
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in matches(members.view(np.uint64), sizes, bits))):
        if (a := top(i)) != (b := top(j)):
            above[max(a, b)] = min(a, b)
            out.append((i, j))
    return members[np.array(out, np.int64).reshape(-1, 2)]


def links(fps: DataFrame, count: int | None = None, large: int = LARGE) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp of a staged table): a spanning forest of each posting."""
    n = positions_for(fps.count() if count is None else count)
    rows = fps.select("fp", F.explode(keys(F.col("fp"), n)).alias("key"))
    if n == BYTES - BITS:
        return _tally(rows)
    full = staged(rows.groupBy("key").count().where(F.col("count") > large).select("key"), "large")
    found = full.count()
    if not found:
        unstage(full)
        return _tally(rows)
    if found <= BROADCAST_KEYS:
        full = F.broadcast(full)
        rest, anew = rows.join(full, "key", "left_anti"), rows.join(full, "key", "left_semi")
    else:
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("fp"), F.lit(DEALT)))
        full = full.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
        rest, anew = dealt.join(full, ["key", "deal"], "left_anti"), dealt.join(full, ["key", "deal"], "left_semi")
    again = anew.select("fp").distinct().select("fp", F.explode(keys(F.col("fp"), BYTES - BITS)).alias("key"))
    return _tally(rest.select("fp", "key")).unionByName(_tally(again))


def _tally(rows: DataFrame) -> DataFrame:
    # Sorting in the engine brings postings together in a stream, so none is held but the one being read.
    rows = rows.repartition("key").sortWithinPartitions("key")

    def run(batches):
        key, held = None, np.empty(0, np.int64)
        for batch in batches:
            k = np.concatenate([np.full(len(held), key, np.int64) if len(held) else held, np.asarray(batch.column("key"))])
            fp = np.concatenate([held, np.asarray(batch.column("fp"))])
            if not len(k):
                continue
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
            key, held = k[-1], fp[bounds[-1] :]
            if len(found := forest(fp[: bounds[-1]], np.diff(bounds))):
                yield _edges(found)
        if len(held) > 1 and len(found := forest(held, np.array([len(held)]))):
            yield _edges(found)

    return rows.mapInArrow(run, "a long, b long")


def _edges(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def joined(rows: DataFrame, table: DataFrame, key: str, n: int, most: int | None = None) -> DataFrame:
    """Rows with the one row of a table for their key, whose column `n_rows` says how many rows there are for it; n: rows in all, most: those of one key at most.

    Hot keys are few, by their share of all rows, and are broadcast apart, so
    that their rows stay where they are.
    """
    bound = max(HOT, n // HOT)
    if (n if most is None else most) <= bound:
        return rows.join(table.drop("n_rows"), key)
    hot = F.broadcast(table.where(F.col("n_rows") > bound).drop("n_rows"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col("n_rows") <= bound).drop("n_rows"), key))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of an edge table a, b (staged: it is read in rounds).

    Large and small stars alternate until a round changes nothing. Every round
    is written to the shared folder, and the one before it is deleted.
    """
    small = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    table = staged(small, "stars")
    n, state = table.count(), None
    while True:
        n = state[0] if state else n
        both = table.select("u", "v").union(table.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n_rows"))
        large = joined(both.where("v > u"), least, "u", 2 * n).select("v", F.col("m").alias("u"))
        down = large.where("v <> u").distinct()
        least = down.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n_rows"))
        hooked = joined(down, least, "v", 2 * n).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        after = staged(hooked.union(least.select("v", F.col("m").alias("u"))).distinct(), "stars")
        unstage(table)
        table = after
        now = table.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            return table.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp (long) and component_id, the least id reachable over links of two or fewer bits.

    Null, empty and blank texts have the fingerprint zero, linked like any
    other; long texts are read whole. Rows without an id take part and name
    nothing; of rows with one id each has its own fingerprint, and repeated
    rows stay. An empty table gives an empty table. Other columns, whatever
    their names, aren't read.
    """
    own = staged(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    least = staged(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")), "distinct")
    n, n_fps, most = least.agg(F.sum("n_rows"), F.count("*"), F.max("n_rows")).first()
    edges = staged(links(least.select("fp"), n_fps), "links")
    roots = components(edges)
    unstage(edges)
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.col("n_rows").alias("n_docs"), F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows"))
    answers = joined(named, of_root, "root", n_fps).select("fp", "component_id", F.col("n_docs").alias("n_rows"))
    return joined(own, answers, "fp", n or 0, most or 0).select(F.col("id").alias(id_col), "fp", "component_id")
