"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt into shards of bounded size by a hash. A shard's
graph grows by batches: greedy beam searches from spread entries propose
neighbours for the new points; pruning keeps, nearest first, those no kept one is closer
to by a factor (relaxed), so that edges stay diverse; reverse edges are added
and pruned alike. Points that no path reaches get an edge from the nearest
that has one. Entries lie far from each other, so that a dense group doesn't
hold a search that begins in it. A query runs a beam search in every shard, whose finds are
measured again in double precision on the original vectors and merged.

A shard's graph is one row. Queries go to the graphs, in broadcast blocks of
bounded bytes, so neither is shuffled; a task keeps each query's best over all
its shards, and those alone are.

Copies of a vector are one point of the graph that carries the smallest ids of
all its rows, enough to fill any answer; every row is indexed that way.
Searches advance a block of queries in lockstep, in whole-array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelark.llm.common import staged
from tidelark.session import ship

#: Points of a shard, about; out-edges; width of the beam while building and searching; relaxation.
SHARD_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 4096, 32, 64, 128, 1.2
#: Where searches begin; further edges a point may get from unreached ones.
ENTRIES, SPARE = 32, 4
#: Bytes of query vectors in a block, which the driver broadcasts; each block is a pass over the graphs.
QUERY_BYTES = 32 << 20
_EXPAND, _LOCKSTEP = 4, 256


def beam_search(points: np.ndarray, norms: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest found (queries x beam, -1 past the end), their squared distances, and the points expanded on the way."""
    b, n = len(queries), len(points)
    rows = np.arange(b)[:, None]
    q_norms = np.einsum("ij,ij->i", queries, queries)
    entries = entries[:beam]
    ids = np.full((b, beam), -1, np.int64)
    far = np.full((b, beam), np.inf, np.float32)
    ids[:, : len(entries)] = entries
    far[:, : len(entries)] = norms[entries] + q_norms[:, None] - 2 * queries @ points[entries].T
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    open_ = ids >= 0
    seen = np.zeros((b, n + 1), bool)
    seen[:, entries] = seen[:, n] = True
    tag = np.zeros((b, n + 1), np.int32)
    trail = []
    while open_.any():
        # The nearest few of each beam that haven't been expanded.
        at = np.argsort(~open_, axis=1, kind="stable")[:, :_EXPAND]
        chosen = np.where(np.take_along_axis(open_, at, 1), np.take_along_axis(ids, at, 1), -1)
        np.put_along_axis(open_, at, False, 1)
        trail.append(chosen)
        new = np.where(chosen[:, :, None] >= 0, edges[np.maximum(chosen, 0)], -1).reshape(b, -1)
        new[new < 0] = n
        new[seen[rows, new]] = n
        place = np.broadcast_to(np.arange(new.shape[1], dtype=np.int32), new.shape)
        tag[rows, new] = place
        new[tag[rows, new] != place] = n  # one of two alike
        seen[rows, new] = True
        # Few of the columns are new; pack them to the left.
        live = new < n
        wide = int(live.sum(axis=1).max(initial=0))
        if not wide:
            continue
        new = np.take_along_axis(new, np.argsort(~live, axis=1, kind="stable")[:, :wide], 1)
        safe = np.minimum(new, n - 1)
        d = norms[safe] + q_norms[:, None] - 2 * np.matmul(points[safe], queries[:, :, None])[:, :, 0]
        d[new == n] = np.inf
        ids = np.concatenate([ids, new], axis=1)
        far = np.concatenate([far, d], axis=1)
        open_ = np.concatenate([open_, new < n], axis=1)
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far, open_ = (np.take_along_axis(x, best, 1) for x in (ids, far, open_))
    ids[~np.isfinite(far)] = -1
    return ids, far, np.concatenate(trail, axis=1)


def robust_prune(points: np.ndarray, own: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges (own x degree, -1 past the end) from candidates (own x many, -1 for none)."""
    found = np.sort(np.where(found == own[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    c = points[np.maximum(found, 0)]
    d = ((c - points[own][:, None]) ** 2).sum(axis=2)
    d[found < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    c = points[np.maximum(found, 0)]
    sq = (c**2).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    out = np.full((len(own), degree), -1, np.int64)
    alive = np.isfinite(d)
    rows = np.arange(len(own))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = found[rows, first][some]
        alive &= alpha * alpha * between[rows, first] > d
        alive[rows, first] = False
    return out


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """The point nearest the mean, then again and again the one farthest from those taken."""
    out = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((points - points[out[0]]) ** 2).sum(axis=1)
    while len(out) < min(n, len(points)) and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[out[-1]]) ** 2).sum(axis=1))
    return np.array(out)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (points x (degree + spare), -1 past the end) and the entries."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    norms = np.einsum("ij,ij->i", points, points)
    entries = spread(points, ENTRIES)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    for again in (False, True):  # the second pass sees the whole graph, so early points find late neighbours
        done = 0 if again else 1
        while done < n:
            batch = order[done : done + (_LOCKSTEP if again else min(_LOCKSTEP, done))]
            ids, _, trail = beam_search(points, norms, edges, entries if again else entries[:done], points[batch], beam)
            edges[batch] = robust_prune(points, batch, np.concatenate([ids, trail, edges[batch]], axis=1), degree, alpha)
            _reverse(points, edges, batch, degree, alpha)
            done += len(batch)
    edges = np.concatenate([edges, np.full((n, SPARE), -1, np.int64)], axis=1)
    _reach(points, edges, entries)
    return edges, entries


def _reach(points: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> None:
    """Makes every point reachable: one that isn't gets an edge from the nearest reached one with a spare place."""
    reached = np.zeros(len(points), bool)

    def walk(start: np.ndarray) -> None:
        while len(start):
            reached[start] = True
            start = np.unique(edges[start])
            start = start[start >= 0]
            start = start[~reached[start]]

    walk(entries)
    while not reached.all():
        lost = int(np.flatnonzero(~reached)[0])
        d = ((points - points[lost]) ** 2).sum(axis=1)
        d[~reached | (edges[:, -1] >= 0)] = np.inf
        near = int(d.argmin())
        if not np.isfinite(d[near]):  # no place is left anywhere; the farthest edge of the nearest gives way
            near = int(np.where(reached, ((points - points[lost]) ** 2).sum(axis=1), np.inf).argmin())
        free = np.flatnonzero(edges[near] < 0)
        edges[near, free[0] if len(free) else -1] = lost
        walk(np.array([lost]))


def _reverse(points: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Adds q -> p for each new edge p -> q; a full q is pruned, in blocks of like numbers of candidates."""
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    new = ~(edges[target] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    if not len(source):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, n_in = np.unique(target, return_index=True, return_counts=True)
    held = (edges[nodes] >= 0).sum(axis=1)
    fits = held + n_in <= degree
    rank = np.arange(len(target)) - np.repeat(first, n_in)
    easy = np.repeat(fits, n_in)
    edges[target[easy], (np.repeat(held, n_in) + rank)[easy]] = source[easy]
    hard = np.flatnonzero(~fits)
    hard = hard[np.argsort(n_in[hard], kind="stable")]
    for i in range(0, len(hard), 64):
        block = hard[i : i + 64]
        wide = int(n_in[block].max())
        incoming = np.full((len(block), wide), -1, np.int64)
        for row, j in enumerate(block):
            incoming[row, : n_in[j]] = source[first[j] : first[j] + n_in[j]]
        edges[nodes[block]] = robust_prune(points, nodes[block], np.concatenate([edges[nodes[block]], incoming], axis=1), degree, alpha)


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat).astype(kind).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), id and score (Euclidean distance) of the k nearest found for each query.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without an id. A query's own id is no candidate;
    repeated rows count once. Vectors of another length than the query's are
    no candidates. Ties go to the smaller id. Queries get all candidates if
    fewer than k; without queries or vectors the result is empty. Other
    columns, whatever their names, aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    take = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    kind = dict(vectors.select(F.col(id_col).alias("id")).dtypes)["id"]
    smallest = Window.partitionBy("v").orderBy("id")
    # The limit by rank is applied before the shuffle too, so copies of one vector don't meet in one task.
    ranked = take(vectors).withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    points = staged(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("dim", F.size("v")), "points")
    wanted = staged(take(queries), "queries")
    shards = max(1, -(-points.count() // shard_rows))
    blocks = max(1, -(-(wanted.agg(F.sum(F.size("v"))).first()[0] or 0) * 8 // QUERY_BYTES))

    def index(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(pc.list_element(table["members"], 0)))  # the same graph, whatever order rows arrive in
        edges, entries = build(_matrix(table["v"], np.float32))
        listed = pa.FixedSizeListArray.from_arrays(pa.array(edges.ravel()), edges.shape[1]).cast(pa.list_(pa.int64()))
        whole = table.select(["v", "members"]).append_column("edges", listed).append_column("entry", pa.array(np.isin(np.arange(len(edges)), entries)))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, whole.schema) as writer:
            writer.write_table(whole)
        return pa.table({"graph": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    sharded = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    graphs = sharded.groupBy("dim", "shard").applyInArrow(index, "graph binary")
    if blocks > 1:  # else the search follows the build without writing the graphs
        graphs = staged(graphs, "graphs")
    found = None
    for block in range(blocks):
        asked = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(asked.toArrow())
        part = _ranked(graphs.mapInArrow(_searching(shared, k, beam), f"query_id {kind}, id {kind}, score double"), k)
        if blocks > 1:
            part = staged(part, "found")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searching(shared, k: int, beam: int):
    """Searches each graph of a task for a block of queries, and hands on the nearest over all of them."""

    def run(batches):
        asked = shared.value
        sizes = np.asarray(pc.list_value_length(asked["v"]))
        types = asked.schema.field("id").type
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for graph in batch.column(0):
                shard = pa.ipc.open_stream(graph.as_buffer()).read_all()
                exact = _matrix(shard["v"])
                places = np.flatnonzero(sizes == exact.shape[1])
                if not len(places):
                    continue
                own = asked.take(pa.array(places))
                wanted, names = _matrix(own["v"]), own["id"].to_pylist()
                points, edges = exact.astype(np.float32), _matrix(shard["edges"], np.int64)
                norms, entries = np.einsum("ij,ij->i", points, points), np.flatnonzero(np.asarray(shard["entry"]))
                members = shard["members"].to_pylist()
                for i in range(0, len(wanted), _LOCKSTEP):
                    block = wanted[i : i + _LOCKSTEP]
                    near, _, _ = beam_search(points, norms, edges, entries, block.astype(np.float32), max(beam, k + 1))
                    d = np.sqrt(((exact[np.maximum(near, 0)] - block[:, None]) ** 2).sum(axis=2))
                    d[near < 0] = np.inf
                    for at, name, row, far in zip(places[i : i + _LOCKSTEP].tolist(), names[i : i + _LOCKSTEP], near, d):
                        had = best.get(at, [])
                        # The (k + 1)th distance bounds what can be in an answer, as does the kth of an earlier shard; ties at it stay in.
                        bound = np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)]
                        bound = min(bound, had[-1][0]) if len(had) == k else bound
                        close = [j for j in np.flatnonzero(far <= bound) if np.isfinite(far[j])]
                        rows = [(float(far[j]), m) for j in close for m in members[row[j]] if m != name]
                        if rows:
                            best[at] = sorted(had + rows)[:k]
        names = asked["id"].to_pylist()
        order = sorted(best)
        for i in range(0, len(order), 1024):
            rows = [(names[at], m, s) for at in order[i : i + 1024] for s, m in best[at]]
            q, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, types), pa.array(ids, types), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    return run
