"""Boosted trees: dump parsing, scoring as Catalyst expressions, and a histogram trainer."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.operators.grids import bin_number
from tidelark.operators.stats import finite
from tidelark.session import staged


@dataclass(frozen=True)
class Split:
    """Left if the feature, as a 32-bit float, is below the threshold; the missing go where `missing` says. Children are node numbers."""

    feature: str
    threshold: float
    yes: int
    no: int
    missing: int
    gain: float = 0.0
    cover: float = 0.0


@dataclass(frozen=True)
class Leaf:
    value: float
    cover: float = 0.0


@dataclass
class Tree:
    nodes: list[Split | Leaf]


@dataclass
class Ensemble:
    trees: list[Tree]
    base_score: float = 0.5

    @property
    def margin(self) -> float:
        return math.log(self.base_score / (1 - self.base_score))

    @property
    def n_nodes(self) -> int:
        return sum(len(t.nodes) for t in self.trees)

    def gains(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for t in self.trees:
            for n in t.nodes:
                if isinstance(n, Split):
                    out[n.feature] = out.get(n.feature, 0.0) + n.gain
        return out

    def to_json(self) -> str:
        return json.dumps({"base_score": self.base_score, "trees": [[{"kind": type(n).__name__, **n.__dict__} for n in t.nodes] for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        x = json.loads(text)
        kinds = {"Split": Split, "Leaf": Leaf}
        return Ensemble([Tree([kinds[n.pop("kind")](**n) for n in t]) for t in x["trees"]], x["base_score"])


def expression(tree: Tree, at: int = 0) -> Column:
    """Nested CASE WHENs: a tree is part of the generated code, and reads only the columns it splits on."""
    n = tree.nodes[at]
    if isinstance(n, Leaf):
        return F.lit(float(n.value))
    x = finite(F.col(n.feature).cast("double")).cast("float")
    left, right = expression(tree, n.yes), expression(tree, n.no)
    return F.when(x.isNull(), left if n.missing == n.yes else right).when(x < F.lit(float(n.threshold)).cast("float"), left).otherwise(right)


def scored(df: DataFrame, model: Ensemble) -> DataFrame:
    """Adds margin and prob."""
    margin = sum((expression(t) for t in model.trees), F.lit(model.margin))
    return df.withColumn("margin", margin).withColumn("prob", 1 / (1 + F.exp(-F.col("margin"))))


def predict(model: Ensemble, x: dict[str, np.ndarray]) -> np.ndarray:
    """Margins of columns of doubles (NaN: missing), without Spark; for folds in memory."""
    size = len(next(iter(x.values())))
    out = np.full(size, model.margin)
    for tree in model.trees:
        at = np.zeros(size, np.int64)
        for i, n in enumerate(tree.nodes):  # children have higher numbers
            here = at == i
            if isinstance(n, Leaf):
                out[here] += n.value
            else:
                v = np.where(np.isfinite(x[n.feature]), x[n.feature], np.nan).astype(np.float32)
                at[here] = np.where(np.isnan(v[here]), n.missing, np.where(v[here] < np.float32(n.threshold), n.yes, n.no))
    return out


_NODE = re.compile(r"^\s*(\d+):\[([^<\]]+)<([^\]]+)\]\s+yes=(\d+),no=(\d+),missing=(\d+)(?:,gain=([^,\s]+),cover=([^,\s]+))?")
_LEAF = re.compile(r"^\s*(\d+):leaf=([^,\s]+)(?:,cover=([^,\s]+))?")


def parsed_dump(texts: Sequence[str], names: Sequence[str]) -> list[dict]:
    """Rows of a node table from text dumps, one for each tree; f0, f1, ... are looked up in names."""
    out = []
    for tree, text in enumerate(texts):
        for line in text.splitlines():
            if m := _NODE.match(line):
                name = names[int(m[2][1:])] if re.fullmatch(r"f\d+", m[2]) and int(m[2][1:]) < len(names) else m[2]
                out.append({"Tree": tree, "Node": int(m[1]), "ID": f"{tree}-{m[1]}", "Feature": m[2], "FeatureName": name, "Split": float(m[3]), "Yes": int(m[4]), "No": int(m[5]), "Missing": int(m[6]), "Gain": float(m[7] or 0), "Cover": float(m[8] or 0), "LeafValue": None})
            elif m := _LEAF.match(line):
                out.append({"Tree": tree, "Node": int(m[1]), "ID": f"{tree}-{m[1]}", "Feature": "Leaf", "FeatureName": "Leaf", "Split": None, "Yes": None, "No": None, "Missing": None, "Gain": 0.0, "Cover": float(m[3] or 0), "LeafValue": float(m[2])})
    return out


def from_rows(rows: Sequence[dict], base_score: float = 0.5) -> Ensemble:
    """An ensemble from a node table."""
    by: dict[int, dict[int, dict]] = {}
    for r in rows:
        by.setdefault(int(r["Tree"]), {})[int(r["Node"])] = r
    trees = []
    for _, nodes in sorted(by.items()):
        order = {k: i for i, k in enumerate(sorted(nodes))}
        trees.append(Tree([
            Leaf(float(r["LeafValue"]), float(r["Cover"] or 0)) if r["Feature"] == "Leaf"
            else Split(r["FeatureName"], float(r["Split"]), order[int(r["Yes"])], order[int(r["No"])], order[int(r["Missing"])], float(r["Gain"] or 0), float(r["Cover"] or 0))
            for _, r in sorted(nodes.items())
        ]))
    return Ensemble(trees, base_score)


@dataclass(frozen=True)
class Boosting:
    """Regularised second-order boosting for binary targets."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.1
    ridge: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    bins: int = 64
    positive_weight: float = 1.0
    base_score: float = 0.5
    #: L1 penalty of leaves; shares of rows and of columns that a tree sees, drawn by the seed.
    alpha: float = 0.0
    subsample: float = 1.0
    columns: float = 1.0
    seed: int = 42


def _shrunk(g: np.ndarray | float, alpha: float) -> np.ndarray | float:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _best_split(g: np.ndarray, h: np.ndarray, miss: tuple[float, float], p: Boosting) -> tuple[float, int, bool] | None:
    """Gain, last bin on the left, and whether the missing go left; from a node's sums by bin."""
    all_g, all_h = g.sum() + miss[0], h.sum() + miss[1]
    score = lambda a, b: _shrunk(a, p.alpha) ** 2 / np.maximum(b + p.ridge, 1e-300)
    best = None
    for left in (True, False):
        lg, lh = np.cumsum(g)[:-1] + left * miss[0], np.cumsum(h)[:-1] + left * miss[1]
        rg, rh = all_g - lg, all_h - lh
        gain = np.where((np.minimum(lh, rh) > 0) & (lh >= p.min_child_weight) & (rh >= p.min_child_weight), (score(lg, lh) + score(rg, rh) - score(all_g, all_h)) / 2 - p.gamma, -np.inf)
        if len(gain) and gain.max() > 1e-12 and (best is None or gain.max() > best[0] + 1e-12):
            best = float(gain.max()), int(gain.argmax()), left
    return best


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Upper bounds of the bins: distinct quantiles. Sketched, so the pass is bounded in memory for any number of rows."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(finite(F.col(c).cast("double")), F.array(*map(F.lit, shares)), F.lit(10_000)).alias(c) for c in features]).first()
    return {c: sorted(set(np.float32(x).item() for x in row[c] or [])) for c in features}


#: Rounds after which margins are written, so that a round evaluates so many trees at most.
WRITTEN = 8


def fit(df: DataFrame, features: Sequence[str], target: str, p: Boosting | None = None, weight: str | None = None) -> Ensemble:
    """Trains over all rows: for each level, gradients are summed by node, feature and bin in one aggregation.

    Rows are binned once, into a narrow table of small integers in the shared
    folder, and their margins are written there every few rounds; those of the
    rounds between, and nodes, are expressions. What reaches the driver
    is bounded by nodes, features and bins, whatever the rows.
    """
    p = p or Boosting()
    edges = bin_edges(df, features, p.bins)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    w = F.when(F.col(target) == 1, w * p.positive_weight).otherwise(w)
    values = df.select(F.col(target).cast("double").alias("y"), w.alias("w"), *[finite(F.col(c).cast("double")).cast("float").alias(f"x{i}") for i, c in enumerate(features)])
    bins = [bin_number(F.col(f"x{i}"), edges[c]).cast("short").alias(f"b{i}") for i, c in enumerate(features)]
    # Rows are drawn by a hash of their values, so a sample is the same however the table is dealt out.
    drawn = [F.xxhash64("y", "w", *[f"x{i}" for i in range(len(features))]).alias("u")] if p.subsample < 1 else []
    rows = staged(values.select("y", "w", *drawn, F.lit(math.log(p.base_score / (1 - p.base_score))).alias("m"), *bins), "bins")
    listed = F.array(*[F.struct(F.lit(i).alias("f"), F.coalesce(f"b{i}", F.lit(-1)).alias("b")) for i in range(len(features))])
    model, over_bins = Ensemble([], p.base_score), []

    for t in range(p.rounds):
        seen = range(len(features))
        if p.columns < 1:
            seen = sorted(np.random.default_rng((p.seed, t)).choice(len(features), max(1, round(p.columns * len(features))), replace=False).tolist())
        margin = sum((expression(t) for t in over_bins), F.col("m"))
        if len(over_bins) == WRITTEN:
            rows, over_bins, margin = staged(rows.withColumn("m", margin), "bins"), [], F.col("m")
        graded = rows.withColumn("p", 1 / (1 + F.exp(-margin))).withColumn("g", F.col("w") * (F.col("p") - F.col("y"))).withColumn("h", F.col("w") * F.col("p") * (1 - F.col("p")))
        if p.subsample < 1:
            graded = graded.where(F.pmod(F.xxhash64(F.lit(p.seed), F.lit(t), "u"), F.lit(1 << 30)) < int(p.subsample * (1 << 30)))
        nodes: list[Split | Leaf] = [Leaf(0.0)]
        twins: list[Split | Leaf] = [Leaf(0.0)]  # the same splits over bins
        open_ = [0]
        for level in range(p.depth + 1):
            here = graded.withColumn("node", _node_of(twins)).where(F.col("node").isin(open_))
            if level == p.depth:  # only leaves are left
                sums = here.groupBy("node").agg(F.lit(0).alias("f"), F.lit(0).alias("b"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            else:
                sums = here.select("node", "g", "h", F.explode(listed).alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            g = {k: [np.zeros(len(edges[c]) + 2) for c in features] for k in open_}
            h = {k: [np.zeros(len(edges[c]) + 2) for c in features] for k in open_}
            for r in sums:
                g[r["node"]][r["f"]][r["b"]] += r["g"]
                h[r["node"]][r["f"]][r["b"]] += r["h"]
            new = []
            for k in open_:
                all_g, all_h = g[k][0].sum(), h[k][0].sum()
                nodes[k] = twins[k] = Leaf(float(-p.rate * _shrunk(all_g, p.alpha) / max(all_h + p.ridge, 1e-300)), float(all_h))
                found = None
                for i in seen if level < p.depth else ():
                    got = _best_split(g[k][i][:-1], h[k][i][:-1], (g[k][i][-1], h[k][i][-1]), p)
                    if got and (found is None or got[0] > found[0][0] + 1e-12):
                        found = got, i
                if found:
                    (gain, last, left), i = found
                    yes = len(nodes)
                    missing = yes if left else yes + 1
                    nodes[k] = Split(features[i], edges[features[i]][last], yes, yes + 1, missing, gain, float(all_h))
                    twins[k] = Split(f"b{i}", last + 0.5, yes, yes + 1, missing)
                    nodes += [Leaf(0.0), Leaf(0.0)]
                    twins += [Leaf(0.0), Leaf(0.0)]
                    new += [yes, yes + 1]
            open_ = new
            if not open_:
                break
        model.trees.append(Tree(nodes))
        over_bins.append(Tree(twins))
    return model


def _node_of(nodes: Sequence[Split | Leaf], at: int = 0) -> Column:
    """Number of the leaf a row falls into."""
    n = nodes[at]
    if isinstance(n, Leaf):
        return F.lit(at)
    x = finite(F.col(n.feature).cast("double")).cast("float")
    left, right = _node_of(nodes, n.yes), _node_of(nodes, n.no)
    return F.when(x.isNull(), left if n.missing == n.yes else right).when(x < F.lit(float(n.threshold)).cast("float"), left).otherwise(right)
