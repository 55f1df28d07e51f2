"""Boosted trees for page scores, grown leaf by leaf from histograms that tasks sum.

Features are cut into bins once. A pass goes over the rows once for all nodes that wait,
of all models that are fitted together (a model for each left-out book): each task adds
up gradients and curvatures by model, node, feature and bin, the sums meet by cell, and
each node's best split is chosen where its cells are, so the driver gets a row for each
node. The leaf of the largest gain is split next, until a tree has ``leaves`` of them. So
that this isn't a pass a split, the children of all leaves that may be next are summed
at once; the order of the splits is then replayed from their gains, and what it doesn't
reach is left out. A tree takes as many passes as it has levels, or a few more.

Gradients are rounded to multiples of 2^-30 and summed as integers: the model doesn't
depend on partitions or on the order of rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.storage import hold
from leafmark.workers import find_us

ONE = 1 << 30
#: Histogram cells (of 24 bytes) that a task sums at once, and trees after which sums of trees are held.
CELLS, KEEP = 8_000_000, 10


@dataclass(frozen=True)
class Growth:
    """How trees are grown: defaults are those of the usual histogram boosting. With ``bins`` of
    0 each value is a bin of its own, so splits are exact."""

    rounds: int = 100
    leaves: int = 31
    least_rows: int = 20
    rate: float = 0.1
    bins: int = 255
    ridge: float = 0.0
    least_curvature: float = 1e-3


@dataclass
class Boosted:
    """Trees over binned features. A tree is a list of nodes (feature, bin, left, right, value):
    rows of a bin up to ``bin`` go left; a leaf has feature -1."""

    features: list[str]
    ends: list[list[float]]
    base: float
    trees: list[list[tuple]] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += values_of(tree, bins)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(binned(x, self.ends)), -700, 700)))

    def transform(self, pages: DataFrame, name: str = "score") -> DataFrame:
        """Add the score, in Arrow batches; a null feature counts as 0."""

        find_us(pages.sparkSession)

        @F.pandas_udf("double")
        def scored(x: pd.DataFrame) -> pd.Series:
            return pd.Series(self.scores(x.to_numpy(float)))

        return pages.withColumn(name, scored(F.struct(*[_number(f) for f in self.features])))

    def save(self, spark: SparkSession, path: str) -> None:
        told = json.dumps({"kind": "boosted", "features": self.features, "ends": self.ends, "base": self.base, "trees": self.trees})
        spark.createDataFrame([(told,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def of(cls, told: dict) -> Boosted:
        return cls(told["features"], told["ends"], told["base"], [[tuple(n) for n in t] for t in told["trees"]])


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)


def binned(x: np.ndarray, ends: list[list[float]]) -> np.ndarray:
    """Bin of each value: how many ends lie below it."""
    return np.stack([np.searchsorted(np.array(e), x[:, j], "left") for j, e in enumerate(ends)], 1).astype(bin_type(ends)) if ends else np.zeros((len(x), 0), np.uint8)


def bin_type(ends: list[list[float]]) -> type:
    return np.uint8 if all(len(e) < 256 for e in ends) else np.uint32


def nodes_of(tree: list[tuple], bins: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    feature, end, left, right = (np.array([n[i] for n in tree]) for i in range(4))
    at = np.zeros(len(bins), np.int64)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        node = at[rows]
        at[rows] = np.where(bins[rows, feature[node]] <= end[node], left[node], right[node])
    return at


def values_of(tree: list[tuple], bins: np.ndarray) -> np.ndarray:
    return np.array([n[4] for n in tree])[nodes_of(tree, bins)]


def bin_ends(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper ends of each feature's bins but the last: middles between its values where these
    are at most ``bins``, or ``bins`` is 0, else quantiles. The driver gets as many numbers."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f).alias("v")) for j, f in enumerate(features)])).alias("p")).select("p.*")
    values = hold(pairs.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    many = [r["j"] for r in values.groupBy("j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bins).collect()] if bins else []
    few = values.filter(~F.col("j").isin(many)).select("j", "v").toPandas()
    ends = [((v[:-1] + v[1:]) / 2).tolist() for v in (np.sort(few.loc[few["j"] == j, "v"].to_numpy(float)) for j in range(len(features)))]
    if many:
        shares = [i / bins for i in range(1, bins)]
        cut = rows.agg(*[F.percentile_approx(features[j], shares, 100 * bins).alias(str(j)) for j in many]).first()
        for j in many:
            ends[j] = sorted(set(cut[str(j)]))
    return ends


def best_split(cells: pd.DataFrame, how: Growth) -> tuple:
    """(g, h, n, gain, feature, bin) of a node's cells (feature, bin, g, h, n): the split of the
    largest gain, of equal ones the first feature and bin; a gain of 0 if there is none."""
    cells = cells.sort_values(["feature", "bin"])
    first = cells["feature"] == cells["feature"].iloc[0]
    g, h, n = (int(cells.loc[first, c].sum()) for c in "ghn")
    below = cells.groupby("feature")[["g", "h", "n"]].cumsum()
    gl, hl, nl = (below[c].to_numpy(np.int64) for c in "ghn")
    gr, hr, nr = g - gl, h - hl, n - nl
    least, ridge = how.least_curvature * ONE, how.ridge * ONE
    fits = (nl >= how.least_rows) & (nr >= how.least_rows) & (hl >= least) & (hr >= least) & (hl + ridge > 0) & (hr + ridge > 0)
    if not fits.any():
        return g, h, n, 0.0, -1, -1
    part = lambda a, b: a.astype(float) ** 2 / np.where(b + ridge > 0, b + ridge, 1)
    gain = np.where(fits, part(gl, hl) + part(gr, hr) - float(g) ** 2 / (h + ridge), -np.inf)
    at = int(np.argmax(gain))
    if gain[at] <= 0:
        return g, h, n, 0.0, -1, -1
    return g, h, n, float(gain[at]), int(cells["feature"].iloc[at]), int(cells["bin"].iloc[at])


class Tree:
    """A tree that grows: all nodes whose sums are known, and the order of their splits."""

    def __init__(self, how: Growth):
        self.how, self.splits, self.children = how, {}, {}
        self.count, self.chosen, self.waiting = 1, [], [0]

    def told(self, node: int, split: tuple) -> None:
        self.splits[node] = split

    def replay(self) -> list[int]:
        """Split the leaf of the largest gain as long as leaves are left; nodes whose sums this
        needs, none once the tree is whole. Ties go to the node that was made first."""
        chosen, waiting, agenda = [], [], [(-self.splits[0][3], 0)]
        while agenda and len(chosen) + 1 < self.how.leaves:
            gain, node = heapq.heappop(agenda)
            if gain >= 0:
                break
            chosen.append(node)
            if node not in self.children:
                self.children[node] = (self.count, self.count + 1)
                self.count += 2
            for child in self.children[node]:
                if child in self.splits:
                    heapq.heappush(agenda, (-self.splits[child][3], child))
                else:
                    waiting.append(child)
        self.chosen, self.waiting = chosen, waiting
        return waiting

    def nodes(self, whole: bool) -> list[tuple]:
        """All known splits, or those of the whole tree with its leaves' values."""
        inner = set(self.chosen) if whole else set(self.children)
        order, at = [0], 0
        while at < len(order):
            order += self.children[order[at]] if order[at] in inner else ()
            at += 1
        place = {node: i for i, node in enumerate(order)} if whole else {node: node for node in range(self.count)}
        out: list[tuple] = [(-1, 0, 0, 0, 0.0)] * (len(order) if whole else self.count)
        for node in order:
            if node in inner:
                left, right = self.children[node]
                out[place[node]] = (self.splits[node][4], self.splits[node][5], place[left], place[right], 0.0)
            elif whole:
                g, h, _ = self.splits[node][:3]
                curve = h / ONE + self.how.ridge
                out[place[node]] = (-1, 0, 0, 0, -self.how.rate * (g / ONE) / curve if curve > 0 else 0.0)
        return out


def fit(rows: DataFrame, features: list[str], held: list[str | None] | None = None, how: Growth = Growth()) -> list[Boosted]:
    """A model for each of ``held``: the book whose rows it doesn't see, or None.

    ``rows`` has book, label (boolean), weight and the features; a null feature counts as 0.
    """
    find_us(rows.sparkSession)
    held = [None] if held is None else held
    rows = rows.select("book", F.col("label").cast("boolean").alias("label"), F.col("weight").cast("double").alias("weight"), *[_number(f) for f in features])
    ends = bin_ends(rows, features, how.bins)
    books = rows.groupBy("book").agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("label"), F.col("weight")).otherwise(0.0)).alias("p")).toPandas()
    models = []
    for book in held:
        seen = books[books["book"] != book] if book is not None else books
        share = min(1 - 1e-9, max(1e-9, seen["p"].sum() / seen["w"].sum())) if seen["w"].sum() > 0 else 0.5
        models.append(Boosted(features, ends, float(np.log(share / (1 - share)))))
    rows = hold(rows.mapInPandas(_packer(features, ends, [m.base for m in models]), "book string, label boolean, weight double, x binary, raw array<double>"), "binned")
    kept = 0  # trees whose sums the rows hold
    for _ in range(how.rounds):
        if len(models[0].trees) - kept >= KEEP:
            rows, kept = hold(rows.mapInPandas(_adder([m.trees[kept:] for m in models], ends), rows.schema), "sums"), len(models[0].trees)
        growing = [Tree(how) for _ in held]
        waiting = [(f, 0) for f in range(len(held))]
        at_once = max(1, CELLS // max(1, _places(ends)[-1]))
        while waiting:
            for i in range(0, len(waiting), at_once):
                for r in _sums(rows, models, kept, growing, waiting[i : i + at_once], held, ends, how):
                    growing[r["fold"]].told(r["node"], tuple(r)[2:])
            waiting = [(f, node) for f in sorted({f for f, _ in waiting}) for node in growing[f].replay()]
        if all(not t.chosen for t in growing):
            break
        for model, tree in zip(models, growing, strict=True):
            model.trees.append(tree.nodes(whole=True))
    return models


def _packer(features: list[str], ends: list[list[float]], bases: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = binned(batch[features].to_numpy(float), ends)
            yield batch[["book", "label", "weight"]].assign(x=[r.tobytes() for r in x], raw=[bases] * len(x))

    return run


def _unpacked(batch: pd.DataFrame, d: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"]), kind).reshape(len(batch), d)


def _places(ends: list[list[float]]) -> np.ndarray:
    """Where each feature's cells begin among a node's, and how many a node has."""
    return np.cumsum([0, *(len(e) + 1 for e in ends)])


def _adder(trees: list[list[list[tuple]]], ends: list[list[float]]):
    """Adds trees to the sums that rows hold."""
    d, kind = len(ends), bin_type(ends)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, raw = _unpacked(batch, d, kind), np.stack(batch["raw"]) if len(batch) else np.zeros((0, len(trees)))
            raw = raw.copy()
            for f, more in enumerate(trees):
                for tree in more:
                    raw[:, f] += values_of(tree, bins)
            yield batch.assign(raw=list(raw))

    return run


def _sums(rows: DataFrame, models: list[Boosted], kept: int, growing: list[Tree], wanted: list[tuple[int, int]], held: list[str | None], ends: list[list[float]], how: Growth) -> list:
    """(fold, node, g, h, n, gain, feature, bin) of the wanted nodes."""
    places, d, kind, by_fold = _places(ends), len(ends), bin_type(ends), {}
    width = int(places[-1])
    for slot, (f, node) in enumerate(wanted):
        by_fold.setdefault(f, []).append((slot, node))
    trees = {f: (models[f].trees[kept:], growing[f].nodes(whole=False)) for f in by_fold}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((3, len(wanted) * width), np.int64)
        for batch in batches:
            bins, raws = _unpacked(batch, d, kind), np.stack(batch["raw"]) if len(batch) else np.zeros((0, len(models)))
            y, weight, book = batch["label"].to_numpy(float), batch["weight"].to_numpy(float), batch["book"]
            for f, slots in by_fold.items():
                done, tree = trees[f]
                slot_of = np.full(len(tree), -1)
                for slot, node in slots:
                    slot_of[node] = slot
                slot = slot_of[nodes_of(tree, bins)]
                use = slot >= 0
                if held[f] is not None:
                    use &= (book != held[f]).to_numpy()
                if not use.any():
                    continue
                raw, some = raws[use, f].copy(), bins[use]
                for old in done:
                    raw += values_of(old, some)
                p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
                g, h = (np.rint(v * weight[use] * ONE).astype(np.int64) for v in (p - y[use], p * (1 - p)))
                for j in range(d):
                    cell = slot[use] * width + places[j] + some[:, j]
                    for out, value in zip(found, (g, h, 1), strict=True):
                        np.add.at(out, cell, value)
        cells = np.flatnonzero(found[2])
        slot, rest = np.divmod(cells, width)
        feature = np.searchsorted(places, rest, "right") - 1
        which = np.array(wanted, np.int64).reshape(-1, 2)[slot]
        yield pd.DataFrame({"fold": which[:, 0], "node": which[:, 1], "feature": feature, "bin": rest - places[feature], **dict(zip("ghn", found[:, cells], strict=True))})

    def choose(cells: pd.DataFrame) -> pd.DataFrame:
        split = best_split(cells, how)
        return pd.DataFrame([(cells["fold"].iloc[0], cells["node"].iloc[0], *split)], columns=["fold", "node", "g", "h", "n", "gain", "feature", "bin"])

    cells = rows.mapInPandas(run, "fold long, node long, feature long, bin long, g long, h long, n long").groupBy("fold", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    told = cells.groupBy("fold", "node").applyInPandas(choose, "fold long, node long, g long, h long, n long, gain double, feature long, bin long").collect()
    missing = set(wanted) - {(r["fold"], r["node"]) for r in told}
    return told + [_Nothing(f, node) for f, node in missing]


class _Nothing(tuple):
    """A node without rows."""

    def __new__(cls, fold: int, node: int):
        return super().__new__(cls, (fold, node, 0, 0, 0, 0.0, -1, -1))

    def __getitem__(self, key):
        return tuple.__getitem__(self, {"fold": 0, "node": 1}.get(key, key))
