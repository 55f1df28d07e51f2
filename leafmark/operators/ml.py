"""Scaling, page scorers and leave-one-book-out evaluation.

The linear scorer is fitted by Newton steps in numpy on the class-balanced,
weighted logistic loss, and applied as one dot product in SQL. Boosted trees are those
of :mod:`leafmark.operators.boosting`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.geometry import PAGE_FEATURES
from leafmark.functions.text import TEXT_FEATURES
from leafmark.operators import boosting
from leafmark.operators.pages import CONTEXT_FEATURES
from leafmark.storage import hold
from leafmark.workers import find_us

FEATURES = [*PAGE_FEATURES, *CONTEXT_FEATURES, *TEXT_FEATURES]
MODELS = ("logistic_regression", "gradient_boosting")


@dataclass
class Linear:
    """Standardised inputs, a weight for each, and a bias."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, features: list[str], penalty: float = 1.0, steps: int = 50) -> Linear:
        """L2 of ``penalty``; classes weigh n / (2 * class size) times the row's weight."""
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale == 0, 1.0, scale)
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
        y = y.astype(float)
        sizes = max(1.0, y.sum()), max(1.0, (1 - y).sum())
        each = weight * np.where(y > 0, len(y) / 2 / sizes[0], len(y) / 2 / sizes[1])
        w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], penalty), 1e-9)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
            grad = z.T @ (each * (p - y)) + ridge * w
            curve = (z * (each * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
            step = np.linalg.solve(curve, grad)
            w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        return cls(features, mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights) + self.bias, -700, 700)))

    def transform(self, pages: DataFrame, name: str = "score") -> DataFrame:
        """Add the score: a dot product and a sigmoid, in whole-stage code."""
        total = F.lit(float(self.bias))
        for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True):
            total = total + (F.col(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
        return pages.withColumn(name, 1 / (1 + F.exp(-total)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Linear:
        return cls(**json.loads(spark.read.text(path).first()[0]))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace columns by (x - mean) / population deviation; constant ones by 0.0."""
    found = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(found)).withColumns(scaled).select(df.columns)  # one row on the right


def fit_boosted(pages: DataFrame, features: list[str] | None = None, how: boosting.Growth = boosting.Growth()) -> boosting.Boosted:
    """Boosted trees on all rows of ``pages`` (book, features, label, weight)."""
    return boosting.fit(pages, features or FEATURES, None, how)[0]


def load_model(spark: SparkSession, path: str) -> Linear | boosting.Boosted:
    """A scorer of either kind that ``save`` wrote."""
    told = json.loads(spark.read.text(path).first()[0])
    return boosting.Boosted.of(told) if told.get("kind") == "boosted" else Linear(**told)


def _plain(pages: DataFrame, features: list[str]) -> DataFrame:
    return pages.select("book", "page_index", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col("label").cast("boolean"), F.col("weight").cast("double"))


def _book_figures(rows: DataFrame, features: list[str]) -> pd.DataFrame:
    """Rows, positives, means and variances of each book: a row a book on the driver."""
    return (
        rows.groupBy("book")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("int")).alias("pos"), *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)], *[F.var_pop(f).alias(f"v_{i}") for i, f in enumerate(features)])
        .orderBy("book")
        .toPandas()
    )


def _newton(rows: DataFrame, features: list[str], figures: pd.DataFrame, held: list[str | None], steps: int = 500) -> list[Linear]:
    """A model for each of ``held``: the book that it doesn't see, or None.

    Each Newton step of all models is one pass that sums losses, gradients and curvatures
    in the tasks; the driver holds these sums and per-book figures, never pages. Steps go
    on to the optimum: the fewer true pages among many, the larger the weights, so a step may
    be as long as the weights are (5 at least), and is halved where the loss rose.
    """
    d = len(features)
    n, pos = figures["n"].to_numpy(float), figures["pos"].to_numpy(float)
    m, v = (figures[[f"{c}_{i}" for i in range(d)]].to_numpy(float).reshape(-1, d) for c in "mv")
    mean, scale, sizes = [], [], []
    for book in held:
        o = (figures["book"] != book).to_numpy() if book is not None else np.ones(len(figures), bool)
        total, p = max(1.0, n[o].sum()), pos[o].sum()
        c = (n[o, None] * m[o]).sum(0) / total
        s = np.sqrt((n[o, None] * (v[o] + (m[o] - c) ** 2)).sum(0) / total)
        mean.append(c)
        scale.append(np.where(s == 0, 1.0, s))
        sizes.append((n[o].sum() / 2 / max(1.0, p), n[o].sum() / 2 / max(1.0, n[o].sum() - p)))
    w, ridge = np.zeros((len(held), d + 1)), np.append(np.ones(d), 1e-9)
    moved, least = np.zeros_like(w), np.full(len(held), np.inf)
    left, size = list(range(len(held))), (d + 1) * (d + 2)
    for _ in range(steps):
        if not left:
            break

        def sums(batches: Iterator[pd.DataFrame], w=w.copy(), left=tuple(left)) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(left), size + 1))
            for batch in batches:
                x, y, each = batch[features].to_numpy(float), batch["label"].to_numpy(float), batch["weight"].to_numpy(float)
                for j, f in enumerate(left):
                    o = (batch["book"] != held[f]).to_numpy() if held[f] is not None else np.ones(len(batch), bool)
                    z = np.concatenate([(x[o] - mean[f]) / scale[f], np.ones((int(o.sum()), 1))], 1)
                    raw = z @ w[f]
                    p = 1 / (1 + np.exp(-np.clip(raw, -60, 60)))
                    a = each[o] * np.where(y[o] > 0, sizes[f][0], sizes[f][1])
                    loss = a @ np.logaddexp(0, np.where(y[o] > 0, -raw, raw))
                    out[j] += np.concatenate([z.T @ (a * (p - y[o])), ((z * (a * p * (1 - p))[:, None]).T @ z).reshape(-1), [loss]])
            yield pd.DataFrame({"fold": np.repeat(np.array(left, np.int64), out.shape[1]), "place": np.tile(np.arange(out.shape[1]), len(left)), "value": out.reshape(-1)})

        found = rows.mapInPandas(sums, "fold long, place long, value double").groupBy("fold", "place").agg(F.sum("value").alias("value")).toPandas()
        table = found.sort_values(["fold", "place"])["value"].to_numpy().reshape(len(left), -1)
        going = []
        for f, row in zip(left, table, strict=True):
            loss = row[size] + ridge @ w[f] ** 2 / 2
            if loss > least[f] * (1 + 1e-9):
                moved[f] /= 2
                w[f] += moved[f]
                going.append(f)
                continue
            least[f] = loss
            curve = row[d + 1 : size].reshape(d + 1, d + 1) + np.diag(ridge + 1e-9)
            step = np.linalg.solve(curve, row[: d + 1] + ridge * w[f])
            moved[f] = step * min(1.0, max(5.0, np.abs(w[f]).max()) / (np.abs(step).max() + 1e-12))
            w[f] -= moved[f]
            if np.abs(step).max() >= 1e-9:
                going.append(f)
        left = going
    if left:
        raise RuntimeError(f"{len(left)} of {len(held)} fits didn't settle in {steps} steps")
    return [Linear(features, mean[f].tolist(), scale[f].tolist(), w[f, :-1].tolist(), float(w[f, -1])) for f in range(len(held))]


def fit_linear(pages: DataFrame, features: list[str] | None = None) -> Linear:
    """Fit on the whole page table, by sums over the tasks."""
    features = features or FEATURES
    rows = hold(_plain(pages, features), "rows")
    return _newton(rows, features, _book_figures(rows, features), [None])[0]


def leave_one_out(pages: DataFrame, features: list[str] | None = None, model: str = MODELS[0], how: boosting.Growth = boosting.Growth()) -> DataFrame:
    """(book, page_index, label, score) of every book that has a true page, scored by a
    model (of ``MODELS``) fitted on all other books. The models of all books are fitted
    together: a pass over the rows serves them all.
    """
    features = features or FEATURES
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    rows = hold(_plain(pages, features), "rows")
    if model == MODELS[1]:
        books = [r["book"] for r in rows.filter("label").select("book").distinct().orderBy("book").collect()]
        fitted = boosting.fit(rows, features, books, how) if books else []
    else:
        figures = _book_figures(rows, features)
        books = figures.loc[figures["pos"] > 0, "book"].tolist()
        fitted = _newton(rows, features, figures, books)
    models = dict(zip(books, fitted, strict=True))
    find_us(rows.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, part in batch.groupby("book"):
                if book in models:
                    yield part[["book", "page_index", "label"]].assign(score=models[book].scores(part[features].to_numpy(float)))

    return rows.mapInPandas(score, "book string, page_index int, label boolean, score double")
