"""Hierarchical language identification with linear support vector machines.

First a language family is predicted, one family against the rest; then, inside
the family, a linear SVM for each pair of languages votes. Features are byte
1- to 4-grams of the letters of the lower-cased whole text, hashed; a text's
margin is the mean of its grams' weights, so one pass over the bytes serves all
machines.

The machines are fitted on a bounded sample of labelled rows (``per_language``
for each of at most ``most_languages``, chosen by a hash of id and text); prediction
covers every row.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a table without labelled rows predicts ``und`` for all; ties go to the language
first in alphabetical order; repeated rows are predicted alike and learned from once;
very long texts are read whole; an empty table gives no rows; extra columns are ignored by :func:`predict` and kept by
:func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import crc_mod, documents, map_rows, workers_find_us

UND = "und"
BITS, ORDERS = 14, (1, 2, 3, 4)
PER_LANGUAGE, MOST_LANGUAGES, LEAST_ROWS = 300, 100, 5

# Families of common ISO 639-1 codes; any other language is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "tr", "uz"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_NOT_LETTER = regex.compile(r"[^\p{L}]+")


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def grams(text: str | None) -> np.ndarray:
    """Hashed grams of a text's letters; runs of other characters become one space."""
    letters = _NOT_LETTER.sub(" ", (text or "").lower())
    if not letters.strip():
        return np.empty(0, np.int32)
    data = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
    out, run = [], np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        run = run[: len(data) - order + 1] * np.uint32(257) + data[order - 1 :]
        if order in ORDERS:
            mixed = (run + np.uint32(order)) * np.uint32(2654435761)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(out)


def counts(text: str | None) -> np.ndarray:
    found = grams(text)
    return np.bincount(found, minlength=1 << BITS).astype(np.float32) / max(1, len(found))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by accelerated gradients; y is -1 or 1, classes
    weigh the same. x has rows of unit scale."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, rate = w.copy(), 1.0 / (2 * float(share @ np.einsum("ij,ij->i", x, x) + share.sum()) + penalty)
    for k in range(steps):
        pull = share * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        grad = penalty * v
        grad[:-1] -= 2 * (pull @ x)
        grad[-1] -= 2 * pull.sum()
        fresh = v - np.float32(rate) * grad
        v = fresh + k / (k + 3) * (fresh - w)
        w = fresh
    return w[:-1], float(w[-1])


class Model:
    """Families, languages, and one row of weights for each machine."""

    def __init__(self, languages: list[str], weights: np.ndarray, biases: np.ndarray):
        self.languages, self.weights, self.biases = languages, weights, biases
        self.families = sorted({family_of(x) for x in languages})
        self.members = {f: [x for x in languages if family_of(x) == f] for f in self.families}
        self.machines = self.order(languages)

    @staticmethod
    def order(languages: list[str]) -> list[tuple]:
        families = sorted({family_of(x) for x in languages})
        first = [("family", f) for f in families] if len(families) > 1 else []
        return first + [("pair", a, b) for a, b in combinations(languages, 2) if family_of(a) == family_of(b)]

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        """x: one row of gram shares for each label; it is scaled in place."""
        languages = sorted(set(labels))
        scale = np.float32(1 / max(1e-9, float(np.sqrt(np.einsum("ij,ij->i", x, x).mean())))) if len(x) else np.float32(1)
        x *= scale
        named, weights, biases = np.array(labels), [], []
        family = np.array([family_of(v) for v in labels])
        for machine in cls.order(languages):
            rows = np.ones(len(x), bool) if machine[0] == "family" else np.isin(named, machine[1:])
            y = np.where((family if machine[0] == "family" else named)[rows] == machine[1], 1, -1).astype(np.float32)
            w, b = fit_svm(x[rows] if not rows.all() else x, y)
            weights.append(w * scale)
            biases.append(b)
        return cls(languages, np.array(weights, np.float32).reshape(len(weights), 1 << BITS), np.array(biases))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.languages:
            return UND, 0.0
        hist = np.bincount(found, minlength=1 << BITS)
        margins = dict(zip(self.machines, self.weights @ (hist / np.float32(len(found))) + self.biases, strict=True))
        family = max(self.families, key=lambda f: margins.get(("family", f), 0.0))
        sure = [margins["family", family]] if len(self.families) > 1 else []
        members = self.members[family]
        votes = {x: 0.0 for x in members}
        for a, b in combinations(members, 2):
            m = margins["pair", a, b]
            votes[a if m >= 0 else b] += 1
            votes[a] += 1e-3 * np.tanh(m)
            votes[b] -= 1e-3 * np.tanh(m)
        best = max(members, key=votes.__getitem__)
        sure += [margins["pair", a, b] * (1 if a == best else -1) for a, b in combinations(members, 2) if best in (a, b)]
        return best, float(1 / (1 + np.exp(-2 * min(sure, default=1.0))))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, least_rows: int = LEAST_ROWS
) -> Model:
    """Fit on about ``per_language`` rows of each language, none of them held out.

    The sample is the rows whose hash of id and text falls under a share of the hash
    range, each id and text once; the counts behind the shares are those of all rows.
    Languages of fewer than ``least_rows`` rows, and those beyond the ``most_languages``
    most frequent (ties in alphabetical order), are not learned. So the sample, the
    machines and what reaches the driver are bounded whatever the table holds.
    """
    rows = documents(docs, id_col, text_col, F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(-1)) != 2))
    often = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows)
    sizes = {r["lang"]: r["n"] for r in often.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000_000)) / F.lit(1e9)
    chosen = rows.filter(draw < F.try_element_at(shares, F.col("lang"))).dropDuplicates(["doc_id", "text", "lang"])

    def make():
        def step(r: dict) -> dict:
            found = [counts(t) for t in r["text"]]
            at = [f.nonzero()[0].astype(np.uint16) for f in found]
            return {"lang": r["lang"], "at": [a.tobytes() for a in at], "share": [f[a].tobytes() for f, a in zip(found, at, strict=True)]}

        return step

    # Whole texts, as sparse features: some ten kilobytes a row.
    found = sorted(map(tuple, map_rows(chosen, make, "lang string, at binary, share binary", 32).collect()))
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for row, (_, at, share) in zip(x, found, strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
    return Model.fit(x, [v for v, _, _ in found])


def predict(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. No shuffle of texts."""
    model = model or fit(docs, id_col, text_col, lang_col, per_language)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.biases))

    def make():
        one = Model(*shared.value).predict

        def step(rows: dict) -> dict:
            found = [one(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return step

    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    rows = documents(docs, id_col, text_col).select("doc_id", "text", held_out)
    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = 0.5, languages: list[str] | None = None, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents in a known language (one of ``languages``, if given), with
    ``lang_col`` set to the prediction; all other columns as they were."""
    model = model or fit(docs, id_col, text_col, lang_col)
    spark = docs.sparkSession
    workers_find_us(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.biases))
    names, allowed = docs.columns, set(languages or []) or None
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Callable[[str | None], tuple[str, float]] = Model(*shared.value).predict
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [one(t.as_py()) for t in part.column(text_at)]
                keep = pa.array([v != UND and s >= min_score and (allowed is None or v in allowed) for v, s in found], pa.bool_())
                columns = list(part.columns)
                columns[lang_at] = pa.array([v for v, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    schema = docs.withColumn(lang_col, F.col(f"`{lang_col}`").cast("string")).schema
    return docs.mapInArrow(run, schema)
