"""Toxicity by cumulative-link ordinal regression on sparse words.

One weight vector is shared by all ordered thresholds: P(grade >= k) is the logistic
of the text's score minus threshold k. L1 keeps few words, so long clean texts
gather no noise. A text's features are 1 + log(count) of its words (lower-cased,
stripped of punctuation), hashed to 32 bits.

Labels say only toxic or not. Toxic training rows are graded by how many words they
hold that are far commoner in toxic rows (below or above the median of such
counts), which gives the grades 0, 1 and 2; labels with more grades are used as
they are.

The model is fitted on a bounded sample of labelled rows (``sample``); every
document is scored, its whole text. Near copies within the sample count once.
Defined results: a null or empty text has the score of no words; without labels, with
one grade only, or without a word that tells the grades apart, severity is 0 and
nothing is toxic; repeated rows are scored alike; a document with several labels takes
the highest, and of several texts of one id the first in order is learned from; a
probability of exactly one half counts as reached; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import documents, map_rows

WORD = re.compile(r"[^\W_]+")
SAMPLE, SPARSE = 16_000, 2e-3
#: Words of a shingle, and hashes of a sketch, by which near copies among labelled rows are told.
SHINGLE, SKETCH = 5, 256
CACHED_WORDS = 500_000


class _Packed(dict):
    """Packed place (in ``known``, ascending; else the 32-bit bucket itself) of each word."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = known

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = np.array([zlib.crc32(word.encode("utf-8", "replace"))], np.int64)
        if self.known is not None:
            place = np.searchsorted(self.known, found)
            place = np.minimum(place, max(0, len(self.known) - 1))
            found = place[self.known[place] == found] if len(self.known) else found[:0]
        packed = self[word] = found.astype(np.int64).tobytes()
        return packed

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places (ascending) and 1 + log(count) of all of the text's words."""
        words = WORD.findall((text or "").lower())
        at, n = np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), np.int64), return_counts=True)
        return at, (1 + np.log(n)).astype(np.float32)


class Ordinal:
    """score = bias-free weights x features; P(grade >= k) = sigmoid(score - cuts[k - 1])."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.at, self.weights, self.cuts = at, weights, cuts

    def at_least(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, sparse: float = SPARSE, steps: int = 400) -> Ordinal:
        """Accelerated proximal gradient on the mean cumulative-link loss, with L1 on the weights."""
        top = int(grades.max(initial=0))
        named = telling(rows, grades > 0) if len(np.unique(grades)) > 1 else np.empty(0, np.int64)
        if not len(named):
            return cls(named, np.empty(0, np.float32), np.empty(0))
        owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        every, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
        place = np.searchsorted(named, every)
        live = named[np.minimum(place, len(named) - 1)] == every
        owner, place, value = owner[live], place[live], value[live].astype(np.float64)
        n, m = len(rows), len(named)
        above = (grades[:, None] >= np.arange(1, top + 1)[None, :]).astype(np.float64)
        # Grade 0 and the rest weigh the same, however rare the rest is.
        each = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / max(1, (grades == 0).sum()))
        base = np.clip(each @ above, 1e-4, 1 - 1e-4)
        cuts = np.log((1 - base) / base)
        w, v, old_cuts, ahead = np.zeros(m), np.zeros(m), cuts.copy(), cuts.copy()
        # Features are scaled by their own spread, so that one step length serves all.
        square = np.bincount(place, value * value * each[owner], m)
        scale = 1 / np.sqrt(square + 1e-3)
        value = value * scale[place]
        x = np.random.default_rng(1).normal(size=m)
        for _ in range(20):  # the largest eigenvalue of the features' second moments
            x /= np.linalg.norm(x) or 1
            x = np.bincount(place, value * (each * np.bincount(owner, value * x[place], n))[owner], m)
        rate = 1 / (0.25 * top * max(1.0, float(np.linalg.norm(x))) + 1)
        for k in range(steps):
            p = 1 / (1 + np.exp(np.clip(ahead[None, :] - np.bincount(owner, value * v[place], n)[:, None], -60, 60)))
            pull = (p - above) * each[:, None]
            grad = np.bincount(place, value * pull.sum(1)[owner], m)
            fresh = v - rate * grad
            fresh = np.sign(fresh) * np.maximum(0, np.abs(fresh) - rate * sparse * scale)
            fresh_cuts = np.sort(ahead + rate * pull.sum(0))
            pace = k / (k + 3)
            v, w = fresh + pace * (fresh - w), fresh
            ahead, old_cuts = fresh_cuts + pace * (fresh_cuts - old_cuts), fresh_cuts
        kept = w != 0
        return cls(named[kept], (w * scale)[kept], old_cuts)


def telling(rows: list[tuple[np.ndarray, np.ndarray]], yes: np.ndarray, times: float = 5.0, least: float = 2.5, share: float = 0.4) -> np.ndarray:
    """Buckets ``times`` as frequent in rows marked ``yes`` as in the others, ascending.

    Their log-odds must differ by ``least`` standard errors, and by ``share`` of the
    largest such figure: words of a few near copies gain in standard errors with
    the sample too, but less than words that toxic texts have in common.
    """
    at, count = _rows_with(rows, yes)
    if not len(at):
        return at
    size = np.array([[(~yes).sum()], [yes.sum()]])
    inside, outside = count + 0.5, np.maximum(size - count, 0) + 0.5
    odds = np.log(inside / outside)
    error = np.sqrt((1 / inside + 1 / outside).sum(0))
    often = inside[1] / size[1] >= times * inside[0] / np.maximum(size[0], 1)
    sure = np.where(often & (count[1] >= 3), (odds[1] - odds[0]) / error, 0.0)
    return at[(sure >= least) & (sure >= share * sure.max())]


def _rows_with(rows: list[tuple[np.ndarray, np.ndarray]], yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and how many rows not marked, and marked, hold each."""
    every = np.concatenate([a for a, _ in rows]) if rows else np.empty(0, np.int64)
    named, place = np.unique(every, return_inverse=True)
    marked = np.repeat(yes, [len(a) for a, _ in rows])
    return named, np.stack([np.bincount(place, ~marked, len(named)), np.bincount(place, marked, len(named))])


def shingle_sketch(text: str | None) -> np.ndarray:
    """The ``SKETCH`` least distinct 32-bit hashes of the text's five-word shingles, ascending."""
    words = WORD.findall((text or "").lower().encode("utf-8", "replace").decode())
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    total = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    total ^= total >> np.uint64(31)
    return np.unique((total * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two shingle sets by their sketches, exact where both hold all."""
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b)).mean()) if len(both) else 0.0


def first_of_copies(sketches: list[np.ndarray], labels: np.ndarray, least: float = 0.8) -> np.ndarray:
    """Rows of the sample that aren't near copies (``likeness`` of ``least`` or more) of an
    earlier kept row with the label: a word of many copies of one text is no more telling
    than a word of one text. Kept rows are compared that share one of the eight least hashes."""
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, one in enumerate(sketches):
        keys = [(int(labels[i]), int(h)) for h in one[:8]]
        if any(likeness(one, sketches[j]) >= least for j in {j for k in keys for j in seen.get(k, ())}):
            continue
        out.append(i)
        for k in keys:
            seen.setdefault(k, []).append(i)
    return np.array(out, np.int64)


def graded(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Labels as grades; a two-valued label is split by its telling words (see above)."""
    if labels.max(initial=0) != 1:
        return labels
    toxic = labels == 1
    at, count = _rows_with(rows, toxic)
    n_yes, n_no = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    common = at[(count[1] >= 5) & (count[1] / n_yes > 10 * (count[0] + 0.5) / n_no)]
    hits = np.array([float(np.exp(v[np.isin(a, common)] - 1).sum()) for a, v in rows])
    return np.where(toxic, np.where(hits > np.median(hits[toxic]), 2, 1), 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """Fit on about ``sample`` labelled documents, drawn by a hash of the id; one text of
    each id (the first in order), so that the sample is bounded whatever ids repeat."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    named = named.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = named.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000_000)) / F.lit(1e9)
    share = min(1.0, sample / max(1, total))
    # The same draw on both sides: few texts enter the join.
    rows = documents(docs, id_col, text_col).filter(draw < share).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = rows.join(named.filter(draw < share), "doc_id")

    def make():
        packed = _Packed()

        def step(r: dict) -> dict:
            found = [packed.count(t) for t in r["text"]]
            return {
                "doc_id": r["doc_id"],
                "label": r["label"],
                "at": [a.astype(np.uint32).tobytes() for a, _ in found],
                "value": [v.tobytes() for _, v in found],
                "sketch": [shingle_sketch(t).tobytes() for t in r["text"]],
            }

        return step

    got = sorted(map(tuple, map_rows(rows, make, "doc_id long, label int, at binary, value binary, sketch binary").collect()))
    found = [(np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(v, np.float32)) for _, _, a, v, _ in got]
    named = np.array([g[1] for g in got], np.int64)
    once = first_of_copies([np.frombuffer(g[4], np.uint32) for g in got], named)
    found, named = [found[i] for i in once], named[once]
    return Ordinal.fit(found, graded(found, named))


def predict(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grade, expected_severity (the sum of P(grade >= k)), p_toxic and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.at, model.weights, model.cuts))

    def make():
        one = Ordinal(*shared.value)
        packed = _Packed(one.at)

        def step(rows: dict) -> dict:
            found = [packed.count(t) for t in rows["text"]]
            p = one.at_least(np.array([float(one.weights[a] @ v) for a, v in found]))
            first = p[:, 0] if p.shape[1] else np.zeros(len(p))
            return {"doc_id": rows["doc_id"], "grade": (p >= 0.5).sum(1), "expected_severity": p.sum(1), "p_toxic": first, "toxic": first >= 0.5}

        return step

    return map_rows(documents(docs, id_col, text_col), make, "doc_id long, grade int, expected_severity double, p_toxic double, toxic boolean")
