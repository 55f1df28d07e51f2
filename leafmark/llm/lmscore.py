"""Language-model scores: a corpus unigram base and a causal self-attention model.

Words (A-Z lower-cased) and one end of text are the tokens of both scores. The model
reads and predicts all subword ids of each word (of the word with a space before it,
merged in one piece by a public vocabulary), each id once, by the probability of its
class in context times its share of the class in the whole training corpus. Ids that
begin a word have classes of their own, so the model tells where words end.

A word's probability is a mixture of two, both given that a word begins. One is that of
its leading class in context times the word's share of that class by counts (a word that
training never saw has the base's probability). The other, of weight ``SPELT``, is the
product of the probabilities of all its ids, up to where the next word begins. The first
sums to one as the base does, the second over all words. The end has one id and no other
spelling.

Everything is learned from every training document (crc32 of the id modulo 7 is not
2): the words' counts, the counts of classes after inputs, and the attention's
parameters, by gradients over all blocks. Each task learns from its documents, and
the tasks' parameters are averaged by the tokens they saw. How rows lie in partitions
has a small effect on the score.

Words with at least a millionth of all tokens (at most a million, by counting) are
broadcast, those of more than 64 bytes by a digest of 128 bits; each occurrence of other words
is joined to the count table with its two probabilities.

Defined results: a null or empty text is one end; very long texts are read whole; with
no training rows N and V are 0, every token is unknown and all scores are 0; a null
doc_id counts as training; rows that repeat id and text have equal scores, once for
each row; classes of equal counts go in the order of their ids; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import attention
from leafmark.llm.common import crc_mod, documents, hold, map_rows, to_arrow, workers_find_us

HOT_SHARE = 1_000_000
#: Words whose ids, or whose counts, a task keeps at a time.
CACHED_WORDS, COUNTED_WORDS = 1_000_000, 400_000
LONG_WORD = 64
#: Bits of a word's code below its place among the broadcast words.
ID_BITS = 40
#: Weight of the word as its ids spell it; the rest is that of its count.
SPELT = 0.05
#: What stands for the documents themselves in the count table; no word is empty.
ROWS = ""


def words_of(text: str | None) -> list[bytes]:
    """Words between the bytes 09 to 0D and 20, which are just the white space of bytes."""
    return (text or "").encode().lower().split()


def long_key(word: bytes) -> bytes:
    """What stands for a long word in a broadcast; no word begins with a space."""
    return b" " + hashlib.md5(word, usedforsecurity=False).hexdigest().encode()


class WordIds(dict):
    """All subword ids of each word, as if a space stood before it, and the word's place
    (from 1) among ``hot`` words (long ones given by :func:`long_key`). A word's code is
    its place above the slot of its ids. Other words are forgotten in time."""

    def __init__(self, encode, hot: list[bytes] = ()):
        self.encode, self.hot, self.long = encode, {}, {}
        self.ids, self.starts = array("i", [0]), array("q", [1])
        for i, w in enumerate(hot, 1):
            if w.startswith(b" "):
                self.long[w] = i
            else:
                self.hot[w] = (i << ID_BITS) + self.keep(w)
        self.kept, self.most = len(self.starts), CACHED_WORDS + len(self.hot)
        self.update(self.hot)

    def keep(self, word: bytes) -> int:
        self.ids.extend(self.encode(b" " + word))
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def forget(self) -> None:
        self.clear()
        self.update(self.hot)
        del self.starts[self.kept :]
        del self.ids[self.starts[-1] :]

    def __missing__(self, word: bytes) -> int:
        found = self.keep(word)
        if len(word) > LONG_WORD and self.long:
            found += self.long.get(long_key(word), 0) << ID_BITS
        self[word] = found
        return found

    def of(self, words: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each word's place; all ids of all words, and the end; how many of them a word has)."""
        if len(self) >= self.most or len(self.ids) >= 8 * self.most:  # never amid a text
            self.forget()
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        slot, starts = code & ((1 << ID_BITS) - 1), np.frombuffer(self.starts, np.int64)
        begin = starts[slot]
        sizes = starts[slot + 1] - begin
        where = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return code >> ID_BITS, np.append(np.frombuffer(self.ids, np.int32)[where], np.int32(end)), sizes


_ENCODERS: dict[str, tiktoken.Encoding] = {}


def _encoder(key: str, ranks: bytes):
    """What a worker keeps from task to task; the ids are those of the public rank file."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]._encode_single_piece


def _rank_file(path: str) -> tuple[str, bytes, np.ndarray]:
    """The file's key and bytes, and which ids begin a word; after the last one, the end of a text."""
    with open(path, "rb") as f:
        ranks = f.read()
    rows = [line.split() for line in ranks.splitlines()]
    leads = np.ones(len(rows) + 1, bool)
    leads[[int(at) for _, at in rows]] = [base64.b64decode(t).startswith(b" ") for t, _ in rows]
    return hashlib.sha256(ranks).hexdigest(), ranks, leads


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``training``, whose number has the empty word; counted
    in each task before the shuffle."""
    schema = "word string, n long"
    workers_find_us(training.sparkSession)
    target = to_arrow(training.sparkSession, schema)

    def flush(counts: Counter) -> pa.RecordBatch:
        words, n = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) >= COUNTED_WORDS:
                    yield flush(counts)
            counts[ROWS.encode()] += batch.num_rows
        if counts:
            yield flush(counts)

    return training.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(counts: DataFrame, vocabulary, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each id in the whole training corpus: occurrences, and the distinct words that it leads."""

    def make():
        encode = _encoder(*vocabulary.value)

        def step(rows: dict) -> dict:
            ids = [encode(b" " + w.encode()) for w in rows["word"]]
            sizes = np.array([len(i) for i in ids], np.int64)
            flat = np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
            n = np.bincount(flat, np.repeat(np.array(rows["n"], np.float64), sizes), size)
            words = np.bincount(np.array([i[0] for i in ids], np.int64), minlength=size)
            at = np.flatnonzero(n)
            return {"id": at, "n": n[at].astype(np.int64), "words": words[at]}

        return step

    summed = map_rows(counts, make, "id long, n long, words long", 8192).groupBy("id").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    n, words = np.zeros(size), np.zeros(size)
    for row in summed.collect():  # at most one row for each id of the vocabulary
        n[row["id"]], words[row["id"]] = row["n"], row["words"]
    return n, words


class Classes:
    """Frequent ids are classes of their own; the rest share classes of even mass. Ids that
    begin a word (``leads``, where given) and others share no group.

    ``mass`` is what the base gives a leading id's words, but for the base's denominator:
    their occurrences and one for each; of other ids their occurrences and one. A class's
    ``share`` is its part of all mass, ``begins`` that of all leading ids.
    """

    def __init__(self, mass: np.ndarray, leads: np.ndarray | None = None):
        n, whole = attention.CLASSES, max(mass.sum(), 1)
        self.of = np.zeros(len(mass), np.int32)
        if leads is None:
            self.deal(mass, np.arange(len(mass)), 0, attention.GROUPS)
        else:
            self.deal(mass, np.flatnonzero(leads), 0, attention.STARTS)
            self.deal(mass, np.flatnonzero(~leads), attention.STARTS, attention.GROUPS)
        self.share = np.bincount(self.of, mass, n) / whole
        self.log_share = np.log(np.maximum(self.share, 1e-30))
        self.log_mass = np.log10(np.maximum(mass / whole, 1e-30))
        self.begins = math.log10(max(self.share[: attention.STARTS * attention.MEMBERS].sum(), 1e-30))
        order = np.argsort(-mass, kind="stable")
        self.input = np.zeros(len(mass), np.int32)
        named = attention.INPUTS * 3 // 4
        self.input[order[:named]] = np.arange(min(named, len(mass)))
        self.input[order[named:]] = named + order[named:] % (attention.INPUTS - named)

    def deal(self, mass: np.ndarray, ids: np.ndarray, low: int, high: int) -> None:
        """Deal ``ids`` to the classes of the groups from ``low`` to ``high``."""
        groups = high - low
        n = groups * attention.MEMBERS
        alone = n * 3 // 4
        order = ids[np.argsort(-mass[ids], kind="stable")]
        # Classes of a group lie apart in frequency, so that groups are of like size.
        place = (low + np.arange(n) % groups) * attention.MEMBERS + np.arange(n) // groups
        self.of[order[:alone]] = place[: min(alone, len(ids))]
        rest = mass[order[alone:]] + 1e-9
        middle = np.cumsum(rest) - rest / 2
        self.of[order[alone:]] = place[alone + np.minimum((middle / max(rest.sum(), 1e-9) * (n - alone)).astype(np.int32), n - alone - 1)]


def context_gains(model: attention.Attention, classes: Classes, texts: list[np.ndarray], at_once: int = 512, begins: bool = False):
    """For each id of each text, log10 of what context makes of its class's share; with
    ``begins`` also log10 of the probability that a word begins there."""
    ids, owner, first = attention.blocks(texts)
    known = np.maximum(ids, 0)
    now, of = attention.shifted(classes.input[known], first), classes.of[known]
    found, start = np.empty(ids.shape, np.float64), np.empty(ids.shape, np.float64)
    for at in range(0, len(ids), at_once):
        part = slice(at, at + at_once)
        found[part], start[part] = model.log_shares(now[at : at + at_once + 1], first[part], of[part])
        found[part] -= classes.log_share[of[part]]
    starts = np.searchsorted(owner, np.arange(len(texts))) * attention.BLOCK
    cut = [[v[a : a + len(t)] for a, t in zip(starts.tolist(), texts, strict=True)] for v in (found.reshape(-1) / math.log(10), start.reshape(-1) / math.log(10))]
    return cut if begins else cut[0]


def spelt_words(classes: Classes, ids: np.ndarray, sizes: np.ndarray, gain: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of (what context makes of each word's leading class, and of the end's; each word's
    probability as the product of its ids', up to where the next word begins)."""
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    begin = start[first]
    each = np.concatenate([[0.0], np.cumsum(gain + classes.log_mass[ids])])
    return gain[first] - (begin - classes.begins), each[first[1:]] - each[first[:-1]] - begin[:-1] + begin[1:]


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    rows = documents(docs, id_col, text_col).withColumn("held_out", held)
    training = rows.filter(~held)
    key, ranks, leads = _rank_file(path)
    vocabulary, size, end = spark.sparkContext.broadcast((key, ranks)), len(leads), len(leads) - 1

    counts = hold(word_counts(training), "words")
    is_rows = F.col("word") == ROWS
    totals = counts.agg(F.count_if(~is_rows).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(is_rows, F.col("n"))), F.lit(0)).alias("rows")).first()
    n_docs, n_all = totals["rows"], totals["n"]  # each document has one end
    counts = counts.filter(~is_rows)
    below = n_all + totals["v"] + (n_docs > 0) + 1
    # Words with at least a millionth of the tokens: there can't be more than a million.
    named = F.when(F.octet_length("word") > LONG_WORD, F.concat(F.lit(" "), F.md5(F.col("word").cast("binary")))).otherwise(F.col("word"))
    hot = counts.filter(F.col("n") * HOT_SHARE >= n_all).select(named.alias("word"), "n").toPandas()
    hot_counts = spark.sparkContext.broadcast((hot["word"].tolist(), hot["n"].to_numpy(np.int64)))
    n, words = id_counts(counts, vocabulary, size)
    n[end], words[end] = n_docs, n_docs > 0
    mass = n + np.where(leads, words, 1)
    spelt_weight = SPELT if n_all else 0.0
    model, pairs = _learn(training, vocabulary, mass, leads)
    fitted = spark.sparkContext.broadcast((model, pairs, mass, leads))
    schema = "doc_id long, held_out boolean, h1 long, h2 long, word string, n long, gain double, spelt double, doc_rows long, n_tokens long, known long, base double, score double"
    workers_find_us(spark)
    target = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs, mass, leads = fitted.value
        classes = Classes(mass, leads)
        model = attention.Attention(model, attention.tables(pairs, classes.share))
        ids = WordIds(_encoder(*vocabulary.value), [w.encode() for w in hot_counts.value[0]])
        log_of = np.log10(np.concatenate([[below], hot_counts.value[1] + 1]) / below)  # 0 for other words
        end_base, end_known = math.log10((n_docs + 1) / below), n_docs > 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                cut = [words_of(t) for t in part["text"]]
                places, pieces, sizes = zip(*(ids.of(w, end) for w in cut), strict=True)
                gains = context_gains(model, classes, pieces, begins=True)
                doc, others, owner, moves, spellings = [], [], [], [], []
                for i, (words, place, *told) in enumerate(zip(cut, places, pieces, sizes, *gains, strict=True)):
                    gain, spelt = spelt_words(classes, *told)
                    is_hot = place > 0
                    log = log_of[place[is_hot]]
                    base = float(log.sum()) + end_base
                    mixed = np.log10((1 - spelt_weight) * 10 ** (log + gain[:-1][is_hot]) + spelt_weight * 10 ** spelt[is_hot])
                    # The end has no spelling but itself.
                    scored = float(mixed.sum()) + end_base + (float(gain[-1]) if end_known else 0.0)
                    where = np.flatnonzero(~is_hot)
                    others += [words[w] for w in where.tolist()]
                    owner.append(np.full(len(where), i))
                    moves.append(gain[where])
                    spellings.append(spelt[where])
                    digest = xxhash.xxh128_digest((part["text"][i] or "").encode())
                    h1, h2 = np.frombuffer(digest, "<i8").tolist()
                    doc.append((part["doc_id"][i], part["held_out"][i], h1, h2, 1, len(words) + 1, int(is_hot.sum()) + int(end_known), base, scored))
                yield _flat(doc, others, np.concatenate(owner), [np.concatenate(moves), np.concatenate(spellings)], target)

    scored = rows.mapInArrow(run, schema)
    joined = scored.join(counts.withColumnRenamed("n", "c"), "word", "left")
    share = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(below))
    moved = share * F.when(F.col("c") > 0, F.pow(F.lit(10.0), F.col("gain"))).otherwise(1.0)
    mixed = F.log10(F.lit(1 - spelt_weight) * moved + F.lit(spelt_weight) * F.pow(F.lit(10.0), F.col("spelt")))
    summed = joined.groupBy("doc_id", "held_out", "h1", "h2").agg(
        F.sum("doc_rows").alias("times"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(F.col("n") > 0, F.log10(share)).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(F.col("n") > 0, mixed).otherwise(0.0)).alias("score"),
    )
    once = lambda c: (F.col(c) / F.col("times")).alias(c)
    return summed.select(
        "doc_id",
        "held_out",
        F.expr("n_tokens div times").alias("n_tokens"),
        F.expr("n_known div times").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        once("base_score"),
        once("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("row"),
    ).drop("row")


def _flat(doc: list[tuple], words: list[bytes], owner: np.ndarray, told: list[np.ndarray], target: pa.Schema) -> pa.RecordBatch:
    """A row for each document with its figures, and one for each occurrence of its rare words
    with gain and spelling (``told``; ``owner`` is its document)."""
    fields, n = list(zip(*doc, strict=True)), len(words)
    which = pa.array(np.concatenate([np.arange(len(doc)), owner]))
    # A word can't begin with a space, so the documents' rows meet no count; each has its own key.
    named = pa.array([b" %d" % h for h in fields[2]] + words, pa.binary())
    arrays = [pa.array(fields[i], target.field(i).type).take(which) for i in range(4)]
    arrays.append(named.cast(pa.string()))
    arrays.append(pa.array(np.repeat([0, 1], [len(doc), n])))
    arrays += [pa.array(np.concatenate([np.zeros(len(doc)), v])) for v in told]
    for field, kind in zip(fields[4:], (np.int64, np.int64, np.int64, np.float64, np.float64), strict=True):
        arrays.append(pa.array(np.concatenate([np.array(field, kind), np.zeros(n, kind)])))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def _learn(training: DataFrame, vocabulary, mass: np.ndarray, leads: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The attention's parameters, the mean of what the tasks learn from all blocks of all
    training documents, and how often each class followed each input."""
    schema = "place int, value double"
    target, shared = to_arrow(training.sparkSession, schema), training.sparkSession.sparkContext.broadcast((mass, leads))
    begin, end = attention.fresh(), len(leads) - 1
    names, cells = sorted(begin), (attention.INPUTS + 1) * attention.CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, classes = WordIds(_encoder(*vocabulary.value)), Classes(*shared.value)
        learner = attention.Learner(begin, classes.share)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = [ids.of(words_of(t.as_py()), end)[1] for t in batch.column(0).slice(at, 64)]
                blocks, _, first = attention.blocks(texts)
                known = np.maximum(blocks, 0)
                learner.learn(classes.input[known], np.where(blocks >= 0, classes.of[known], -1), first)
        if learner.seen:
            # Counts are summed; parameters are weighed by the tokens seen, which come last.
            some = learner.pairs.nonzero()[0]
            flat = np.concatenate([*(learner.p[k].reshape(-1) for k in names), [1.0]]).astype(np.float64) * learner.seen
            places = np.concatenate([some, cells + np.arange(len(flat))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.concatenate([learner.pairs[some], flat]))], schema=target)

    summed = training.select("text").mapInArrow(run, schema).groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    every = np.zeros(cells + sum(v.size for v in begin.values()) + 1)
    every[summed["place"].to_numpy(np.int64)] = summed["value"].to_numpy()
    pairs, flat, at, out = every[:cells], every[cells:], 0, {}
    if not flat[-1]:
        return begin, pairs
    for k in names:
        v = begin[k]
        out[k] = (flat[at : at + v.size] / flat[-1]).astype(np.float32).reshape(v.shape)
        at += v.size
    return out, pairs
