"""Line dedup by rolling hashes over line hashes.

A text is cut into words (signs of scripts written without spaces are words of their
own) and into lines: at line ends, behind sentences, and inside longer ones behind words
whose hash is the least of some words around, so that a passage is cut alike wherever it
stands, in any script. A hash rolls over the hashes of each two lines that follow each
other. Where such a hash stands elsewhere before, two whole lines are repeated; those
near each other that repeat the same place (smallest doc_id, then line) are one chunk,
whose bounds follow from the repeated content alone, and the chunk's words are compared
with the kept ones, up to ``GROW`` words on to both sides, as a passage may begin or end
inside a line. Of words that are equal in runs of ``RUN`` or more, a stretch of
``PASSAGE`` or more is removed whole; of a shorter one, the lines that lie in it whole, if
they are two or more and have ``MIN_WORDS`` words. What is removed always stands at an
earlier place too. Every rolling hash is looked up, and not only those that would be
bounds of chunks when each document is cut by itself: of passages of some 50 words, half
would hold no whole chunk.

Defined results: a null text stays null, an empty one empty; rows without an id
stay as they are and are nobody's first occurrence; rows that repeat id and text
count as one document; very long texts are read whole; extra columns are ignored by
:func:`dedup` and kept by :func:`apply`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, held_now, hold, map_rows, release, workers_find_us

#: Equal words in a row that count, words compared to each side, and words of a chunk's
#: piece, of which the first and the last two equal lines are compared.
RUN, GROW, SPAN = 8, 36, 64
#: Equal words that go whole; lines and words that a shorter stretch must have.
PASSAGE, MIN_LINES, MIN_WORDS = 40, 2, 8
#: Rolling hashes at one or more in so many places are hot.
HOT_SHARE = 1000
#: Bytes of a line left whole; a longer one is cut behind words of the least hash among as
#: many words on both sides.
LONG_LINE, AROUND = 96, 4
_STOPS, _CLOSERS = np.isin(np.arange(256), list(b".!?")), np.isin(np.arange(256), list(b"\"')]"))
_WIDE, _BLANKS = re.compile(rb"[\xe0-\xff]"), re.compile(rb"[ \t]*")
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.where(_SPACES, 0, np.random.default_rng(11).integers(1, 1 << 63, 256)).astype(np.uint64)
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
#: A word's hash is the sum of its bytes' numbers times powers of ``_ODD`` by place; bytes
#: are gone through in pieces, by powers from a piece's start on and their inverses.
_ODD, _PIECE = 0x9E3779B97F4A7C15, 1 << 16


def _powers(of: int) -> np.ndarray:
    out = np.full(_PIECE, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_starts(data: bytes) -> np.ndarray:
    """Byte places at which words begin."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    space = _SPACES[b]
    begins = ~space
    begins[1:] &= space[:-1]
    if b.max() >= 0xE0:  # signs of scripts without spaces: CJK, Hangul, Thai, Lao and above
        lead = b >= 0xE3
        lead[:-1] |= (b[:-1] == 0xE0) & (b[1:] >= 0xB8) & (b[1:] <= 0xBB)
        begins |= lead
        at = lead.nonzero()[0]
        after = at + np.where(b[at] >= 0xF0, 4, 3)
        after = after[after < len(b)]
        begins[after] |= ~space[after]
    return begins.nonzero()[0]


def word_hashes(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words without the space behind them."""
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        after = int(np.searchsorted(starts, begin + _PIECE, "right"))
        if after < len(starts) or begin + _PIECE < len(b):
            after -= 1  # the last of these words may go on behind the piece
        if after > i:
            end = int(starts[after]) if after < len(starts) else len(b)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(_BYTES[b[begin:end]] * _POWERS[: end - begin], out=sums[1:])
            at = starts[i:after] - begin
            out[i:after] = (sums[np.append(at[1:], end - begin)] - sums[at]) * _INVERSE[at]
            i = after
        else:  # a word longer than a piece
            end = int(starts[i + 1]) if i + 1 < len(starts) else len(b)
            whole = 0
            for at in range(begin, end, _PIECE):
                part = b[at : min(end, at + _PIECE)]
                whole += int((_BYTES[part] * _POWERS[: len(part)]).sum()) * pow(_ODD, at - begin, 1 << 64)
            out[i] = whole % (1 << 64)
            i += 1
    return _mixed(out)


def line_begins(data: bytes, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a line, the first among them."""
    if not len(starts):
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    breaks, stops = np.flatnonzero(b == 10), np.flatnonzero(_STOPS[b])
    after = stops + 1
    while len(after):  # quotes and brackets that a sentence's end is in
        inside = after < len(b)
        stops, after = stops[inside], after[inside]
        closer = _CLOSERS[b[after]]
        if not closer.any():
            break
        after = after + closer
    stops = stops[(b[after] == 32) | (b[after] == 9)]
    at = np.unique(np.concatenate([[0], np.searchsorted(starts, np.concatenate([breaks, stops]), "right")]))
    at = at[at < len(starts)]
    # Words of long lines, which are those whose last word begins far behind the first.
    each = np.diff(np.append(at, len(starts)))
    is_long = starts[at + each - 1] - starts[at] > LONG_LINE
    if not is_long.any():
        return at
    line = np.repeat(np.arange(len(at)), each)
    some = np.flatnonzero(is_long[line])
    line, words = line[some], words[some]
    # Of the least hash among those around, all in the line, the first of equals; the next begins a line.
    least = np.ones(len(some), bool)
    for d in range(1, AROUND + 1):
        here, ahead, same = words[:-d], words[d:], line[d:] == line[:-d]
        least[:d] = least[len(some) - d :] = False
        least[d:] &= same & (ahead < here)
        least[:-d] &= same & (here <= ahead)
    return np.sort(np.concatenate([at, some[least] + 1]))


def layouts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: places and hashes of words, the words that begin lines, the first
    word of each text (and the number of words), and each text's place."""
    data = b"\n".join(texts)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = word_starts(data)
    words = word_hashes(data, starts)
    return starts, words, line_begins(data, starts, words), np.searchsorted(starts, places), places


def layouts_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: byte places of words, and those behind its lines, which together are the text."""
    starts, _, lines, bounds, places = layouts(texts)
    begins = starts[lines]
    first = np.searchsorted(lines, bounds)
    for i, text in enumerate(texts):
        yield starts[bounds[i] : bounds[i + 1]] - places[i], np.append(begins[first[i] + 1 : first[i + 1]] - places[i], len(text))


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, first word of the second, hash) of each two lines that follow each other."""
    _, words, lines, bounds, _ = layouts(texts)
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    place = np.arange(len(words)) - np.repeat(lines, np.diff(np.append(lines, len(words))))
    hashes = np.add.reduceat(_mixed(words + place.astype(np.uint64) * _STEP), lines)
    # Pairs of lines that don't reach into the next text.
    which = np.searchsorted(bounds, lines, "right") - 1
    same = which[1:] == which[:-1]
    rolled = _mixed(hashes[:-1] * _STEP + hashes[1:])[same]
    which, lines = which[1:][same], lines[1:][same]
    return which, lines - bounds[which], rolled.view(np.int64)


def lines_of(data: bytes) -> list[bytes]:
    """A text's lines."""
    ((_, ends),) = layouts_of([data])
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] if data else []


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, at (first word of the second) and h of each two lines that follow each other."""

    def make():
        def step(rows: dict) -> dict:
            which, at, h = anchors_of([(t or "").encode() for t in rows["text"]])
            return {"doc_id": np.array(rows["doc_id"], np.int64)[which], "at": at, "h": h}

        return step

    return map_rows(docs, make, "doc_id long, at long, h long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text without repeated passages, n_removed (lines), removed_chars.

    Rows are one for each row of ``docs``.
    """
    rows = documents(docs, id_col, text_col)
    return _cut(rows.join(_repeats(rows), "doc_id", "left"))


def _repeats(rows: DataFrame) -> DataFrame:
    """(doc_id, hits): places of anchors to compare, with the words of what is kept."""
    mark = held_now()
    hits = _first_places(hold(anchors(rows.filter("doc_id is not null and text is not null")), "anchors"))
    # Of those near each other that repeat the same place, the first and the last reach all between.
    one = hits.select("doc_id", F.col("from.doc_id").alias("kept_id"), F.col("from.at").alias("kept_at"), (F.col("at") - F.col("from.at")).alias("shift"))
    ends = one.groupBy("doc_id", "kept_id", "shift", F.expr(f"kept_at div {SPAN}").alias("span")).agg(F.array_distinct(F.array(F.min("kept_at"), F.max("kept_at"))).alias("ends"))
    hits = hold(ends.select("doc_id", "kept_id", "shift", F.explode("ends").alias("kept_at")), "repeats")
    release(mark, but=1)  # the anchors
    wanted = hits.groupBy("kept_id").agg(F.collect_set("kept_at").alias("ats")).withColumnRenamed("kept_id", "doc_id")
    sources = hold(_contexts(rows.join(wanted, "doc_id")).groupBy("kept_id", "kept_at").agg(F.min(F.struct("first", "words")).alias("s")).select("kept_id", "kept_at", "s.*"), "sources")
    told = hits.join(sources, ["kept_id", "kept_at"]).select("doc_id", F.struct("kept_id", "shift", "first", "words").alias("hit"))
    return told.groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))


def _first_places(found: DataFrame) -> DataFrame:
    """Those that stand elsewhere before, with ``from``: the first place of the same hash.

    Hashes that hold a thousandth of all places (at most a thousand, by counting; told by
    counts of hashed cells first) aren't shuffled: the driver gets their first places.
    """
    here, total = F.struct("doc_id", "at"), found.count()
    often = F.col("n") * HOT_SHARE >= total
    cell = F.pmod("h", F.lit(1 << 16))
    cells = [r["cell"] for r in found.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).filter(often).collect()]
    some = found.filter(cell.isin(cells)).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first"))
    firsts = {r["h"]: r["first"] for r in some.filter(often).collect()}
    is_hot = F.col("h").isin(list(firsts))
    every = found.filter(~is_hot).withColumn("from", F.min(here).over(Window.partitionBy("h")))
    if firsts:
        every = every.unionByName(found.filter(is_hot).withColumn("from", _place_of(firsts, "h")))
    return every.filter(F.col("from") != here)


def _place_of(places: dict[int, Row], key: str) -> Column:
    """The place of a known hash, out of a thousand at most."""
    pairs = [x for k, p in sorted(places.items()) for x in (F.lit(k), F.struct(F.lit(p["doc_id"]).cast("long").alias("doc_id"), F.lit(p["at"]).cast("long").alias("at")))]
    return F.element_at(F.create_map(*pairs), F.col(key))


def _contexts(rows: DataFrame) -> DataFrame:
    """The words of kept occurrences with those beside them, from the ``first`` on."""

    def make():
        def step(r: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("kept_id", "kept_at", "first", "words")}
            for doc_id, text, ats in zip(r["doc_id"], r["text"], r["ats"], strict=True):
                data = (text or "").encode()
                bounds = [*word_starts(data).tolist(), len(data)]
                for at in ats:
                    if at + 1 < len(bounds):
                        low = max(0, at - GROW)
                        out["kept_id"].append(doc_id)
                        out["kept_at"].append(at)
                        out["first"].append(low)
                        out["words"].append(data[bounds[low] : bounds[min(len(bounds) - 1, at + RUN + GROW)]])
            return out

        return step

    return map_rows(rows, make, "kept_id long, kept_at long, first long, words binary")


def _words(data: bytes) -> list[bytes]:
    if data.isascii() or not _WIDE.search(data):
        return data.split()
    at = [*word_starts(data).tolist(), len(data)]
    return [data[a:b].rstrip() for a, b in zip(at, at[1:], strict=False)]


def _runs(at: int, here: list[bytes], other: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, after the last) of the stretches of equal words, from place ``at`` on."""
    if here == other:
        yield at, at + len(here)
        return
    begin = None
    for i, (x, y) in enumerate(zip(here, other, strict=True), at):
        if x == y:
            begin = i if begin is None else begin
        elif begin is not None:
            yield begin, i
            begin = None
    if begin is not None:
        yield begin, at + len(here)


def _union(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch are one; in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1]:
            if high > out[-1][1]:
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def cut_all(texts: list[str | None], hits: list[list[dict] | None]) -> list[tuple[str | None, int]]:
    """Each text without the hits that its words confirm, and the lines removed, whole or in part."""
    some = [i for i, h in enumerate(hits) if h]
    found: list[tuple[str | None, int]] = [(t, 0) for t in texts]
    data = [(texts[i] or "").encode() for i in some]
    for i, own, (starts, ends) in zip(some, data, layouts_of(data), strict=True):
        left = _left(own, starts, ends, hits[i])
        if left is not None:
            found[i] = left
    return found


def _left(data: bytes, starts: np.ndarray, ends: np.ndarray, hits: list[dict]) -> tuple[str, int] | None:
    own, equal = _words(data), {}
    for hit in hits:
        other, at = _words(hit["words"]), hit["first"] + hit["shift"]
        skip = max(0, -at)
        other, at = other[skip : max(0, len(own) - at)], at + skip
        equal.setdefault((hit["kept_id"], hit["shift"]), []).extend(_runs(at, own[at : at + len(other)], other))
    again = _union([x for runs in equal.values() for x in _union(runs) if x[1] - x[0] >= RUN])
    if not again:
        return None
    bounds, lines, gone = [*starts.tolist(), len(data)], [0, *ends.tolist()], []
    for low, high in again:
        begin, end = bounds[low] if low else 0, bounds[high]
        if high - low >= PASSAGE:
            # A line's end behind a passage stays, unless the passage began the line.
            end = _BLANKS.match(data, bounds[high - 1] + len(own[high - 1]), end).end()
            if data[end : end + 1] == b"\n" and (not begin or data[begin - 1 : begin] == b"\n"):
                end += 1
        else:
            i, j = bisect_left(lines, begin), bisect_right(lines, end) - 1
            if j - i < MIN_LINES:
                continue
            begin, end = lines[i], lines[j]
            if bisect_left(bounds, end, 0, len(own)) - bisect_left(bounds, begin, 0, len(own)) < MIN_WORDS:
                continue
        gone.append((begin, end))
    kept, at, n, last = [], 0, 0, 0
    for begin, end in gone:
        kept.append(data[at:begin])
        first, after = bisect_right(lines, begin) - 1, bisect_left(lines, end)
        n, last, at = n + after - max(first, last), after, end
    return b"".join([*kept, data[at:]]).decode(), n


def _cut(rows: DataFrame) -> DataFrame:
    def make():
        def step(r: dict) -> dict:
            found = cut_all(r["text"], r["hits"])
            return {
                "doc_id": r["doc_id"],
                "text": [f[0] for f in found],
                "n_removed": [f[1] for f in found],
                "removed_chars": [len(t or "") - len(f[0] or "") for t, f in zip(r["text"], found, strict=True)],
            }

        return step

    return map_rows(rows, make, "doc_id long, text string, n_removed long, removed_chars long")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with their new texts; those of which nothing is left go. Other
    columns pass through, beside the text, in the one shuffle; ``chars_col`` is set."""
    names = docs.columns
    told = _repeats(documents(docs, id_col, text_col)).select(F.col("doc_id").alias("__told"), F.col("hits").alias("__hits"))
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    if chars_col in names:
        docs = docs.withColumn(chars_col, F.col(f"`{chars_col}`").cast("long"))
    rows = docs.join(told, docs[id_col].cast("long") == F.col("__told"), "left").drop("__told")
    workers_find_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: names.index(c) for c in (text_col, chars_col) if c in names}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = cut_all(part.column(at[text_col]).to_pylist(), part.column(len(names)).to_pylist())
                columns = list(part.columns[: len(names)])
                columns[at[text_col]] = pa.array([t for t, _ in done], pa.string())
                if chars_col in at:
                    columns[at[chars_col]] = pa.array([None if t is None else len(t) for t, _ in done], pa.int64())
                keep = pa.array([not n or bool((t or "").strip()) for t, n in done], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return rows.mapInArrow(run, docs.schema)
