"""How far the sources of each language are from each other, and the terms that set them apart.

A text's terms are its runs of letters (A-Z in lower case, and all signs beyond ASCII). Of
each language the terms of enough documents are kept. A group is a source of a language;
its share of a term is ``1 + floor(SCALE * (count + PRIOR) / (all + PRIOR * terms))``, in
integers. Two groups differ by the sum of their shares' differences over all kept terms.

The kept terms of a language are dealt to blocks, and its groups to teams. A station is a
block's team: its groups' counts stay in one partition, and compressed vectors of the
other teams circulate: by a round-robin tournament each two teams meet once, one of them
at home. Its task goes round by round, unpacks a visiting team, and gives what each two
groups differ by over the block, in both directions; the blocks' sums are added up. As a
group's vector is made, a heap keeps its block's terms that stand out most from the
language. Vectors are as long as a block has terms of the group, so no task holds a
vocabulary, and a hot source's rows are counted in all tasks before they are shuffled.

Defined results: null text, language and source count as empty; a text without terms counts
for its group only; groups without kept terms are told apart by their shares of no
occurrence; a language without kept terms gives pairs of value 0 and no terms; a source that
is alone in its language has no pairs; ties are in order of UTF-8; repeated rows count each;
very long texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import held_now, hold, map_rows, release, to_arrow, workers_find_us

LEAST_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Groups for which there is one more team, and the most teams (even).
TEAM_GROUPS, TEAMS = 8, 16
#: Counts that a block has for each group of the language, on average, and at most in all.
GROUP_CELLS, BLOCK_CELLS = 512, 500_000
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 400_000
#: Bytes of terms as they are, A-Z in lower case; all others are spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def shares(counts: np.ndarray, in_all: int, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (counts + PRIOR) / (in_all + PRIOR * terms))``, by long division in
    steps of a thousand: exact while the divisor is under 9 * 10^15."""
    of = np.int64(in_all + PRIOR * terms)
    out, rest = np.divmod(counts.astype(np.int64) + PRIOR, of)
    for _ in range(3):  # SCALE is 1000 ** 3
        digit, rest = np.divmod(rest * 1000, of)
        out = out * 1000 + digit
    return out + 1


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), summed up in each task; a null term counts the documents."""
    spark = docs.sparkSession
    workers_find_us(spark)
    schema = "lang string, source string, term string, n long, docs long"
    target = to_arrow(spark, schema)

    def told(found: dict[tuple[str, str], list]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (rows, n, seen) in found.items():
            terms = [None, *(t.decode() for t in n)]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [rows, *map(seen.__getitem__, n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], list] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for text, lang, source in zip(part["text"], part["lang"], part["source"], strict=True):
                    group = found.get((lang, source))
                    if group is None:
                        group = found[lang, source] = [0, Counter(), Counter()]
                    rows, n, seen = group
                    before, words = len(n), terms_of(text)
                    n.update(words)
                    seen.update(set(words))
                    group[0] = rows + 1
                    held += len(n) - before
                if held > HELD_COUNTS:
                    yield from told(found)
                    found, held = {}, 0
        yield from told(found)

    return docs.mapInArrow(run, schema)


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids and their counts, compressed."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n)


class Team:
    """Unpacked vectors of a block's team: the terms that its groups have, with their
    shares, group after group, and each group's share of a term it hasn't."""

    def __init__(self, rows: dict[str, list]):
        self.sources = rows["source"]
        ids, found = [], []
        for packed, n, v in zip(rows["packed"], rows["in_all"], rows["terms"], strict=True):
            at, counts = unpack(packed)
            ids.append(at)
            found.append(shares(counts, int(n), int(v)) if v else counts)
        self.none = np.array([shares(np.zeros(1, np.int64), int(n), int(v))[0] if v else 0 for n, v in zip(rows["in_all"], rows["terms"], strict=True)], np.int64)
        self.sizes = np.array(list(map(len, ids)), np.int64)
        self.ends = np.cumsum(self.sizes)
        self.ids = np.concatenate([np.zeros(0, np.int64), *ids])
        self.shares = np.concatenate([np.zeros(0, np.int64), *found])
        self.own_none = np.repeat(self.none, self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each group's stretch."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.ends] - total[self.ends - self.sizes]

    def meet(self, home: Team, i: int, size: int) -> np.ndarray:
        """What home's group ``i`` and each group here differ by over the block's ``size`` terms."""
        part = slice(home.ends[i] - home.sizes[i], home.ends[i])
        dense, has = np.full(size, home.none[i]), np.zeros(size, bool)
        dense[home.ids[part]] = home.shares[part]
        has[home.ids[part]] = True
        theirs, both = dense[self.ids], has[self.ids]
        total = self.sums(np.abs(theirs - self.shares))  # terms that they have
        total += np.abs(home.shares[part][:, None] - self.none[None, :]).sum(axis=0) - self.sums(np.where(both, np.abs(theirs - self.own_none), 0))  # that only home has
        neither = size - home.sizes[i] - self.sizes + self.sums(both.astype(np.int64))
        return total + neither * np.abs(home.none[i] - self.none)


def _play(home: pa.Table, visitors: pa.Table) -> pa.Table:
    """A station's meetings, round by round; its own groups meet each other first."""
    out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
    if home.num_rows:
        rows = home.to_pydict()
        here, lang, size = Team(rows), rows["lang"][0], rows["size"][0]
        for round_ in [-1, *sorted(pc.unique(visitors["round"]).to_pylist())]:
            away = here if round_ < 0 else Team(visitors.filter(pc.equal(visitors["round"], round_)).to_pydict())
            for i, source in enumerate(here.sources):
                values, first = away.meet(here, i, size), i + 1 if round_ < 0 else 0
                others = away.sources[first:]
                out["source"] += [source] * len(others) + others
                out["item"] += others + [source] * len(others)
                out["value"] += values[first:].tolist() * 2
        out["lang"] = [lang] * len(out["value"])
    return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()})


def opponents(team: Column, teams: Column) -> Column:
    """Opponent of each round, by the circle method: team numbers of all rounds, an array.
    In round r teams i and (r - i) modulo (teams - 1) meet, and the one that would meet
    itself meets the last team."""
    circle = F.greatest(teams - 1, F.lit(1))
    met = lambda r: F.pmod(r - team, circle)
    mine = lambda r: F.when(team == circle, F.pmod(r * F.shiftright(circle + 1, 1), circle)).when(met(r) == team, circle).otherwise(met(r))
    return F.when(teams > 1, F.transform(F.sequence(F.lit(0).cast("long"), circle - 1), mine)).otherwise(F.array().cast("array<bigint>"))


def _vectors(cells: DataFrame) -> DataFrame:
    """Packed vector, and the terms that stand out most, of each group's part of a block."""

    def make():
        def step(r: dict) -> dict:
            out: dict[str, list] = {c: r[c] for c in _VECTOR}
            out["packed"], out["top"] = [], []
            for cells_, n, v, n_lang in zip(r["cells"], r["in_all"], r["terms"], r["in_lang"], strict=True):
                cells_ = sorted(cells_ or [], key=lambda c: c["id"])
                counts = np.array([c["n"] for c in cells_], np.int64)
                out["packed"].append(pack(np.array([c["id"] for c in cells_], np.int64), counts))
                best: list = []
                if cells_:
                    more = shares(counts, n, v) - shares(np.array([c["total"] for c in cells_], np.int64), n_lang, v)
                    best = heapq.nsmallest(TOP, ((-int(more[i]), cells_[i]["term"].encode()) for i in np.flatnonzero(more > 0)))
                out["top"].append([{"item": t.decode(), "value": -f} for f, t in best])
            return out

        return step

    schema = ", ".join(f"{c} {kind}" for c, kind in _VECTOR.items()) + ", packed binary, top array<struct<item string, value long>>"
    return map_rows(cells.select(*_VECTOR, "in_lang", "cells"), make, schema, 16)


_VECTOR = {"lang": "string", "source": "string", "block": "long", "size": "long", "team": "long", "teams": "long", "in_all": "long", "terms": "long"}


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP, group_cells: int = GROUP_CELLS, team_groups: int = TEAM_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): of part ``pair`` all other sources of the
    language by what they differ, of part ``term`` the ``top`` (at most 50) terms whose share is above
    the language's, by how far."""
    mark = held_now()
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for a, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    cells = hold(count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("cells"))
    kept = hold(kept.filter(F.col("docs") >= least).drop("docs"), "kept")
    groups = cells.filter("term is null").select("lang", "source")
    # A row for each language: its blocks and teams follow from its sizes.
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("in_lang"), F.sum("cells").alias("cells"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(sizes, "lang", "left").fillna(0, ["terms", "in_lang", "cells"])
    a_block = F.least(F.col("groups") * group_cells, F.lit(BLOCK_CELLS))
    pairs_of_teams = F.ceil(F.least(F.col("groups") / team_groups, F.lit(TEAMS)) / 2)
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("cells") / a_block))).withColumn("teams", F.when(F.col("groups") <= team_groups, F.lit(1)).otherwise(2 * pairs_of_teams).cast("long"))
    langs = hold(langs.drop("cells"), "languages")
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    numbered = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "term", "total", block.alias("block"))
    numbered = hold(numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "terms")
    told = hold(cells.join(numbered, ["lang", "term"]).select("lang", "source", "block", "id", "n", "total", "term"), "cells")
    lists = told.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("id", "n", "total", "term")).alias("cells"), F.sum("n").alias("some"))
    lists = hold(lists, "lists")
    # Each group is in each block of its language, with or without terms there.
    in_all = lists.groupBy("lang", "source").agg(F.sum("some").alias("in_all"))
    in_block = numbered.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("size"))
    team = F.pmod(F.xxhash64("source"), F.col("teams"))
    every = groups.join(in_all, ["lang", "source"], "left").join(langs, "lang").withColumn("team", team).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = every.join(in_block, ["lang", "block"], "left").join(lists.drop("some"), ["lang", "source", "block"], "left").fillna(0, ["in_all", "size"])
    vectors = hold(_vectors(every), "vectors")
    release(mark, but=1)
    home = vectors.select("lang", "block", "team", "source", "size", "in_all", "terms", "packed")
    met = vectors.select("lang", "block", "team", "source", "in_all", "terms", "packed", F.posexplode(opponents(F.col("team"), F.col("teams"))).alias("round", "station"))
    # Of two teams the lower is at home if their numbers' sum is even.
    away = (F.col("team") < F.col("station")) != ((F.col("team") + F.col("station")) % 2 == 0)
    met = met.filter(away).select("lang", "block", "station", "source", "in_all", "terms", "packed", "round")
    workers_find_us(docs.sparkSession)
    met = home.groupBy("lang", "block", "team").cogroup(met.groupBy("lang", "block", "station")).applyInArrow(_play, "lang string, source string, item string, value long")
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = vectors.select("lang", "source", F.inline("top"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    ranked = [found.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")) for part, found in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
