"""The divergence audit against plain sums over all pairs and terms, and against the SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from leafmark.llm import divergence, queries
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=30, top=50):
    counts, groups, seen = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        counts[lang].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def share(of, kept=kept):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, whole = share(counts[lang, source]), share(counts[lang])
        parts = {"pair": [], "term": [(own[t] - whole[t], t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]}
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = share(counts[lang, other])
            parts["pair"].append((sum(abs(own[t] - theirs[t]) for t in kept), other))
        for part, found in parts.items():
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_query_against_plain_sums_and_sql(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()))
    got = sorted(map(tuple, queries.op13_source_divergence(spark, SF).select(*COLUMNS).collect()))
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_source_divergence"])
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM want").fetchall())


def test_many_teams_and_blocks(spark):
    """33 sources of one language, one with a third of all rows, in teams of two and blocks
    of a few counts; sources without kept terms; a language without any; ties; null, empty
    and long texts; columns whose names clash."""
    rng = random.Random(5)
    words = [*(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)), "É", "漢字", "The", "THE"]
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 33}é" if i % 2 else f"S{i % 31}"
        text = None if i % 97 == 0 else "" if i % 89 == 0 else " ".join(rng.choice(words[: 20 + i % 184]) + rng.choice(["", ".", " 12 ", "'s", "_x"]) for _ in range(30))
        rows.append((text, "xx", source))
    rows += [("rare word", "yy", f"y{i}") for i in range(3)] + [("alone " * 40_000, "zz", "only")] * 12 + [("and", None, None), ("and", "", "b"), (None, None, "c")]
    rows += [("nothing kept here qqq", "xx", "odd"), ("", "xx", "empty"), ("12 34", "xx", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).selectExpr("*", "1 as item", "2 as block", "'z' as team", "3 as n")
    for group_cells, team_groups in ((4, 2), (10_000, 40), (20, 1)):
        got = divergence.audit(docs, least=10, group_cells=group_cells, team_groups=team_groups)
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain(rows, least=10)


def test_shares_are_exact():
    rng = random.Random(6)
    for _ in range(500):
        n, terms = rng.randint(0, 10 ** rng.randint(1, 15)), rng.randint(1, 10 ** rng.randint(1, 9))
        counts = [rng.randint(0, n) for _ in range(20)] + [0, n]
        assert divergence.shares(np.array(counts), n, terms).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * terms) for c in counts]


@pytest.mark.parametrize("teams", [1, 2, 4, 6, 16])
def test_each_two_teams_meet_once(spark, teams):
    from pyspark.sql import functions as F

    met = [(r["id"], *x) for r in spark.range(teams).select("id", divergence.opponents(F.col("id"), F.lit(teams).cast("long")).alias("o")).collect() for x in enumerate(r["o"])]
    assert all((o, r, i) in set(met) for i, r, o in met)
    assert sorted((i, o) for i, _, o in met if i < o) == [(i, o) for i in range(teams) for o in range(i + 1, teams)]
    assert len(met) == teams * (teams - 1) and all(i != o for i, _, o in met)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).collect() == []
