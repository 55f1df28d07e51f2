"""Operators against plain Python over the smallest tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from leafmark.llm import attention, bpe, fingerprint, graph, langid, licenses, linededup, lmscore, neardup, packing, queries, toxicity
from leafmark.llm.common import hold
from tests.conftest import SF

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def low(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_quality_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op1_quality_rules(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op1_quality_rules"])
    order = sorted(got.columns)
    assert sorted(map(tuple, got.select(order).collect())) == sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(order)} FROM want").fetchall())


def test_quality_repeats_of_long_texts(spark):
    """Past 32767 words another sort is used; both must count alike."""
    from leafmark.llm import quality

    rng = random.Random(3)
    words = [f"w{rng.randint(0, 60)}" for _ in range(34_000)]
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - 2):
        if counts[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = True
    row = quality.judge(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == hit.sum()


def test_quality_repeats_whatever_hashes_collide(spark, monkeypatch):
    """With one hash for very many windows, words alone decide."""
    from leafmark.llm import quality

    monkeypatch.setattr(quality, "_window_hash", lambda w, i: F.length(F.get(w, i)).cast("long"))
    rng = random.Random(8)
    words = [f"{rng.randint(0, 9)}" for _ in range(400)]
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - 2):
        if counts[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = True
    row = quality.judge(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == hit.sum()


def test_bpe_equals_the_library(docs, texts, reference):
    rows = {r["doc_id"]: r for r in bpe.encode(docs, PATH, PATTERN, ("ids", "ids_sha256", "decoded_sha256")).collect()}
    for key, text in texts.items():
        ids = reference.encode_ordinary(text or "")
        assert rows[key]["ids"] == ids and rows[key]["n_tokens"] == len(ids)
        assert rows[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_round_trip(docs, texts):
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {k: v or "" for k, v in texts.items()}


def test_bpe_appends_and_edits(reference):
    encoder, _, _ = bpe.worker_state(*bpe.vocabulary(PATH), PATTERN)
    rng = random.Random(5)
    for _ in range(300):
        piece = bpe.Piece(encoder, bytes(rng.choice(b"ther aning.\xc3\xa9") for _ in range(rng.randint(0, 300))))
        a = rng.randint(0, len(piece.data))
        piece.replace(a, rng.randint(a, len(piece.data)), bytes(rng.choice(b"thr a") for _ in range(rng.randint(0, 9))))
        piece.append(b"then")
        assert piece.ids == reference._encode_single_piece(piece.data)


def test_license_base_and_labels(docs, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.scan(docs).collect():
        words = word.findall(low(texts[r["doc_id"]]))
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        base = {label for _, label in hits}
        assert r["base_labels"] == ",".join(sorted(base)) and base <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_matching_statistics():
    rng = random.Random(9)
    templates = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    machine = licenses.Automaton(templates)
    inside = lambda part: [(t, i + len(part) - 1) for t, x in enumerate(templates) for i in range(len(x)) if x[i : i + len(part)] == part]
    for _ in range(60):
        ids = [rng.choice([0, 1, 2, 3, None]) for _ in range(40)]
        found = machine.stretches(ids)
        for end, size, state in found:
            part = ids[end - size + 1 : end + 1]
            assert sorted((t, p) for t, ps in machine.ends[state].items() for p in ps) == sorted(inside(part))
            before = ids[end - size] if end >= size else None
            assert before is None or not inside([before, *part])
            after = ids[end + 1] if end + 1 < len(ids) else None
            assert after is None or not inside([*part, after])


def test_license_templates_are_found():
    scan = licenses.Scanner().scan
    for label, _, text in licenses.TEMPLATES:
        r = scan("some words before " + text.upper() + " and after")
        assert r["labels"] == ",".join(sorted({label, *filter(None, r["base_labels"].split(","))})) and r["score"] == 1
    cut = licenses.TEMPLATES[0][2].split()
    edited = " ".join(cut[:30] + ["inserted"] + cut[30:60] + cut[64:])
    assert scan(edited)["labels"] == "mit" and 0.6 < scan(edited)["score"] < 1
    assert scan("the cat sat on the mat and all was well")["labels"] == ""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This project is licensed under the terms of the BSD license.", ""),
        ("This project is licensed under the terms of the contract signed by both parties.", ""),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution-Unheard 4.0 International License.", ""),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "lgpl"),
        ("Text. Released under the MIT License. Then more. All rights reserved. Licensed under the Apache License, Version 2.0.", "apache,mit"),
        ("Copyright 2001 Somebody. All rights reserved.", ""),
        ("This document is released under CC BY-SA 3.0.", "cc-by,cc-by-sa"),
        ("Text available under CC BY-NC-ND 2.5, photographs apart.", "cc-by,cc-by-nc-nd"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
        ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd"),
        ("/* SPDX-License-Identifier: Unheard-Of */", ""),
        ("CC0 1.0", "cc0"),
        ("The code is Apache-2.0 throughout.", "apache"),
        ("Licensed under the BSD 3-Clause License.", "bsd"),
        ("Licensed under the GNU GPL v3 or any later version.", "gpl"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by"),
        ("They arrived by cc by train, 3 of 0 were licensed under nobody.", "cc-by"),
        ("Released under the MIT License. " * 3, "mit"),
    ],
)
def test_license_labels(text, labels):
    assert licenses.Scanner().scan(text)["labels"] == labels


def test_license_score_comes_from_the_chain():
    scan = licenses.Scanner().scan
    assert 0 < scan("The cc by line was empty")["score"] < licenses.MIN_COVER
    assert scan("Licensed under CC BY 4.0")["score"] == 1


def test_license_chains_against_plain_search():
    """All chains of a template's stretches, each extended by every stretch before it."""
    rng = random.Random(6)
    letters = "abcdef"
    for _ in range(40):
        templates = [("x", "", " ".join(rng.choice(letters) for _ in range(rng.randint(6, 30)))) for _ in range(3)]
        one = licenses.Scanner(templates, {"zz": "zz"})
        words = [rng.choice([*letters, "other"]).encode() for _ in range(60)]
        for t, (_, _, text) in enumerate(templates):
            known, ids = text.split(), [w.decode() for w in words]
            matches = [(i + n - 1, j + n - 1, n) for i in range(60) for j in range(len(known)) for n in range(2, 31) if i + n <= 60 and j + n <= len(known) and ids[i : i + n] == known[j : j + n]]
            matches.sort()
            sums, best = one.sums[t], []
            for end, place, size in matches:
                weight = sums[place + 1] - sums[place + 1 - size]
                for (e, p, _), w in zip(matches, best, strict=False):
                    trim = max(0, e + 1 - (end - size + 1), p + 1 - (place - size + 1))
                    gap = max(0, end - size + 1 + trim - e - 1)
                    if e < end and p < place and trim < size and gap <= licenses.MAX_GAP:
                        weight = max(weight, w + sums[place + 1] - sums[place + 1 - size + trim] - licenses.GAP_COST * gap)
                best.append(weight)
            assert np.allclose([c.weight for c in one.chains(t, matches)], best)


def _shingles(text, n=5):
    words = WORD.findall(low(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_fingerprints(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs).collect()}
    order = sorted(texts, reverse=True)
    off = []
    for key, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other, r = texts[key] or "", texts[after] or "", rows[key]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, b in (("near_edited", edited), ("near_next", other)):
            x, y = _shingles(text), _shingles(b)
            true = len(x & y) / len(x | y) if x | y else 1.0
            if len(x | y) <= fingerprint.K:
                assert abs(r[name] - true) < 1e-12
            off.append(r[name] - true)
        n = len(_shingles(text))
        assert abs(r["n_shingles"] / n - 1) < 0.5 if n > fingerprint.K else r["n_shingles"] == n
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_sketches_merge(docs):
    whole = fingerprint.sketch(docs).withColumn("g", F.col("doc_id") % 3)
    merged = {r["g"]: r["sketch"] for r in fingerprint.merge_all(whole, ["g"]).collect()}
    for g in range(3):
        every = sorted({h for r in whole.filter(F.col("g") == g).collect() for h in r["sketch"]})
        assert merged[g] == every[: fingerprint.K]
    part = whole.limit(1).select("sketch", F.slice("sketch", 1, 10).alias("some"))
    row = part.select(fingerprint.containment(F.col("some"), F.col("sketch")).alias("c"), fingerprint.distinct_shingles(F.col("some")).alias("n")).first()
    assert row["c"] == 1.0 and row["n"] == 10


def _components(texts, size, least):
    sets = {k: frozenset(_shingles(t, size)) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= (len(sets[a]) + len(sets[b]) - both) * least:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, texts, size):
    want, sizes = _components(texts, size, 80)
    rows = neardup.groups(docs, size, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes
    assert all(r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in rows)


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    """Every bucket dealt to many blocks, every class broadcast: the same groups."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    monkeypatch.setattr(neardup, "HOT_SHARE", 10**9)
    rng = random.Random(13)
    shared, texts = [f"w{rng.randint(0, 999)}" for _ in range(60)], {}
    for i in range(70):  # a passage in all of them, so buckets are large and mostly unlike
        own = [f"x{rng.randint(0, 10**6)}" for _ in range(rng.choice([2, 8, 30]))]
        texts[i] = " ".join(shared + own)
    rows = neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == _components(texts, 4, 80)[0]


def test_near_duplicates_of_one_id(spark):
    """Two texts of one id are one node, linked with what either is like."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, c)]
    for _ in range(2):
        got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {5: 5, 7: 5, 9: 5, 11: 11}
        rows.reverse()


def test_near_duplicate_chains(spark):
    """A chain of edits links its ends only through the middle; copies come in numbers."""
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = {}
    for i in range(80):
        texts[i] = " ".join(words)
        words[rng.randrange(120)] = f"n{i}"
    texts |= {100 + i: texts[7] for i in range(50)} | {200 + i: f"lone text number {i} of its kind" for i in range(5)}
    rows = neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == _components(texts, 4, 80)[0]


def test_pigeonhole_guarantee():
    """Signatures under the distance share a chunk but for one component."""
    rng = random.Random(2)
    for _ in range(2000):
        wrong = rng.sample(range(neardup.CHUNKS * neardup.LANES), neardup.MAX_DISTANCE)
        assert min(Counter(w // neardup.LANES for w in wrong).get(c, 0) for c in range(neardup.CHUNKS)) <= 1


@pytest.mark.parametrize(("parts", "nodes"), [(1, 10**6), (16, 10**6), (7, 3)])
def test_components(spark, monkeypatch, parts, nodes):
    """In one task, over many, and with tasks that join few nodes at a time."""
    monkeypatch.setattr(graph, "hold", lambda df, name: hold(df.repartition(parts, "a") if name == "edges" else df, name).repartition(parts))
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(900, x) for x in range(901, 960)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == {k: v for k, v in parent.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_packing_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 50, len(lengths))
        k = int(rng.integers(1, 5))
        ends = packing.choose_boundaries(lengths, counts, k)
        cost = lambda cut: sum(c * min(e for e in cut if e >= n) for n, c in zip(lengths, counts, strict=True))
        from itertools import combinations

        others = [cost([*c, lengths[-1]]) for r in range(k) for c in combinations(lengths[:-1].tolist(), r)]
        assert len(ends) <= k and cost(ends) == min(others)


def test_packing_is_optimal_for_long_texts():
    """Past 512 tokens too, against the plain quadratic recurrence."""
    rng = np.random.default_rng(2)
    for k in (1, 3, 8):
        lengths = np.unique(rng.integers(1, 70_000, 300))
        counts = rng.integers(1, 50, len(lengths))
        before = np.concatenate([[0], np.cumsum(counts)])
        best = np.concatenate([[0.0], np.full(len(lengths), np.inf)])
        for _ in range(k):
            best = np.array([0.0, *((best[:j] + (before[j] - before[:j]) * lengths[j - 1]).min() for j in range(1, len(lengths) + 1))])
        ends = packing.choose_boundaries(lengths, counts, k)
        assert len(ends) <= k and sum(int(c) * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True)) == best[-1]
    assert packing.choose_boundaries(np.array([0]), np.array([7]), 4) == [0] and packing.choose_boundaries(np.zeros(0), np.zeros(0), 4) == []


def test_packing_repeated_rows(spark):
    """Very many copies of one row are numbered one by one."""
    rows = packing.pack(spark.createDataFrame([(1, "a b c")] * 500 + [(2, "a b")] * 3, "doc_id long, text string"), buckets=2, budget=30, parts=4).collect()
    assert len({(r["bucket"], r["batch"], r["place"]) for r in rows}) == len(rows) == 503


def test_packing_batches(docs, texts):
    rows = packing.pack(docs, buckets=4, budget=2000, parts=8).collect()
    for r in rows:
        assert r["n_tokens"] == len(WORD.findall(texts[r["doc_id"]] or "")) <= r["padded_length"]
    batches = Counter((r["bucket"], r["batch"]) for r in rows)
    width = {r["bucket"]: r["padded_length"] for r in rows}
    assert all(n * width[b] <= 2000 or n == 1 for (b, _), n in batches.items())
    for b in width:
        full = max(1, 2000 // max(1, width[b]))
        sizes = [n for (x, _), n in sorted(batches.items()) if x == b]
        assert sizes[:-1] == [full] * (len(sizes) - 1)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_against_plain_python(spark, docs, texts):
    """Grams counted one by one, machines applied one by one, votes of each pair."""
    model = langid.fit(docs)
    machines = dict(zip(model.machines, zip(model.weights.astype(float), model.biases, strict=True), strict=True))

    def plain(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        data = (" " + re.sub(" +", " ", letters) + " ").encode()
        if not letters.strip():
            return "und", 0.0
        found = []
        for order in range(1, 5):
            for i in range(len(data) - order + 1):
                run = 0
                for c in data[i : i + order]:
                    run = (run * 257 + c) % 2**32
                found.append(((run + order) * 2654435761 % 2**32) >> (32 - langid.BITS))
        margin = {m: float(np.mean(w[found])) + b for m, (w, b) in machines.items()}
        family = max(model.families, key=lambda f: margin.get(("family", f), 0.0))
        beats = {x: {y: margin[("pair", x, y)] if x < y else -margin[("pair", y, x)] for y in model.members[family] if y != x} for x in model.members[family]}
        best = max(sorted(beats), key=lambda x: (sum(m >= 0 for m in beats[x].values()), sum(np.tanh(m) for m in beats[x].values())))
        sure = min([*([margin["family", family]] if len(model.families) > 1 else []), *beats[best].values()], default=1.0)
        return best, 1 / (1 + math.exp(-2 * sure))

    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for key in [*sorted(texts)[:60], *[k for k in texts if not texts[k]]]:
        lang, score = plain(texts[key])
        assert rows[key]["lang_pred"] == lang and abs(rows[key]["score"] - score) < 1e-4


def test_language_sample_is_bounded(spark):
    """A row repeated without end is learned from once; rare and excess languages aren't learned."""
    rows = [(None, "always the same row stands here", "en")] * 300 + [(i, f"der Satz Nummer {i} steht hier", "de") for i in range(40)]
    rows += [(100 + i, f"la phrase {i}", "fr") for i in range(30)] + [(900 + i, "rara", "xx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == ["de", "en", "fr"] and langid.fit(docs, most_languages=2).languages == ["de", "en"]
    assert langid.fit(docs, least_rows=1000).languages == []


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    rows = toxicity.predict(docs.join(labels.filter("doc_id % 3 = 0").select("doc_id"), "doc_id"), model).join(labels.select("doc_id", F.col("toxic").alias("t")), "doc_id").collect()
    hit = sum(r["toxic"] and r["t"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.9 and hit / sum(r["t"] == 1 for r in rows) > 0.75
    assert list(model.cuts) == sorted(model.cuts) and all(0 <= r["expected_severity"] <= 2 for r in rows)


def test_line_dedup(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**5)}" for _ in range(rng.randint(5, 12))) + ". "
    passage = "".join(sentence() for _ in range(9))
    clean = {i: "".join(sentence() + ("\n" if rng.random() < 0.2 else "") for _ in range(30)) for i in range(40)}
    texts = dict(clean)
    for i in range(0, 40, 4):
        at = clean[i].index(". ") + 2
        texts[i] = clean[i][:at] + passage + clean[i][at:]
    rows = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows[0]["text"] == texts[0] and rows[0]["n_removed"] == 0
    for i, text in clean.items():
        if i:
            assert rows[i]["text"] == text, i
    assert all(rows[i]["n_removed"] >= 9 for i in range(4, 40, 4))


@pytest.mark.parametrize("letters", ["abcdefgh", "aeilnorsñ", "абвгдежз", "अआइईकखगघ", "".join(map(chr, range(0x4E00, 0x9000)))], ids=["ascii", "spanish", "cyrillic", "devanagari", "han"])
def test_line_dedup_finds_every_passage(spark, letters):
    """Two copies of passages of 50 to 60 words, at random words of long sentences."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(letters) for _ in range(9))
    some = lambda n: [word() + (". " if rng.random() < 0.03 else " ") for _ in range(n)]
    texts, clean = {}, {}
    for i in range(150):
        passage = some(rng.randint(50, 60))
        for doc_id in (i, 1000 + i):
            own, at = some(rng.randint(0, 300)), rng.random()
            at = int(at * (len(own) + 1))
            clean[doc_id] = "".join(own)
            texts[doc_id] = "".join(own[:at] + passage + own[at:])
    rows = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(rows[i] == (texts[i] if i < 1000 else clean[i]) for i in texts)


def _stretches(places, least):
    """(first, after the last) of each run of successive numbers, of ``least`` or more."""
    places = sorted(places)
    breaks = [i for i in range(1, len(places)) if places[i] != places[i - 1] + 1]
    ends = zip([0, *breaks], [*breaks, len(places)], strict=True)
    return [(places[a], places[b - 1] + 1) for a, b in ends if b - a >= least] if places else []


def plain_line_dedup(texts):
    """Every two lines looked up by their words, every repeat compared word by word."""
    run, grow = linededup.RUN, linededup.GROW
    words, found, first, out = {}, [], {}, {}
    for key in sorted(texts):
        data = texts[key].encode()
        starts = linededup.word_starts(data)
        words[key] = [data[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(data)], strict=False)]
        begins = [int(np.searchsorted(starts, at)) for at in np.cumsum([0, *map(len, linededup.lines_of(data))])]
        for a, b, c in zip(begins, begins[1:], begins[2:], strict=False):
            two = (tuple(words[key][a:b]), tuple(words[key][b:c]))
            found.append((key, b, two))
            first.setdefault(two, (key, b))
    for key, text in texts.items():
        equal = {}
        for own, at, two in found:
            kept = first[two]
            if own == key and kept != (key, at):
                other = words[kept[0]]
                for d in range(-grow, run + grow):
                    if 0 <= at + d < len(words[key]) and 0 <= kept[1] + d < len(other) and words[key][at + d] == other[kept[1] + d]:
                        equal.setdefault((kept[0], at - kept[1]), set()).add(at + d)
        again = {x for places in equal.values() for a, b in _stretches(places, run) for x in range(a, b)}
        data, gone = text.encode(), set()
        starts = linededup.word_starts(data).tolist()
        lines = np.cumsum([0, *map(len, linededup.lines_of(data))]).tolist()
        for a, b in _stretches(again, run):
            begin, end = starts[a] if a else 0, starts[b] if b < len(starts) else len(data)
            if b - a >= linededup.PASSAGE:
                stop = starts[b - 1] + len(words[key][b - 1])
                while stop < end and data[stop : stop + 1] in (b" ", b"\t"):
                    stop += 1
                if data[stop : stop + 1] == b"\n" and (not begin or data[begin - 1 : begin] == b"\n"):
                    stop += 1
                gone |= set(range(begin, stop))
            else:
                whole = [(x, y) for x, y in zip(lines, lines[1:], strict=False) if begin <= x and y <= end]
                if len(whole) >= linededup.MIN_LINES and sum(whole[0][0] <= x < whole[-1][1] for x in starts) >= linededup.MIN_WORDS:
                    gone |= set(range(whole[0][0], whole[-1][1]))
        out[key] = bytes(c for i, c in enumerate(data) if i not in gone).decode()
    return out


def _pairs(texts):
    """Places of each two lines that follow each other and have the words to count, in order."""
    places = {}
    for key in sorted(texts):
        lines = linededup.lines_of(texts[key].encode())
        for i, two in enumerate(zip(lines, lines[1:], strict=False)):
            if sum(len(linededup.word_starts(x)) for x in two) >= linededup.MIN_WORDS:
                places.setdefault(b"".join(two).decode().strip(), []).append((key, i))
    return places


def check_line_dedup(texts, rows):
    """By no rule of the operator's own: two lines that stand before don't stand again, and
    a word that stands once stays."""
    repeats = 0
    for two, places in _pairs(texts).items():
        for key in {k for k, _ in places}:
            first_here = places[0][0] == key
            repeats += len(places) > first_here
            assert rows[key].count(two) <= first_here, (two, key, places)
    counts = Counter(w for t in texts.values() for w in t.split())
    for key, text in texts.items():
        left = Counter(rows[key].split())
        assert all(left[w] for w in text.split() if counts[w] == 1), key
        assert not left - Counter(text.split())
    return repeats


def _dedup(spark, texts):
    return {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("share", [2, 1000])
def test_line_dedup_against_all_pairs_of_lines(spark, monkeypatch, share):
    """With and without hashes that count as hot; passages of any length at any place, whole
    copies, and a text that repeats itself."""
    monkeypatch.setattr(linededup, "HOT_SHARE", share)
    rng = random.Random(21)
    word = lambda: rng.choice(["der", "la", "of"]) if rng.random() < 0.2 else "".join(rng.choice("aeilnor") for _ in range(rng.randint(2, 7)))
    some = lambda n: [word() + rng.choice([" "] * 9 + [". ", ".\n", "  ", "\n"]) for _ in range(n)]
    passages = [some(n) for n in (12, 20, 45, 60, 130)]
    common, texts = some(25), {}
    for i in range(60):
        parts = [some(rng.randint(0, 60)) for _ in range(4)]
        texts[i] = "".join(w for p in parts for w in [*p, *rng.choice([[], common, rng.choice(passages)])])
    texts |= {100 + i: texts[7] for i in range(12)} | {200: "", 201: "one", 202: "a " * 300, 203: texts[3] + texts[3]}
    rows = _dedup(spark, texts)
    assert check_line_dedup(texts, rows) > 300
    assert {k: rows[k] for k in texts} == plain_line_dedup(texts)
    assert all(not rows[100 + i].strip() for i in range(12)) and rows[200] == "" and rows[201] == "one"


def test_short_blocks_of_short_lines_go(spark):
    """Blocks of four lines of five words, and of two lines of four, in documents that share nothing else."""
    rng = random.Random(22)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(n)) + "\n"
    texts, clean = {}, {}
    for i in range(200):
        block = "".join(line(*([5], [4])[i % 2]) for _ in range((4, 2)[i % 2]))
        for doc_id in (i, 1000 + i):
            a, b = ("".join(line(rng.randint(3, 9)) for _ in range(rng.randint(0, 6))) for _ in range(2))
            texts[doc_id], clean[doc_id] = a + block + b, a + b
    rows = _dedup(spark, texts)
    assert rows == {k: texts[k] if k < 1000 else clean[k] for k in texts}


def test_passages_that_a_third_text_holds_in_part(spark):
    """The first 34 of 48 words stand in an earlier document, the whole in two later ones."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("aeilnorst") for _ in range(8))
    some = lambda n: [word() + (". " if rng.random() < 0.08 else " ") for _ in range(n)]
    texts, wanted = {}, {}
    for i in range(100):
        passage = some(48)
        own = [("".join(some(60)), "".join(some(60))) for _ in range(3)]
        texts[i] = own[0][0] + "".join(passage[:34]) + own[0][1]
        for k in (1, 2):
            texts[1000 * k + i] = own[k][0] + "".join(passage) + own[k][1]
        wanted[2000 + i] = own[2][0] + own[2][1]
    rows = _dedup(spark, texts)
    check_line_dedup(texts, rows)
    assert all(rows[i] == texts[i] for i in range(100))
    assert sum(rows[k] == wanted[k] for k in wanted) >= 95  # in the rest less than two whole lines stay
    assert all(len(rows[k].split()) <= len(wanted[k].split()) + 24 for k in wanted)


@pytest.mark.parametrize("letters", ["aeilnorsñ", "абвгдежз", "अआइईकखगघ"])
def test_long_lines_are_cut_in_every_script(letters):
    rng = random.Random(4)
    line = " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(200)).encode()
    parts = linededup.lines_of(line)
    assert b"".join(parts) == line and len(parts) > 200 / 14


def _lm_tokens(texts):
    return {k: [*WORD.findall(low(t)), " end"] for k, t in texts.items()}


def test_lm_base_counts(docs, texts):
    rows = {r["doc_id"]: r for r in lmscore.score(docs, PATH).collect()}
    tokens = _lm_tokens(texts)
    training = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(training.values()), len(training)
    for key, words in tokens.items():
        r = rows[key]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(training[w] > 0 for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((training[w] + 1) / (n + v + 1)) for w in words)) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 7 == 2) and r["score"] < 0


def test_lm_scores_above_the_base(spark):
    """Context must help on texts that training never saw."""
    rows = lmscore.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).filter("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.1


def test_lm_long_words_are_broadcast_too(spark, monkeypatch):
    """A long word of every document counts as one of the hot words, and as it did when joined."""
    link = "https://example.org/" + "a-very-long-path-" * 6
    docs = spark.createDataFrame([(i, f"see {link}{i % 2} and {link} or {'é' * 40} number {i}") for i in range(60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.score(docs, PATH).collect()}
    monkeypatch.setattr(lmscore, "HOT_SHARE", 0)  # no word is hot
    want = {r["doc_id"]: r for r in lmscore.score(docs, PATH).collect()}
    for key, r in want.items():
        assert got[key]["n_known"] == r["n_known"] and abs(got[key]["base_score"] - r["base_score"]) < 1e-9 and abs(got[key]["score"] - r["score"]) < 1e-6
    ids = lmscore.WordIds(lambda w: [len(w)], [b"a", lmscore.long_key(link.encode())])
    assert ids[b"a"] >> lmscore.ID_BITS == 1 and ids[link.encode()] >> lmscore.ID_BITS == 2 and ids[link.encode() + b"x"] >> lmscore.ID_BITS == 0


def _attend(p, counted, before, label):
    """Log-probability of class ``label`` after the inputs ``before`` (of this block and the one before)."""
    e, width = p["embed"].astype(float), attention.WIDTH
    own, past = before
    t = len(own) - 1
    heads = [(x, i) for i, x in enumerate(past)] + [(x, attention.BLOCK + i) for i, x in enumerate(own)]
    s = np.array([e[own[t]] @ p["wq"] @ (e[x] @ p["wk"]) / math.sqrt(width) + p["place"][t][i] for x, i in heads])
    a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    mixed = sum(w * (e[x] @ p["wv"]) for w, (x, _) in zip(a, heads, strict=True))
    group, member = divmod(label, attention.MEMBERS)
    outer = mixed @ p["out"] + counted[0][own[t]]
    inner = mixed @ p["inner"][group] + counted[1][own[t] * attention.GROUPS + group]
    return outer[group] - np.log(np.exp(outer).sum()) + inner[member] - np.log(np.exp(inner).sum())


def _some_model(seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    p = {k: v + rng.normal(0, spread, v.shape).astype(np.float32) for k, v in attention.fresh().items()}
    share = rng.random(attention.CLASSES)
    pairs = rng.integers(0, 9, (attention.INPUTS + 1) * attention.CLASSES)
    return attention.Attention(p, attention.tables(pairs, share / share.sum()))


def test_lm_scores_each_token_once():
    """Batches of masked blocks against a loop over single tokens."""
    rng, model = np.random.default_rng(3), _some_model()
    classes = lmscore.Classes(rng.integers(0, 50, 3000).astype(float))
    texts = [rng.integers(0, 3000, n) for n in (1, 16, 17, 40, 5, 64)]
    for text, found in zip(texts, lmscore.context_gains(model, classes, texts, at_once=3), strict=True):
        assert len(found) == len(text)
        inputs = [attention.INPUTS, *classes.input[text][:-1].tolist()]
        for t in range(len(text)):
            begin = t // attention.BLOCK * attention.BLOCK
            context = inputs[begin : t + 1], inputs[begin - attention.BLOCK : begin] if begin else []
            want = _attend(model.p, (model.top, model.low), context, int(classes.of[text[t]])) - classes.log_share[classes.of[text[t]]]
            assert abs(found[t] - want / math.log(10)) < 1e-3


def test_lm_spells_words_by_all_ids():
    """A word's probability is the product of its ids', given that a word begins, up to where the next begins."""
    rng, model = np.random.default_rng(8), _some_model()
    leads = rng.random(3000) < 0.5
    mass = rng.integers(1, 50, 3000).astype(float)
    classes = lmscore.Classes(mass, leads)
    assert (classes.of[leads] // attention.MEMBERS < attention.STARTS).all() and (classes.of[~leads] // attention.MEMBERS >= attention.STARTS).all()
    sizes = rng.integers(1, 5, 23)
    some = lambda of, n: rng.choice(np.flatnonzero(of), n)
    text = np.concatenate([*(np.append(some(leads, 1), some(~leads, n - 1)) for n in sizes), some(leads, 1)])
    gain, spelt = lmscore.spelt_words(classes, text, sizes, *(v[0] for v in lmscore.context_gains(model, classes, [text], begins=True)))
    inputs, counted, own, start = [attention.INPUTS, *classes.input[text][:-1].tolist()], (model.top, model.low), [], []
    for t in range(len(text)):
        begin = t // attention.BLOCK * attention.BLOCK
        context = inputs[begin : t + 1], inputs[begin - attention.BLOCK : begin] if begin else []
        k = classes.of[text[t]]
        own.append(_attend(model.p, counted, context, int(k)) + np.log(mass[text[t]] / mass[classes.of == k].sum()))
        start.append(np.log(sum(np.exp(_attend(model.p, counted, context, c)) for c in range(attention.STARTS * attention.MEMBERS))))
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        assert abs(spelt[i] - (sum(own[a:b]) - start[a] + start[b]) / math.log(10)) < 1e-3
    share = mass[leads].sum()
    for i, a in enumerate([0, *ends]):
        k = classes.of[text[a]]
        want = own[a] - np.log(mass[text[a]] / mass[classes.of == k].sum()) - start[a] - np.log(mass[classes.of == k].sum() / share)
        assert abs(gain[i] - want / math.log(10)) < 1e-3


def test_lm_keeps_all_ids_of_a_word(monkeypatch):
    monkeypatch.setattr(lmscore, "CACHED_WORDS", 3)
    ids = lmscore.WordIds(lambda w: list(w[1:]), [b"hot", lmscore.long_key(b"x" * 70)])
    for words in ([b"hot", b"a", b"bc"], [b"def", b"x" * 70, b"hot"], [], [b"y" * 70, b"a"]):
        places, pieces, sizes = ids.of(words, 999)
        assert pieces.tolist() == [*b"".join(words), 999] and sizes.tolist() == [len(w) for w in words]
        assert places.tolist() == [{b"hot": 1, b"x" * 70: 2}.get(w, 0) for w in words]


def test_lm_tells_words_by_their_last_ids(spark):
    """New words that begin alike but end unlike, as training's words do or don't, score apart."""
    path, held = PATH, next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    encode = lmscore._encoder(*lmscore._rank_file(path)[:2])
    begin, known, strange = "river", "zqzq", "xwxw"
    new = [begin + known, begin + strange]
    lead, tails = encode(b" river")[0], [encode(b" " + w.encode()) for w in new]
    assert [t[0] for t in tails] == [lead, lead] and tails[0][1:] != tails[1][1:]
    rows = [(i, " ".join(w + known for w in ("road", "town", "boat", "grain")) + " river road") for i in range(60)]
    scores = []
    for word in new:
        docs = spark.createDataFrame([*rows, (held, f"road {word} town")], "doc_id long, text string").coalesce(2)
        scores.append({r["doc_id"]: r["score"] for r in lmscore.score(docs, path).collect()}[held])
    assert scores[0] > scores[1] + 0.001


def test_lm_classes_share_all_mass():
    mass = np.random.default_rng(5).integers(0, 9, 5000).astype(float)
    classes = lmscore.Classes(mass)
    assert abs(classes.share.sum() - 1) < 1e-9 and classes.of.min() >= 0 and classes.of.max() < attention.CLASSES
    assert np.allclose(classes.share, [mass[classes.of == k].sum() / mass.sum() for k in range(attention.CLASSES)])
    assert lmscore.Classes(np.zeros(10)).share.sum() == 0


def test_lm_learns_from_all_documents(spark):
    """The order of words in the training documents tells."""
    rng, words = random.Random(5), ["river", "road", "town", "boat", "grain", "war", "north", "spring"]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)

    def held_score(ordered):
        rows = [(held, " ".join(words * 50))]
        for i in range(150):
            some = words * 50
            if not ordered:
                rng.shuffle(some)
            rows.append((i, " ".join(some)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        return {r["doc_id"]: r["score"] for r in lmscore.score(docs, PATH).collect()}[held]

    assert held_score(True) > held_score(False) + 5


def test_sets_are_compared_outside_the_join(spark, monkeypatch):
    """A condition that holds the comparison is too long a method to be compiled."""
    seen = []
    monkeypatch.setattr(neardup, "components", lambda edges: seen.append(edges) or graph.components(edges))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(6)], "doc_id long, text string")
    neardup.groups(docs, 4, 80)
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("array_intersect" in x for x in plan) and not any("array_intersect" in x for x in plan if "Join" in x)


def test_near_copies_unlike_all_others_make_no_pairs(spark, monkeypatch):
    """Copies of one text, some with too many edits to be like any other: no pair of those is compared."""
    met, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, least: met.append(pairs.count()) or confirmed(pairs, least))
    rng, texts = random.Random(41), {}
    base = [f"w{i}" for i in range(150)]
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(0, 150, 5), 6 if i % 3 else 1):
            words[at] = f"own{i}-{at}"
        texts[i] = " ".join(words)
    rows = neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == _components(texts, 4, 80)[0]
    assert met == [0]


def test_near_copies_that_share_edits_make_few_pairs(spark, monkeypatch):
    """Copies of one text whose edits stand in some others too: the pairs compared grow with the copies, not their square."""
    met, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "LARGE_ROWS", 20, raising=False)
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, least: met.append(pairs.count()) or confirmed(pairs, least))
    rng, texts = random.Random(43), {}
    base = [f"w{i}" for i in range(150)]
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(0, 150, 5), 5 if i % 3 else 1):
            words[at] = f"new{rng.randrange(8)}-{at}"
        texts[i] = " ".join(words)
    rows = neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    want = _components(texts, 4, 80)[0]
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert len(set(want.values())) > 20 and 0 < sum(met) < 6 * len(texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_large_groups_against_brute_force(spark, monkeypatch, seed):
    """Long and short near copies, some of another copy, with edits of their own and of others."""
    monkeypatch.setattr(neardup, "LARGE_ROWS", 8)
    rng, texts = random.Random(seed), {}
    for k in range(3):
        copies = [[f"w{k}-{i}" for i in range(90)]]
        for i in range(70):
            words = list(rng.choice(copies[:1] if rng.random() < 0.7 else copies))
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice([f"new{k}-{rng.randrange(9)}", f"own{k}-{i}"])
            copies.append(words[: len(words) - rng.choice([0, 0, 0, 4, 9, 20])])
            texts[1000 * k + rng.randrange(1000)] = " ".join(copies[-1])
    rows = neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == _components(texts, 4, 80)[0]


def test_first_meetings_of_signatures(spark):
    """Two signatures under the distance meet first in just one of the buckets that they share."""
    rng, rows, want = random.Random(9), [], []
    for k in range(300):
        x = [rng.randrange(1 << neardup.LANE_BITS) for _ in range(neardup.CHUNKS * neardup.LANES)]
        y = [v ^ rng.choice([0, 0, 1, 1 << rng.randrange(neardup.LANE_BITS)]) for v in x]
        pack = lambda v: [sum(c << (neardup.LANE_BITS * j) for j, c in enumerate(v[i : i + neardup.LANES])) for i in range(0, len(v), neardup.LANES)]
        errors = [sum(a != b for a, b in zip(x[i : i + 4], y[i : i + 4], strict=True)) for i in range(0, 48, 4)]
        first = next((i for i, e in enumerate(errors) if e <= 1), None)
        shared = [(i * 4 + j) for i, e in enumerate(errors) for j in range(4) if e == 0 or (e == 1 and x[i * 4 + j] != y[i * 4 + j])]
        want += [(k, b, b == next(b for b in shared if b // 4 == first)) for b in shared]
        rows += [(k, b, *neardup.planes(pack(x)), *neardup.planes(pack(y))) for b in shared]
    names = neardup._PLANES
    table = spark.createDataFrame(rows, ["k", "bucket", *(f"x{c}" for c in names), *(f"y{c}" for c in names)])
    left = table.select("k", "bucket", *(F.col(f"x{c}").alias(c) for c in names)).alias("x")
    right = table.select("k", "bucket", *(F.col(f"y{c}").alias(c) for c in names)).alias("y")
    pairs = left.join(right, (F.col("x.k") == F.col("y.k")) & (F.col("x.bucket") == F.col("y.bucket")))
    got = pairs.select("x.k", "x.bucket", neardup._first_meeting("x", "y").alias("first")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_signatures_are_the_least_hashes():
    rng = np.random.default_rng(8)
    for n in (1, 5, neardup.AT_ONCE, neardup.AT_ONCE + 1, 3 * neardup.AT_ONCE + 7):
        found = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        least = [min((int(x) ^ int(a)) * int(b) % 2**64 for x in found) for a, b in neardup._SEEDS]
        least = (neardup._mix(np.array(least, np.uint64)) >> np.uint64(64 - neardup.LANE_BITS)).tolist()
        lanes = [least[i : i + neardup.LANES] for i in range(0, len(least), neardup.LANES)]
        assert neardup.signature(found) == [sum(v << (neardup.LANE_BITS * i) for i, v in enumerate(x)) for x in lanes]


def test_hubs_are_dealt_to_parts(spark, monkeypatch):
    """Keys that count as hot at ten rows: groups and components stay as they are."""
    from leafmark.llm import common

    rng = random.Random(31)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(90):  # near copies of one text, some of another, and others
        words = list(base if i % 3 else [f"x{j}" for j in range(60)] if i % 2 else [f"{i}-{j}" for j in range(60)])
        words[rng.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs, 4, 80).collect()}
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 60) for i in range(20)] + [(200, 201)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(6)
    monkeypatch.setattr(common, "KEY_ROWS", 10)
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(docs, 4, 80).collect()} == want and len(set(want.values())) < 60
    found = {r["node"]: r["component"] for r in graph.components(table, 2).collect()}
    assert found == {**dict.fromkeys(range(80), 0), 200: 200, 201: 200}
    hot = common.hot_keys(table, "a")
    assert [tuple(r) for r in hot.collect()] == [(0, 6)]
    assert common.dealt(table, hot, "a", "b").filter("a = 0").select("salt").distinct().count() == 6
    assert common.copied(table.filter("b = 1"), hot, "a").count() == 6


def test_attention_sums_to_one_and_is_causal():
    rng, model = np.random.default_rng(0), _some_model()
    ids, _, first = attention.blocks([rng.integers(0, 900, 50).astype(np.int32), rng.integers(0, 900, 7).astype(np.int32)])
    now = attention.shifted(np.maximum(ids, 0), first)
    every = sum(np.exp(model.log_shares(now, first, np.full(ids.shape, c))) for c in range(attention.CLASSES))
    assert np.allclose(every, 1, atol=1e-4)
    base = model.log_shares(now, first, np.zeros(ids.shape, int))
    now[2, 9] = 5  # in the second block: a later token changes nothing before it
    changed = model.log_shares(now, first, np.zeros(ids.shape, int))
    assert np.allclose(base[0], changed[0], atol=1e-5) and np.allclose(base[1, :9], changed[1, :9], atol=1e-5) and not np.allclose(base[1, 9:], changed[1, 9:])
    assert np.allclose(base[3:], changed[3:], atol=1e-5)  # nor anything two blocks on, or in another text


def test_attention_gradients():
    rng, model = np.random.default_rng(1), _some_model(1, 0.1)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    counted = model.top.astype(np.float64), model.low.astype(np.float64)
    now, classes = rng.integers(0, 1000, (4, 16)), rng.integers(-1, attention.CLASSES, (3, 16))
    first = np.array([False, False, True])

    def loss(q):
        shares = attention.Attention(q, counted).log_shares(now, first, np.maximum(classes, 0))
        return -float(shares[classes >= 0].mean())

    grads = attention.gradients(attention.Attention(p, counted), now, first, classes)
    assert set(grads) == set(p)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[at]) < 1e-3 * abs(g[at]) + 1e-6, name


def plain_quality(text):
    """The text that the quality rules leave, or None if they reject it."""
    from leafmark.llm import quality as q

    def passes(line):
        n, has = len(line), lambda p: re.search(p, line) is not None
        marks = lambda p: sum(1 for _ in re.finditer(p, line)) * q.MARK_CHARS
        prose = has(q.SENTENCE_END) and marks(q.SHOUT) <= n
        menu = marks(q.SEPARATOR) > n or (n <= q.MENU_CHARS and has(q.MENU))
        notice = n <= q.BOILERPLATE_CHARS and has(q.BOILERPLATE)
        return (prose and not menu and not notice) or not has(q.WORD)

    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - 2):
        if counts[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = True
    if len(words) < q.MIN_WORDS or 100 * hit.sum() > 50 * len(words):
        return None
    left = [x for x in lines if passes(x)]
    chars = lambda some: sum(len(x) for x in some if re.search(q.WORD, x))
    return "\n".join(left) if chars(left) >= chars(lines) * q.MIN_KEPT_SHARE else None


def test_pipeline_against_brute_force(spark):
    """Each stage's rows and texts, remade in plain Python from the stage before."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:4]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in after.values())
        texts = {k: r["text"] for k, r in before.items()}
        if name.startswith("quality"):
            want = {k: v for k, v in ((k, plain_quality(t)) for k, t in texts.items()) if v is not None}
            assert len(want) > 100
        elif name.startswith("language"):
            told = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
            want = {k: t for k, t in texts.items() if told[k]["lang_pred"] != "und" and told[k]["score"] >= 0.5}
            assert all(r["lang"] == told[k]["lang_pred"] for k, r in after.items())
        elif name.startswith("line"):
            want = {k: v for k, v in plain_line_dedup(texts).items() if v == texts[k] or v.strip()}
        else:
            parts, _ = _components(texts, 5, 80)
            want = {k: t for k, t in texts.items() if parts[k] == k}
        assert {k: r["text"] for k, r in after.items()} == want, name
        rest = [c for c in docs.columns if c not in ("text", "n_chars", "lang")]
        assert all(r[c] == before[k][c] for k, r in after.items() for c in rest)
        docs = out
    packed = pipeline.STAGES[4][1](spark, docs, SF).collect()
    lengths = {r["doc_id"]: len(WORD.findall(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in packed} == lengths
    held, n = np.unique(list(lengths.values()), return_counts=True)
    assert sorted({r["padded_length"] for r in packed}) == packing.choose_boundaries(held, n, packing.BUCKETS)


def _tox(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    return model, {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}


@pytest.mark.parametrize("toxic", [lambda i: 0, lambda i: 1, lambda i: i % 2], ids=["none", "all", "no telling word"])
def test_toxicity_without_anything_to_learn(spark, toxic):
    model, rows = _tox(spark, [(i, "the same few words for everybody") for i in range(30)], [(i, toxic(i)) for i in range(30)])
    assert not len(model.at) and all(r["grade"] == 0 and r["expected_severity"] == 0 and not r["toxic"] for r in rows.values())


def test_toxicity_optimum():
    """The fit's loss against a plain proximal-gradient descent of many small steps."""
    rng = np.random.default_rng(4)
    grades = rng.choice([0, 0, 0, 1, 2], 120)
    rows = []
    for g in grades:
        at = sorted({*rng.integers(50, 90, 6).tolist(), *(rng.integers(0, 4, 1 + g).tolist() if g else [])})
        rows.append((np.array(at, np.int64), np.ones(len(at), np.float32)))
    model = toxicity.Ordinal.fit(rows, grades, sparse=2e-3, steps=2000)
    named = toxicity.telling(rows, grades > 0)
    x = np.array([[float(v[a == n].sum()) for n in named] for a, v in rows])
    each = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())
    above = (grades[:, None] >= [1, 2]).astype(float)

    def loss(w, cuts):
        p = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        return -float((each[:, None] * (above * np.log(p) + (1 - above) * np.log(1 - p))).sum()) + 2e-3 * np.abs(w).sum()

    w, cuts = np.zeros(len(named)), np.array([0.0, 1.0])
    for _ in range(60_000):
        p = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        pull = (p - above) * each[:, None]
        w = w - 0.2 * x.T @ pull.sum(1)
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.2 * 2e-3)
        cuts = np.sort(cuts + 0.2 * pull.sum(0))
    full = np.zeros(len(named))
    full[np.searchsorted(named, model.at)] = model.weights
    assert loss(full, model.cuts) < loss(w, cuts) + 1e-3


def test_toxicity_counts_near_copies_once():
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    edited = words[:50] + ["other"] + words[50:]
    unlike = [f"v{rng.randint(0, 9999)}" for _ in range(100)] + words[:100]
    sketches = [toxicity.shingle_sketch(" ".join(x)) for x in (words, edited, unlike, words, words)]
    assert toxicity.first_of_copies(sketches, np.array([0, 0, 0, 1, 1])).tolist() == [0, 2, 3]
    a, b = (_shingles(" ".join(x)) for x in (words, unlike))
    assert abs(toxicity.likeness(sketches[0], sketches[2]) - len(a & b) / len(a | b)) < 0.1
