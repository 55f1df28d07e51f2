"""The manifest against a plain tree over all rows, and against the SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmark.llm import manifest, queries
from leafmark.llm.common import crc_mod, lower_az
from tests.conftest import SF


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, fanout, proofs, owners):
    """The root of a list of nodes; appends to each owner's proof and path on the way."""
    while len(nodes) > 1:
        after, of = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for j, mine in enumerate(owners[i : i + fanout]):
                for x in mine:
                    proofs[x].append((run[:j], run[j + 1 :]))
            after.append(h(run))
            of.append([x for mine in owners[i : i + fanout] for x in mine])
        nodes, owners = after, of
    return nodes[0]


def plain(rows, fanout=16, tampered=lambda i, t: t):
    """doc_id, leaf, subroot, root, proof, folded root of each row (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), k))
    proofs, subroots, owners = defaultdict(list), {}, []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        leaves = sorted(groups[g])
        subroots[g] = climb([x[2] for x in leaves], fanout, proofs, [[x[3]] for x in leaves])
        owners.append([x[3] for x in leaves])
    root = climb([subroots[g] for g in order], fanout, proofs, owners) if order else None
    out = []
    for k, r in enumerate(rows):
        folded = leaf_of((*r[:4], tampered(r[0], r[4])))
        for left, right in proofs[k]:
            folded = h([*left, folded, *right])
        proof = "".join("".join(left + right) for left, right in proofs[k])
        out.append((r[0], leaf_of(r), subroots[r[1]], root, h([proof]), folded, folded == root))
    return out


def bend(doc_id, text):
    hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit and text is not None else text


def key(row):
    return tuple((x is not None, x or 0) for x in row)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def audited(docs, **more):
    found = manifest.audit(docs, changed={"text": lower_az(F.col("text"))}, where=crc_mod(F.col("doc_id"), 5) == 0, **more)
    return sorted(map(tuple, found.select(*COLUMNS).collect()), key=key)


def test_query_against_plain_tree_and_sql(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select(*manifest.FIELDS).collect()))
    got = sorted(map(tuple, queries.op11_merkle_manifest(spark, SF).select(*COLUMNS).collect()), key=key)
    assert got == sorted(plain(rows, tampered=bend), key=key)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_merkle_manifest"])
    assert got == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM want").fetchall()), key=key)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (16, 2)])
def test_many_rounds(spark, fanout, levels):
    """Sizes around powers of the fanout, so last runs hold one node on any level; null
    sources and ids, ids and whole rows that repeat, empty and null fields."""
    rng, rows = random.Random(fanout * 10 + levels), []
    for g, size in enumerate([1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 65, 1, 28, 130]):
        source = None if g == 5 else "" if g == 6 else f"s{g:x}é" if g % 2 else f"S{g}"
        rows += [(rng.choice([None, rng.randint(-9, 99), rng.randint(0, 10**12)]), source, rng.choice([None, "en", ""]), rng.choice([None, 7]), rng.choice([None, "", "Text ABC é", "plain"])) for _ in range(size)]
    rows += rows[-3:]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(3)
    got = audited(docs.withColumn("node", F.lit("clash")), fanout=fanout, levels=levels)
    assert got == sorted(plain(rows, fanout, bend), key=key)


def test_proofs_fold_by_their_shape(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "en", 1, f"T{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars int, text string")
    for r in manifest.audit(docs, outputs=("leaf", "proof", "place", "size", "group_place", "groups", "root", "verified"), fanout=4, levels=1).collect():
        places = manifest.shape(r["place"], r["size"], 4) + manifest.shape(r["group_place"], r["groups"], 4)
        assert r["verified"] and manifest.fold(r["leaf"].encode(), bytes(r["proof"]), places).decode() == r["root"]
        assert manifest.fold(b"0" * 64, bytes(r["proof"]), places).decode() != r["root"] or not places


def test_lone_row(spark):
    docs = spark.createDataFrame([(10, None, None, None, None)], "doc_id long, source string, lang string, n_chars int, text string")
    (row,) = audited(docs)
    leaf = h(["2:10----"])
    assert row[1:6] == (leaf, leaf, leaf, h([""]), leaf) and row[6]
