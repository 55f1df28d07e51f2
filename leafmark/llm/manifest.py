"""Merkle manifest of a dataset: a tree over each group's rows, and one over the groups' roots.

A leaf is the digest of a row's fields. Of every ``fanout`` nodes that follow each other
(the last run may hold fewer, even one) the digest is a node of the next level, until one
is left: a group's subroot; subroots in the groups' order give the root likewise. All
digests are sha256, and enter the next as lower-case hex text.

Nodes are reduced by superblocks: a bucket is ``fanout ** levels`` nodes that follow each
other, and one task collapses its levels at once (``applyInPandas``); bucket roots are
reduced again as long as a group has more than one, so a group of any size is spread over
buckets of a few hundred rows. What was a bucket's inside is held, 32 bytes a node; from the
root down each bucket is given the siblings above it, and a leaf's proof is those inside
its bucket, then those above. Rows are numbered by range partitions of (group, order,
leaf) and the counts of earlier ones, without a task that sees a group.

Defined results: a null field is ``-`` in a leaf, an empty one ``0:``; a null group is a group
of its own, before all others; a null id comes before others; rows that repeat an id follow
each other by leaf, and rows equal in all fields have a leaf each; a lone leaf is its
subroot, a lone subroot the root, and the proof of a lone leaf in a lone group is empty;
texts of any length enter whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import held_now, hold, map_rows, release, workers_find_us

FANOUT, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest, and of one as hex text.
RAW, HEX = 32, 64


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _texts(raw: bytes) -> list[bytes]:
    """Digests as hex text."""
    return [raw[i : i + RAW].hex().encode() for i in range(0, len(raw), RAW)]


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fanout
    return levels


def collapse(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> list[list[bytes]]:
    """The nodes, and those of the next levels."""
    rows = [nodes]
    for _ in range(levels):
        nodes = [digest(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        rows.append(nodes)
    return rows


def shape(at: int, n: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(place in the run, its size) on each level above node ``at`` of ``n``."""
    out = []
    while n > 1:
        first = at - at % fanout
        out.append((at - first, min(fanout, n - first)))
        at, n = at // fanout, -(-n // fanout)
    return out


def fold(leaf: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof (siblings as hex text, level by level) give."""
    at = 0
    for place, size in places:
        own, end = at + place * HEX, at + (size - 1) * HEX
        leaf = digest([proof[at:own], leaf, proof[own:end]])
        at = end
    return leaf


def siblings(rows: list[list[bytes]], at: int, fanout: int = FANOUT) -> bytes:
    """Those of node ``at``, level by level, inside what :func:`collapse` gave."""
    out = []
    for nodes in rows[:-1]:
        first = at - at % fanout
        out += nodes[first:at]
        out += nodes[at + 1 : first + fanout]
        at //= fanout
    return b"".join(out)


def leaf_of(fields: list[Column]) -> Column:
    """Digest (binary) of the fields: byte count, colon and value of each; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` in range partitions, with their number ``__part`` and a place ``__pos``; and
    for each group and partition the place ``__from`` where the group's numbers are 0, and
    its rows ``__n``: a row for each group, and one more for each partition, at most.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__pos", F.monotonically_increasing_id())
    placed = hold(placed.withColumn("__part", F.shiftright("__pos", 33)), "placed")
    runs = placed.groupBy(*group, "__part").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, hold(runs.select(*group, "__part", (F.col("__first") - earlier).alias("__from"), F.sum("__n").over(whole).alias("__n")), "runs")


def _at(placed: DataFrame, runs: DataFrame, group: list[str], at: str) -> DataFrame:
    """Join what :func:`_numbered` gives, null groups too: the number within the group."""
    keys = (*group, "__part")
    right = runs.withColumnsRenamed({c: f"__of_{c}" for c in keys})
    same = F.col("__part") == F.col("__of___part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(right, same).withColumn(at, F.col("__pos") - F.col("__from")).drop("__pos", "__part", "__from", *[f"__of_{c}" for c in keys])


def _collapser(fanout: int, levels: int, lists: tuple[str, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What makes a row of a bucket's nodes."""
    block = fanout**levels

    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n, raw = int(rows["n"].iloc[0]), b"".join(rows["node"])
        root = collapse(_texts(raw), min(levels, height(n, fanout)), fanout)[-1][0]
        made = {"g": rows["g"].iloc[0], "at": rows["bucket"].iloc[0], "n": -(-n // block), "below": n, "nodes": raw, "node": bytes.fromhex(root.decode())}
        return pd.DataFrame({k: [v] for k, v in made.items()} | {c: [rows[c].tolist()] for c in lists})

    return bucket


def _reduce(nodes: DataFrame, fanout: int, levels: int, *more: tuple[str, str]) -> list[DataFrame]:
    """One held table for each round, from the nodes (g, at, n, node) up: (g, at, n, size of
    the group below, nodes, root) of each bucket, and lists of the ``more`` columns at the
    first. A group is in the rounds until it has one bucket."""
    block, out, carried = fanout**levels, [], more
    top = nodes.agg(F.max("n")).first()[0] or 1
    workers_find_us(nodes.sparkSession)
    while True:
        schema = "g long, at long, n long, below long, nodes binary, node binary" + "".join(f", {c} array<{kind}>" for c, kind in carried)
        buckets = nodes.withColumn("bucket", F.expr(f"at div {block}")).groupBy("g", "bucket").applyInPandas(_collapser(fanout, levels, tuple(c for c, _ in carried)), schema)
        out.append(hold(buckets, "superblocks"))
        top, carried = -(-top // block), ()
        if top <= 1:
            return out
        nodes = out[-1].filter("n > 1").select("g", "at", "n", "node")


def _above(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, at, above) of the lowest round's buckets: the siblings above each, those of
    ``tops`` (g, above) at last. What else ``tops`` has of a group, all its buckets get."""
    given = None
    for round_ in reversed(rounds):
        ends = round_.filter("n = 1").select("g", "at").join(tops, "g")
        given = ends if given is None else given.unionByName(ends)
        if round_ is rounds[0]:
            return given
        given = hold(_children(round_.join(given, ["g", "at"]), fanout, levels).drop("below"), "above")


#: What a group's buckets are told from above: siblings, and of all its rows the same.
_TOLD = {"above": "binary", "groups": "long", "subroot": "binary"}


def _children(buckets: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, at, below, and what is told) of the nodes in the buckets: ``above`` has their
    siblings there, then those above the bucket."""
    block, told = fanout**levels, [c for c in _TOLD if c in buckets.columns]

    def make():
        def step(r: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("g", "at", "below", *told)}
            for i, (at, n, raw, above) in enumerate(zip(r["at"], r["below"], r["nodes"], r["above"], strict=True)):
                rows = collapse(_texts(raw), min(levels, height(n, fanout)), fanout)
                size = len(rows[0])
                out["at"].extend(range(at * block, at * block + size))
                out["above"].extend(siblings(rows, j, fanout) + above for j in range(size))
                for c in ("g", "below", *told[1:]):
                    out[c].extend([r[c][i]] * size)
            return out

        return step

    return map_rows(buckets.select("g", "at", "below", "nodes", *told), make, "g long, at long, below long" + "".join(f", {c} {_TOLD[c]}" for c in told), 16)


def audit(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    order: str = "doc_id",
    group: str = "source",
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    outputs: tuple[str, ...] = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"),
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """``order`` and the asked outputs of every row.

    outputs: ``leaf``, ``subroot``, ``root`` (hex), ``proof`` (binary: siblings as hex text)
    and ``proof_sha256``; ``place`` and ``size`` in the group, ``group_place`` and ``groups``,
    which :func:`shape` turns into a proof's shape; ``folded_root``, made of the proof and of
    the leaf, or of that with the ``changed`` fields ``where`` that holds; and ``verified``,
    whether that is the root.
    """
    mark = held_now()
    own = [F.col(f"`{f}`") for f in fields]
    bent = leaf_of([(changed or {}).get(f, c) for f, c in zip(fields, own, strict=True)])
    bent = F.when(F.coalesce(where, F.lit(False)), bent) if where is not None else bent if changed else F.lit(None).cast("binary")
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{order}`").cast("long").alias("id"), leaf_of(own).alias("node"), bent.alias("bent"))
    placed, runs = _numbered(hold(leaves, "leaves"), ["group"], ["id", "node"])
    groups = _at(*_numbered(runs.select("group").distinct(), [], ["group"]), [], "g").select(F.col("group").alias("__group"), "g")
    runs = runs.join(groups, F.col("group").eqNullSafe(F.col("__group"))).drop("__group")
    rows = _at(placed, runs, ["group"], "at").select("g", "at", F.col("__n").alias("n"), "node", "bent", F.col("id").cast("string").alias("id"))
    rounds = _reduce(rows, fanout, levels, ("id", "string"), ("bent", "binary"))
    release(mark, but=len(rounds))
    subroots = hold(reduce(DataFrame.unionByName, [r.filter("n = 1").select("g", "node") for r in rounds]), "subroots")
    upper = _reduce(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.lit(subroots.count()).cast("long").alias("n"), "node"), fanout, levels)
    root = upper[-1].first()
    over = _above(upper, upper[-1].select("g", F.lit(b"").alias("above")), fanout, levels)
    over = _children(upper[0].join(over, ["g", "at"]), fanout, levels).select(F.col("at").alias("g"), F.col("below").alias("groups"), "above")
    tops = hold(over.join(subroots.withColumnRenamed("node", "subroot"), "g"), "tops")
    lowest = rounds[0].join(_above(rounds, tops, fanout, levels), ["g", "at"]).withColumn("root", F.lit(root["node"] if root else b""))
    found = _proofs(lowest.select("g", "at", "below", "nodes", "id", "bent", "above", "groups", "subroot", "root"), outputs, fanout, levels)
    return found.select(F.col("id").cast("long").alias(order), *outputs)


_KINDS = {"leaf": "string", "subroot": "string", "root": "string", "proof": "binary", "proof_sha256": "string", "folded_root": "string", "verified": "boolean", "place": "long", "size": "long", "group_place": "long", "groups": "long"}


def _proofs(lowest: DataFrame, outputs: tuple[str, ...], fanout: int, levels: int) -> DataFrame:
    """A row for each leaf of the lowest buckets."""
    block = fanout**levels

    def make():
        def step(r: dict) -> dict:
            out: dict[str, list] = {"id": [], **{c: [] for c in _KINDS}}
            for i, raw in enumerate(r["nodes"]):
                g, at, n, groups, above = r["g"][i], r["at"][i], r["below"][i], r["groups"][i], r["above"][i]
                subroot, root = r["subroot"][i].hex(), r["root"][i].hex()
                rows = collapse(_texts(raw), min(levels, height(n, fanout)), fanout)
                upper = shape(at, -(-n // block), fanout) + shape(g, groups, fanout)
                for j, (leaf, bent) in enumerate(zip(rows[0], r["bent"][i], strict=True)):
                    proof = siblings(rows, j, fanout) + above
                    lower = [(j // fanout**k % fanout, min(fanout, len(rows[k]) - j // fanout ** (k + 1) * fanout)) for k in range(len(rows) - 1)]
                    folded = fold(leaf if bent is None else bent.hex().encode(), proof, lower + upper).decode()
                    made = (leaf.decode(), subroot, root, proof, hashlib.sha256(proof).hexdigest(), folded, folded == root, at * block + j, n, g, groups)
                    for c, v in zip(_KINDS, made, strict=True):
                        out[c].append(v)
                out["id"].extend(r["id"][i])
            return {c: out[c] for c in ("id", *outputs)}

        return step

    return map_rows(lowest, make, "id string" + "".join(f", {c} {_KINDS[c]}" for c in outputs), 4)
