"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A text's set of shingles gets a signature of 48 components of 12 bits. It is cut
into 12 chunks of 4 components; by the pigeonhole principle two signatures that
differ in at most 23 components differ in at most one component of some chunk,
so each chunk is indexed four times, with one component left out, and every pair
under that distance meets. (Sets with Jaccard 0.8 differ in 9.6 components on
average; more than 23 in about one of 300,000 pairs.) Pairs that meet are
confirmed on their full sets.

Texts with equal sets are one class and enter once. Classes that meet are first
linked to the nearest of their buckets' smallest members, so a large group of near
copies collapses to few components before anything is compared twice; the
remaining pairs, those between different components, are then confirmed, each at
the first chunk where it meets: no bucket's pairs are written out, no link is lost,
and large buckets are dealt to blocks. A bucket's rows of the component that has most
of them don't meet each other, and no two sets meet of which one shares too few shingles
with all others together.

Defined results: null, empty and blank texts have the empty set, link with nothing
and keep themselves; fewer words than a shingle are one shingle; equal texts and
repeated rows share a class; a row with a null doc_id is in its class's component
(null, and kept, if no row of the class has an id); rows that share a doc_id count
as one node, linked with whatever one of their texts is linked with; very long texts
enter whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import FENCE, copied, dealt, documents, fenced, hold, hot_keys, map_rows
from leafmark.llm.graph import components

CHUNKS, LANES, LANE_BITS = 12, 4, 12
#: The distance (differing components) under which every pair meets.
MAX_DISTANCE = 2 * CHUNKS - 1
#: The first bit of each chunk, in numbers that have a bit for each component.
_FIRSTS = sum(1 << (LANES * i) for i in range(CHUNKS))
_SEEDS = np.random.default_rng(20260).integers(1, 2**63, (CHUNKS * LANES, 2), dtype=np.uint64) | np.uint64(1)
_XOR, _ODD = _SEEDS[:, :1].copy(), _SEEDS[:, 1:].copy()
#: Shingles that are hashed at once.
AT_ONCE = 1024
#: Word hashes that a worker remembers; rows of a bucket that one block holds; classes of at
#: least one in so many rows are broadcast; sets in a component's buckets whose pairs are all compared.
CACHED_WORDS, BLOCK_ROWS, HOT_SHARE, LARGE_ROWS = 500_000, 4096, 1000, 256


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased)."""
    words = (text or "").encode().lower().split()  # white space of bytes: 09 to 0D and 20
    h = _mix(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    n = max(1, len(h) - size + 1) if len(h) else 0
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += h[i : i + n]
    found = _mix(total)
    found.sort()
    new = np.ones(n, bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def signature(found: np.ndarray) -> list[int]:
    """One packed long for each chunk; the least of each of 48 hashes of the set."""
    least = np.full(CHUNKS * LANES, np.iinfo(np.uint64).max)
    for at in range(0, len(found), AT_ONCE):  # all hashes of a part of the set at once
        h = found[at : at + AT_ONCE] ^ _XOR
        h *= _ODD
        np.minimum(least, h.min(1), out=least)
    least = _mix(least) >> np.uint64(64 - LANE_BITS)
    return (least.reshape(CHUNKS, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(LANE_BITS))).sum(1).astype(np.int64).tolist()


def planes(sig: list[int]) -> list[int]:
    """The same signature as longs with a bit for each component, one for each place of a bit."""
    lanes = (np.array(sig, np.int64)[:, None] >> (np.arange(LANES) * LANE_BITS)).reshape(-1)
    bits = lanes >> np.arange(LANE_BITS)[:, None] & 1
    return (bits << np.arange(CHUNKS * LANES)).sum(1).tolist()


def _first_name(found: np.ndarray) -> int:
    return int(_mix(found.copy()).sum().astype(np.int64))


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits that name the set), sig and planes of every text."""

    def make():
        def step(rows: dict) -> dict:
            sets = [shingle_set(t, size) for t in rows["text"]]
            with np.errstate(over="ignore"):
                sigs = [signature(s) if len(s) else None for s in sets]
                return {
                    "doc_id": rows["doc_id"],
                    "n": [len(s) for s in sets],
                    "s1": list(map(_first_name, sets)),
                    "s2": [int(_mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64)) for s in sets],
                    "sig": sigs,
                    "planes": [planes(s) if s else None for s in sigs],
                }

        return step

    return map_rows(documents(docs, id_col, text_col), make, "doc_id long, n long, s1 long, s2 long, sig array<long>, planes array<long>")


def _plain(places: DataFrame) -> DataFrame:
    """The same rows with columns that can't be null: the joins' conditions are then
    short enough to be compiled, at a tenth of the cost."""
    zero = F.lit(0).cast("long")
    plain = {c: F.coalesce(F.col(c).cast("long"), zero) for c in places.columns if c not in ("key", "shingles")}
    empty = F.array().cast("array<bigint>")
    return places.withColumns(plain | ({"shingles": F.coalesce("shingles", empty)} if "shingles" in places.columns else {}))


def _differ(a: str, b: str) -> Column:
    """A bit for each component in which two signatures differ."""
    each = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in _PLANES]
    return reduce(Column.bitwiseOR, each)


def _close(a: str, b: str, least: int) -> Column:
    """Sizes that a pair of the wanted likeness can have, and signatures under the distance."""
    sizes = (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * least)
    return sizes & (F.bit_count(_differ(a, b)) <= MAX_DISTANCE)


def _first_meeting(a: str, b: str) -> Column:
    """True where the bucket is the first, of all that a pair shares: each chunk before has two
    differing components or more, and the one left out differs, or none does and it is the first."""
    d, bucket = _differ(a, b), F.col(f"{a}.bucket")
    d1, d2, d3 = (F.shiftright(d, i) for i in (1, 2, 3))
    two = d.bitwiseOR(d1).bitwiseAND(d2.bitwiseOR(d3)).bitwiseOR(d.bitwiseAND(d1)).bitwiseOR(d2.bitwiseAND(d3))
    start = F.call_function("shiftleft", F.lit(1).cast("long"), (bucket - bucket % LANES).cast("int"))
    before = F.bitwise_not(two).bitwiseAND(_FIRSTS).bitwiseAND(start - 1) == 0
    return before & ((bucket % LANES == 0) | (d.bitwiseAND(start * ((1 << LANES) - 1)) != 0))


def _both(a: str, b: str) -> Column:
    return F.size(F.array_intersect(F.col(f"{a}.shingles"), F.col(f"{b}.shingles"))).cast("long")


def _alike(a: str, b: str, least: int) -> Column:
    return _both(a, b) * (100 + least) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * least  # the intersection is made once


def _confirmed(met: DataFrame, least: int) -> DataFrame:
    """(a, b), the components of the pairs ``met`` whose sets are alike. The sets are compared
    in a projection of their own: within the join's condition that loop would be part of a
    method too long for the JVM's compiler, and several times slower."""
    named = met.select(F.col("x.component").alias("a"), F.col("y.component").alias("b"), _both("x", "y").alias("both"), _alike("x", "y", least).alias("alike"))
    return fenced(named).filter((F.col(FENCE) >= 0) & F.col("alike") & (F.col("both") > 0)).select("a", "b")


def _halves(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join of places within their buckets: each row of the first meets all
    rows of its bucket in the second, once. A bucket of more than ``BLOCK_ROWS`` rows is
    dealt to blocks: the first side's rows have one each, the second side's go to all."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    return places.withColumn("block", block).alias("x"), places.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("y")


def _met() -> Column:
    same = F.lit(True)
    for c in ("bucket", "key", "block"):
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return same


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component; ``guest`` is 0 for the rows of
    the component that has most of a bucket's rows, which never meet each other, else 1."""
    each = placed.groupBy("bucket", "key", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = each.groupBy("bucket", "key").agg(F.max_by("component", "rows").alias("main"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    found = placed.drop("guest", "main").join(main.select("bucket", "key", "main"), ["bucket", "key"])
    return found.withColumn("guest", (F.col("component") != F.col("main")).cast("long"))


def _fit(sets: DataFrame, least: int) -> DataFrame:
    """(rep, s1, m) of the sets that some other of ``sets`` can be like; m is how many of a
    set's shingles others have too. No intersection has more, so a set is like no other
    if that is too few: near copies that differ too much from all others need no pairs."""
    each = sets.select("rep", "s1", F.explode("shingles").alias("shingle"))
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("rep").alias("rep"), F.min("s1").alias("s1")).filter("sets = 1")
    alone = once.groupBy("rep", "s1").agg(F.count(F.lit(1)).alias("alone"))
    m = F.col("n") - F.coalesce("alone", F.lit(0))
    return sets.join(alone, ["rep", "s1"], "left").filter(m * 100 >= F.col("n") * least).select("rep", "s1", m.alias("m"))


def _enough(a: str, b: str, least: int) -> Column:
    """Whether the smaller ``m`` of two sets is an intersection that makes them alike."""
    return F.least(f"{a}.m", f"{b}.m") * (100 + least) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * least


def _size_class(n: Column) -> Column:
    """Set sizes in steps of about a hundredth."""
    return F.floor(F.log2(n) * 64).cast("int")


def _profiles(placed: DataFrame, sets: DataFrame, large: DataFrame, least: int) -> DataFrame:
    """For each set and each of its ``large`` main components: ``common``, how many of its
    shingles are common, that is, stand in more than a sixteenth of the largest component's sets
    (256 at the least), and ``others``, those of its other shingles, the rarest first, that a second
    set has too. Sets of a pair that share none of the latter have no more in common than the
    smaller ``common``; the last few are left out, as far as a pair must share more of them."""
    of = placed.join(large, "main").select("main", "rep", "s1", "n", "m", "component", *_PLANES).distinct()
    of = hold(of, "large")
    many = max(LARGE_ROWS, large.agg(F.max("total")).first()[0] // 16)
    big = hold(sets.join(of.select("rep", "s1").distinct(), ["rep", "s1"], "left_semi"), "big")
    each = big.select("rep", "s1", F.explode("shingles").alias("shingle"))
    counted = hold(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("rep").alias("rep"), F.min("s1").alias("s1")).filter(F.col("sets") <= many), "counted")
    alone = counted.filter("sets = 1").groupBy("rep", "s1").agg(F.count(F.lit(1)).alias("alone"))
    rare = each.join(counted.filter("sets > 1").select("shingle", "sets"), "shingle")
    rare = rare.groupBy("rep", "s1").agg(F.transform(F.sort_array(F.collect_list(F.struct("sets", "shingle"))), lambda x: x["shingle"]).alias("others"))
    found = of.join(alone, ["rep", "s1"], "left").join(rare, ["rep", "s1"], "left")
    found = found.withColumn("few", F.when(F.col("others").isNull(), 0).otherwise(F.size("others")).cast("long"))
    found = found.withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)) - F.col("few")).drop("alone")
    # A like set has least/100 of the shingles at the least, and the intersection as many of both.
    smallest = F.ceil(F.col("n") * least / 100)
    must = F.greatest(F.lit(1), F.ceil((F.col("n") + smallest) * least / (100 + least)) - F.col("common"))
    first = F.slice("others", F.lit(1), F.greatest(F.lit(0), F.col("few") - must + 1).cast("int"))
    return found.withColumn("others", first)


def _hubs(profiles: DataFrame, sets: DataFrame) -> DataFrame:
    """Each set of another component beside the set of the main one that has most of the
    common shingles, with their sets: what is like that needs no other pairs with its component."""
    central = F.struct("common", -F.col("few"), -F.col("rep"), "s1")
    hubs = profiles.filter("component = main").groupBy("main").agg(F.max_by(F.struct("rep", "s1"), central).alias("h")).select("main", "h.rep", "h.s1")
    full = lambda rows: rows.join(sets.select("rep", "s1", "n", "shingles"), ["rep", "s1"])
    guests = profiles.filter("component <> main").select("main", "rep", "s1", "component")
    hot = hot_keys(guests, "main")
    y = copied(full(hubs), hot, "main").withColumn("component", F.col("main")).alias("y")
    return dealt(full(guests), hot, "main", "rep").alias("x").join(y, (F.col("x.main") == F.col("y.main")) & (F.col("x.salt") == F.col("y.salt")))


def _across(profiles: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs of ``profiles``, of different components, that can be alike, with their sets:
    those that share one of the ``others``, and those alike enough without. The second kind
    are few: a set that isn't like the main component's can be so only to a smaller one,
    so its partners are looked for by their sizes."""
    x, y = profiles.alias("x"), profiles.alias("y")
    need = (F.col("x.n") + F.col("y.n")) * least
    common = F.least("x.common", "y.common")
    fits = (F.col("x.main") == F.col("y.main")) & _enough("x", "y", least) & _close("x", "y", least)
    named = [F.col("x.component").alias("a"), F.col("y.component").alias("b"), *(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "xy" for c in ("rep", "s1"))]

    shared = [profiles.withColumn("shingle", F.explode("others")).drop("others").alias(t) for t in "xy"]
    some = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & ((common + F.least("x.few", "y.few")) * (100 + least) >= need)
    sharing = shared[0].join(shared[1], fits & some).select(*named)

    n = F.col("n")
    top = F.floor(F.col("common") * (100 + least) / least) - n
    bottom = F.ceil(n * least / 100)
    guests = profiles.filter((F.col("component") != F.col("main")) & (top >= bottom)).drop("others")
    x = guests.withColumn("class", F.explode(F.sequence(_size_class(bottom), _size_class(top)))).alias("x")
    y = profiles.drop("others").withColumn("class", _size_class(n)).alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.component") < F.col("y.component"))
    alone = (F.col("x.class") == F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & once & (common * (100 + least) >= need)
    pairs = hold(sharing.unionByName(x.join(y, fits & alone).select(*named)).distinct(), "pairs")

    ends = [sets.select("rep", "s1", "n", "shingles").alias(t) for t in "xy"]
    same = lambda t: (F.col(f"p.{t}_rep") == F.col(f"{t}.rep")) & (F.col(f"p.{t}_s1") == F.col(f"{t}.s1"))
    met = pairs.alias("p").join(ends[0], same("x")).join(ends[1], same("y"))
    side = lambda t, c: F.struct(F.col(f"p.{c}").alias("component"), *(F.col(f"{t}.{k}").alias(k) for k in ("n", "shingles"))).alias(t)
    return met.select(side("x", "a"), side("y", "b"))


def groups(docs: DataFrame, size: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Two rows are linked when 100 * intersection >= ``least`` * union of their sets
    of ``size``-word shingles.
    """
    rows = hold(signatures(docs, size, id_col, text_col), "signatures")
    filled = rows.filter("n > 0")
    # One row for each distinct set, named by its smallest doc_id.
    classes = filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    members = filled.filter("doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "sig", "planes")).alias("m"))
    nodes = members.select(F.col("m.doc_id").alias("rep"), "s1", F.col("m.n").alias("n"), F.col("m.sig").alias("sig"), *[F.get("m.planes", F.lit(i)).alias(c) for i, c in enumerate(_PLANES)])
    nodes = hold(nodes, "nodes")

    lane_off = [~(((1 << LANE_BITS) - 1) << (LANE_BITS * j)) & ((1 << (LANE_BITS * LANES)) - 1) for j in range(LANES)]
    keys = [
        F.struct(F.lit(i * LANES + j).alias("bucket"), F.get("sig", F.lit(i)).bitwiseAND(F.lit(off)).alias("key"))
        for i in range(CHUNKS)
        for j, off in enumerate(lane_off)
    ]
    places = nodes.select("rep", "s1", F.explode(F.array(*keys)).alias("k")).select("rep", "s1", "k.bucket", "k.key")
    shared = places.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = shared.select("bucket", "key", F.ceil(F.col("size") / BLOCK_ROWS).cast("long").alias("blocks"))
    places = _plain(hold(places.join(shared, ["bucket", "key"]).join(nodes.drop("sig"), ["rep", "s1"]), "places"))

    # Places with some partner under the distance; the others need no set.
    x, y = _halves(places)
    apart = _met() & (F.col("x.rep") != F.col("y.rep"))
    places = _plain(hold(x.join(y, apart & _close("x", "y", least), "left_semi").drop("block"), "meeting"))

    wanted = places.select("rep", "s1").distinct()
    texts = documents(docs, id_col, text_col).join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = hold(_sets(texts, size).join(wanted, ["rep", "s1"], "left_semi").dropDuplicates(["rep", "s1"]), "sets")

    # The nearest of the smallest members of a node's buckets.
    heads = places.groupBy("bucket", "key").agg(F.min("rep").alias("head"))
    h = hold(places.join(heads, ["bucket", "key"]).filter("rep <> head").select("rep", "n", *_PLANES, "head").distinct(), "heads")
    # A large group's rows have one head, and then one neighbour: they are dealt to parts.
    hot = hot_keys(h, "head")
    y = copied(nodes.withColumn("head", F.col("rep")), hot, "head").alias("y")
    pairs = dealt(h, hot, "head", "rep").alias("x").join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.salt") == F.col("y.salt"))).filter(_close("x", "y", least))
    best = pairs.groupBy(F.col("x.rep").alias("a")).agg(F.min(F.struct(F.bit_count(_differ("x", "y")).alias("d"), F.col("y.rep").alias("b"))).alias("o"))
    near = hold(best.select("a", F.col("o.b").alias("b")), "near")
    hot = hot_keys(near, "b")
    left = dealt(near, hot, "b", "a").join(sets.alias("x"), F.col("a") == F.col("x.rep"))
    right = copied(sets.withColumn("b", F.col("rep")), hot, "b").select(F.col("b").alias("of"), F.col("salt").alias("part"), "rep", "s1", "n", "shingles").alias("y")
    stars = hold(left.join(right, (F.col("b") == F.col("of")) & (F.col("salt") == F.col("part"))).filter(_alike("x", "y", least)).select("a", "b"), "stars")
    merged = components(stars)

    # What is left: pairs whose ends are still in different components.
    own = F.coalesce("component", "rep").alias("component")
    placed = places.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "s1", "bucket", "key", "blocks", "n", *_PLANES, own)
    placed = _mixed(hold(placed, "placed"))
    fit = hold(_fit(sets.join(placed.select("rep", "s1").distinct(), ["rep", "s1"], "left_semi"), least), "fit")
    placed = _plain(hold(_mixed(placed.join(fit, ["rep", "s1"])), "mixed"))
    # The sets that meet a large component are told apart by what they don't have in common with it.
    large = placed.select("main", "rep", "s1").distinct().groupBy("main").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") > LARGE_ROWS)
    large, found = hold(large, "mains"), stars
    if not large.isEmpty():
        profiles = hold(_profiles(placed, sets, large, least), "profiles")
        near = hold(_confirmed(_hubs(profiles, sets), least).distinct(), "hubs")
        main = profiles.join(near.select(F.col("a").alias("component"), F.col("b").alias("main"), F.lit(True).alias("in")), ["component", "main"], "left")
        profiles = main.withColumn("component", F.when(F.col("in"), F.col("main")).otherwise(F.col("component"))).drop("in")
        found = found.unionByName(near).unionByName(_confirmed(_across(hold(profiles, "guests"), sets, least), least))
        placed = placed.join(large.select("main"), "main", "left_anti")
    # A guest meets all rows of its bucket, the others meet the guests.
    x, y = _halves(placed.withColumn("side", F.col("guest")))[0], _halves(placed.withColumn("side", F.explode(F.sequence(1 - F.col("guest"), F.lit(1).cast("long")))))[1]
    apart = _met() & (F.col("x.side") == F.col("y.side")) & (F.col("x.component") != F.col("y.component"))
    open_ = x.join(y, apart & _enough("x", "y", least) & _close("x", "y", least) & _first_meeting("x", "y"), "left_semi").drop("block", "side")
    open_ = _plain(hold(open_.join(sets.select("rep", "s1", "shingles"), ["rep", "s1"]), "open"))
    x, y = _halves(open_.filter("guest = 1"))[0], _halves(open_)[1]
    across = _met() & ((F.col("y.guest") == 0) | (F.col("x.component") < F.col("y.component")))
    links = _confirmed(x.join(y, across & _enough("x", "y", least) & _close("x", "y", least) & _first_meeting("x", "y")), least)
    joined = components(found.unionByName(links.distinct()))

    labels = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "rows", F.coalesce("component", "rep").alias("component"))
    return _labelled(rows.select("doc_id", "n", "s1", "s2"), hold(labels, "labels"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row with its class's component. Classes of a thousandth of all rows or more (a
    thousand at most, by counting) are broadcast, so that no task gets all their rows."""
    total = labels.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_hot = F.col("rows") * HOT_SHARE >= total
    hot = labels.filter(is_hot).select("s1", "s2", F.lit(True).alias("hot"), "component")
    marked = rows.join(F.broadcast(hot), ["s1", "s2"], "left")
    rest = marked.filter("hot is null").drop("hot", "component").join(labels.filter(~is_hot).select("s1", "s2", "component"), ["s1", "s2"], "left")
    found = marked.filter("hot").drop("hot").unionByName(rest)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


_PLANES = [f"p{i}" for i in range(LANE_BITS)]


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def make():
        def step(rows: dict) -> dict:
            sets = [shingle_set(t, size) for t in rows["text"]]
            with np.errstate(over="ignore"):
                return {"rep": rows["doc_id"], "s1": list(map(_first_name, sets)), "n": [len(s) for s in sets], "shingles": [s.astype(np.int64) for s in sets]}

        return step

    return map_rows(texts, make, "rep long, s1 long, n long, shingles array<long>")


def keep_one(docs: DataFrame, size: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns as they were; rows that repeat the
    kept document's id stay with it, and rows without an id stay."""
    gone = groups(docs, size, least, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
