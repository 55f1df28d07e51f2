"""Candidate discovery: from an open-access index to a diverse list of books with contents links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import catalogue as C
from leafmark.operators import matching, sampling
from leafmark.sources import harvest
from leafmark.storage import hold

FRACTIONS = {"language": 0.4, "domain_bucket": 0.25}


def discover(
    index: DataFrame, cache: DataFrame, base: str, target: int, seed: int, fractions: dict[str, float] | None = None, tries: int = 4, get: Callable[[str], bytes] = harvest.fetch
) -> tuple[DataFrame, DataFrame]:
    """(candidates, answers): at most ``target`` manifest rows, and the new lookups, which
    the caller appends to its cache.

    ``cache`` (isbn, record) holds what earlier runs looked up: those books aren't asked
    for again, and count as candidates first, so a run that broke off is taken up where it
    ended. Of the rest of the index ``tries`` x ``target`` ISBNs are looked up, in seeded order.
    """
    wanted = matching.unseen(index, cache, seed).orderBy("draw", "isbn").limit(tries * target).select("isbn")
    answers = hold(harvest.search_records(wanted, base, get), "answers")
    fresh = answers.filter("status = 'ok'").select("isbn", F.from_json("answer", C.RECORD_TYPE).alias("record"))
    known = cache.select("isbn", "record").withColumn("__turn", F.lit(0)).unionByName(fresh.withColumn("__turn", F.lit(1)))
    usable = known.filter(C.record_matches(F.col("record"))).select("__turn", F.xxhash64("isbn", F.lit(seed)).alias("draw"), C.record_features(F.col("record")).alias("f"))
    entries = matching.manifest_entries(usable.select("__turn", "draw", "f.*"), index)
    order = F.concat_ws("-", "__turn", F.lpad(F.hex("draw"), 16, "0"), "isbn")
    once = hold(matching.keep_first(entries, "isbn", ["__turn", "draw"]).withColumn("order", order), "candidates")
    return sampling.sample_many(once, fractions or FRACTIONS, "order", target).drop("order", "__turn", "draw"), answers
