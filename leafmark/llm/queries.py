"""Registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import bpe, divergence, fingerprint, langid, licenses, linededup, lmscore, manifest, neardup, packing, piecebpe, quality, toxicity
from leafmark.llm.common import crc_mod, lower_az


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_docs(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(_docs(spark, sf_dir), path, public_tokenizers.PATTERN, ("ids_sha256", "decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir)).drop("spans")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_docs(spark, sf_dir))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_docs(spark, sf_dir), size=4, least=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.predict(docs, model)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_docs(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return manifest.audit(docs, changed={"text": lower_az(docs["text"])}, where=crc_mod(docs["doc_id"], 5) == 0)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``agrees``: whether the library gives the same ids and text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piecebpe.encode(_docs(spark, sf_dir), path, ("ids_sha256", "decoded_sha256", "agrees"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_source_divergence": op13_source_divergence,
}

_LINE_OK = f"""(regexp_matches(l, '{quality.SENTENCE_END.replace("'", "''")}')
      AND len(regexp_extract_all(l, '{quality.SHOUT}')) * {quality.MARK_CHARS} <= length(l)
      AND len(regexp_extract_all(l, '{quality.SEPARATOR}')) * {quality.MARK_CHARS} <= length(l)
      AND NOT (length(l) <= {quality.MENU_CHARS} AND regexp_matches(l, '{quality.MENU}'))
      AND NOT (length(l) <= {quality.BOILERPLATE_CHARS} AND regexp_matches(l, '{quality.BOILERPLATE}')))"""



def _merkle_sql(levels: int = 7, fanout: int = manifest.FANOUT) -> str:
    """Both trees level by level, ``levels`` high: up to 16^7 rows a source and sources.

    ``u{i}`` has the nodes of level i over the rows, ``v{i}`` those over the subroots;
    ``a`` and ``z`` are the siblings before and after a node in its run.
    """

    def tree(t: str) -> str:
        out = []
        for i in range(levels):
            run = f"(PARTITION BY g, p // {fanout} ORDER BY p ROWS BETWEEN"
            out.append(f"""{t}s{i} AS MATERIALIZED (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS z FROM {t}{i})""")
            out.append(f"""{t}{i + 1} AS MATERIALIZED (SELECT g, p // {fanout} AS p, (max(n) + {fanout - 1}) // {fanout} AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE max(h) END AS h
  FROM {t}{i} GROUP BY g, p // {fanout})""")
        return ",\n".join(out)

    def climb(t: str, before: str, place: str, names: str) -> str:
        out = []
        for i in range(levels):
            out.append(f"""{t}c{i} AS MATERIALIZED (SELECT {names}, c.proof || coalesce(s.a || s.z, '') AS proof, CASE WHEN s.n > 1 THEN sha256(s.a || c.f || s.z) ELSE c.f END AS f
  FROM {before} c JOIN {t}s{i} s ON s.g = {"c.g" if t == "u" else "0"} AND s.p = {place} // {fanout**i})""")
            before = f"{t}c{i}"
        return ",\n".join(out)

    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    bits = "list_reduce(list_prepend(xor(x, y), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: {bits})"
    names = "c.k, c.g, c.p, c.doc_id, c.leaf"
    return f"""
WITH l AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bent FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER () AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM l),
u0 AS (SELECT g, p, n, leaf AS h FROM r),
{tree("u")},
v0 AS (SELECT 0 AS g, g AS p, count(*) OVER () AS n, h FROM u{levels}),
{tree("v")},
start_ AS (SELECT k, g, p, doc_id, leaf, '' AS proof, coalesce(bent, leaf) AS f FROM r),
{climb("u", "start_", "c.p", names)},
{climb("v", f"uc{levels - 1}", "c.g", names)}
SELECT doc_id, leaf, u{levels}.h AS subroot, v{levels}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = v{levels}.h AS verified
FROM vc{levels - 1} c JOIN u{levels} USING (g) CROSS JOIN v{levels}"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, doc_id, text,
        list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram, len(words) AS n
      FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM p)),
f AS (SELECT rid, i, i <= n - 2 AND count(CASE WHEN i <= n - 2 THEN 1 END) OVER (PARTITION BY rid, gram) >= 2 AS hit FROM g),
c AS (SELECT rid, max(hit::int) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM f),
r AS (SELECT rid, sum(covered) AS n_repeat FROM c GROUP BY rid),
m AS (SELECT p.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) AS all_chars,
        coalesce(list_sum(list_transform(list_filter(lines, lambda l: {_LINE_OK}), lambda l: length(l))), 0) AS ok_chars
      FROM p LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(ok_chars::DOUBLE / nullif(all_chars, 0), 0.0) AS kept_share,
  NOT base_failed AND ok_chars >= all_chars * {quality.MIN_KEPT_SHARE}::DOUBLE AS kept
FROM b""",
    "op11_merkle_manifest": _merkle_sql(),
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {divergence.LEAST_DOCS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + {divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + {divergence.PRIOR}) // (g.n + {divergence.PRIOR} * v.v) AS p,
  1 + {divergence.SCALE}::HUGEINT * (kept.total + {divergence.PRIOR}) // (v.n + {divergence.PRIOR} * v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= {divergence.TOP}""",
}
