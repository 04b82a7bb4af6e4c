"""The registered queries of the corpus operators: production parameters, whole tables, whole results."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import decontam, linededup, merkle, packing, quality, rules, simhash, suffixes, tokenfiles, toxicity, whitening
from terrace.llm.common import table
from terrace.llm.pii import pseudonymise
from terrace.llm.rules import quality_rules
from terrace.llm.sharding import shard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("op1_edit_join_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), short=True)


@query("op2_hilbert_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_hilbert_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)


@query("op4_template_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_golay_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_trie_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op7_elias_fano_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    """The same counts with lists and windows; SQL meets every n-gram, not only those that may repeat."""
    over = " OR ".join(f"coalesce(c{n}, 0) > {v}::DOUBLE * greatest(1, word_chars)" for n, v in rules.LIMITS.items())
    each = ", ".join(f"coalesce(max(chars) FILTER (WHERE n = {n}), 0) AS c{n}" for n in rules.LIMITS)
    most = ", ".join(f"coalesce(c{n}, 0)" for n in rules.LIMITS)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    b AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(ls), lambda x: length(x))), 0) AS BIGINT) AS line_chars FROM w),
    g AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([{', '.join(map(str, rules.LIMITS))}]) AS n))),
    r AS (SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
    p AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS pos FROM r),
    s AS (SELECT doc_id, n, count(*) AS k, sum(length(ws[pos])) AS chars FROM p JOIN w USING (doc_id) GROUP BY ALL),
    c AS (SELECT doc_id, coalesce(max(k) FILTER (WHERE n = 8), 0) AS n_repeat_words, {each} FROM s GROUP BY doc_id),
    a AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, {', '.join(f'c{n}' for n in rules.LIMITS)} FROM b LEFT JOIN c USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR line_chars > {rules.LINE_LIMIT}::DOUBLE * greatest(1, word_chars) OR {over}) AS kept,
      line_chars, CAST(greatest({most}) AS BIGINT) AS repeat_chars FROM a"""


@query("op8_repetition_rules", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op9_byte_convnet_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


#: Names the key of the pseudonyms in the session's settings.
PII_KEY = "spark.terrace.pii.key"


@query("op10_feistel_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for every validated value. Where the session names no key, it gets one that nobody
    knows: values stay linked within the session, and nobody can undo them."""
    if spark.conf.get(PII_KEY, None) is None:
        spark.conf.set(PII_KEY, secrets.token_hex(32))
    out = pseudonymise(table(spark, sf_dir, "documents"), key=spark.conf.get(PII_KEY))
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_values"), "pii_kinds")


@query("op11_incremental_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_difference_cover_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))
