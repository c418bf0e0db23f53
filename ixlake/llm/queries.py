"""Registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ixlake.llm.common import documents
from ixlake.llm.covertree import near_vectors
from ixlake.llm.language import identify_documents
from ixlake.llm.lines import dedup_lines
from ixlake.llm.minhash import near_duplicates
from ixlake.llm.mixing import mix_documents
from ixlake.llm.packing import pack_documents
from ixlake.llm.quality import judge_documents
from ixlake.llm.secrets import scan_documents
from ixlake.llm.sharding import shard_documents
from ixlake.llm.tokenfile import round_trip
from ixlake.llm.trie import conversation_trie
from ixlake.llm.urls import judge_urls
from ixlake.llm.whitening import whiten_vectors

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words and 85 per cent, as this query is defined; the operator's defaults are 5 and 80."""
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.crc32(text.cast("binary")).alias("text_crc32"), F.length(text).cast("long").alias("n_chars")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_boilerplate_words",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op11 decide; the model's verdicts and scores are beyond SQL."""
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-number part of op13; eigenvalues are beyond SQL."""
    return op13_embedding_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_language": op8_language,
    "op9_sharding": op9_sharding,
    "op10_token_output": op10_token_output,
    "op11_url_filters": op11_url_filters,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_embedding_whitening": op13_embedding_whitening,
    "url_rules": url_rules,
    "whitening_deviation": whitening_deviation,
}
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op6_quality_rules": f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    grams AS (
      SELECT rid, unnest(range(1, len(ws) - 6)) AS pos, unnest([array_to_string(ws[i:i + 7], ' ')
        FOR i IN range(1, len(ws) - 6)]) AS gram FROM d WHERE len(ws) >= 8),
    repeats AS (
      SELECT rid, count(DISTINCT pos + k) AS n FROM (
        SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS times FROM grams),
        (SELECT unnest(range(8)) AS k) WHERE times > 1 GROUP BY rid),
    raw AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
    lines AS (
      SELECT rid, source, t, line, len(regexp_extract_all(line, '{_WORD}')) AS words,
        translate(array_to_string(regexp_extract_all(line, '{_WORD}'), ' '), '{_UPPER}', '{_LOWER}') AS norm
      FROM raw WHERE regexp_matches(line, '{_WORD}')),
    duplicates AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
    hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
    frequent AS (
      SELECT source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM lines GROUP BY source, norm) f
      WHERE n > 10 AND n * 100.0 > 1.0 * (SELECT h.n FROM hosts h WHERE h.source IS NOT DISTINCT FROM f.source)),
    gone AS (
      SELECT rid, sum(words)::BIGINT AS n FROM lines l
      WHERE EXISTS (SELECT 1 FROM frequent f WHERE f.norm = l.norm AND f.source IS NOT DISTINCT FROM l.source) GROUP BY rid),
    counted AS (
      SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        coalesce(g.n, 0)::BIGINT AS n_boilerplate_words
      FROM d LEFT JOIN duplicates u USING (rid) LEFT JOIN repeats r USING (rid) LEFT JOIN gone g USING (rid))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_boilerplate_words >= 20
        AND (n_words - n_boilerplate_words) * 100 >= 30 * n_words AS kept
    FROM counted
    """,
    "op12_conversation_trie": f"""
    WITH own AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
        sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) AS k,
        len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS w
      FROM conversations WHERE conv_id IS NOT NULL),
    conv AS (
      SELECT conv_id, n, conv_id - conv_id % 20 AS donor, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
      FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)),
    rebuilt AS (
      SELECT c.conv_id, pos - h + least(h, coalesce(d.n, 0)) AS pos, k, w
      FROM own JOIN conv c USING (conv_id) LEFT JOIN (SELECT conv_id AS donor, n FROM conv) d USING (donor) WHERE pos >= h
      UNION ALL
      SELECT c.conv_id, pos, k, w FROM conv c JOIN own ON own.conv_id = c.donor AND pos < h),
    paths AS (
      SELECT conv_id, coalesce(list(k ORDER BY pos) FILTER (WHERE k IS NOT NULL), []) AS ks,
        coalesce(list(w ORDER BY pos) FILTER (WHERE k IS NOT NULL), []) AS ws
      FROM conv LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
    members AS (SELECT conv_id, len(ks) AS size, unnest(range(len(ks) + 1)) AS depth, ks, ws FROM paths),
    nodes AS (
      SELECT ks[:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        min(CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END) AS w,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends
      FROM members GROUP BY ALL),
    children AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    known AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
    totals AS (
      SELECT path[:up] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
        sum((n_convs - 1) * w)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS up FROM known) GROUP BY 1)
    SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens,
      sha256(k.ends) AS ends_sha256
    FROM known k JOIN totals USING (path) LEFT JOIN known p ON k.depth > 0 AND p.path = k.path[:k.depth - 1]
    """,
    "url_rules": f"""
    SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END AS verdict
    FROM (SELECT page_id, host, path, CASE
        WHEN ('.' || host).ends_with('.example.org') AND path.starts_with('/es/') THEN 'example.org/es/'
        WHEN ('.' || host).ends_with('.example.org') AND path.starts_with('/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host).ends_with('.com') AND path.starts_with('/fr/') THEN 'com/fr/'
        WHEN ('.' || host).ends_with('.com') AND path.starts_with('/de/') THEN 'com/de/'
        WHEN ('.' || host).ends_with('.org') AND path.starts_with('/') THEN 'org/' END AS rule
      FROM (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages)))
    """,
    "whitening_deviation": """
    WITH kept AS (
      SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT + 100000) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    sums AS (SELECT list(s ORDER BY pos) AS s, max(n) AS n FROM (
      SELECT pos, sum(v) AS s, count(*) AS n FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM kept) GROUP BY pos))
    SELECT vec_id, n, list_sum(list_transform(list_zip(x, s), lambda z: (n * z[1] - z[2]) * (n * z[1] - z[2])))::BIGINT AS deviation
    FROM kept, sums
    """,
}
