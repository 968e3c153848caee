"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotquery.llm.common import prepare, table
from lotquery.llm.decontam import find_contamination
from lotquery.llm.exact_dedup import exact_dedup
from lotquery.llm.html_extract import extract_pages
from lotquery.llm.langid import identify_languages
from lotquery.llm.line_dedup import line_dedup
from lotquery.llm.mixing import MAX_REPETITION, mix_sources
from lotquery.llm.near_dedup import near_dedup
from lotquery.llm.periodic_runs import periodic_runs, run_digests
from lotquery.llm.quality import score_quality
from lotquery.llm.sharding import shard_documents
from lotquery.llm.token_counts import count_tokens
from lotquery.llm.token_output import token_output
from lotquery.llm.whitening import whiten

#: Vocabulary of the token counts.
COUNTED_BY = "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(corpus_pipeline.TOKENIZER))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), "mix_pass", "mix_block", "mix_key")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whiten(table(spark, sf_dir, "embeddings"))


def plant_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting of a tenth of the documents: from a word on,
    the words that follow repeat with a period; both come from the id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), plant_repeats))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED_BY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_output": op6_token_output,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS owner FROM (SELECT DISTINCT k, doc_id FROM keyed WHERE length(k) >= 40)
  GROUP BY k HAVING count(*) >= 5),
marked AS (
  SELECT keyed.doc_id, i, line, often.k IS NOT NULL AND often.owner <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_source_mixing": f"""
WITH RECURSIVE narrow AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS mix_tokens,
         md5(coalesce(text, '')) AS body FROM documents),
sources AS (SELECT source, sum(mix_tokens) AS tokens FROM narrow GROUP BY source),
bisect AS (
  SELECT -1 AS low, {1 << 20} AS high
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE middle END, CASE WHEN ok THEN middle ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS middle,
               (SELECT max(power(tokens / (SELECT max(tokens) FROM sources), ((b.low + b.high) // 2) / {float(1 << 20)!r} - 1))
                FROM sources WHERE tokens > 0) <= {MAX_REPETITION!r} AS ok
        FROM bisect b WHERE high - low > 1)),
fit AS (SELECT min(high) / {float(1 << 20)!r} AS a FROM bisect),
weights AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN power(tokens, a) ELSE 0 END
         / (SELECT sum(power(tokens, a)) FROM sources WHERE tokens > 0) AS weight
  FROM sources, fit),
quotas AS (
  SELECT source, tokens, weight, CAST(round(weight * (SELECT max(tokens / weight) FROM weights WHERE tokens > 0)) AS BIGINT) AS quota
  FROM weights),
plan AS (
  SELECT source, weight, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS full_passes,
         CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM quotas),
last_pass AS (
  SELECT *, sum(mix_tokens) OVER (PARTITION BY source ORDER BY k) - sum(mix_tokens) OVER (PARTITION BY source, k) AS before
  FROM (SELECT n.*, weight, full_passes, rest, md5(concat(full_passes, '|', doc_id, '|', body)) AS k
        FROM narrow n JOIN plan p ON n.source IS NOT DISTINCT FROM p.source)),
copies AS (
  SELECT *, unnest(generate_series(0, CAST(full_passes AS BIGINT) - (CASE WHEN before < rest THEN 0 ELSE 1 END))) AS mix_pass
  FROM last_pass)
SELECT doc_id, source, mix_tokens, round(weight, 6) AS mix_weight, mix_pass,
       substr(md5(concat(mix_pass, '|', doc_id, '|', body)), 1, 3) AS mix_block,
       md5(concat(mix_pass, '|', doc_id, '|', body)) AS mix_key
FROM copies
""",
    "op9_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 4))) AS i) WHERE len(w) > 0),
sizes AS (SELECT words.doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY words.doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 85 * (x.n + y.n - m)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM edges UNION SELECT node, b FROM reach JOIN edges ON a = other),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sizes LEFT JOIN least ON node = doc_id
""",
    "op3_decontamination": r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS wide, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS phrase
  FROM item_words, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, i, wide, list_aggregate(w[i:i + wide - 1], 'string_agg', ' ') AS phrase
  FROM words, (SELECT DISTINCT wide FROM windows), LATERAL (SELECT unnest(generate_series(1, len(w) - wide + 1)) AS i)),
found AS (SELECT doc_id, i, places.wide, item_id FROM places JOIN windows USING (phrase, wide)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + wide - 1)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
