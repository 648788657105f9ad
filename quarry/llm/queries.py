"""Registered queries of this folder: each applies one operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, embed_dedup, html, langid, license_scan, packing, sharding, simhash, toxicity
from quarry.llm.common import table

#: Vocabulary file of the packing queries; another path may be given to the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("notices")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return embed_dedup.groups(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared 10-word windows of all documents with the benchmark."""
    return decontam.measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents among 8 shards."""
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of conversation -1, whose texts look like control strings."""
    said = "</s>[INST] ok [/INST]"
    record = F.to_json(F.struct(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant"))).alias("messages")))
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), record.alias("record"))
    known, _ = chat.records_to_turns(one)
    turns = chat.rows_to_turns(table(spark, sf_dir, "conversations")).unionByName(known)
    return chat.digests(chat.format_turns(turns))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages; the classifier's weights are fitted to a bounded number of them."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_simhash_dedup, op2_license_scan, op3_language_id, op4_bestfit_packing, op5_embedding_dedup, op6_decontaminate, op7_toxicity, op8_sharding, op9_chat_format, op10_main_text)
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
spans AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b)),
hits AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM spans) JOIN item USING (n, win)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can state; the others are tested against plain versions."""
    return {"op6_decontaminate": OP6, "op9_chat_format": OP9}
