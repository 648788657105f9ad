"""Queries over texts alone: hashing, language, nodes, chunks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import shared_folder, spread, table
from quarry.config import ChunkSettings
from quarry.functions import text as X
from quarry.operators import chunking, index
from quarry.plans.registry import CHUNKS, LINES, TOKENS, query
from quarry.sources import files

#: Chunks of the SQL-checked queries: long lines stay whole; ``chunk_documents`` cuts them too.
WHOLE_LINES = ChunkSettings(split_long=False)


def chunks_of(spark: SparkSession, sf_dir: str, settings: ChunkSettings = WHOLE_LINES) -> DataFrame:
    """Chunks of all documents, by lines."""
    return chunking.chunk_nodes(chunking.line_nodes(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), settings)


@query(r"""
WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS text_hash FROM documents)
SELECT doc_id, text_hash, min(doc_id) OVER (PARTITION BY text_hash) AS kept_id, min(doc_id) OVER (PARTITION BY text_hash) <> doc_id AS duplicate FROM h""")
def doc_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the folded text, and the first document with it. The least id is a partial aggregate, so copies never meet in one task."""
    shared_folder(spark)
    # read twice, so the narrow hashes are kept in the shared folder
    h = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.text_hash(F.col("text")).alias("text_hash")).checkpoint(eager=True)
    return h.join(h.groupBy("text_hash").agg(F.min("doc_id").alias("kept_id")), "text_hash").select("doc_id", "text_hash", "kept_id", (F.col("kept_id") != F.col("doc_id")).alias("duplicate"))


@query(r"""
WITH r AS (SELECT substr(coalesce(text, ''), 1, 4000) AS h FROM documents),
s AS (SELECT CASE WHEN length(h) = 0 THEN 0 ELSE (length(h) - length(regexp_replace(h, '[\x{4E00}-\x{9FFF}]', '', 'g'))) / length(h) END AS p FROM r)
SELECT CASE WHEN p > 0.3 THEN 'zh' WHEN p < 0.05 THEN 'en' ELSE 'mixed' END AS language, count(*) AS n FROM s GROUP BY ALL""")
def doc_language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language class."""
    return table(spark, sf_dir, "documents").groupBy(X.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)
SELECT kind, id, length(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS hash FROM t""")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without control characters."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    clean = X.sanitize(F.coalesce("text", F.lit("")))
    return d.unionByName(p).select("kind", "id", F.char_length(clean).alias("n_chars"), F.sha2(clean, 256).alias("hash"))


@query(r"""
SELECT mime, error, count(*) AS n FROM (
  SELECT NULL AS mime, 'unsupported' AS error FROM pages UNION ALL SELECT 'text/plain', NULL FROM documents) GROUP BY ALL""")
def sniff_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of pages (as .html) and documents (as .txt) by their bytes and names."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return files.sniff(p.unionByName(d)).groupBy("mime", "error").agg(F.count("*").alias("n"))


@query(rf"""
WITH {LINES}, n AS (SELECT document_id, count(*) AS n_nodes, substr(min_by(u, pos), 1, 200) AS title, string_agg(u, chr(10) || chr(10) ORDER BY pos) AS full_text FROM units GROUP BY ALL)
SELECT document_id, n_nodes, title, sha256(trim(regexp_replace(full_text, '\s+', ' ', 'g'))) AS text_hash, substr(sha1(document_id || ':0'), 1, 16) AS first_node_id FROM n""")
def nodes_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of plain texts: their number, title, hash and first id."""
    texts = F.transform("nodes", lambda n: n["text"])
    d = chunking.line_nodes(table(spark, sf_dir, "documents")).where(F.size("nodes") > 0)
    return d.select("document_id", F.size("nodes").alias("n_nodes"), F.substring(texts[0], 1, 200).alias("title"), X.text_hash(F.array_join(texts, "\n\n")).alias("text_hash"), X.node_id(F.col("document_id"), F.lit(0)).alias("first_node_id"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, document_id, chunk_index, token_count, length(content) AS char_count, sha256(content) AS hash FROM chunks")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of lines into chunks; lines over the most tokens stay whole here."""
    return chunks_of(spark, sf_dir).select("chunk_id", "document_id", "chunk_index", "token_count", "char_count", F.sha2("content", 256).alias("hash"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunker, long lines cut by sentences, clauses and length. Tested against a plain version."""
    return chunking.finished(chunks_of(spark, sf_dir, ChunkSettings())).select("chunk_id", "document_id", "chunk_index", "token_count", "parent_index", "content_hash")


@query(rf"""
WITH RECURSIVE {CHUNKS},
block AS (
  SELECT document_id, chunk_index, token_count, 0::BIGINT AS parent_index, token_count AS total FROM chunks WHERE chunk_index = 0
  UNION ALL
  SELECT c.document_id, c.chunk_index, c.token_count, CASE WHEN b.total >= 1024 THEN c.chunk_index ELSE b.parent_index END, CASE WHEN b.total >= 1024 THEN 0 ELSE b.total END + c.token_count
  FROM block b JOIN chunks c ON c.document_id = b.document_id AND c.chunk_index = b.chunk_index + 1)
SELECT document_id, parent_index, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM block GROUP BY ALL""")
def chunk_parent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent blocks of chunks."""
    return chunks_of(spark, sf_dir).groupBy("document_id", "parent_index").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"))


@query(rf"""
WITH RECURSIVE {CHUNKS}
SELECT chunk_id, sha256(trim(regexp_replace(content, '\s+', ' ', 'g')) || chr(31) || 'v1' || chr(31) || 'hash' || chr(31) || '1024') AS content_hash, sha256(content) AS embed_hash FROM chunks""")
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes and embedding texts of chunks (no title, no section here)."""
    return chunking.finished(chunks_of(spark, sf_dir)).select("chunk_id", "content_hash", F.sha2("embed_text", 256).alias("embed_hash"))


@query(r"""
WITH p AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;…\n]*[。！？!?；;…\n]|[^。！？!?；;…\n]+$'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n_pieces, coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS longest, sha256(coalesce(list_aggregate(l, 'string_agg', '|'), '')) AS hash FROM p""")
def sentence_split_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their ends."""
    p = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.split_keep(F.col("text")).alias("l"))
    return p.select("doc_id", F.size("l").alias("n_pieces"), F.coalesce(F.array_max(F.transform("l", lambda x: F.char_length(x))), F.lit(0)).alias("longest"), F.sha2(F.array_join("l", "|"), 256).alias("hash"))


@query(rf"""
WITH t AS (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS l, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(l) AS n_tokens, len(list_distinct(l)) AS n_distinct, ceil(length(text) / 4.0)::BIGINT AS estimate FROM t""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, distinct tokens and the token estimate of documents."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("l"), X.token_count(F.col("text")).alias("estimate"))
    return d.select("doc_id", F.size("l").alias("n_tokens"), F.size(F.array_distinct("l")).alias("n_distinct"), "estimate")


@query(rf"""
WITH RECURSIVE {CHUNKS}, tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TOKENS.format('content')}) AS term FROM chunks) GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term""")
def corpus_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and places of every term."""
    return index.term_stats(chunks_of(spark, sf_dir))


@query(rf"""
WITH RECURSIVE {CHUNKS} SELECT count(*) AS n_chunks, round(avg(greatest(len({TOKENS.format('content')}), 1)), 6) AS avg_len FROM chunks""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and average length of chunks."""
    return index.corpus_stats(chunks_of(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


@query(r"""
WITH q AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f, coalesce(text, '') AS text FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (length(f) < 40 OR len(regexp_extract_all(f, '(?i)(vol\.|pp\.|et al\.|IEEE Trans|arXiv|Proceedings|doi:|\[\d+\])')) >= 3) AS junk,
  count(*) FILTER (len(regexp_extract_all(q.text, '(?i)\b(vol\.|no\.|pp\.|doi:|arXiv:)')) >= 2) AS reference_entries, count(*) FILTER (regexp_matches(q.text, '[A-Za-z]{20,}')) AS glued
FROM q JOIN documents USING (doc_id) GROUP BY source""")
def quality_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk, reference entries and swallowed spaces by source."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(X.is_junk(t)).alias("junk"), F.count_if(X.is_reference_entry(t)).alias("reference_entries"), F.count_if(X.is_glued(t)).alias("glued"))


@query(r"""
WITH f AS (SELECT l.toxic, length(d.text) < 200 AS short, regexp_matches(d.text, '[A-Za-z]{20,}') AS glued FROM documents d JOIN labels l USING (doc_id))
SELECT toxic, count(*) AS n, round(avg(short::INT), 6) AS short_share, round(avg(glued::INT), 6) AS glued_share FROM f GROUP BY toxic""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of glued and of short texts among two groups of documents (the toxic flag stands for missed and found)."""
    f = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return f.groupBy("toxic").agg(F.count("*").alias("n"), share(F.char_length("text") < 200).alias("short_share"), share(X.is_glued(F.col("text"))).alias("glued_share"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 20")
def pagination_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of documents, newest first (a page is the feature)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).offset(20).limit(20)
