"""Queries over index tables, stores and smaller rules that have no line of their own elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import table
from quarry.functions import text as X
from quarry.operators import answers, conversations, evaluation, index, retrieval
from quarry.plans.registry import CHUNKS, query
from quarry.plans.text_queries import chunks_of


@query("""
WITH base AS (SELECT vec_id AS chunk_id, label AS document_id, 0 AS version FROM embeddings),
fresh AS (SELECT vec_id AS chunk_id, label AS document_id, 1 AS version FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label, 1 FROM embeddings WHERE vec_id % 7 = 0),
merged AS (SELECT * FROM base WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT document_id, version, count(*) AS n FROM merged WHERE document_id <> 4 GROUP BY ALL""")
def index_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after an upsert and the deletion of one document (labels stand for documents)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), F.lit(1).alias("tenant_id"))
    new = v.where("chunk_id % 3 = 0").unionAll(v.where("chunk_id % 7 = 0").withColumn("chunk_id", F.col("chunk_id") + 1000000)).withColumn("version", F.lit(1))
    rest, _ = index.delete_document(index.upsert(v.withColumn("version", F.lit(0)), new), 4)
    return rest.groupBy("document_id", "version").agg(F.count("*").alias("n"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS chunk_id, CASE WHEN d.doc_id IS NULL THEN 'store' ELSE 'index' END AS missing_in FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that one of store and index lacks (documents and labels stand for them)."""
    ids = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").alias("chunk_id"))
    return index.reconcile(ids("documents"), ids("labels"))


@query(rf"""
WITH RECURSIVE {CHUNKS}, q AS (SELECT chunk_id, content, CASE WHEN chunk_id % 3 = 0 THEN 'not in the text at all' ELSE substr(content, 5, 40) END AS quote FROM chunks)
SELECT chunk_id, trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(content, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS grounded FROM q""")
def citation_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes (of every chunk, a third of them invented) against their chunks."""
    chunks = chunks_of(spark, sf_dir)
    quotes = chunks.select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, "not in the text at all").otherwise(F.substring("content", 5, 40)).alias("quote"))
    return evaluation.groundedness(quotes, chunks).select("chunk_id", "grounded")


@query(r"""
WITH c AS (SELECT avg((len(regexp_extract_all(text, '(?i)\b(vol\.|no\.|pp\.|doi:|arXiv:)')) >= 2)::INT) AS corpus_share, avg((text LIKE '%e%')::INT) AS e FROM documents),
f AS (SELECT quality = 1 AS found, avg((len(regexp_extract_all(text, '(?i)\b(vol\.|no\.|pp\.|doi:|arXiv:)')) >= 2)::INT) AS share FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT found, round(share, 6) AS share, round(corpus_share, 6) AS corpus_share, round(share / nullif(corpus_share, 0), 6) AS ratio FROM f, c""")
def pollution_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference entries among found and missed texts against the corpus (quality stands for found)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    hits = d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("found")), "doc_id")
    out = evaluation.oversampling(hits, d)
    return out.select("found", *(F.round(c, 6).alias(c) for c in ("share", "corpus_share", "ratio")))


@query("""
SELECT source, count(*) AS n_documents, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(doc_id * (1 + doc_id % 97))::BIGINT AS id_sum FROM documents GROUP BY source""")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source with a digest of their ids. Sums alone, so no source is ever gathered; ``section_listing`` lists what a document holds."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("chars"), F.min(i).alias("first_id"), F.max(i).alias("last_id"), F.sum(i * (1 + i % 97)).alias("id_sum"))


@query(r"""
WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM benchmark)
SELECT item_id, len(list_distinct(w)) AS n_terms, list_max(list_transform(w, lambda x: length(x))) AS longest FROM q""")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a page would mark for every benchmark text, longest first."""
    q = table(spark, sf_dir, "benchmark").select("item_id", X.highlight_terms(F.col("text")).alias("w"))
    return q.select("item_id", F.size("w").alias("n_terms"), F.char_length(F.col("w")[0]).alias("longest"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 3 < 2 THEN 'rewrite' ELSE 'refuse' END WHEN quality = 1 THEN 'generate' WHEN doc_id % 3 < 2 THEN 'rewrite' ELSE 'refuse' END AS route FROM labels""")
def grade_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next steps after grading (a label is a question: quality its verdict, the id its attempts)."""
    q = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") == 1, "sufficient").otherwise("insufficient")
    return q.select("doc_id", answers.grade_route(F.col("doc_id") % 5 != 0, verdict, F.col("doc_id") % 3, 2, True).alias("route"))


@query("""
SELECT conv_id, max(turn) AS version, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id""")
def latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of every thread's state (a message stands for a version)."""
    m = table(spark, sf_dir, "conversations").select(F.lit(1).alias("tenant_id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("version"), "role")
    return conversations.latest_tasks(m).select(F.col("thread_id").alias("conv_id"), "version", "role")


@query("""
SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'failed' WHEN regexp_matches(rtrim(text), '[?？]$') THEN 'waiting_input' ELSE 'completed' END AS status,
  CASE turn % 3 WHEN 0 THEN 'grade_query' WHEN 1 THEN 'course_selection' ELSE 'general' END AS task_type FROM conversations""")
def task_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status after answers, and kind of task after tools."""
    c = table(spark, sf_dir, "conversations")
    tool = F.when(F.col("turn") % 3 == 0, "query_grades").when(F.col("turn") % 3 == 1, "query_grades").otherwise("other")
    current = F.when(F.col("turn") % 3 == 1, "course_selection").otherwise("general")
    return c.select("conv_id", "turn", conversations.status_after(F.col("text"), F.col("turn") % 7 == 6).alias("status"), conversations.type_after_tool(tool, current).alias("task_type"))


@query("""
WITH q AS (SELECT item_id, text, 'x ' || text AS translated FROM benchmark)
SELECT item_id, CASE WHEN item_id % 4 = 0 THEN text WHEN regexp_matches(text, '(?i)\\b(?:reference|citation|author|published|journal|conference|volume|doi)\\b') THEN text || chr(10) || translated ELSE translated END AS rerank_text FROM q""".replace("\\\\", "\\"))
def rerank_query_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text to rerank with, for candidates without CJK characters; every fourth has no translation."""
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("x "), "text")).alias("translated"))
    pool = q.select("query_id", F.col("query_id").alias("chunk_id"))
    return retrieval.rerank_query(pool, b.select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content")), q).select(F.col("query_id").alias("item_id"), "rerank_text")
