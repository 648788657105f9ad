"""Queries over look-ups, counts, offsets, statuses, channel diagnosis and answer events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import table
from quarry.functions import text as X
from quarry.operators import answering, conversations, lookups, worker
from quarry.operators import evaluation as E
from quarry.plans.prepared import chunks_of
from quarry.plans.registry import CHUNKS, TOKENS, hybrid, query
from quarry.plans.retrieval_queries import GOLD, METRICS, gold_of, hits_of


@query(r"""
WITH h AS (SELECT doc_id, source, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS text_hash FROM documents)
SELECT text_hash, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, count(*) AS versions FROM h GROUP BY text_hash""")
def newest_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest document of every content hash."""
    h = table(spark, sf_dir, "documents").select("doc_id", "source", X.text_hash(F.col("text")).alias("text_hash"))
    return lookups.newest(h, "text_hash", "doc_id").select("text_hash", "doc_id", "source", "versions")


@query("""
WITH a AS (SELECT item_id, unnest([item_id * 3, -1, item_id, item_id * 2 + 1]) AS doc_id, unnest(range(0, 4)) AS ord FROM benchmark),
o AS (SELECT item_id, doc_id, dense_rank() OVER (PARTITION BY item_id ORDER BY first_) - 1 AS ord FROM (SELECT item_id, doc_id, min(ord) AS first_ FROM a GROUP BY ALL))
SELECT item_id AS query_id, ord, doc_id, source FROM o JOIN documents USING (doc_id)""")
def lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by lists of ids, in the order of each list."""
    i = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.array(i * 3, F.lit(-1).cast("long"), i, i * 2 + 1).alias("ids"))
    return lookups.in_order(asked, table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("query_id", "ord", "doc_id", "source")


@query("""
SELECT 'documents' AS what, source AS tenant_id, count(*) AS total, count(*) FILTER (coalesce(quality, 1) = 1) AS live FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL
UNION ALL SELECT 'vectors', (vec_id % 3)::VARCHAR, count(*), count(*) FILTER (label < 5) FROM embeddings GROUP BY ALL""")
def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors of every tenant, all and live (sources and ids stand for tenants, labels for the flags)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("tenant_id", F.col("source"))
    v = table(spark, sf_dir, "embeddings").withColumn("tenant_id", (F.col("vec_id") % 3).cast("string"))
    both = lookups.counts(d, F.coalesce("quality", F.lit(1)) == 1).withColumn("what", F.lit("documents")).unionByName(lookups.counts(v, F.col("label") < 5).withColumn("what", F.lit("vectors")))
    return both.select("what", "tenant_id", "total", "live")


@query("SELECT CASE item_id % 4 WHEN 0 THEN 'single_hop' WHEN 1 THEN 'multi_hop' ELSE 'unanswerable' END AS type, count(*) AS n FROM benchmark GROUP BY ALL")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by type (told by the id)."""
    kind = F.when(F.col("item_id") % 4 == 0, "single_hop").when(F.col("item_id") % 4 == 1, "multi_hop").otherwise("unanswerable")
    return table(spark, sf_dir, "benchmark").groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {hybrid()}, {GOLD},
best AS (SELECT query_id, chunk_id, min(rank) AS rank FROM hits GROUP BY ALL)
SELECT query_id, chunk_id, coalesce(rank, {lookups.NO_RANK}) AS best_rank FROM gold LEFT JOIN best USING (query_id, chunk_id)""")
def best_source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank of every gold chunk over all sources."""
    ranks = hits_of(spark, sf_dir).groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "rank"))).alias("ranks"))
    gold = gold_of(spark, sf_dir, chunks_of(spark, sf_dir)).join(ranks, ["query_id", "chunk_id"], "left")
    return gold.select("query_id", "chunk_id", lookups.best_rank(F.col("ranks")).alias("best_rank"))


@query(f"""
WITH RECURSIVE {hybrid()}, {GOLD},
head AS (SELECT DISTINCT query_id FROM hits JOIN gold USING (query_id, chunk_id) WHERE channel = 'sparse' AND rank <= 5),
refused AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 = 0)
SELECT count(*) AS false_refusals, count(*) FILTER (h.query_id IS NULL) AS not_retrieved FROM (SELECT DISTINCT query_id FROM gold JOIN refused USING (query_id)) LEFT JOIN head h USING (query_id)""")
def refusal_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused questions that have gold (every third counts as refused), and those whose gold was not among the first five."""
    gold = gold_of(spark, sf_dir, chunks_of(spark, sf_dir)).select("query_id", "chunk_id")
    refused = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("query_id"))
    return E.refusal_causes(refused, gold, hits_of(spark, sf_dir).where("channel = 'sparse'"), 5)


@query(r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS line FROM s),
o AS (SELECT doc_id, line, x, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(x) - 1)::BIGINT AS char_start FROM n)
SELECT doc_id, line, char_start, char_start + length(x) AS char_end FROM o WHERE trim(x) <> ''""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the lines of every document."""
    return lookups.line_offsets(table(spark, sf_dir, "documents"))


@query(f"SELECT item_id, len({TOKENS.format('text')}) AS n_terms, sha256(array_to_string({TOKENS.format('text')}, ' ')) AS hash FROM benchmark")
def analyzer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the index reads every benchmark text."""
    rows = answering.analysed(table(spark, sf_dir, "benchmark"), "text")
    return rows.select("item_id", F.size("terms").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("hash"))


READINGS = "runs AS (SELECT CASE channel WHEN 'sparse' THEN 'original' ELSE 'variant' END AS arm, query_id, chunk_id, rank AS pos, score FROM hits)"


@query(f"""
WITH RECURSIVE {hybrid()}, {GOLD}, {READINGS},
pairs AS (SELECT arm, query_id FROM (VALUES ('original'), ('variant')) v(arm), (SELECT DISTINCT query_id FROM gold)),
first_ AS (SELECT arm, query_id, min(pos) AS r FROM runs JOIN gold USING (query_id, chunk_id) WHERE pos <= 10 GROUP BY ALL)
SELECT arm, {METRICS} FROM pairs LEFT JOIN first_ USING (arm, query_id) GROUP BY arm""")
def reading_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of either reading of the questions over the same gold."""
    runs = hits_of(spark, sf_dir).select(F.when(F.col("channel") == "sparse", "original").otherwise("variant").alias("arm"), "query_id", "chunk_id", F.col("rank").alias("pos"))
    return E.metrics(runs, gold_of(spark, sf_dir, chunks_of(spark, sf_dir)), ("original", "variant"))


@query(f"""
WITH RECURSIVE {hybrid()}, {READINGS}
SELECT arm, count(DISTINCT query_id) AS answered, round(count(*) / count(DISTINCT query_id), 6) AS mean_hits, round(avg(score) FILTER (pos = 1), 6) AS mean_top_score, count(*) FILTER (pos = 50) AS full_lists FROM runs GROUP BY arm""")
def sparse_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lexical channel finds anything for either reading: questions with hits, their number, the best scores."""
    arm = F.when(F.col("channel") == "sparse", "original").otherwise("variant")
    return E.channel_health(hits_of(spark, sf_dir).withColumn("arm", arm), 50)


@query(rf"""
WITH RECURSIVE {hybrid()}, {GOLD},
bad AS (SELECT chunk_id FROM (SELECT chunk_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM chunks) WHERE length(f) < 40 OR len(regexp_extract_all(f, '(?i)(vol\.|pp\.|et al\.|IEEE Trans|arXiv|Proceedings|doi:|\[\d+\])')) >= 3),
runs AS (SELECT 'before' AS arm, query_id, chunk_id, pos FROM fused UNION ALL SELECT 'after', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) FROM fused WHERE chunk_id NOT IN (SELECT chunk_id FROM bad)),
pairs AS (SELECT arm, query_id FROM (VALUES ('before'), ('after')) v(arm), (SELECT DISTINCT query_id FROM gold)),
first_ AS (SELECT arm, query_id, min(pos) AS r FROM runs JOIN gold USING (query_id, chunk_id) WHERE pos <= 10 GROUP BY ALL)
SELECT arm, {METRICS} FROM pairs LEFT JOIN first_ USING (arm, query_id) GROUP BY arm""")
def junk_filter_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall before and after junk chunks are taken out of the fused lists."""
    from quarry.operators import retrieval

    chunks = chunks_of(spark, sf_dir)
    fused = retrieval.rrf(hits_of(spark, sf_dir)).select("query_id", "chunk_id", "pos")
    return E.metrics(E.without_chunks(fused, chunks.where(X.is_junk(F.col("content")))), gold_of(spark, sf_dir, chunks), ("before", "after"))


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT role, turn % 2 AS parity, count(*) AS n, count(*) FILTER (regexp_matches(rtrim(coalesce(text, '')), '[?？]$')) AS asks_back FROM m WHERE n = 1 GROUP BY ALL""")
def last_turn_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last turns of all conversations are."""
    m = lookups.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    asks = conversations.status_after(F.coalesce("text", F.lit("")), F.lit(False)) == "waiting_input"
    return m.groupBy("role", (F.col("turn") % 2).alias("parity")).agg(F.count("*").alias("n"), F.count_if(asks).alias("asks_back"))


@query("""
WITH a AS (SELECT conv_id * 1048576 + turn AS query_id, coalesce(text, '') AS answer, turn % 5 = 1 AS broken FROM conversations WHERE role = 'assistant'),
e AS (
  SELECT query_id, 0 AS n, 'start' AS event, 'generate' AS data FROM a
  UNION ALL SELECT query_id, 1, 'error', 'model_failed' FROM a WHERE broken
  UNION ALL SELECT query_id, 1, 'citations', '[1]' FROM a WHERE NOT broken
  UNION ALL SELECT query_id, 2 + i, 'delta', substr(answer, i * 8 + 1, 8) FROM (SELECT query_id, answer, unnest(range(0, (length(answer) + 7) // 8)) AS i FROM a WHERE NOT broken)
  UNION ALL SELECT query_id, 2 + (length(answer) + 7) // 8, 'done', length(answer)::VARCHAR FROM a WHERE NOT broken)
SELECT * FROM e""")
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as streams of events (every fifth fails)."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = a.select((F.col("conv_id") * 1048576 + F.col("turn")).alias("query_id"), F.lit("generate").alias("route"), F.col("text").alias("answer"), F.lit("[1]").alias("citations"), F.when(F.col("turn") % 5 == 1, "model_failed").alias("error"))
    return answering.events(rows)


CHANGES = "CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'chunking' WHEN 'signup' THEN 'embedding' WHEN 'purchase' THEN 'ready' ELSE 'failed' END"


@query(f"""
WITH RECURSIVE p(status, progress, ends) AS (VALUES ('pending', 0, false), ('parsing', 30, false), ('chunking', 45, false), ('embedding', 90, false), ('ready', 100, true), ('failed', 100, true)),
c AS (SELECT user_id AS document_id, {CHANGES} AS new, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT DISTINCT document_id, 0::BIGINT AS n, 'pending' AS status FROM c
  UNION ALL
  SELECT c.document_id, c.n, CASE WHEN o.ends THEN CASE WHEN f.status <> 'ready' AND c.new = 'parsing' THEN c.new ELSE f.status END WHEN w.ends OR w.progress > o.progress THEN c.new ELSE f.status END
  FROM f JOIN c ON c.document_id = f.document_id AND c.n = f.n + 1 JOIN p o ON o.status = f.status JOIN p w ON w.status = c.new)
SELECT document_id, status, progress, ends AS done FROM (SELECT *, max(n) OVER (PARTITION BY document_id) AS top FROM f) JOIN p USING (status) WHERE n = top""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents stand after their changes of status (users' events stand for them)."""
    return lookups.statuses(table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.expr(CHANGES).alias("status")))


@query("""
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'failed' END AS status, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_job_type: ' || event_type END AS last_error, count(*) AS n FROM events GROUP BY ALL""")
def job_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed jobs (events) by what becomes of them: unknown types fail at once."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("job_type"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("last_error"))
    return worker.dispatched(jobs, ("click", "view")).groupBy("status", "last_error").agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {CHUNKS}
SELECT document_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens, sha256(string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_index)) AS listing FROM chunks GROUP BY document_id""")
def section_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document and section in order (lines have one section; a list is as long as its document)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda s: s["chunk_id"].cast("string"))
    rows = chunks_of(spark, sf_dir).groupBy("document_id", "section_path").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.sha2(F.array_join(ids, ","), 256).alias("listing"))
    return rows.drop("section_path")
