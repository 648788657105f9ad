"""Queries of the retrieval line: search, fusion, reranking, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import shared_folder, table
from quarry.config import RetrievalSettings
from quarry.functions import text as X
from quarry.operators import evaluation as E
from quarry.operators import index, retrieval
from quarry.operators.postings import LexicalIndex
from quarry.plans.prepared import chunks_of, index_of
from quarry.plans.registry import BENCHMARK, BM25, CHUNKS, TOKENS, hybrid, query


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as queries; their first half of words stands for a translation."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = F.split("text", " ")
    return b.withColumn("translated", F.array_join(F.slice(words, 1, F.ceil(F.size(words) / 2).cast("int")), " "))


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lexical channels of every benchmark text."""
    q = benchmark(spark, sf_dir)
    second = q.where("translated <> '' and translated <> text")
    # one pass over the asked terms' postings scores both readings of all queries
    both = q.select((F.col("query_id") * 2).alias("query_id"), "text").unionAll(second.select(F.col("query_id") * 2 + 1, "translated"))
    hits = index_of(spark, sf_dir).search(both)
    name = F.when(F.col("query_id") % 2 == 0, "sparse").otherwise("sparse_x")
    return hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), name.alias("channel"), "chunk_id", "score", "rank")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in vectors: a chunk has that of its document's number, a benchmark text that of seven times its own, modulo their count."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("dense"))
    n = v.count()
    chunks = chunks_of(spark, sf_dir).select("chunk_id", F.pmod("document_id", F.lit(n)).alias("vec_id")).join(v, "vec_id").select("chunk_id", "dense")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.pmod(F.col("item_id") * 7, F.lit(n)).alias("vec_id"))
    return chunks, asked.join(v, "vec_id").select("query_id", "dense")


def all_hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical channels and the dense one, kept in the shared folder for the arms that read them."""
    dense = retrieval.channel(index.dense(*chunk_vectors(spark, sf_dir)), "dense")
    shared_folder(spark)
    return hits_of(spark, sf_dir).unionByName(dense).checkpoint(eager=True)


def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as chunks, and those whose id is divisible by 20 as queries."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), F.col("label").alias("document_id")), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense"))


DENSE = """
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label AS document_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {where}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs) WHERE rank <= {k})
"""


@query(f"WITH RECURSIVE {BENCHMARK}, {BM25} SELECT query_id, chunk_id, rank, score FROM sparse")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 50 chunks for every benchmark text."""
    return index_of(spark, sf_dir).search(benchmark(spark, sf_dir)).select("query_id", "chunk_id", "rank", "score")


@query(f"WITH RECURSIVE {BENCHMARK}, {BM25.replace('chunks AS (SELECT', 'all_chunks AS (SELECT').replace('tok AS (', 'chunks AS (SELECT * FROM all_chunks WHERE document_id % 7 <> 0), tok AS (', 1)} SELECT query_id, chunk_id, rank, score FROM sparse")
def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over an index that was filled in two steps, had documents replaced and others removed."""
    chunks = chunks_of(spark, sf_dir)
    made = LexicalIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", segment=1024)
    made.add(chunks.where("document_id % 2 = 0").withColumn("content", F.concat(F.col("content"), F.lit(" more"))))
    made.add(chunks.where("document_id % 2 = 1 or document_id % 4 = 0"))
    made.add(chunks.where("document_id % 4 = 2"))
    made.remove(chunks.where("document_id % 7 = 0").select("document_id"))
    return made.search(benchmark(spark, sf_dir)).select("query_id", "chunk_id", "rank", "score")


@query(f"WITH RECURSIVE {hybrid()} SELECT query_id, channel, chunk_id, rank, score FROM hits")
def bm25_multi_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of every query as channels."""
    return hits_of(spark, sf_dir)


@query(f"WITH {DENSE.format(where='', k=50)} SELECT query_id, chunk_id, rank, score FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 50 vectors for every query vector."""
    v, q = vectors_of(spark, sf_dir)
    return index.dense(v, q).select("query_id", "chunk_id", "rank", "score")


@query(f"WITH {DENSE.format(where='AND v.label < 5', k=50)} SELECT query_id, chunk_id, rank, score FROM dense")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among active vectors (labels below 5 stand for active)."""
    v, q = vectors_of(spark, sf_dir)
    return index.dense(v.where("document_id < 5"), q).select("query_id", "chunk_id", "rank", "score")


@query("""
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 6) AS total, round(embedding[1]::DOUBLE / n, 6) AS first_part FROM n""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors: sum of the parts and the first."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", X.l2_normalize(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("u")[0], 6).alias("first_part"))


@query(f"WITH RECURSIVE {hybrid()} SELECT query_id, chunk_id, score, pos, sparse_rank FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of both channels."""
    return retrieval.rrf(hits_of(spark, sf_dir)).select("query_id", "chunk_id", "score", "pos", "sparse_rank")


@query(f"WITH RECURSIVE {hybrid('CASE WHEN channel = ' + chr(39) + 'sparse' + chr(39) + ' THEN 1.0 ELSE 0.5 END')} SELECT query_id, chunk_id, score, pos FROM fused")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion with half weight for the second channel."""
    return retrieval.rrf(hits_of(spark, sf_dir), weights={"sparse_x": 0.5}).select("query_id", "chunk_id", "score", "pos")


@query(f"WITH RECURSIVE {hybrid()} SELECT query_id, chunk_id, pos FROM fused WHERE pos <= 60 OR sparse_rank <= 10")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for reranking."""
    return retrieval.candidates(retrieval.rrf(hits_of(spark, sf_dir))).select("query_id", "chunk_id", "pos")


#: what a reranker reads of a chunk
READ = "('Document: ' || chr(10) || 'Section: ' || chr(10) || content)"
RERANK = (
    hybrid()
    + rf""",
pool AS (SELECT query_id, chunk_id, pos FROM fused WHERE pos <= 60 OR sparse_rank <= 10),
bag AS (SELECT chunk_id, list_distinct({TOKENS.format(READ)}) AS have FROM chunks),
want AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS asked FROM benchmark),
marked AS (SELECT query_id, chunk_id, pos, round(len(list_intersect(asked, have)) / greatest(len(asked), 1), 9) AS rerank_score FROM pool JOIN bag USING (chunk_id) JOIN want USING (query_id)),
reranked AS (SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS pos FROM marked)
"""
)


@query(f"WITH RECURSIVE {RERANK} SELECT query_id, chunk_id, rerank_score, pos FROM reranked")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by shared tokens, a deterministic stand-in for a model."""
    chunks = chunks_of(spark, sf_dir)
    pool = retrieval.candidates(retrieval.rrf(hits_of(spark, sf_dir)))
    return retrieval.rerank(pool, retrieval.overlap_scores(pool, chunks, benchmark(spark, sf_dir))).select("query_id", "chunk_id", "rerank_score", "pos")


@query(f"""
WITH {DENSE.format(where='', k=50)}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) > 1 AS again FROM dense)
SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY again, rank) AS pos FROM d""")
def diversify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hit of every document (labels stand for documents) first."""
    v, q = vectors_of(spark, sf_dir)
    hits = index.dense(v, q).withColumnRenamed("rank", "pos").join(v.select("chunk_id", "document_id"), "chunk_id")
    return retrieval.diversify(hits, "document_id").select("query_id", "chunk_id", "document_id", "pos")


@query(rf"""
WITH RECURSIVE {hybrid()}, late AS (SELECT query_id, chunk_id, pos, len(regexp_extract_all(content, '(?i)(vol\.|pp\.|et al\.|IEEE Trans|arXiv|Proceedings|doi:|\[\d+\])')) > 0 AS late FROM fused JOIN chunks USING (chunk_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY late, pos) AS pos FROM late""")
def demote_reference_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with marks of references behind the others, for queries that ask for none."""
    chunks = chunks_of(spark, sf_dir).withColumn("node_type", F.when(F.regexp_count("content", F.lit(X.REFERENCE_MARK)) > 0, "reference").otherwise("paragraph"))
    fused = retrieval.rrf(hits_of(spark, sf_dir))
    return retrieval.by_intent(fused, chunks, benchmark(spark, sf_dir)).select("query_id", "chunk_id", "pos")


@query(f"""
WITH RECURSIVE {hybrid()}, live AS (SELECT chunk_id FROM chunks JOIN labels l ON l.doc_id = document_id WHERE quality = 1)
SELECT query_id, count(*) AS asked, count(*) FILTER (live.chunk_id IS NULL) AS missing FROM fused LEFT JOIN live USING (chunk_id) WHERE pos <= 5 GROUP BY query_id""")
def hydrate_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first five hits are missing from the live store (documents of good quality stand for it)."""
    chunks = chunks_of(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    _, missing = retrieval.hydrate(retrieval.rrf(hits_of(spark, sf_dir)), chunks.join(good, "document_id", "left_semi"), 5)
    return missing


FINAL = (
    hybrid()
    + r""",
head AS (SELECT query_id, chunk_id, pos, score, document_id, content, trim(regexp_replace(content, '\s+', ' ', 'g')) AS k FROM fused JOIN chunks USING (chunk_id) WHERE pos <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY pos) AS copy FROM head),
final AS (SELECT query_id, chunk_id, document_id, score, content, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM once WHERE copy = 1)
"""
)


@query(f"WITH RECURSIVE {FINAL} SELECT query_id, chunk_id, document_id, rank FROM final")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hits, cut before copies go."""
    chunks = chunks_of(spark, sf_dir)
    rows, _ = retrieval.hydrate(retrieval.rrf(hits_of(spark, sf_dir)), chunks, 5)
    return retrieval.dedupe(rows).select("query_id", "chunk_id", "document_id", "rank")


#: the dense channel beside both lexical ones
DENSE_CHUNKS = """
nv AS (SELECT count(*) AS n FROM embeddings),
sim AS (SELECT item_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
  FROM benchmark CROSS JOIN nv JOIN embeddings q ON q.vec_id = (item_id * 7) % n CROSS JOIN embeddings v),
dense AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM chunks CROSS JOIN nv JOIN sim ON vec_id = document_id % n) WHERE rank <= 50)
"""
FUSING = """round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) FILTER (channel <> 'dense') AS sparse_rank, min(rank) FILTER (channel = 'dense') AS dense_rank,
  max(score) FILTER (channel = 'dense') AS dense_score, min(rank) AS head_rank, count(*) AS n_channels"""
THREE = (
    hybrid().split("hits AS (")[0]
    + DENSE_CHUNKS
    + f""",
hits AS (SELECT query_id // 2 AS query_id, CASE WHEN query_id % 2 = 0 THEN 'sparse' ELSE 'sparse_x' END AS channel, chunk_id, score, rank FROM sparse UNION ALL SELECT query_id, 'dense', chunk_id, score, rank FROM dense),
fusing AS (SELECT query_id, chunk_id, {FUSING} FROM hits GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM fusing),
bag AS (SELECT chunk_id, list_distinct({TOKENS.format(READ)}) AS have FROM chunks),
want AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS asked FROM benchmark)"""
)
LINE = (
    THREE
    + r""",
marked AS (SELECT f.*, round(len(list_intersect(asked, have)) / greatest(len(asked), 1), 9) AS rerank_score FROM fused f JOIN bag USING (chunk_id) JOIN want USING (query_id) WHERE pos <= 60 OR head_rank <= 10),
reranked AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS pos FROM marked),
head AS (SELECT r.*, document_id, content, trim(regexp_replace(content, '\s+', ' ', 'g')) AS k FROM reranked r JOIN chunks USING (chunk_id) WHERE pos <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY pos) AS copy FROM head),
line AS (SELECT * EXCLUDE (pos, copy, k), row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM once WHERE copy = 1)
"""
)


@query(f"WITH RECURSIVE {THREE} SELECT query_id, chunk_id, pos, score, dense_rank, sparse_rank, dense_score, n_channels FROM fused")
def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the dense channel and both lexical ones."""
    fused = retrieval.rrf(all_hits_of(spark, sf_dir))
    return fused.select("query_id", "chunk_id", "pos", "score", "dense_rank", "sparse_rank", "dense_score", F.size("sources").alias("n_channels"))


@query(f"WITH RECURSIVE {LINE} SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score, rerank_score, dense_rank, sparse_rank, sha256(content) AS hash FROM line")
def hybrid_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole line for every benchmark text: dense and lexical channels, fusion, candidates, reranking, order by intent, cut, texts, no copies."""
    chunks, q = chunks_of(spark, sf_dir), benchmark(spark, sf_dir)
    vectors, query_vectors = chunk_vectors(spark, sf_dir)
    rows = retrieval.retrieve(chunks, q, vectors=vectors, query_vectors=query_vectors, lexical=index_of(spark, sf_dir).search, scorer=lambda pool: retrieval.overlap_scores(pool, chunks, q))
    return rows.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rerank_score", "dense_rank", "sparse_rank", F.sha2("content", 256).alias("hash"))


@query(f"""
WITH RECURSIVE {CHUNKS},
block AS (
  SELECT document_id, chunk_index, chunk_id, token_count, 0::BIGINT AS parent_index, token_count AS total FROM chunks WHERE chunk_index = 0
  UNION ALL
  SELECT c.document_id, c.chunk_index, c.chunk_id, c.token_count, CASE WHEN b.total >= 1024 THEN c.chunk_index ELSE b.parent_index END, CASE WHEN b.total >= 1024 THEN 0 ELSE b.total END + c.token_count
  FROM block b JOIN chunks c ON c.document_id = b.document_id AND c.chunk_index = b.chunk_index + 1)
SELECT chunk_id, size_ - 1 AS n_siblings, CASE WHEN chunk_id = lo THEN second ELSE lo END AS first_sibling FROM (
  SELECT chunk_id, count(*) OVER w AS size_, min(chunk_id) OVER w AS lo, nth_value(chunk_id, 2) OVER (PARTITION BY document_id, parent_index ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
  FROM block WINDOW w AS (PARTITION BY document_id, parent_index)) WHERE size_ > 1""")
def section_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other chunks of every chunk's parent block."""
    chunks = chunks_of(spark, sf_dir)
    return retrieval.siblings(chunks, chunks).select("chunk_id", F.size("sibling_ids").alias("n_siblings"), F.col("sibling_ids")[0].alias("first_sibling"))


@query(f"""
WITH RECURSIVE {FINAL},
b AS (SELECT query_id, rank, '[' || rank || '] doc-' || document_id || chr(10) || content AS block FROM final),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
SELECT query_id, count(*) AS n_blocks, sha256(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS hash FROM u WHERE used <= 2000 OR rank = 1 GROUP BY query_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of at most 2000 characters."""
    chunks = chunks_of(spark, sf_dir)
    rows, _ = retrieval.hydrate(retrieval.rrf(hits_of(spark, sf_dir)), chunks, 5)
    rows = retrieval.dedupe(rows).withColumn("label", F.concat(F.lit("doc-"), "document_id"))
    return retrieval.context(rows, 2000).select("query_id", "n_blocks", F.sha2("context", 256).alias("hash"))


@query(f"""
WITH RECURSIVE {LINE}
SELECT query_id, n_dense, n_sparse, n_fused, round(top_score, 9) AS top_score, n_final, n_documents FROM
 (SELECT query_id, count(*) FILTER (channel = 'dense') AS n_dense, count(*) FILTER (channel <> 'dense') AS n_sparse FROM hits GROUP BY ALL) JOIN (SELECT query_id, count(*) AS n_fused, max(score) AS top_score FROM fused GROUP BY ALL) USING (query_id)
 JOIN (SELECT query_id, count(*) AS n_final, count(DISTINCT document_id) AS n_documents FROM line GROUP BY ALL) USING (query_id)""")
def retrieval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every stage for every query."""
    chunks = chunks_of(spark, sf_dir)
    hits = all_hits_of(spark, sf_dir)
    fused = retrieval.rrf(hits)
    pool = retrieval.candidates(fused)
    rows, _ = retrieval.hydrate(retrieval.rerank(pool, retrieval.overlap_scores(pool, chunks, benchmark(spark, sf_dir))), chunks, 5)
    return retrieval.diagnostics(hits, fused, retrieval.dedupe(rows)).withColumn("top_score", F.round("top_score", 9))


@query(f"""
WITH RECURSIVE {hybrid()},
a AS (SELECT query_id, chunk_id, rank FROM hits WHERE channel = 'sparse' AND rank <= 5), b AS (SELECT query_id, chunk_id, rank FROM hits WHERE channel = 'sparse_x' AND rank <= 5),
u AS (SELECT query_id, chunk_id, 0 AS round, rank FROM a UNION ALL SELECT query_id, chunk_id, 1, rank FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round, rank) AS nth FROM u),
m AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round, rank, chunk_id) AS rank FROM o WHERE nth = 1)
SELECT * FROM m WHERE rank <= 10""")
def round_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of hits merged."""
    hits = hits_of(spark, sf_dir).where("rank <= 5")
    return retrieval.merge_rounds(hits.where("channel = 'sparse'"), hits.where("channel = 'sparse_x'"), 5)


# --- evaluation ---------------------------------------------------------------------------------

KEY = r"regexp_replace(lower(translate({0}, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')), '[^\p{{L}}\p{{N}}]', '', 'g')"
GOLD = rf"""
ck AS (SELECT chunk_id, document_id, {KEY.format('content')} AS key FROM chunks), bk AS (SELECT item_id AS query_id, {KEY.format('text')} AS phrase FROM benchmark),
gold AS (SELECT query_id, chunk_id, document_id FROM bk JOIN ck ON phrase <> '' AND contains(key, phrase))
"""


def gold_of(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Chunks that hold a benchmark text: its gold chunks."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    return E.resolve_evidence(chunks, b)


@query(f"WITH RECURSIVE {CHUNKS}, {GOLD} SELECT * FROM gold")
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold chunks of every benchmark text by letters and digits alone."""
    return gold_of(spark, sf_dir, chunks_of(spark, sf_dir))


METRICS = "round(avg((coalesce(r, 999) <= 1)::INT), 6) AS r_at_1, round(avg((coalesce(r, 999) <= 3)::INT), 6) AS r_at_3, round(avg((coalesce(r, 999) <= 5)::INT), 6) AS r_at_5, round(avg((coalesce(r, 999) <= 10)::INT), 6) AS r_at_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr"
#: Arms of the ablation: channels, and whether candidates are reranked.
ARM_CHANNELS = {
    "full": (("dense", "sparse", "sparse_x"), True),
    "no_translate": (("dense", "sparse"), True),
    "no_rerank": (("dense", "sparse", "sparse_x"), False),
    "no_dense": (("sparse", "sparse_x"), True),
    "no_sparse": (("dense",), True),
    "dense_only": (("dense",), False),
    "sparse_only": (("sparse", "sparse_x"), False),
}
_VALUES = ", ".join(f"('{arm}', '{c}', {str(again).lower()})" for arm, (channels, again) in ARM_CHANNELS.items() for c in channels)
ARMS = (
    THREE
    + f""", {GOLD},
arm_of(arm, channel, again) AS (VALUES {_VALUES}),
arm_fusing AS (SELECT arm, again, query_id, chunk_id, {FUSING} FROM hits JOIN arm_of USING (channel) GROUP BY ALL),
arm_fused AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, chunk_id) AS pos FROM arm_fusing),
arm_marked AS (SELECT arm, query_id, chunk_id, round(len(list_intersect(asked, have)) / greatest(len(asked), 1), 9) AS s FROM arm_fused JOIN bag USING (chunk_id) JOIN want USING (query_id) WHERE again AND (pos <= 60 OR head_rank <= 10)),
runs AS (SELECT arm, query_id, chunk_id, row_number() OVER (PARTITION BY arm, query_id ORDER BY s DESC, chunk_id) AS pos FROM arm_marked UNION ALL SELECT arm, query_id, chunk_id, pos FROM arm_fused WHERE NOT again),
asked_arms AS (SELECT arm, query_id FROM (SELECT DISTINCT arm FROM arm_of), (SELECT DISTINCT query_id FROM gold)),
"""
)
FIRST = "first_ AS (SELECT arm, query_id, min(pos) AS r FROM runs JOIN gold USING (query_id, chunk_id) WHERE pos <= {depth} GROUP BY ALL)"


def runs_of(spark: SparkSession, sf_dir: str, arms: tuple[str, ...] = tuple(ARM_CHANNELS)) -> DataFrame:
    """Positions of the arms: (arm, query_id, chunk_id, pos). All arms read one set of hits and are fused in one aggregate."""
    chunks, q = chunks_of(spark, sf_dir), benchmark(spark, sf_dir)
    arm = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(again).alias("again"), F.array(*map(F.lit, channels)).alias("channels")) for a, (channels, again) in ARM_CHANNELS.items() if a in arms)))
    hits = all_hits_of(spark, sf_dir).withColumn("a", arm).where(F.array_contains("a.channels", F.col("channel"))).select("a.arm", "a.again", "query_id", "channel", "chunk_id", "score", "rank")
    fused = retrieval.rrf(hits, by=("arm", "again", "query_id"))
    pool = retrieval.candidates(fused.where("again"))
    done = retrieval.rerank(pool, retrieval.overlap_scores(pool, chunks, q), by=("arm", "query_id"))
    return done.select("arm", "query_id", "chunk_id", "pos").unionAll(fused.where("not again").select("arm", "query_id", "chunk_id", "pos"))


@query(f"WITH RECURSIVE {ARMS} {FIRST.format(depth=10)} SELECT {METRICS} FROM asked_arms LEFT JOIN first_ USING (arm, query_id) WHERE arm = 'full'")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of the full line over all benchmark texts that stand in a chunk."""
    return E.metrics(runs_of(spark, sf_dir, ("full",)), gold_of(spark, sf_dir, chunks_of(spark, sf_dir)), ("full",), (1, 3, 5, 10), 10).drop("arm")


@query(f"WITH RECURSIVE {ARMS} {FIRST.format(depth=10)} SELECT arm, {METRICS} FROM asked_arms LEFT JOIN first_ USING (arm, query_id) GROUP BY arm")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all seven arms."""
    return E.metrics(runs_of(spark, sf_dir), gold_of(spark, sf_dir, chunks_of(spark, sf_dir)), tuple(ARM_CHANNELS), (1, 3, 5, 10), 10)


@query(f"""
WITH RECURSIVE {ARMS} {FIRST.format(depth=50)}
SELECT arm, round(avg((coalesce(r, 999) <= 1)::INT), 6) AS r_at_1, round(avg((coalesce(r, 999) <= 5)::INT), 6) AS r_at_5, round(avg((coalesce(r, 999) <= 10)::INT), 6) AS r_at_10, round(avg((coalesce(r, 999) <= 30)::INT), 6) AS r_at_30,
 round(avg((coalesce(r, 999) <= 50)::INT), 6) AS r_at_50, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(1 - avg((r IS NOT NULL)::INT), 6) AS missing_from_pool, round(avg((r IS NOT NULL)::INT) - avg((coalesce(r, 999) <= 10)::INT), 6) AS lost_later
FROM asked_arms LEFT JOIN first_ USING (arm, query_id) WHERE arm IN ('dense_only', 'sparse_only', 'no_rerank', 'full') GROUP BY arm""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by depth for every stage (dense, sparse, fused, reranked), and where gold chunks are lost."""
    stages = ("dense_only", "sparse_only", "no_rerank", "full")
    return E.funnel(runs_of(spark, sf_dir, stages), gold_of(spark, sf_dir, chunks_of(spark, sf_dir)), stages, (1, 5, 10, 30, 50), 50)


@query(f"""
WITH RECURSIVE {CHUNKS}, {GOLD},
g AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'single_hop' ELSE 'unanswerable' END AS type FROM benchmark)
SELECT query_id, 'answerable_without_gold' AS problem FROM g WHERE type <> 'unanswerable' AND query_id NOT IN (SELECT query_id FROM gold)
UNION ALL SELECT DISTINCT query_id, 'unanswerable_with_gold' FROM g JOIN gold USING (query_id) WHERE type = 'unanswerable'""")
def golden_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions of a question set (types by parity of the id, gold chunks by evidence)."""
    chunks = chunks_of(spark, sf_dir)
    gold = gold_of(spark, sf_dir, chunks)
    g = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "single_hop").otherwise("unanswerable").alias("type"))
    return E.golden_problems(g, gold.select("query_id", "chunk_id", "document_id", F.col("document_id").alias("gold_document_id")), chunks).select("query_id", "problem")


@query("""
WITH r AS (SELECT doc_id, quality = 0 AS unanswerable, toxic = 1 AS refused, 1 + doc_id % 3 AS checked, least(doc_id % 4, 1 + doc_id % 3) AS grounded FROM labels)
SELECT round(coalesce(count(*) FILTER (unanswerable AND refused) / nullif(count(*) FILTER (unanswerable), 0), 0), 6) AS refuse_accuracy, count(*) FILTER (unanswerable) AS refuse_n,
 round(coalesce(count(*) FILTER (NOT unanswerable AND refused) / nullif(count(*) FILTER (NOT unanswerable), 0), 0), 6) AS false_refuse_rate, count(*) FILTER (NOT unanswerable AND refused) AS false_refuse_n,
 round(sum(grounded) / sum(checked), 6) AS citation_groundedness, sum(checked)::BIGINT AS citations_checked FROM r""")
def refusal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusal and groundedness ratios (labels stand for question types and routes)."""
    rows = table(spark, sf_dir, "labels").select(
        F.when(F.col("quality") == 0, "unanswerable").otherwise("single_hop").alias("type"), F.when(F.col("toxic") == 1, "refuse").otherwise("generate").alias("route"), F.lit(0).alias("n_citations"),
        (1 + F.col("doc_id") % 3).alias("checked"), F.least(F.col("doc_id") % 4, 1 + F.col("doc_id") % 3).alias("grounded"),
    )
    return E.refusal(rows)


@query()
def hash_embedding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search with hashed token counts as vectors; tested against a plain version."""
    from quarry.providers import HashEmbedder

    chunks = chunks_of(spark, sf_dir)
    e = HashEmbedder()
    return index.dense(e.embed(chunks, "content").select("chunk_id", "dense"), e.embed(benchmark(spark, sf_dir), "text", is_query=True).select("query_id", "dense"))


@query(f"""
WITH RECURSIVE {FINAL}
SELECT query_id, coalesce(substr(content, 1, 80), '') AS answer_head, sha256(coalesce(content, '')) AS answer_hash, CASE WHEN content IS NULL THEN 'refuse' ELSE 'generate' END AS route
FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN (SELECT query_id, content FROM final WHERE rank = 1) USING (query_id)""")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer without a model: the best chunk with its citation, or a refusal."""
    from quarry.operators import answers

    chunks = chunks_of(spark, sf_dir)
    rows, _ = retrieval.hydrate(retrieval.rrf(hits_of(spark, sf_dir)), chunks, 5)
    out = answers.extractive(benchmark(spark, sf_dir).select("query_id"), retrieval.dedupe(rows))
    answer = F.when(F.col("route") == "generate", F.regexp_replace("answer", r" \[1\]$", "")).otherwise("")
    return out.select("query_id", F.substring(answer, 1, 80).alias("answer_head"), F.sha2(answer, 256).alias("answer_hash"), "route")


