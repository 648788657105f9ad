"""Fusion, candidate choice, reranking, order by intent, hydration, de-duplication, context.

Every step takes and gives rows for many queries at once and partitions by query_id. Only ids, ranks and
scores travel until ``hydrate`` joins the texts of the few hits that are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry._session import shared_folder
from quarry.config import RetrievalSettings
from quarry.functions import text as X
from quarry.operators.index import bm25, dense

Scorer = Callable[[DataFrame], DataFrame]


def channel(hits: DataFrame, name: str) -> DataFrame:
    """Ranked hits as rows of a channel."""
    return hits.select("query_id", F.lit(name).alias("channel"), "chunk_id", "score", "rank")


def rrf(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None, top_k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion: query_id, chunk_id, score, dense_rank, sparse_rank, dense_score, head_rank, sources, pos.

    ``hits`` has query_id, channel, chunk_id, score, rank, one row for each channel and chunk. A channel of
    weight 0 is left out, others weigh 1 unless given. pos orders by (score to 9 digits, descending; chunk_id).
    ``by`` says what one list of hits belongs to, such as an arm of an experiment and a query.
    """
    if k <= 0:
        raise ValueError("k has to be positive")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, float(w)).otherwise(weight)
    is_dense, is_sparse = F.col("channel").startswith("dense"), F.col("channel").startswith("sparse")
    fused = (
        hits.withColumn("w", weight)
        .where("w <> 0")
        .groupBy(*by, "chunk_id")
        .agg(
            F.round(F.sum(F.col("w") / (F.lit(k) + F.col("rank"))), 9).alias("score"),
            F.min(F.when(is_dense, F.col("rank"))).alias("dense_rank"),
            F.min(F.when(is_sparse, F.col("rank"))).alias("sparse_rank"),
            F.max(F.when(is_dense, F.col("score"))).alias("dense_score"),
            F.min("rank").alias("head_rank"),
            F.array_sort(F.collect_set("channel")).alias("sources"),
        )
    )
    out = fused.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")))
    return out.where(F.col("pos") <= top_k) if top_k else out


def candidates(fused: DataFrame, settings: RetrievalSettings | None = None) -> DataFrame:
    """The head of the fused list and the heads of all channels, in fused order."""
    s = settings or RetrievalSettings()
    return fused.where((F.col("pos") <= s.fused_top_k) | (F.col("head_rank") <= s.channel_head))


def rerank(pool: DataFrame, scores: DataFrame | None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """New positions by rerank score (9 digits, descending; chunk_id); those without one follow in fused order.

    ``scores`` has query_id, chunk_id, rerank_score; without it (no reranker, or it failed) the order stays.
    """
    if scores is None:
        return pool.withColumn("rerank_score", F.lit(None).cast("double"))
    joined = pool.join(scores.select("query_id", "chunk_id", F.round("rerank_score", 9).alias("rerank_score")), ["query_id", "chunk_id"], "left")
    scored = F.col("rerank_score").isNotNull()
    order = Window.partitionBy(*by).orderBy(F.desc(scored), F.desc_nulls_last("rerank_score"), F.when(scored, F.col("chunk_id")).otherwise(F.col("pos")))
    return joined.withColumn("pos", F.row_number().over(order))


def overlap_scores(pool: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """A deterministic reranker: share of the query's distinct tokens that stand in the candidate's document text.

    That is ``rerank_document`` of the chunk, with its title and section where the table has them.
    """
    text = rerank_document(*(F.col(c) if c in chunks.columns else F.lit("") for c in ("doc_title", "section_path")))
    pairs = pool.select("query_id", "chunk_id").distinct()
    texts = pairs.join(chunks.select("chunk_id", text.alias("read")), "chunk_id").join(queries.select("query_id", F.array_distinct(X.tokens(F.col("text"))).alias("asked")), "query_id")
    found = F.size(F.array_intersect("asked", F.array_distinct(X.tokens(F.col("read")))))
    return texts.select("query_id", "chunk_id", F.round(found / F.greatest(F.size("asked"), F.lit(1)), 9).alias("rerank_score"))


def rerank_query(pool: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Which text to rerank with: query_id, cjk_share, rerank_text (``queries`` has query_id, text, translated)."""
    share = pool.select("query_id", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id").groupBy("query_id").agg(F.avg(X.mostly_cjk(F.col("content")).cast("double")).alias("cjk_share"))
    q, t = F.col("text"), F.col("translated")
    both = F.concat(q, F.lit("\n"), t)
    pick = (
        F.when(F.coalesce(t, F.lit("")) == "", q)
        .when(q.rlike(X.BIBLIOGRAPHIC) | X.mixed_language_term(q), both)
        .when(F.col("cjk_share") <= 0.35, t)
        .when(F.col("cjk_share") >= 0.65, q)
        .otherwise(both)
    )
    return queries.join(share, "query_id", "left").select("query_id", "cjk_share", pick.alias("rerank_text"))


def rerank_document(title="doc_title", section="section_path", content="content"):  # noqa: ANN001, ANN201
    """The text a reranker reads of a candidate."""
    return F.concat(F.lit("Document: "), F.coalesce(title, F.lit("")), F.lit("\nSection: "), F.coalesce(section, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))


def by_intent(pool: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """New positions by what a query asks for.

    Author comparisons bring metadata to the front; others but bibliographic ones send references and
    metadata to the back; questions about several documents show the first hit of each document first.
    """
    known = chunks.select("chunk_id", "node_type", "document_id")
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = pool.join(known, "chunk_id", "left").join(q, "query_id")
    late = (
        F.when(F.col("text").rlike(X.AUTHOR_COMPARISON), F.col("node_type").isNull() | (F.col("node_type") != "metadata"))
        .when(F.col("text").rlike(X.BIBLIOGRAPHIC), F.lit(False))
        .otherwise(F.col("node_type").isNull() | F.col("node_type").isin("reference", "metadata"))
    )
    rows = rows.withColumn("late", late).withColumn("doc", F.coalesce("document_id", -F.col("chunk_id")))
    first = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("late", "pos"))
    rows = rows.withColumn("again", F.when(F.col("text").rlike(X.MULTI_DOCUMENT), first > 1).otherwise(F.lit(False)))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("again", "late", "pos")))
    return rows.select(*pool.columns)


def diversify(pool: DataFrame, document: str) -> DataFrame:
    """New positions: the first hit of every document, then the rest, else in order."""
    again = F.row_number().over(Window.partitionBy("query_id", document).orderBy("pos")) > 1
    return pool.withColumn("again", again).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("again", "pos"))).drop("again")


def hydrate(pool: DataFrame, chunks: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """The first ``top_k`` of each query with their records, and how many of them are missing from the store.

    The cut comes before the join, so a query may get fewer than ``top_k``.
    """
    head = pool.where(F.col("pos") <= top_k)
    joined = head.join(chunks.withColumn("known", F.lit(True)), "chunk_id", "left")
    missing = joined.groupBy("query_id").agg(F.count("*").alias("asked"), F.count_if(F.col("known").isNull()).alias("missing"))
    return joined.where("known").drop("known"), missing


def dedupe(rows: DataFrame) -> DataFrame:
    """One of the rows of a query with equal folded content, that of the best position; rank from 1. Empty ones all stay."""
    key = X.fold(F.coalesce("content", F.lit("")))
    rows = rows.withColumn("key", F.when(key == "", F.concat(F.lit("\u0000"), F.col("chunk_id").cast("string"))).otherwise(key))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("pos"))).where("copy = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).drop("key", "copy")


def siblings(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Other chunks of the same parent block: (chunk_id, sibling_ids in order)."""
    asked = rows.select("chunk_id").distinct()
    own = asked.join(chunks.select("chunk_id", "document_id", "parent_index"), "chunk_id")
    block = chunks.select("document_id", "parent_index", F.col("chunk_id").alias("other"))
    return own.join(block, ["document_id", "parent_index"]).where("other <> chunk_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list("other")).alias("sibling_ids"))


def within_budget(rows: DataFrame, max_chars: int) -> DataFrame:
    """Blocks of each query from the first on while their lengths sum up to the budget; the first always.

    Adds block and used (characters up to and with it). A block that goes over ends the list.
    """
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("label", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("block", block).withColumn("used", F.sum(F.char_length("block")).over(order))
    # lengths are positive, so the running sum crosses the budget once
    return rows.withColumn("nth", F.row_number().over(order)).where((F.col("used") <= max_chars) | (F.col("nth") == 1)).drop("nth")


def context(rows: DataFrame, max_chars: int = 12000) -> DataFrame:
    """The context of each query: query_id, n_blocks, context."""
    kept = within_budget(rows, max_chars)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"])
    return kept.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.array_join(blocks, "\n\n---\n\n").alias("context"))


def merge_rounds(previous: DataFrame, fresh: DataFrame, top_k: int) -> DataFrame:
    """Hits of an earlier and a later round: earlier ones first, each chunk once, 2 * top_k at most, ranks from 1."""
    rows = previous.select("query_id", "chunk_id", F.lit(0).alias("round"), "rank").unionByName(fresh.select("query_id", "chunk_id", F.lit(1).alias("round"), "rank"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("round", "rank"))).where("nth = 1")
    rows = rows.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("round", "rank", "chunk_id")))
    return rows.where(F.col("new_rank") <= 2 * top_k).select("query_id", "chunk_id", F.col("new_rank").alias("rank"))


def isolated(channels: dict[str, Callable[[], DataFrame]], failures: dict[str, str] | None = None) -> DataFrame:
    """The rows of all channels that can be planned and run; what failed is named in ``failures`` with its error.

    Each channel is run on its own into the shared folder (top_k rows a query), so that one that fails
    leaves the others as they are. If all fail, the last error is raised.
    """
    out, error = None, None
    for name, plan in channels.items():
        try:
            rows = channel(plan(), name).checkpoint(eager=True)
        except Exception as e:  # noqa: BLE001  whatever a channel's provider or plan raises
            error = e
            if failures is not None:
                failures[name] = f"{type(e).__name__}: {e}".splitlines()[0]
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise error or ValueError("no channel is left")
    return out


def search(
    chunks: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    settings: RetrievalSettings | None = None,
    use_dense: bool = True,
    use_sparse: bool = True,
    use_rerank: bool = True,
    use_translate: bool = True,
    scorer: Scorer | None = None,
    lexical: Callable[[DataFrame, int, float, float], DataFrame] | None = None,
    failures: dict[str, str] | None = None,
) -> DataFrame:
    """Channels of every query, fused: the columns of ``rrf``.

    ``queries`` has query_id and text, and may have translated; blank queries give no rows. A translation
    adds channels ``*_x`` and never replaces one. A channel without its tables is left out; one that fails is
    left out and named in ``failures``, as is a reranker that fails, whose fused order then stays. ``lexical``
    searches an index instead of the chunks (as ``LexicalIndex.search``).
    """
    s = settings or RetrievalSettings()
    shared_folder(chunks.sparkSession)
    queries = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    find = lexical or (lambda q, *limits: bm25(chunks, q, *limits))
    plans: dict[str, Callable[[], DataFrame]] = {}
    if use_sparse:
        plans["sparse"] = lambda: find(queries.select("query_id", "text"), s.sparse_top_k, s.k1, s.b)
        if use_translate and "translated" in queries.columns:
            other = queries.where("coalesce(translated, '') <> '' and translated <> text").select("query_id", F.col("translated").alias("text"))
            plans["sparse_x"] = lambda: find(other, s.sparse_top_k, s.k1, s.b)
    if use_dense and vectors is not None and query_vectors is not None:
        plans["dense"] = lambda: dense(vectors, query_vectors.join(queries.select("query_id"), "query_id", "left_semi"), s.dense_top_k)
    fused = rrf(isolated(plans, failures), s.rrf_k)
    if use_rerank and scorer is not None:
        pool = candidates(fused, s)
        try:
            scores = scorer(pool).checkpoint(eager=True)
        except Exception as e:  # noqa: BLE001  whatever a reranker raises
            scores = None
            if failures is not None:
                failures["rerank"] = f"{type(e).__name__}: {e}".splitlines()[0]
        fused = rerank(pool, scores)
    return fused


def retrieve(chunks: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """The whole line for every query: search, order by intent, cut, hydrate, de-duplicate, renumber."""
    s = options.get("settings") or RetrievalSettings()
    pool = by_intent(search(chunks, queries, **options), chunks, queries)
    rows, _ = hydrate(pool, chunks, s.final_top_k)
    return dedupe(rows)


def diagnostics(hits: DataFrame, fused: DataFrame, final: DataFrame) -> DataFrame:
    """One row for each query: hits of the channels, fused chunks, final ones and their documents."""
    a = hits.groupBy("query_id").agg(F.count_if(F.col("channel").startswith("dense")).alias("n_dense"), F.count_if(F.col("channel").startswith("sparse")).alias("n_sparse"))
    b = fused.groupBy("query_id").agg(F.count("*").alias("n_fused"), F.max("score").alias("top_score"))
    c = final.groupBy("query_id").agg(F.count("*").alias("n_final"), F.count_distinct("document_id").alias("n_documents"))
    return a.join(b, "query_id", "left").join(c, "query_id", "left").fillna(0, ["n_fused", "n_final", "n_documents"])
