"""Lexical (BM25) and dense search over tables, many queries in one plan.

Queries are the small side: they go to every task in parts of a bounded size, each task scores its own
chunks against all of them and keeps its best hits for each query, and only those are shuffled to be ranked.
Postings are never shuffled, and no pair of query and chunk without a shared term is ever made.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry._session import workers_see_package
from quarry.functions import text as X

#: Queries that one pass takes; more queries take more passes.
QUERY_BLOCK = 5000
HITS = "query_id long, chunk_id long, score double"

_RUNS = re.compile("([㐀-䶿一-鿿]+)|((?:(?![㐀-䶿一-鿿])[^\\W_])+)")


def tokenise(text: str) -> list[str]:
    """As ``quarry.functions.text.tokens``."""
    out: list[str] = []
    for cjk, word in _RUNS.findall(text or ""):
        if word:
            out.append(word.lower())
        else:
            out += list(cjk)
            out += map("".join, zip(cjk, cjk[1:], strict=False))
    return out


def ranked(hits: DataFrame, top_k: int, by: tuple[str, ...] = ("query_id",), digits: int = 6) -> DataFrame:
    """Hits with rank from 1 by (score rounded, descending; chunk_id), the first ``top_k`` of each query."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", digits)), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).withColumn("score", F.round("score", digits))


def query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """The queries in parts of about QUERY_BLOCK rows; the driver holds one part at a time."""
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        yield part.select(*columns).collect()


def corpus_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: n chunks and avg_len, their average number of tokens (an empty chunk counts as 1)."""
    return chunks.select(F.greatest(F.size(X.tokens(F.col(content))), F.lit(1)).alias("n")).agg(F.count("*").alias("n_chunks"), F.avg("n").alias("avg_len"))


def term_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """term, df (chunks that have it) and cf (times it stands)."""
    terms = chunks.select("chunk_id", F.explode(X.tokens(F.col(content))).alias("term"))
    each = terms.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _counts(chunks: DataFrame, terms: frozenset[str]) -> tuple[int, float, dict[str, int]]:
    """Chunks, average length, and df of the given terms: one pass, partial sums for each task."""
    sent = chunks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df, n, total = sent.value, Counter(), 0, 0
        for b in batches:
            for t in b.column(1).to_pylist():
                words = tokenise(t)
                n += 1
                total += max(len(words), 1)
                df.update(wanted.intersection(words))
        keys = list(df)
        yield pa.RecordBatch.from_arrays([pa.array([None, None, *keys], pa.string()), pa.array(["n", "len", *["df"] * len(keys)]), pa.array([n, total, *df.values()], pa.int64())], names=["term", "kind", "n"])

    rows = chunks.select("chunk_id", "content").mapInArrow(run, "term string, kind string, n long").groupBy("term", "kind").agg(F.sum("n").alias("n")).collect()
    one = {r.kind: r.n for r in rows if r.term is None}
    n = one.get("n", 0)
    return n, one.get("len", 0) / n if n else 1.0, {r.term: r.n for r in rows if r.term is not None}


def bm25(chunks: DataFrame, queries: DataFrame, top_k: int = 50, k1: float = 1.2, b: float = 0.75, stats_of: DataFrame | None = None) -> DataFrame:
    """BM25 hits: query_id, chunk_id, score (6 digits), rank.

    ``chunks`` has chunk_id and content, ``queries`` query_id and text. A query's terms count once each.
    Statistics are of ``stats_of`` (all active chunks, whatever the filters), by default of ``chunks``.
    Queries without terms, and null ones, have no hits.
    """
    workers_see_package(chunks.sparkSession)
    slim = chunks.select(F.col("chunk_id").cast("long"), "content")
    base = slim if stats_of is None else stats_of.select(F.col("chunk_id").cast("long"), "content")
    sc = chunks.sparkSession.sparkContext
    out = None
    for rows in query_blocks(queries.where("query_id is not null"), ["query_id", "text"]):
        terms = [sorted(set(tokenise(r.text))) for r in rows]
        asked: dict[str, list[int]] = defaultdict(list)
        for q, words in enumerate(terms):
            for t in words:
                asked[t].append(q)
        n, avg, df = _counts(base, frozenset(asked))
        table = {t: (math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)), np.array(qs)) for t, qs in asked.items() if t in df}
        part = _bm25_pass(slim, sc.broadcast((table, np.array([r.query_id for r in rows], np.int64), avg or 1.0)), top_k, k1, b)
        out = part if out is None else out.unionAll(part)
    hits = chunks.sparkSession.createDataFrame([], HITS) if out is None else out
    return ranked(hits, top_k)


def _bm25_pass(chunks: DataFrame, sent, top_k: int, k1: float, b: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, avg = sent.value
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        floor = np.zeros(len(ids))
        scores = np.zeros(len(ids))
        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokenise(text)
                counts = Counter(w for w in words if w in table)
                if not counts:
                    continue
                scores[:] = 0
                norm = k1 * (1 - b + b * max(len(words), 1) / avg)
                for t in sorted(counts):
                    idf, qs = table[t]
                    tf = counts[t]
                    scores[qs] += idf * tf * (k1 + 1) / (tf + norm)
                for q in np.flatnonzero((scores > 0) & (scores >= floor)).tolist():
                    heap, item = best[q], (round(float(scores[q]), 6), -chunk)
                    if len(heap) < top_k:
                        heapq.heappush(heap, item)
                    else:
                        heapq.heappushpop(heap, item)
                        floor[q] = heap[0][0] - 1e-6
        found = [(q, -c, s) for q, heap in enumerate(best) for s, c in heap]
        yield pa.RecordBatch.from_arrays([pa.array(ids[[q for q, _, _ in found]] if found else [], pa.int64()), pa.array([c for _, c, _ in found], pa.int64()), pa.array([s for *_, s in found], pa.float64())], names=["query_id", "chunk_id", "score"])

    return chunks.mapInArrow(run, HITS)


def dense(vectors: DataFrame, queries: DataFrame, top_k: int = 50) -> DataFrame:
    """Inner-product hits in double precision: query_id, chunk_id, score (6 digits), rank.

    ``vectors`` has chunk_id and dense, ``queries`` query_id and dense. Vectors that are null, of another
    length or hold null components have no hits.
    """
    workers_see_package(vectors.sparkSession)
    sc = vectors.sparkSession.sparkContext
    good = "dense is not null and size(dense) > 0 and not exists(dense, x -> x is null)"
    slim = vectors.where(good).select(F.col("chunk_id").cast("long"), F.col("dense").cast("array<double>").alias("dense"))
    out = None
    for rows in query_blocks(queries.where(good).where("query_id is not null"), ["query_id", "dense"]):
        sizes = defaultdict(list)
        for r in rows:
            sizes[len(r.dense)].append(r)
        for size, some in sorted(sizes.items()):
            sent = sc.broadcast((np.array([r.query_id for r in some], np.int64), np.array([r.dense for r in some], np.float64)))
            part = _dense_pass(slim.where(F.size("dense") == size), sent, top_k)
            out = part if out is None else out.unionAll(part)
    hits = vectors.sparkSession.createDataFrame([], HITS) if out is None else out
    return ranked(hits, top_k)


def _dense_pass(vectors: DataFrame, sent, top_k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        held_ids, held = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for b in batches:
            if not b.num_rows:
                continue
            chunk = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(len(chunk), -1)
            scores = np.concatenate([held, np.round(q @ x.T, 6)], axis=1)
            all_ids = np.concatenate([held_ids, np.broadcast_to(chunk, (len(ids), len(chunk)))], axis=1)
            order = np.lexsort((all_ids, -scores), axis=1)[:, :top_k]
            held, held_ids = np.take_along_axis(scores, order, 1), np.take_along_axis(all_ids, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, held.shape[1])), pa.array(held_ids.ravel()), pa.array(held.ravel())], names=["query_id", "chunk_id", "score"])

    return vectors.mapInArrow(run, HITS)


# --- index tables -------------------------------------------------------------------------------


def upsert(index: DataFrame, records: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with ``records`` in place of rows of the same key; idempotent. Keys of ``records`` have to be distinct."""
    return index.join(records.select(key), key, "left_anti").select(*records.columns).unionByName(records)


def replace_documents(index: DataFrame, records: DataFrame) -> DataFrame:
    """The index with ``records`` in place of all rows of their documents and tenants, also if they are fewer than before."""
    own = records.select("tenant_id", "document_id").distinct()
    return index.join(own, ["tenant_id", "document_id"], "left_anti").select(*records.columns).unionByName(records)


def delete_document(index: DataFrame, document_id: int, tenant_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """The index without a document of a tenant, and one row with how many rows go."""
    gone = (F.col("document_id") == document_id) & (F.col("tenant_id") == tenant_id)
    return index.where(~F.coalesce(gone, F.lit(False))), index.where(gone).agg(F.count("*").alias("deleted"))


def reconcile(store: DataFrame, index: DataFrame) -> DataFrame:
    """Chunk ids that only one side has: (chunk_id, missing_in)."""
    both = store.select("chunk_id", F.lit(1).alias("s")).join(index.select("chunk_id", F.lit(1).alias("i")), "chunk_id", "full")
    return both.where("s is null or i is null").select("chunk_id", F.when(F.col("s").isNull(), "store").otherwise("index").alias("missing_in"))


def active(index: DataFrame, tenant_id: int = 1) -> DataFrame:
    """Rows of a tenant that search may return; reaches the scan as a filter."""
    return index.where((F.col("tenant_id") == tenant_id) & F.col("is_active"))
