"""A lexical index that stands in tables: segments of postings, added, replaced and removed by document.

A segment holds the postings of some thousand chunks, one row for each term (``chunks``, ``tfs`` and the
chunks' ``lengths``), and one row without a term that lists its chunks and their documents. Rows are dealt to
folders by hash of the term, so a search reads the buckets of the asked terms alone and tokenises no text.
Segments are never changed: removing documents writes those that hold them anew under a new generation. The
manifest says which generation of which segment counts; it is written last, so a job that dies leaves the
index as it was. One writer at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import workers_see_package
from quarry.operators.index import HITS, query_blocks, ranked, tokenise

#: Chunks of a segment, at most; folders by hash of the term; queries that are scored together in a segment.
SEGMENT, BUCKETS, SLICE = 8192, 16, 256
POSTING = "segment long, term string, chunks array<long>, tfs array<int>, lengths array<int>, documents array<long>"
MANIFEST = "version long, segment long, generation long, n_chunks long, total_length long"


@dataclass
class LexicalIndex:
    """The index in ``folder``, a path that driver and executors share."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    segment: int = SEGMENT

    # --- tables ---------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest") if self._exists("manifest") else self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """Number of the last manifest; 0 before the first."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def manifest(self) -> DataFrame:
        """The segments that count, with their generations, chunks and lengths."""
        return self._manifests().where((F.col("version") == self.version()) & (F.col("segment") >= 0))

    def postings(self) -> DataFrame:
        """Rows of the segments that count, with their bucket. A manifest is a row a segment, so it is joined as it is best."""
        if not self._exists("postings"):
            return self.spark.createDataFrame([], POSTING + ", bucket int")
        rows = self.spark.read.schema(POSTING + ", generation long, bucket int").parquet(f"{self.folder}/postings")
        return rows.join(self.manifest().select("segment", "generation"), ["segment", "generation"], "left_semi").drop("generation")

    def directory(self) -> DataFrame:
        """segment, chunk_id, document_id and length of every chunk."""
        rows = self.postings().where("bucket = -1")
        return rows.select("segment", F.explode(F.arrays_zip("chunks", "documents", "lengths")).alias("c")).select("segment", F.col("c.chunks").alias("chunk_id"), F.col("c.documents").alias("document_id"), F.col("c.lengths").alias("length"))

    def stats(self) -> tuple[int, float]:
        """Chunks and their average length, from the manifest alone."""
        r = self.manifest().agg(F.sum("n_chunks").alias("n"), F.sum("total_length").alias("len")).first()
        return int(r.n or 0), (r.len / r.n if r.n else 1.0)

    def _write(self, rows: DataFrame, gone: DataFrame | None) -> None:
        """Write segments under a new generation, then the manifest: what counted less ``gone``, and the new ones."""
        version = self.version() + 1
        bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        rows.withColumn("generation", F.lit(version)).withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("generation", "bucket").parquet(f"{self.folder}/postings")
        mine = self.spark.read.schema(POSTING + ", generation long, bucket int").parquet(f"{self.folder}/postings").where(f"generation = {version} and bucket = -1 and size(chunks) > 0")
        fresh = mine.select("segment", "generation", F.size("chunks").cast("long").alias("n_chunks"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_length"))
        held = self.manifest().drop("version")
        if gone is not None:
            held = held.join(gone.select("segment").distinct(), "segment", "left_anti")
        mark = self.spark.range(1).select(*(F.lit(x).cast("long").alias(c) for c, x in (("segment", -1), ("generation", version), ("n_chunks", 0), ("total_length", 0))))  # an empty index has a manifest too
        held.unionByName(fresh).unionByName(mark).select(F.lit(version).cast("long").alias("version"), "segment", "generation", "n_chunks", "total_length").write.mode("append").parquet(f"{self.folder}/manifest")

    # --- changes --------------------------------------------------------------------------------

    def add(self, chunks: DataFrame) -> None:
        """Index ``chunks`` (chunk_id, document_id, content); documents that are there are replaced whole, so again is the same."""
        workers_see_package(self.spark)
        self.remove(chunks.select("document_id").distinct())
        most, generation = self.segment, self.version() + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = (generation << 40) + (TaskContext.get().partitionId() << 16)
            held = _Segment(first)
            for b in batches:
                for chunk, document, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    held.take(chunk, document, tokenise(text))
                    if len(held.chunks) >= most:
                        yield from held.rows()
                        held = _Segment(held.number + 1)
            if held.chunks:
                yield from held.rows()

        slim = chunks.select(F.col("chunk_id").cast("long"), F.col("document_id").cast("long"), "content")
        self._write(slim.mapInArrow(run, POSTING), None)

    def remove(self, documents: DataFrame) -> None:
        """Take documents (document_id) out; only segments that hold one of them are written anew."""
        if not self._exists("manifest"):
            return
        dead = self.directory().join(documents.select(F.col("document_id").cast("long")).distinct(), "document_id", "left_semi").groupBy("segment").agg(F.collect_set("chunk_id").alias("dead"))
        if dead.limit(1).count():  # at most ``segment`` ids in a row
            rows = self.postings().drop("bucket").join(dead, "segment")
            out = F.col("dead")
            keep = F.transform(F.col("chunks"), lambda c: ~F.array_contains(out, c))
            cut = lambda name: F.when(F.col(name).isNull(), F.col(name)).otherwise(F.transform(F.filter(F.arrays_zip(name, F.col("keep")), lambda x: x["keep"]), lambda x: x[name]))
            rows = rows.withColumn("keep", keep).select("segment", "term", *(cut(x).alias(x) for x in ("chunks", "tfs", "lengths", "documents")))
            self._write(rows.where("term is null or size(chunks) > 0"), dead)

    # --- search ---------------------------------------------------------------------------------

    def term_stats(self, terms: DataFrame) -> DataFrame:
        """df and cf of each of the given terms (term)."""
        asked = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        return self.postings().join(asked, ["bucket", "term"]).groupBy("term").agg(F.sum(F.size("chunks")).alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("cf"))

    def search(self, queries: DataFrame, top_k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """BM25 hits as of ``index.bm25``: query_id, chunk_id, score (6 digits), rank; of the asked terms' postings alone."""
        workers_see_package(self.spark)
        n, avg = self.stats()
        out = None
        for rows in query_blocks(queries.where("query_id is not null"), ["query_id", "text"]) if n else ():
            asked: dict[str, list[int]] = defaultdict(list)
            for q, r in enumerate(rows):
                for t in set(tokenise(r.text)):
                    asked[t].append(q)
            if asked:
                part = self._scored(rows, asked, n, avg, top_k, k1, b)
                out = part if out is None else out.unionAll(part)
        return ranked(self.spark.createDataFrame([], HITS) if out is None else out, top_k)

    def _scored(self, rows: list, asked: dict[str, list[int]], n: int, avg: float, top_k: int, k1: float, b: float) -> DataFrame:
        sc = self.spark.sparkContext
        # the terms of at most QUERY_BLOCK queries
        terms = self.spark.createDataFrame([(t,) for t in asked], "term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        met = self.postings().join(F.broadcast(terms), ["bucket", "term"], "left_semi").select("segment", "term", "chunks", "tfs", "lengths")
        df = {r.term: r.df for r in met.groupBy("term").agg(F.sum(F.size("chunks")).alias("df")).collect()}
        table = {t: (math.log(1 + (n - d + 0.5) / (d + 0.5)), np.array(asked[t])) for t, d in df.items()}
        sent = sc.broadcast((table, np.array([r.query_id for r in rows], np.int64)))

        def score(segment: pd.DataFrame) -> pd.DataFrame:
            mine, ids = sent.value
            segment = segment.sort_values("term")
            chunks = np.unique(np.concatenate(segment["chunks"].to_list()))
            out = []
            places, weights = [], []
            for t, c, tf, size in zip(segment["term"], segment["chunks"], segment["tfs"], segment["lengths"], strict=True):
                places.append(np.searchsorted(chunks, c))
                weights.append(mine[t][0] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(size, 1) / avg)))
            asks = [mine[t][1] for t in segment["term"]]
            for first in range(0, len(ids), SLICE):
                scores = np.zeros((min(SLICE, len(ids) - first), len(chunks)))
                for qs, at, w in zip(asks, places, weights, strict=True):
                    for q in qs[np.searchsorted(qs, first) : np.searchsorted(qs, first + SLICE)].tolist():
                        scores[q - first, at] += w
                scores = np.round(scores, 6)
                for q, row in enumerate(scores):
                    some = np.flatnonzero(row > 0)
                    if len(some) > top_k:  # all that are as good as the last of the best, then the least ids among equals
                        some = some[row[some] >= np.partition(row[some], -top_k)[-top_k]]
                        some = some[np.lexsort((chunks[some], -row[some]))[:top_k]]
                    if len(some):
                        out.append(pd.DataFrame({"query_id": ids[first + q], "chunk_id": chunks[some], "score": row[some]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "chunk_id": np.zeros(0, np.int64), "score": np.zeros(0)})

        return met.groupBy("segment").applyInPandas(score, HITS)


class _Segment:
    """Postings of a segment while it is filled."""

    def __init__(self, number: int):
        self.number = number
        self.chunks: list[int] = []
        self.documents: list[int] = []
        self.lengths: list[int] = []
        self.terms: dict[str, tuple[list[int], list[int]]] = {}

    def take(self, chunk: int, document: int, words: list[str]) -> None:
        at = len(self.chunks)
        self.chunks.append(chunk)
        self.documents.append(document)
        self.lengths.append(max(len(words), 1))
        for w in words:
            places, tfs = self.terms.setdefault(w, ([], []))
            if places and places[-1] == at:
                tfs[-1] += 1
            else:
                places.append(at)
                tfs.append(1)

    def rows(self, most: int = 4096) -> Iterator[pa.RecordBatch]:
        names = ["segment", "term", "chunks", "tfs", "lengths", "documents"]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([self.number]), pa.array([None], pa.string()), pa.array([self.chunks], longs), pa.array([None], ints), pa.array([self.lengths], ints), pa.array([self.documents], longs)], names=names)
        chunks, lengths = np.array(self.chunks), np.array(self.lengths, np.int32)
        items = sorted(self.terms.items())
        for i in range(0, len(items), most):
            part = items[i : i + most]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(part), self.number)),
                    pa.array([t for t, _ in part], pa.string()),
                    pa.array([chunks[p] for _, (p, _) in part], longs),
                    pa.array([tf for _, (_, tf) in part], ints),
                    pa.array([lengths[p] for _, (p, _) in part], ints),
                    pa.nulls(len(part), longs),
                ],
                names=names,
            )
