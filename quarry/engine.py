"""The engine as one object: tables in a folder, ingestion, retrieval, answers, deletion, reindexing, health.

Tables are Parquet folders: documents, nodes-free chunks and index rows by collection. A table is replaced by
writing a new version beside the old one and switching a small pointer file, so a reader never sees half a
table and a failed write changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import EPOCH, ChunkSettings, RetrievalSettings
from quarry.operators import answers, chunking, index, lookups, retrieval
from quarry.operators.agent import Tool
from quarry.operators.answering import State, answer_all
from quarry.operators.tools import Records, academic_tools, knowledge_tool
from quarry.providers import HashEmbedder, NoGenerator
from quarry.sources import files

DOCUMENTS = "document_id long, tenant_id int, name string, sha256 string, text_hash string, title string, lang string, mime string, status string, progress int, error string, version int, deleted_at timestamp"
CHUNKS = "chunk_id long, document_id long, tenant_id int, chunk_index int, content string, embed_text string, token_count int, char_count int, section_path string, node_type string, page_start int, page_end int, method string, parent_index int, content_hash string, version int, embed_status string, doc_title string, deleted_at timestamp"
INDEX = "chunk_id long, document_id long, tenant_id int, content string, dense array<double>, is_active boolean"
PROGRESS = {"parsing": 30, "chunking": 45, "embedding": 90, "ready": 100, "failed": 100, "needs_ocr": 100}


class BadRequest(ValueError):
    """A request outside its limits."""


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not deleted: deletion is a time, and the epoch means never."""
    return rows.where(F.col("deleted_at") == F.lit(EPOCH))


class Engine:
    """All tables of one folder, for one tenant at a time."""

    def __init__(self, spark: SparkSession, folder: str, tenant_id: int = 1, collection: str = "main", chunk: ChunkSettings | None = None, search: RetrievalSettings | None = None, embedder=None, generator=None):  # noqa: ANN001
        self.spark, self.folder, self.tenant_id, self.collection = spark, folder.rstrip("/"), tenant_id, collection
        self.chunk_settings, self.search_settings = chunk or ChunkSettings(), search or RetrievalSettings()
        self.embedder, self.generator = embedder or HashEmbedder(64), generator or NoGenerator()

    # --- tables ---------------------------------------------------------------------------------

    def _pointer(self, name: str):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_CURRENT")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def table(self, name: str) -> DataFrame:
        """The current version of documents, chunks or an index; empty if there is none."""
        schema = {"documents": DOCUMENTS, "chunks": CHUNKS}.get(name, INDEX)
        fs, path = self._pointer(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        stream = fs.open(path)
        try:
            version = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}")

    def replace(self, name: str, rows: DataFrame, sort: list[str]) -> None:
        """Write a new version, then switch to it."""
        version = f"v-{uuid.uuid4().hex}"
        schema = self.table(name).schema
        rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).sortWithinPartitions(*sort).write.parquet(f"{self.folder}/{name}/{version}")
        fs, path = self._pointer(name)
        stream = fs.create(path, True)
        stream.writeUTF(version)
        stream.close()

    @property
    def index_name(self) -> str:
        return f"index-{self.collection}"

    # --- ingestion ------------------------------------------------------------------------------

    def ingest(self, path: str, pattern: str = "*") -> DataFrame:
        """Read files, and store documents, chunks and vectors. Returns the touched documents.

        A file whose bytes a ready document has is skipped. One that failed before is tried again in its own
        row. Files are told apart by their bytes; equal files are one document. The index is written last.
        """
        known = live(self.table("documents")).where(F.col("tenant_id") == self.tenant_id)
        found = files.read_files(self.spark, path, pattern).dropDuplicates(["sha256"])
        fresh = found.join(known.where("status = 'ready'").select("sha256"), "sha256", "left_anti")
        parsed = files.parse(files.sniff(fresh)).persist()
        # ids follow from the bytes, so a second try meets its own row
        parsed = parsed.withColumn("document_id", F.pmod(F.xxhash64("sha256"), F.lit(1 << 42)))
        chunks = chunking.finished(chunking.chunk_nodes(parsed.where("nodes is not null"), self.chunk_settings), parsed.select("document_id", F.col("title").alias("doc_title")), self.chunk_settings)
        chunks = chunks.withColumns({"tenant_id": F.lit(self.tenant_id), "version": F.lit(1), "embed_status": F.lit("pending"), "deleted_at": F.lit(EPOCH)}).persist()
        has = chunks.select("document_id").distinct().withColumn("has", F.lit(True))
        status = F.when(F.col("error") == "no_parser", "needs_ocr").when(F.col("error").isNotNull() | F.col("has").isNull(), "failed").otherwise("ready")
        documents = parsed.join(has, "document_id", "left").withColumns({"tenant_id": F.lit(self.tenant_id), "status": status, "version": F.lit(1), "deleted_at": F.lit(EPOCH)})
        progress = F.lit(0)
        for name, value in PROGRESS.items():
            progress = F.when(F.col("status") == name, value).otherwise(progress)
        documents = documents.withColumns({"error": F.substring(F.coalesce("error", F.when(F.col("has").isNull(), "empty")), 1, 2000), "progress": progress})
        documents = documents.select(*(f.name for f in self.table("documents").schema)).persist()
        vectors = self.embedder.embed(chunks.select("chunk_id", "document_id", "tenant_id", "content", "embed_text"), "embed_text").drop("embed_text").withColumn("is_active", F.lit(True))
        self.replace("documents", index.upsert(self.table("documents"), documents, "document_id"), ["document_id"])
        self.replace("chunks", index.replace_documents(self.table("chunks"), chunks.withColumn("embed_status", F.lit("embedded")).select(*(f.name for f in self.table("chunks").schema))), ["document_id", "chunk_index"])
        self.replace(self.index_name, index.replace_documents(self.table(self.index_name), vectors.select(*(f.name for f in self.table(self.index_name).schema))), ["chunk_id"])
        return self.table("documents").join(documents.select("document_id"), "document_id", "left_semi")

    def delete_document(self, document_id: int) -> int:
        """Take a document's rows out of the index, then mark it and its chunks deleted. Returns how many vectors went."""
        rest, gone = index.delete_document(self.table(self.index_name), document_id, self.tenant_id)
        n = gone.first().deleted
        self.replace(self.index_name, rest, ["chunk_id"])
        mine = (F.col("document_id") == document_id) & (F.col("tenant_id") == self.tenant_id)
        for name in ("chunks", "documents"):
            self.replace(name, self.table(name).withColumn("deleted_at", F.when(mine, F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None))).otherwise(F.col("deleted_at"))), ["document_id"])
        return n

    def reindex(self, collection: str, dry_run: bool = True) -> int:
        """Embed all live chunks into another collection and, unless it is a dry run, switch to it. Returns the chunks."""
        chunks = live(self.table("chunks")).where(F.col("tenant_id") == self.tenant_id)
        if dry_run:
            return chunks.count()
        vectors = self.embedder.embed(chunks.select("chunk_id", "document_id", "tenant_id", "content", "embed_text"), "embed_text").drop("embed_text").withColumn("is_active", F.lit(True))
        self.replace(f"index-{collection}", vectors, ["chunk_id"])
        self.collection = collection
        return self.table(self.index_name).count()

    # --- questions ------------------------------------------------------------------------------

    @staticmethod
    def checked(text: str, top_k: int) -> str:
        """A query's text without outer spaces; BadRequest if it or top_k is out of range."""
        text = (text or "").strip()
        if not 1 <= len(text) <= 2000 or not 1 <= top_k <= 50:
            raise BadRequest("a query has 1 to 2000 characters, top_k is 1 to 50")
        return text

    def retrieve(self, queries: DataFrame, top_k: int = 5, use_dense: bool = True, use_sparse: bool = True) -> DataFrame:
        """Evidence of many queries (query_id, text): query_id, rank, chunk_id, document_id, label, content and scores."""
        if not 1 <= top_k <= 50:
            raise BadRequest("top_k is 1 to 50")
        chunks = live(self.table("chunks")).where(F.col("tenant_id") == self.tenant_id)
        found = index.active(self.table(self.index_name), self.tenant_id)
        q = queries.where(F.char_length(F.trim("text")).between(1, 2000))
        fused = retrieval.search(
            found.select("chunk_id", "content"), q, found.select("chunk_id", "dense"), self.embedder.embed(q.select("query_id", "text"), "text", is_query=True).select("query_id", "dense"),
            settings=self.search_settings, use_dense=use_dense, use_sparse=use_sparse,
        )
        rows, _ = retrieval.hydrate(retrieval.by_intent(fused, chunks, q), chunks, top_k)
        from quarry.functions.text import label

        rows = retrieval.dedupe(rows.withColumn("label", label(F.col("doc_title"), F.col("section_path"), F.col("page_start"), F.col("page_end"))))
        return rows.select("query_id", "rank", "chunk_id", "document_id", "label", "content", F.round("score", 6).alias("score"), "dense_rank", "sparse_rank", "dense_score")

    def ask(self, question: str, top_k: int = 5) -> dict:
        """One question, answered by extraction: route, answer, citations, verified."""
        text = self.checked(question, top_k)
        queries = self.spark.createDataFrame([(1, text)], "query_id long, text string")
        evidence = self.retrieve(queries, top_k).persist()
        said = answers.extractive(queries.select("query_id"), evidence)
        good, checked = answers.verify(said, evidence)
        row, flags = said.first(), checked.first()
        return {"route": row.route, "answer": row.answer, "citations": [r.asDict() for r in good.orderBy("place").collect()], "verified": row.route == "refuse" or flags.verified}

    # --- state ----------------------------------------------------------------------------------

    def documents(self, limit: int = 20, offset: int = 0) -> DataFrame:
        """Live documents, newest ids first, one page."""
        return live(self.table("documents")).where(F.col("tenant_id") == self.tenant_id).orderBy(F.desc("document_id")).offset(offset).limit(limit)

    def document(self, document_id: int) -> dict | None:
        """A live document of this tenant as plain values; null if there is none."""
        row = self._own("documents").where(F.col("document_id") == document_id).first()
        return row.asDict(recursive=True) if row else None

    def by_hash(self, sha256: str) -> dict | None:
        """The newest live document with these bytes."""
        row = self._own("documents").where(F.col("sha256") == sha256).orderBy(F.desc("document_id")).first()
        return row.asDict(recursive=True) if row else None

    def chunks_in_order(self, ids: list[int]) -> DataFrame:
        """Live chunks of the given ids, in their order (ord)."""
        asked = self.spark.createDataFrame([(1, ids)], "query_id long, ids array<long>")
        return lookups.in_order(asked, self._own("chunks"), "chunk_id").drop("query_id").orderBy("ord")

    def counts(self) -> dict:
        """Live documents and chunks, and vectors whether they are active or not."""
        return {"documents": self._own("documents").count(), "chunks": self._own("chunks").count(), "vectors": self.table(self.index_name).where(F.col("tenant_id") == self.tenant_id).count()}

    def _own(self, name: str) -> DataFrame:
        return live(self.table(name)).where(F.col("tenant_id") == self.tenant_id)

    def tools(self, read: Records | None = None) -> list[Tool]:
        """What an agent may call here: the documents, and the records if there are any."""
        return [knowledge_tool(self.retrieve, self.spark), *(academic_tools(read) if read else [])]

    def answer(self, questions: dict[int, str], histories: dict[int, list[dict]] | None = None, rewrites: int = 2, top_k: int = 5) -> list[State]:
        """Many questions at once, with grading and new wordings if there is a model."""
        states = [State(i, self.checked(q, top_k), q.strip(), (histories or {}).get(i, [])) for i, q in sorted(questions.items())]
        return answer_all(self.spark, states, lambda q: self.retrieve(q, top_k), self.generator, rewrites, top_k)

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        """Whether tables can be read; a missing model does not count against it."""
        parts = {}
        for name in ("documents", "chunks", self.index_name):
            try:
                self.table(name).limit(1).count()
                parts[name] = {"ok": True}
            except Exception as e:  # noqa: BLE001  the report is what tells
                parts[name] = {"ok": False, "error": type(e).__name__}
        parts["generator"] = {"ok": self.generator.enabled, "optional": True}
        return {"ready": all(p["ok"] for p in parts.values() if not p.get("optional")), "components": parts}

    def reconcile(self) -> DataFrame:
        """Chunk ids that only the store or only the index has."""
        return index.reconcile(live(self.table("chunks")), self.table(self.index_name))
