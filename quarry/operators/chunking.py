"""Nodes to chunks: structure-aware packing, one document at a time, without a shuffle.

The packing is a fold with resets over a document's nodes, which no window can express. It runs over Arrow
batches of whole documents (a node list each), so its memory is that of a batch and its cost is linear.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry._session import workers_see_package
from quarry.config import ChunkSettings
from quarry.functions import text as X

NODE = "struct<type:string,level:int,text:string,section:string,page_start:int,page_end:int,method:string,cells:array<array<string>>,code_lang:string>"
CHUNK = "chunk_index int, content string, token_count int, char_count int, section_path string, node_type string, page_start int, page_end int, method string, parent_index int"
ATOMIC = frozenset({"metadata", "table", "code"})
#: Chunks of a document whose ids stay apart: chunk_id = document_id * 2^20 + chunk_index.
ID_BITS = 20

_CJK = re.compile("[　-〿㐀-䶿一-鿿＀-￯]")


def count_tokens(text: str) -> int:
    """The estimate of ``quarry.functions.text.token_count``."""
    cjk = len(_CJK.findall(text))
    return cjk + math.ceil((len(text) - cjk) / 4)


def _longest_prefix(text: str, start: int, most: int) -> int:
    """End of the longest piece from ``start`` on with at most ``most`` tokens, one character at least."""
    reach = range(start + 1, len(text) + 1)
    return start + max(1, bisect_right(reach, most, key=lambda end: count_tokens(text[start:end])))


def keep_split(text: str, ends: str) -> list[str]:
    """Pieces that end with one of ``ends``; blank pieces are left out."""
    return [p for p in re.findall(f"[^{ends}]*[{ends}]|[^{ends}]+", text) if p.strip()]


class Packer:
    """Chunks of one document's nodes."""

    def __init__(self, settings: ChunkSettings):
        self.s = settings.clamped()

    def chunks(self, nodes: list[dict]) -> list[dict]:
        """Chunks in order, numbered, with the number of the first chunk of their parent block."""
        out: list[dict] = []
        held: list[dict] = []
        held_tokens = 0

        def close() -> None:
            nonlocal held, held_tokens
            content = "\n\n".join(u["text"] for u in held).strip()
            if content:
                out.append(self._chunk(content, held[0], held[-1]))
            held, held_tokens = [], 0

        for unit in self.units(nodes):
            n = count_tokens(unit["text"])
            long = n > self.s.max_tokens
            if unit["type"] in ATOMIC or long:
                close()
                out += [self._chunk(part, unit, unit) for part in (self._parts(unit) if long and self.s.split_long else [unit["text"]])]
                continue
            if held and ((held[-1]["section"], held[-1]["method"]) != (unit["section"], unit["method"]) or held_tokens + n > self.s.target_tokens):
                close()
            held.append(unit)
            held_tokens += n
            if held_tokens >= self.s.target_tokens:
                close()
        close()
        return self._numbered(out)

    @staticmethod
    def units(nodes: list[dict]) -> Iterator[dict]:
        """Nodes that become chunks, each with its section; titles only name sections, footers and blanks go."""
        path: list[tuple[int, str]] = []
        for node in nodes:
            text = (node["text"] or "").strip()
            if node["type"] == "title":
                level = node["level"] or 1
                path = [p for p in path if p[0] < level] + [(level, text)]
            elif node["type"] != "footer" and text:
                yield node | {"text": text, "section": node["section"] or " > ".join(t for _, t in path)}

    def _parts(self, unit: dict) -> list[str]:
        if unit["type"] == "table" and unit["cells"] and len(unit["cells"]) > 1:
            return self._table(unit["cells"])
        if unit["type"] == "code":
            return self._code(unit)
        return self.text_parts(unit["text"])

    def _runs(self, items: list, cost, start: int) -> list[list]:
        """Items in runs whose costs, with ``start`` for each run, keep within the most tokens; one item at least."""
        runs: list[list] = []
        total = math.inf
        for item in items:
            n = cost(item)
            if total + n > self.s.max_tokens:
                runs.append([])
                total = start
            runs[-1].append(item)
            total += n
        return runs

    def _table(self, cells: list[list[str]]) -> list[str]:
        """Rows in runs, the head repeated over each."""
        head = cells[0]
        runs = self._runs(cells[1:], lambda row: count_tokens(markdown([head, row])), count_tokens(markdown([head, head])))
        return [markdown([head, *run]) for run in runs]

    def _code(self, unit: dict) -> list[str]:
        """Lines in runs, each fenced again."""
        fence = "```" + (unit["code_lang"] or "")
        runs = self._runs(unit["text"].splitlines(), count_tokens, 2 * count_tokens(fence))
        return ["\n".join([fence, *run, "```"]) for run in runs]

    def text_parts(self, text: str) -> list[str]:
        """Sentences packed together; what is still too long by clauses; what is still too long cut hard."""
        fits = lambda x: count_tokens(x) <= self.s.max_tokens
        out: list[str] = []
        for piece in self._packed(keep_split(text, X.SENTENCE_END)):
            for part in [piece] if fits(piece) else self._packed(keep_split(piece, X.CLAUSE_END)):
                out += [part] if fits(part) else self.hard_parts(part)
        return [p.strip() for p in out if p.strip()]

    def _packed(self, pieces: list[str]) -> list[str]:
        out: list[str] = []
        for p in pieces:
            if out and count_tokens(out[-1] + p) <= self.s.target_tokens:
                out[-1] += p
            else:
                out.append(p)
        return out

    def hard_parts(self, text: str) -> list[str]:
        """Longest pieces that fit; each begins ``overlap_tokens`` of text before the end of the one before."""
        back = _longest_prefix(text, 0, self.s.overlap_tokens) if self.s.overlap_tokens > 0 and text else 0
        out, start = [], 0
        while start < len(text):
            end = _longest_prefix(text, start, self.s.max_tokens)
            out.append(text[start:end])
            start = len(text) if end == len(text) else max(end - back, start + 1)
        return out

    @staticmethod
    def _chunk(content: str, first: dict, last: dict) -> dict:
        return {
            "content": content, "token_count": count_tokens(content), "char_count": len(content), "section_path": first["section"],
            "node_type": first["type"], "page_start": first["page_start"], "page_end": last["page_end"], "method": first["method"],
        }

    def _numbered(self, chunks: list[dict]) -> list[dict]:
        """Numbers, and parent blocks: a new one where the section changes or the block has enough tokens."""
        parent, total, section = 0, 0, None
        for i, c in enumerate(chunks):
            if c["section_path"] != section or total >= self.s.parent_tokens:
                parent, total, section = i, 0, c["section_path"]
            c["chunk_index"], c["parent_index"] = i, parent
            total += c["token_count"]
        return chunks


def markdown(cells: list[list[str]]) -> str:
    """A Markdown table of rows; empty if no cell has text. As ``quarry.functions.text.table_markdown``."""
    width = max(map(len, cells), default=0)
    clean = [[re.sub(r"\s*\n\s*", " ", (c or "").replace("|", "\\|")).strip() for c in row] + [""] * (width - len(row)) for row in cells]
    if not any(any(row) for row in clean):
        return ""
    lines = ["| " + " | ".join(row) + " |" for row in clean]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def chunk_nodes(documents: DataFrame, settings: ChunkSettings | None = None) -> DataFrame:
    """Chunks of documents given as (document_id, nodes: array of NODE in reading order).

    Returns chunk_id, document_id and CHUNK. Null and empty node lists give no chunks.
    """
    packer = Packer(settings or ChunkSettings())
    workers_see_package(documents.sparkSession)
    names = [x.split()[0] for x in CHUNK.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("document_id", pa.int64()), *((x.split()[0], kinds[x.split()[1]]) for x in CHUNK.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for doc, nodes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = packer.chunks(nodes.as_py() or [])
                ids += [doc] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[n] for r in rows], schema.field(n).type) for n in names)], schema=schema)

    out = documents.select(F.col("document_id").cast("long"), "nodes").mapInArrow(run, "document_id long, " + CHUNK)
    return out.withColumn("chunk_id", F.shiftleft("document_id", ID_BITS) + F.col("chunk_index")).select("chunk_id", "document_id", *names)


def line_nodes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain texts as (document_id, nodes): each line with text is a paragraph."""
    lines = F.filter(F.transform(F.split(X.sanitize(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: X.strip(x)), lambda x: x != "")
    empty = lambda kind: F.lit(None).cast(kind)
    node = lambda x: F.struct(
        F.lit("paragraph").alias("type"), empty("int").alias("level"), x.alias("text"), F.lit("").alias("section"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"),
        F.lit("native").alias("method"), empty("array<array<string>>").alias("cells"), empty("string").alias("code_lang"),
    )
    return documents.select(F.col(doc_id).cast("long").alias("document_id"), F.transform(lines, node).alias("nodes"))


def finished(chunks: DataFrame, titles: DataFrame | None = None, settings: ChunkSettings | None = None) -> DataFrame:
    """Chunks with content_hash and embed_text: the title and section stand before the content, not in it.

    ``titles`` has document_id and doc_title; without it the section alone leads.
    """
    s = settings or ChunkSettings()
    if titles is not None:
        chunks = chunks.join(titles.select("document_id", "doc_title"), "document_id", "left")
        title = F.when(F.coalesce("doc_title", F.lit("")) != "", F.concat(F.lit("《"), "doc_title", F.lit("》")))
    else:
        title = F.lit(None).cast("string")
    lead = F.concat_ws(" > ", title, F.nullif("section_path", F.lit("")))
    embed = F.when(lead != "", F.concat(lead, F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return chunks.withColumn("content_hash", X.chunk_hash(F.col("content"), s.version, s.model, s.dimensions)).withColumn("embed_text", embed)
