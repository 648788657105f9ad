"""Files as sources: type by content, parsers to nodes, JSON lines, upload landing, corpus export."""

from __future__ import annotations

import io
import json
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import workers_see_package
from quarry.functions import text as X
from quarry.operators.chunking import NODE

PDF, DOCX, MARKDOWN, PLAIN = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/markdown", "text/plain"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, content, size_bytes and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def has_word_document(content: bytes) -> bool:
    """Whether bytes are a ZIP archive with a word-processor document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return "word/document.xml" in z.namelist()
    except (zipfile.BadZipFile, OSError, ValueError):
        return False


def sniff(files: DataFrame) -> DataFrame:
    """The files with mime, or null and an error: unsupported, legacy_office or empty.

    PDFs and old office files are told by their first bytes, in the JVM; only archives are opened, in
    Python. Text needs a known ending and a valid UTF-8 head; a character cut at the head's end does no harm.
    """
    workers_see_package(files.sparkSession)

    @F.pandas_udf("boolean")
    def word(content):  # noqa: ANN001, ANN202
        return content.map(lambda c: c is not None and has_word_document(bytes(c))).astype(bool)

    head = F.hex(F.substring("content", 1, 8))
    zipped = files.withColumn("head", F.coalesce(head, F.lit("")))
    ending = F.lower(F.regexp_extract("name", r"(\.[^./]*)$", 1))
    text = F.expr("is_valid_utf8(substring(content, 1, 4093)) or is_valid_utf8(substring(content, 1, 4094)) or is_valid_utf8(substring(content, 1, 4095)) or is_valid_utf8(substring(content, 1, 4096))")
    archive = zipped.where(F.col("head").startswith("504B")).withColumn("mime", F.when(word("content"), DOCX))
    other = zipped.where(~F.col("head").startswith("504B")).withColumn(
        "mime", F.when(F.col("head").startswith("255044462D"), PDF).when(ending.isin(".md", ".markdown") & text, MARKDOWN).when((ending == ".txt") & text, PLAIN)
    )
    error = F.when(F.col("mime").isNotNull(), None).when(F.col("head").startswith("D0CF11E0A1B11AE1"), "legacy_office").when(F.col("content").isNull(), "empty").otherwise("unsupported")
    return other.unionByName(archive).withColumn("error", error).drop("head")


# --- parsers ------------------------------------------------------------------------------------


def _node(kind: str, text: str, **more) -> dict:
    return {"type": kind, "level": None, "text": text, "section": "", "page_start": 0, "page_end": 0, "method": "native", "cells": None, "code_lang": None} | more


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])[ \t]+(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def inline(text: str) -> str:
    """Marks of emphasis and links taken off; code keeps its back-ticks, images become their description."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", lambda m: f"[图片: {m[1]}]" if m[1] else "[图片]", text)
    text = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", text)
    parts = re.split(r"(`[^`]*`)", text)
    return "".join(p if i % 2 else re.sub(r"(\*\*|__|\*|(?<!\w)_|_(?!\w))", "", p) for i, p in enumerate(parts)).strip()


def table_cells(lines: list[str]) -> list[list[str]]:
    """Cells of table lines, without the rule."""
    rows = [[c.strip() for c in re.sub(r"^\||\|$", "", x.strip()).split("|")] for x in lines if x.strip()]
    return [r for r in rows if not all(re.fullmatch(":?-+:?", c) for c in r)]


def parse_markdown(raw: str, tables: bool = True) -> list[dict]:
    """Blocks of Markdown in order: titles with level and path, code, tables, lists, quotes, paragraphs."""
    lines, out, path, i = raw.splitlines(), [], [], 0
    where = lambda: " > ".join(t for _, t in path)

    def starts(x: str) -> bool:
        return bool(_FENCE.match(x) or _HEADING.match(x) or _ITEM.match(x) or _RULE.match(x) or x.lstrip().startswith(">"))

    while i < len(lines):
        x = lines[i]
        if not x.strip() or _RULE.match(x):
            i += 1
        elif m := _HEADING.match(x):
            text = inline(m[2] or "")
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), text)]
            if text:
                out.append(_node("title", text, level=len(m[1]), section=where()))
            i += 1
        elif m := _FENCE.match(x):
            end = next((k for k in range(i + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[k])), len(lines))
            if body := "\n".join(lines[i + 1 : end]).strip("\n"):
                out.append(_node("code", body, section=where(), code_lang=m[2] or None))
            i = end + 1
        elif x.startswith("    "):
            end = next((k for k in range(i, len(lines)) if lines[k].strip() and not lines[k].startswith("    ")), len(lines))
            out.append(_node("code", "\n".join(y[4:] for y in lines[i:end]).strip("\n"), section=where()))
            i = end
        elif tables and _ROW.match(x) and i + 1 < len(lines) and "-" in lines[i + 1] and _TABLE_RULE.match(lines[i + 1]):
            end = next((k for k in range(i + 2, len(lines)) if not _ROW.match(lines[k])), len(lines))
            cells = [[inline(c) for c in r] for r in table_cells(lines[i:end])]
            out.append(_node("table", "\n".join(y.strip() for y in lines[i:end]), section=where(), cells=cells))
            i = end
        elif _ITEM.match(x):
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() and (k + 1 == len(lines) or not (_ITEM.match(lines[k + 1]) or lines[k + 1].startswith("  ")))), len(lines))
            end = next((k for k in range(i + 1, end) if _HEADING.match(lines[k]) or _FENCE.match(lines[k])), end)
            items = [inline(re.sub(r"^\s*(?:[-+*]|\d{1,9}[.)])\s+", "", y)) for y in lines[i:end] if y.strip()]
            out.append(_node("list", "\n".join(f"- {t}" for t in items), section=where()))
            i = end
        else:
            quote = x.lstrip().startswith(">")
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or not quote and starts(lines[k])), len(lines))
            text = "\n".join(inline(re.sub(r"^\s*>\s?", "", y) if quote else y.strip()) for y in lines[i:end]).strip()
            if text:
                out.append(_node("paragraph", text, section=where()))
            i = end
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> list[dict]:
    """Blocks of a word-processor file in body order: headings by style or outline level, lists, tables, paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    said = lambda e: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip()
    for e in body if body is not None else ():
        where = " > ".join(t for _, t in path)
        if e.tag == f"{_W}tbl":
            cells = []
            for row in e.iter(f"{_W}tr"):
                line = []
                for c in row.iter(f"{_W}tc"):
                    merged = c.find(f"{_W}tcPr/{_W}vMerge")
                    line.append("" if merged is not None and merged.get(f"{_W}val") != "restart" else said(c))
                    span = c.find(f"{_W}tcPr/{_W}gridSpan")
                    line += [""] * (int(span.get(f"{_W}val", 1)) - 1 if span is not None else 0)
                cells.append(line)
            from quarry.operators.chunking import markdown

            if text := markdown(cells):
                out.append(_node("table", text, section=where, cells=cells))
        elif e.tag == f"{_W}p" and (text := said(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            style = names.get(style.get(f"{_W}val"), style.get(f"{_W}val", "")) if style is not None else ""
            outline = e.find(f"{_W}pPr/{_W}outlineLvl")
            m = re.match(r"(?i)(?:heading|标题)\s*(\d)", style)
            level = int(m[1]) if m else 1 if style.lower() == "title" else int(outline.get(f"{_W}val")) + 1 if outline is not None else None
            if level and level <= 9:
                path = [p for p in path if p[0] < level] + [(level, text)]
                out.append(_node("title", text, level=level, section=" > ".join(t for _, t in path)))
            else:
                listed = e.find(f"{_W}pPr/{_W}numPr") is not None or "list" in style.lower()
                out.append(_node("list" if listed else "paragraph", text, section=where))
    return out


#: Parsers by type. A PDF parser needs a library that is not here; put one in to support it.
PARSERS: dict[str, Callable[[bytes], list[dict]]] = {
    MARKDOWN: lambda c: parse_markdown(c.decode("utf-8", "replace")),
    PLAIN: lambda c: parse_markdown(c.decode("utf-8", "replace"), tables=False),
    DOCX: parse_docx,
}


def parse(files: DataFrame) -> DataFrame:
    """Nodes of sniffed files: the columns of ``files`` without content, and nodes, error, text_hash, lang, title.

    A file that has no parser, or breaks it, gets an error and no nodes; the others go on.
    """
    workers_see_package(files.sparkSession)
    rest = [c for c in files.columns if c not in ("content", "mime", "error")]
    kind = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("section", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("method", pa.string()), ("cells", pa.list_(pa.list_(pa.string()))), ("code_lang", pa.string())]))
    parsers = dict(PARSERS)
    control = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, errors = [], []
            for mime, error, content in zip(b.column("mime").to_pylist(), b.column("error").to_pylist(), b.column("content"), strict=True):
                found = None
                if error is None:
                    try:
                        found = [n | {"text": control.sub("", n["text"]), "section": control.sub("", n["section"])} for n in parsers[mime](content.as_py())]
                    except KeyError:
                        error = "no_parser"
                    except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                        error = f"unreadable: {type(e).__name__}"
                nodes.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), b.column("mime"), pa.array(errors, pa.string()), pa.array(nodes, kind)], names=[*rest, "mime", "error", "nodes"])

    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest)
    out = files.select(*rest, "mime", "error", "content").mapInArrow(run, f"{fields}, mime string, error string, nodes array<{NODE}>")
    full = F.array_join(F.transform(F.filter("nodes", lambda n: n["type"] != "footer"), lambda n: n["text"]), "\n\n")
    first = F.try_element_at(F.filter("nodes", lambda n: (n["type"] == "title") & (n["level"] == 1) & (F.trim(n["text"]) != "")), F.lit(1))
    some = F.try_element_at(F.filter("nodes", lambda n: F.trim(n["text"]) != ""), F.lit(1))
    title = F.coalesce(F.substring(X.strip(first["text"]), 1, 200), F.substring(X.strip(some["text"]), 1, 200), F.col("name"))
    return out.withColumn("text_hash", F.when(F.col("nodes").isNotNull(), X.text_hash(full))).withColumn("lang", F.when(F.col("nodes").isNotNull(), X.language(full))).withColumn("title", title)


# --- other sources and sinks --------------------------------------------------------------------

GOLDEN = "id string, type string, question string, gold_chunk_ids array<long>, gold_doc_ids array<long>, note string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their gold chunks, one JSON object a line."""
    return spark.read.schema(GOLDEN).json(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(id, phrase) of one JSON object that lists phrases by question."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>"))).select(F.col("key").alias("id"), F.explode("value").alias("phrase"))


def export_corpus(chunks: DataFrame, documents: DataFrame, path: str, only: list[int] | None = None) -> None:
    """Live chunks of live documents as JSON lines, in the order of (document_id, chunk_index) within each file."""
    rows = chunks.join(documents.select("document_id", F.col("title").alias("doc_title")), "document_id")
    if only is not None:
        rows = rows.where(F.col("document_id").isin(only))
    rows.repartitionByRange("document_id").sortWithinPartitions("document_id", "chunk_index").write.mode("overwrite").json(path)


def land_upload(folder: str, name: str, pieces: Iterator[bytes], most_bytes: int) -> str:
    """Write an upload into a landing folder under a safe name; ValueError if it is too large (nothing is left)."""
    safe = re.sub(r"[^\w.\-]+", "_", os.path.basename(name.replace("\\", "/"))).lstrip(".") or "upload"
    target, written = Path(folder) / safe, 0
    with open(target, "wb") as f:
        for p in pieces:
            written += len(p)
            if written > most_bytes:
                break
            f.write(p)
    if written > most_bytes:
        target.unlink()
        raise ValueError(f"larger than {most_bytes} bytes")
    return str(target)


def inside(folder: str, path: str) -> str:
    """The real path if it stands below the folder, else ValueError."""
    real, root = os.path.realpath(os.path.join(folder, path)), os.path.realpath(folder)
    if os.path.commonpath([real, root]) != root:
        raise ValueError("path leaves the folder")
    return real


def report(path: str, results: dict) -> None:
    """Results as JSON and as a Markdown table beside it; a phase that this run did not make keeps its last one."""
    target = Path(path)
    old = json.loads(target.read_text()) if target.exists() else {}
    merged = old | results
    target.write_text(json.dumps(merged, ensure_ascii=False, indent=1, sort_keys=True))
    lines = ["| phase | metric | value |", "| --- | --- | --- |"]
    lines += [f"| {phase} | {k} | {v} |" for phase, x in sorted(merged.items()) for k, v in sorted(x.items()) if not isinstance(v, (dict, list))]
    target.with_suffix(".md").write_text("\n".join(lines) + "\n")
