"""Models as replaceable providers; the defaults need none and are deterministic."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry._session import workers_see_package
from quarry.functions.text import FOREIGN_SCRIPT


_FOREIGN = re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), FOREIGN_SCRIPT))


class Unavailable(RuntimeError):
    """A provider that is switched off was asked for something."""


class Embedder(Protocol):
    """Texts to vectors; queries may be treated unlike documents."""

    dimensions: int
    enabled: bool

    def embed(self, rows: DataFrame, text: str, is_query: bool = False) -> DataFrame: ...


class Reranker(Protocol):
    """(query_id, chunk_id, query, document) to rerank_score."""

    enabled: bool

    def score(self, rows: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    """One turn of a chat, with tool calls if asked for."""

    enabled: bool

    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> dict: ...


class HashEmbedder:
    """Counts of hashed lower-case words, scaled to length 1; a stand-in without meaning but with identity."""

    enabled = True

    def __init__(self, dimensions: int = 1024, query_prefix: str = ""):
        self.dimensions, self.query_prefix = dimensions, query_prefix

    def vector(self, text: str) -> list[float]:
        counts = Counter(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % self.dimensions for w in (text or "").lower().split())
        norm = math.sqrt(sum(n * n for n in counts.values()))
        return [counts[i] / norm if norm else 0.0 for i in range(self.dimensions)]

    def embed(self, rows: DataFrame, text: str, is_query: bool = False) -> DataFrame:
        """The rows with a column dense."""
        workers_see_package(rows.sparkSession)
        prefix, at, me = self.query_prefix if is_query else "", rows.columns.index(text), self
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = [me.vector(prefix + (t or "")) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, "dense"])

        return rows.mapInArrow(run, fields + ", dense array<double>")


class NoReranker:
    """Keeps the order it gets: 1 / position. Counts as switched off, so that reranking is skipped."""

    enabled = False

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("rerank_score", 1 / F.col("pos"))


class NoGenerator:
    enabled = False

    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> dict:
        raise Unavailable("no language model is configured")


class ScriptedGenerator:
    """Gives prepared turns one after another; for tests and dry runs."""

    enabled = True

    def __init__(self, turns: list[dict]):
        self.turns = list(turns)
        self.seen: list[list[dict]] = []

    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> dict:
        self.seen.append(messages)
        if not self.turns:
            raise Unavailable("the script is over")
        return {"content": "", "tool_calls": []} | self.turns.pop(0)


class NoTranslator:
    """Gives no translation, so that no channel is added."""

    enabled = False

    def translate(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("translated", F.lit(None).cast("string"))


class ModelTranslator:
    """Translations by a model, each (target, text) once while it is kept; the model sees distinct texts of questions alone.

    A text that needs none, an empty answer, one that still has letters of the source or is far too long, and
    a failure give null, so that no channel is added.
    """

    def __init__(self, model: Generator, target: str = "en", most: int = 10_000):
        self.model, self.target, self.most = model, target, most
        self.known: dict[tuple[str, str], str | None] = {}

    @property
    def enabled(self) -> bool:
        return self.model.enabled

    def one(self, text: str | None) -> str | None:
        key = (self.target, (text or "").strip())
        if not key[1] or not self.enabled or self.target == "en" and not _FOREIGN.search(key[1]):
            return None
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            try:
                said = " ".join((self.model.chat([{"role": "user", "content": f"Translate into {self.target}, nothing else: {key[1]}"}])["content"] or "").split()).strip("\"'“”‘’")
            except Exception:  # noqa: BLE001  search goes on without a second reading
                return None
            self.known[key] = said if said and not _FOREIGN.search(said) and len(said) <= 400 else None
        return self.known[key]

    def translate(self, queries: DataFrame) -> DataFrame:
        """The queries with ``translated``. Queries are the small side: their distinct texts come to the driver."""
        texts = [r.text for r in queries.select("text").where("text is not null").distinct().collect()]
        rows = [(t, self.one(t)) for t in texts]
        return queries.join(queries.sparkSession.createDataFrame(rows, "text string, translated string"), "text", "left").select(*queries.columns, "translated")


def batches(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items, in order."""
    if size < 1:
        raise ValueError("size has to be positive")
    it = iter(items)
    while part := list(itertools.islice(it, size)):
        yield part


class ExactTokens:
    """Token counts by a tokenizer's own file (a path, read once in each worker) and the longest input of its model."""

    def __init__(self, file: str, model_max: int | None = None):
        self.file, self.model_max = file, model_max

    def count(self, text: str | None) -> int:
        return len(_tokenizer(self.file).encode(text or "", add_special_tokens=False).ids)

    def column(self, rows: DataFrame, text: str, name: str = "token_count") -> DataFrame:
        """The rows with the number of tokens of a text, in Arrow batches."""
        workers_see_package(rows.sparkSession)
        file, at = self.file, rows.columns.index(text)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                ids = _tokenizer(file).encode_batch([x or "" for x in b.column(at).to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x.ids) for x in ids], pa.int64())], names=[*b.schema.names, name])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


@functools.cache
def _tokenizer(file: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def structured(text: str, required: dict[str, type]) -> dict:
    """The JSON object of a model's answer, fences taken off; ValueError if a field is missing or of another type."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    found = json.loads(body)
    for name, kind in required.items():
        if not isinstance(found.get(name), kind):
            raise ValueError(f"{name} is missing or no {kind.__name__}")
    return found


def structured_chat(model: Generator, messages: list[dict], required: dict[str, type]) -> dict:
    """A structured answer; a wrong one is sent back once with what was wrong."""
    said = model.chat(messages)["content"]
    try:
        return structured(said, required)
    except ValueError as error:
        again = [*messages, {"role": "assistant", "content": said}, {"role": "user", "content": f"Answer with one JSON object only. Problem: {error}"}]
        return structured(model.chat(again)["content"], required)


#: Providers by kind and name; more can be put in.
REGISTRY = {"embedder": {"hash": HashEmbedder}, "reranker": {"none": NoReranker}, "generator": {"none": NoGenerator}, "translator": {"none": NoTranslator}}


def provider(kind: str, name: str, **options):
    """A provider by its configured name."""
    try:
        return REGISTRY[kind][name](**options)
    except KeyError:
        raise ValueError(f"unknown {kind}: {name}") from None
