"""Best-fit packing of documents into token sequences, planned over a histogram of lengths.

Best-fit decreasing needs only how many pieces there are of each length, so the plan is made over at most
``CAPACITY`` counts on the driver. Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import map_text, materialise

CAPACITY = 4096
END_ID = 1
#: Rows of a plan that are sent to all workers (40 bytes each); a larger plan is joined instead.
PLAN_ROWS = 200_000
#: Words whose ids a worker keeps; the table starts anew when it is full.
CACHE_WORDS = 500_000

# --- tokens -------------------------------------------------------------------------------------

#: Characters of texts that go the fast way: composed, without odd spaces, lower-cased one by one.
_FAST = "".join(chr(c) for r in (range(0x21, 0x7F), range(0xA1, 0x250), range(0x2010, 0x2028), range(0x2030, 0x205F)) for c in r if c not in (0xAD, 0x130))
_LETTERS = "".join(c for c in _FAST if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _FAST if unicodedata.category(c)[0] == "N")
_SLOW = re.compile(f"[^\\t\\n\\r {re.escape(_FAST)}]")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Little-endian 32-bit ids of the tokens of each lower-cased, space-free word; computed when missed.

    The vocabulary marks word ends, so a word's ids do not depend on its neighbours. Its ids are also its
    merge order, so the same merges run in a rank-based encoder with a space as the mark of word ends.
    """

    def __init__(self, file: str):
        super().__init__()
        self.whole = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            loaded = json.load(f)
        vocabulary = loaded["model"]["vocab"]
        special = {x["content"] for x in loaded["added_tokens"]}
        #: Texts with one of these go to the library whole, in either case if it looks for it after lower-casing.
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)", re.I)
        byte_of, ranks = _byte_of(), {}
        for token, i in vocabulary.items():
            if token not in special:
                body = token.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in body) + b" " * (body != token)] = i
        self.ranks = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if len(word) > 200:
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = np.array(self.ranks.encode_ordinary(" ".join(_PIECES.findall(word)) + " "), "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers."""
        if _SLOW.search(text) or self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


_WORDS: dict[str, WordIds] = {}


def word_ids(file: str) -> WordIds:
    """The table of this worker process."""
    if file not in _WORDS:
        _WORDS[file] = WordIds(file)
    return _WORDS[file]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids on request).

    Null text counts as empty and gives one piece of the end id alone. Each row is cut by itself.
    """
    end = np.array([END_ID], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer)
        for b in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                buffer = table.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(buffer), width)):
                    part = buffer[at : at + width]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- plan ---------------------------------------------------------------------------------------


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, copies, first sequence, offset): from that rank on, pieces of that length fill
    sequences in order, ``copies`` in each, from that offset on, up to the next row's first rank. A length's
    pieces go where least room is left; equal sequences are handled together as a range of numbers.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)
    left: list[int] = []  # the rooms that exist, ascending
    out, opened = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                bisect.insort(left, space)
                room[space] = []
            room[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            i = bisect.bisect_left(left, length)
            if i < len(left):
                space = left[i]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], left[i]
            else:
                space, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            copies = space // length
            used = min(n, -(-todo // copies))
            out.append((length, rank, copies, first, capacity - space))
            placed = min(todo, used * copies)
            rest = placed - (used - 1) * copies  # in the last sequence
            put(space, first + used, n - used)
            put(space - copies * length, first, used - (rest < copies))
            if rest < copies:
                put(space - rest * length, first + used - 1, 1)
            rank, todo = rank + placed, todo - placed
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as best-fit decreasing finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request). A
    document is its ids and the end id; only longer ones are cut, into full pieces and a last shorter one.
    Null text counts as empty; repeated rows are packed each; an empty table gives no rows. The driver
    sees one count for each length. Ranks are taken inside (length, stored partition), so a length that a
    third of the pieces share never meets in one task.
    """
    spark = docs.sparkSession
    base = materialise(pieces(docs, tokenizer, capacity, with_ids)).withColumn("part", F.spark_partition_id())
    held = materialise(base.groupBy("length", "part").agg(F.count("*").alias("n")))
    rows = plan({r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = base.withColumn("rank", F.row_number().over(inside) - 1).join(held, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    slotted = _by_broadcast(ranked, rows) if len(rows) <= PLAN_ROWS else _by_join(ranked, spark.createDataFrame(_ends(rows), "length long, first_rank long, end_rank long, copies long, first_sequence long, first_offset long"))
    return slotted.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def _ends(rows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, ...]]:
    out = []
    for row, after in zip(rows, [*rows[1:], (None,)], strict=False):
        out.append((row[0], row[1], after[1] if after[0] == row[0] else 1 << 62, *row[2:]))
    return out


def _by_broadcast(ranked: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    sent = ranked.sparkSession.sparkContext.broadcast(table)
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        keys = (t[:, 0] << 48) | t[:, 1]
        for b in batches:
            length, rank = b.column(at_length).to_numpy(), b.column(at_rank).to_numpy()
            row = t[np.searchsorted(keys, (length << 48) | rank, "right") - 1] if b.num_rows else t[:0]
            over = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(row[:, 3] + over // row[:, 2]), pa.array(row[:, 4] + over % row[:, 2] * length)], names=[*b.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return map_text(ranked, run, fields + ", sequence_id long, offset long")


def _by_join(ranked: DataFrame, rows: DataFrame, chunk: int = 1024) -> DataFrame:
    """The same by an equi-join on (length, chunk of ranks), for plans too large to send to all workers."""
    most = F.lit(1 << 62)
    last = ranked.groupBy("length").agg(F.max("rank").alias("last"))
    rows = rows.join(last, "length").withColumn("end_rank", F.when(F.col("end_rank") == most, F.col("last") + 1).otherwise(F.col("end_rank")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first_rank") / chunk), F.floor((F.col("end_rank") - 1) / chunk)))).drop("last")
    met = ranked.withColumn("chunk", F.floor(F.col("rank") / chunk)).join(rows, ["length", "chunk"]).where("rank >= first_rank and rank < end_rank")
    over = F.col("rank") - F.col("first_rank")
    return met.withColumn("sequence_id", F.col("first_sequence") + F.floor(over / F.col("copies"))).withColumn("offset", F.col("first_offset") + F.pmod(over, F.col("copies")) * F.col("length"))
