"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Texts become words; every run of ``K`` words has a hash, and of every ``SPAN - K + 1`` consecutive hashes the
least is a fingerprint. Two texts that share ``SPAN`` consecutive words share such a fingerprint, so joining the
fingerprints of documents and of benchmark items on the hash misses no shared span. Each hit is then extended
word by word to the left and to the right, so equal hashes of different words never count.

A fingerprint carries the words that stand around it as far as a span can reach; no text travels. Documents are
read once, whatever the size of the benchmark: a bit table of at most ``MOST_BITS`` bits, the only thing that is
sent to all workers unmeasured, keeps those fingerprints at home that no item has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Words, map_text, materialise, text_slices

SPAN = 10
K = 5
#: Bits of the table of benchmark fingerprints, for each fingerprint and at most (32 MB).
BITS_EACH, MOST_BITS = 64, 1 << 28
#: Bytes of benchmark fingerprints and of keys of contaminated documents that are sent to all workers; more are joined.
SENT_BYTES = 32 << 20
#: Text bytes that are hashed together: the tables and sums for them take about 60 times as much.
SLICE = 1 << 20
#: Fingerprints of a document in one row; a document with more has several rows.
ROW_PRINTS = 4096

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose low bits depend on all of them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Hasher:
    """Hashes of words and of word runs of a slice; keeps its tables of powers between slices."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, w: Words) -> np.ndarray:
        if len(self.up) <= len(w.text):
            n = max(SLICE, len(w.text)) + 1
            self.up, self.down = _powers(np.uint64(_BASE), n), _powers(_INVERSE, n)
        total = np.zeros(len(w.text) + 1, np.uint64)
        np.cumsum((w.text.astype(np.uint64) + np.uint64(1)) * self.up[: len(w.text)], out=total[1:])
        return _mix((total[w.end] - total[w.start]) * self.down[w.start] + (w.end - w.start).astype(np.uint64))

    @staticmethod
    def runs(words: np.ndarray, k: int, span: int) -> np.ndarray:
        """Hash of the k words from each word on (shorter by k - 1), different for each span."""
        n = max(0, len(words) - k + 1)
        out = np.full(n, span, np.uint64)
        for j in range(k):
            out = _mix(out + words[j : j + n] + np.uint64(j + 1))
        return out


class Bits:
    """A table of bits that says which hashes may be those of benchmark fingerprints."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.mask = np.uint64(bits - 1)
        self.table = np.zeros(bits // 64, np.int64)
        self.table[slots] = values
        self.table = self.table.view(np.uint8)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def winnow(w: Words, hashed: np.ndarray, span: int, bits: Bits | None = None, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of the fingerprints of a slice for windows of ``span`` words.

    A fingerprint is a run of words whose hash is the least of a window within its text. With ``bits`` only
    those that may be the benchmark's are looked at; with ``whole`` only texts of just ``span`` words are,
    if that is less than SPAN.
    """
    k = min(K, span)
    hashes = Hasher.runs(hashed, k, span)
    at = np.arange(len(hashes)) if bits is None else np.flatnonzero(bits.may(hashes))
    text = np.searchsorted(w.first, at, "right") - 1
    begin, end = w.first[text], w.first[text + 1]
    ok = (at + k <= end) & (end - begin >= span)
    if whole and span < SPAN:
        ok &= end - begin == span
    at, text, begin, end = at[ok], text[ok], begin[ok], end[ok]
    size = span - k + 1
    chosen = np.zeros(len(at), bool)
    for back in range(size):
        start = at - back
        inside = (start >= begin) & (start + span <= end)
        least = hashes[np.where(inside, start, 0)] if len(hashes) else hashes
        for j in range(1, size):
            least = np.minimum(least, hashes[np.where(inside, start + j, 0)])
        chosen |= inside & (least == hashes[at])
    return text[chosen], at[chosen], hashes[at[chosen]]


_PRINT = pa.struct([("hash", pa.int64()), ("span", pa.int32()), ("at", pa.int64()), ("left", pa.int32()), ("context", pa.string())])


def prints_of(w: Words, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, span: int) -> Iterator[tuple[int, dict]]:
    """Fingerprints with their place in the text, the words around as far as a span reaches, and how many of them stand before."""
    k = min(K, span)
    reach = span - k
    for d, i, h in zip(text.tolist(), at.tolist(), hashes.view(np.int64).tolist(), strict=True):
        first, end = int(w.first[d]), int(w.first[d + 1])
        a, b = max(first, i - reach), min(end, i + k + reach)
        words = [w.text[x:y].tobytes() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
        yield d, {"hash": h, "span": span, "at": i - first, "left": i - a, "context": b" ".join(words).decode("utf-8", "replace")}


def extended(span: int, left: int, context: str, item_left: int, item_context: str) -> tuple[int, int] | None:
    """Words before and after a common fingerprint that agree too; None if its own words differ or the run is too short."""
    k = min(K, span)
    mine, theirs = context.split(" "), item_context.split(" ")
    if mine[left : left + k] != theirs[item_left : item_left + k]:
        return None
    before = 0
    while before < min(left, item_left) and mine[left - before - 1] == theirs[item_left - before - 1]:
        before += 1
    after, most = 0, min(len(mine) - left, len(theirs) - item_left) - k
    while after < most and mine[left + k + after] == theirs[item_left + k + after]:
        after += 1
    return (before, after) if before + k + after >= span else None


def benchmark_prints(benchmark: DataFrame) -> DataFrame:
    """Fingerprints of the benchmark: item (item_id as text), hash, span, left, context. Items without id or words have none."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for first, _, offsets, raw in text_slices(b.column(1), SLICE):
                w = Words(offsets, raw)
                hashed = hasher.words(w)
                for span in range(1, SPAN + 1):
                    found = list(prints_of(w, *winnow(w, hashed, span, whole=True), span))
                    if found:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([first + d for d, _ in found])), *(pa.array([p[f] for _, p in found], _PRINT.field(f).type) for f in ("hash", "span", "left", "context"))], names=["item", "hash", "span", "left", "context"])

    return map_text(rows, run, "item string, hash long, span int, left int, context string").distinct()


def bits_of(prints: DataFrame) -> tuple[Bits, list[int], int]:
    """The bit table of benchmark fingerprints, their spans (10 at most), and the bytes that they all take."""
    size = prints.agg(F.count("*").alias("n"), F.sum(F.octet_length("context") + F.octet_length("item") + 64).alias("bytes"), F.collect_set("span").alias("spans")).first()
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * size.n).bit_length()))
    low = F.col("hash").bitwiseAND(F.lit(bits - 1))
    slots = prints.select(F.shiftright(low, 6).alias("slot"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    table = slots.toPandas()  # as many rows as the table has words, at most
    return Bits(bits, table["slot"].to_numpy(np.int64), table["bits"].to_numpy(np.int64)), sorted(size.spans), int(size.bytes or 0)


def document_prints(docs: DataFrame, bits: Bits, spans: list[int]) -> DataFrame:
    """One pass over the documents: row (a number of each row), key, n_words and prints that the benchmark may have.

    ``docs`` has key and text. A document with more than ROW_PRINTS such fingerprints has further rows with
    the same number, whose n_words is null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, hasher = sent.value, Hasher()
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            taken, rows, words, prints = [], [], [], []
            for first, end, offsets, raw in text_slices(b.column(1), SLICE):
                w = Words(offsets, raw)
                hashed = hasher.words(w)
                found: dict[int, list[dict]] = {}
                for span in spans:
                    for d, p in prints_of(w, *winnow(w, hashed, span, mine), span):
                        found.setdefault(d, []).append(p)
                for d, n in enumerate(w.counts().tolist()):
                    own = found.get(d, [])
                    for i in range(0, max(1, len(own)), ROW_PRINTS):
                        taken.append(first + d)
                        rows.append(number + first + d)
                        words.append(None if i else n)
                        prints.append(own[i : i + ROW_PRINTS])
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0).take(pa.array(taken, pa.int64())), pa.array(words, pa.int64()), pa.array(prints, pa.list_(_PRINT))], names=["row", "key", "n_words", "prints"])

    return map_text(docs.select("key", "text"), run, f"row long, key {kind}, n_words long, prints array<struct<hash:long,span:int,at:long,left:int,context:string>>")


def hits(base: DataFrame, prints: DataFrame, small: bool) -> DataFrame:
    """(row, item, first, end) of shared runs of words: fingerprints joined on the hash, extended and verified.

    A passage that many documents share gives one hash many rows on the documents' side; a small benchmark
    is sent to them, with a larger one adaptive execution splits such a key.
    """
    mine = base.where(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", "p.at", "p.left", "p.context", "p.hash", "p.span")
    theirs = prints.select("hash", "span", "item", F.col("left").alias("item_left"), F.col("context").alias("item_context"))
    met = mine.join(F.broadcast(theirs) if small else theirs, ["hash", "span"]).select("row", "item", "at", "span", "left", "context", "item_left", "item_context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, first, end = [], [], []
            columns = [b.column(i).to_pylist() for i in range(2, 8)]
            for i, (at, span, *contexts) in enumerate(zip(*columns, strict=True)):
                if reach := extended(span, *contexts):
                    taken.append(i)
                    first.append(at - reach[0])
                    end.append(at + min(K, span) + reach[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(taken, pa.int64())), b.column(1).take(pa.array(taken, pa.int64())), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["row", "item", "first", "end"])

    return map_text(met, run, "row long, item string, first long, end long")


def merged(runs: DataFrame, by: list[str]) -> DataFrame:
    """Union of half-open runs (first, end) within each group, by a window whose state is one number."""
    order = Window.partitionBy(*by).orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.coalesce((F.col("first") > before).cast("int"), F.lit(1)))
    return fresh.withColumn("part", F.sum("fresh").over(order)).groupBy(*by, "part").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("part")


def _searched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' rows with their numbers, and the hits in them. ``docs`` has key and text."""
    prints = materialise(benchmark_prints(benchmark))
    bits, spans, size = bits_of(prints)
    base = materialise(document_prints(docs, bits, spans))
    return base, hits(base, prints, size <= SENT_BYTES)


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Shared runs: doc_id, item_id (as text), first word and end word, for every document and item that share one."""
    base, found = _searched(docs.select(F.col("doc_id").alias("key"), "text"), benchmark)
    return merged(found, ["row", "item"]).join(base.where("n_words is not null").select("row", "key"), "row").select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "first", "end")


def measure(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts and items have no words; items without an id are left out; an item of fewer than 10 words, but
    not none, is one window; repeated rows are measured each; an empty benchmark contaminates nothing, an
    empty table of documents gives no rows; further columns are not read. Ids of either table may be of any type.
    Only rows with a hit are shuffled, with their runs and items.
    """
    base, found = _searched(docs.select(F.col("doc_id").alias("key"), "text"), benchmark)
    rows = base.where("n_words is not null")
    zero = F.lit(0).cast("long")
    none = (("n_hit", zero), ("n_items", zero), ("items_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    clear = rows.where(F.size("prints") == 0).select("key", "n_words", *(value.alias(name) for name, value in none))
    return clear.unionByName(_measured(rows.where(F.size("prints") > 0), found)).withColumnRenamed("key", "doc_id").withColumn("contaminated", F.col("n_hit") > 0)


def _measured(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, n_words, n_hit, n_items and items_sha256 of ``rows``, read off their hits in order of place.

    A row and its hits meet in one shuffle and one sort; the pass over them holds the end of the last run and
    the set of items, as many as the benchmark has at most.
    """
    no = lambda kind: F.lit(None).cast(kind)
    kind = rows.schema["key"].dataType
    heads = rows.select("row", F.lit(-1).cast("long").alias("first"), no("long").alias("end"), no("string").alias("item"), "key", "n_words")
    both = heads.unionByName(found.select("row", "first", "end", "item", no(kind).alias("key"), no("long").alias("n_words")))
    dealt = both.repartition("row").sortWithinPartitions("row", "first", "end")
    names = ["key", "n_words", "n_hit", "n_items", "items_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, words, hit, last, items = None, None, None, 0, 0, set()

        def done() -> pa.RecordBatch:
            digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            return pa.RecordBatch.from_arrays([key, pa.array([words], pa.int64()), pa.array([hit], pa.int64()), pa.array([len(items)], pa.int64()), pa.array([digest])], names=names)

        held: list[pa.RecordBatch] = []
        for b in batches:
            for i, (row, first, end, item, n) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True)):
                if row != now:
                    if now is not None:
                        held.append(done())
                    now, key, words, hit, last, items = row, b.column(4).slice(i, 1), n, 0, 0, set()
                else:
                    hit += max(0, end - max(first, last))
                    last = max(last, end)
                    items.add(item)
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if now is not None:
            yield done()

    return map_text(dealt, run, f"key {kind.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all their columns, that share no window with the benchmark.

    Rows are told apart by their texts alone, so null or repeated ids and extra columns do no harm. Only
    keys of contaminated texts travel: up to SENT_BYTES of them go to all workers and the documents are
    filtered where they stand; with more, the documents are joined with them.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(SPAN), "text").alias("b"))
    base, found = _searched(docs.select(key.alias("key"), "text"), benchmark)
    bad = materialise(base.where("n_words is not null").join(found.select("row").distinct(), "row", "left_semi").select("key.a", "key.b").distinct())
    few = 16 * bad.count() <= SENT_BYTES
    met = (F.xxhash64(docs["text"]) == bad["a"]) & (F.xxhash64(F.lit(SPAN), docs["text"]) == bad["b"])
    return docs.join(F.broadcast(bad) if few else bad, met, "left_anti")
