"""What the operators of this folder share: materialising, text buffers, word spans, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry._session import table as table  # noqa: PLC0414
from quarry._session import workers_see_package

#: Rows that one Arrow batch may hold. Long texts make wide rows, so the default of 10,000 is too many.
BATCH_ROWS = 512
#: Text bytes that the numpy passes look at together; bounds the memory of their temporaries.
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on: worker path, bounded Arrow batches, a checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; a temporary one is used only where none is set.
    """
    workers_see_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quarry-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share."""
    prepare(spark)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from those files."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text, unsigned; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column without copying; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes (a longer text is a run alone).

    Yields first row, end row, offsets from 0 and bytes of the run.
    """
    at, raw = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, at[first : end + 1] - at[first], raw[at[first] : at[end]]
        first = end


def map_text(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the settings of this folder."""
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


# --- words as spans of bytes -------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """Spans of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased texts of a slice."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        self.text = _LOWER[raw]
        inside = _WORD[self.text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        #: Index of each text's first word, and one more at the end.
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


# --- connected components ----------------------------------------------------------------------


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, root) for every node with an edge; root is the least node.

    ``edges`` has long columns ``a`` and ``b``. Alternates large-star and small-star steps (Kiveris and
    others, 2014) until the edge set is a star forest. Each step is a min-aggregate (combined before the
    shuffle) and an equi-join that adaptive execution can split at hub nodes; nothing goes to the driver
    but a row count and a checksum. Each round is checkpointed, so lineage stays short and a lost executor
    costs one round. Self-loops and repeated edges don't matter; nulls are dropped.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node without a larger neighbour keeps its link to its least neighbour
        large = large.unionAll(least.where("m <> u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialise(small.select("e.u", "e.v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        row = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if (row.n, row.h) == sign:
            break
        sign = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least node reachable from each of 0..n-1 over edges given as index arrays; vectorised label passing."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        keep = a != b
        left, right, a, b = left[keep], right[keep], a[keep], b[keep]
        if not len(left):
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:  # shorten paths to their roots
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
