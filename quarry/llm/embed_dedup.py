"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Following C2LSH and QALSH (Gan and others, 2012; Huang and others, 2015): unit vectors are projected on
random directions. On each line a vector collides with those in a window centred on its own value; pairs that
collide often enough are verified by their cosine. Two kinds of lines share the work:

- On ``cuts`` lines and on one line that is sorted within a task, the window is so wide (``WIDE``) that a pair
  at the threshold nearly always collides. A pair must collide on all of them, so the lines are cut into ranges
  as wide as the window and only neighbouring ranges meet. More vectors are cut along more lines.
- On ``COUNTED`` further lines the window is narrow (``NARROW``); the pair's collisions are counted over small
  integers, a strip of rows against a slice of rows at a time.

Windows and count are calibrated so that a pair at the threshold itself is found with a known chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected, local_roots, map_text, materialise

COSINE = 0.95
#: Half widths of the windows, as shares of the distance of two vectors at the threshold.
WIDE, NARROW = 3.0, 1.5
#: Lines whose collisions are counted, and the wanted chance that a pair at the threshold reaches the count.
COUNTED, RECALL = 16, 0.995
#: Lines that are cut into ranges, at most.
MOST_CUTS = 3
#: Vectors on either side of a task, at most about; vectors for each further line that is cut.
BLOCK, FIRST_CUT, CUT_RATIO = 1 << 14, 1 << 12, 8
#: Ranges of a cut line are numbered from -EDGE to EDGE; the outer ones have no end.
EDGE = 6
#: Rows of the table of cells (32 bytes each) that are sent to all workers; a larger one is joined instead.
MOST_CELLS = 100_000
#: Rows and columns of counts that are made together, and linked pairs that are merged together.
STRIP, SLICE, HELD = 64, 4096, 1 << 16
#: Share of candidates in a strip from which the whole strip is verified by one matrix product.
DENSE = 1 / 16
#: A narrow window spans so many steps of the small integers.
STEPS = 12
SEED = 20

_ROOT_HALF = math.sqrt(0.5)


@cache
def calibrated(cosine: float = COSINE) -> tuple[float, float, int]:
    """Half widths of the wide and the narrow windows, and the least number of collisions in narrow ones.

    The projections of two unit vectors differ by a normal variable of their distance as deviation, so each
    direction collides independently with one known chance; the count is the largest that a pair at the
    threshold reaches with the chance RECALL. Nearer pairs have a higher one.
    """
    distance = math.sqrt(2 - 2 * cosine)
    p = math.erf(NARROW * _ROOT_HALF)
    chance = [math.comb(COUNTED, i) * p**i * (1 - p) ** (COUNTED - i) for i in range(COUNTED + 1)]
    need = max(i for i in range(COUNTED + 1) if sum(chance[i:]) >= RECALL)
    return WIDE * distance, NARROW * distance, need


def recall_at_threshold(cuts: int) -> float:
    """Chance that a pair at the threshold itself is found."""
    p = math.erf(NARROW * _ROOT_HALF)
    need = calibrated()[2]
    counted = sum(math.comb(COUNTED, i) * p**i * (1 - p) ** (COUNTED - i) for i in range(need, COUNTED + 1))
    return math.erf(WIDE * _ROOT_HALF) ** (cuts + 1) * counted


def directions(dimensions: int) -> np.ndarray:
    """Fixed random directions (dimensions x lines), the same on every machine: cut lines, the sorted line, counted lines."""
    return np.random.Generator(np.random.PCG64([SEED, dimensions])).standard_normal((dimensions, MOST_CUTS + 1 + COUNTED))


def candidates(a: np.ndarray, b: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that collide often enough and have the cosine; each once."""
    wide, narrow, need = calibrated(cosine)
    axes = directions(a.shape[1])[:, MOST_CUTS:]
    lines_a, lines_b = a @ axes, b @ axes
    by_a, by_b = np.argsort(lines_a[:, 0], kind="stable"), np.argsort(lines_b[:, 0], kind="stable")
    line_a, line_b = lines_a[by_a, 0], lines_b[by_b, 0]
    # one step more than the window, so that rounding loses no collision; values that wrap around only add some
    reach = STEPS + 1
    small_a, small_b = (np.ascontiguousarray(np.floor(x[by, 1:] * (STEPS / narrow)).astype(np.int64).astype(np.uint8).T) for x, by in ((lines_a, by_a), (lines_b, by_b)))
    small_a = small_a - np.uint8(reach)
    apart, close = np.empty((STRIP, SLICE), np.uint8), np.empty((STRIP, SLICE), bool)
    for i in range(0, len(a), STRIP):
        end = min(i + STRIP, len(a))
        low, high = np.searchsorted(line_b, line_a[i] - wide, "left"), np.searchsorted(line_b, line_a[end - 1] + wide, "right")
        for j in range(low, high, SLICE):
            to = min(j + SLICE, high)
            t, c = apart[: end - i, : to - j], close[: end - i, : to - j]
            count = np.zeros(t.shape, np.uint8)
            for x, y in zip(small_a, small_b, strict=True):
                np.subtract(y[None, j:to], x[i:end, None], out=t)
                np.less_equal(t, 2 * reach, out=c)
                np.add(count, c.view(np.uint8), out=count)
            left, right = np.nonzero(count >= need)
            if not len(left):
                continue
            if len(left) > DENSE * count.size:
                products = (a[by_a[i:end]] @ b[by_b[j:to]].T)[left, right]
                left, right = by_a[left + i], by_b[right + j]
            else:
                left, right = by_a[left + i], by_b[right + j]
                products = np.einsum("ij,ij->i", a[left], b[right])
            keep = products >= cosine
            if keep.any():
                yield left[keep], right[keep]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _units(column: pa.Array) -> tuple[list[bytes | None], np.ndarray]:
    """Bytes of the unit vector of each row (None if it cannot link with anything), and its places on the cut lines."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[bytes | None] = [None] * len(column)
    at = np.zeros((len(column), MOST_CUTS))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
    wide = calibrated()[0]
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        v = values[offsets[rows][:, None] + np.arange(size)]
        top = np.abs(v).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        rows, v = rows[good], v[good] / top[good, None]  # no overflow
        v = (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] + 0.0).astype("<f8")
        at[rows] = v @ directions(size)[:, :MOST_CUTS] / wide
        for i, row in zip(rows.tolist(), v, strict=True):
            out[i] = row.tobytes()
    return out, at


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, unit (bytes of the doubles of the unit vector) and its places on the cut lines, in ranges.

    ``unit`` is null if the vector cannot link with anything: a null or empty vector, one with null or
    non-finite components, or zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, at = _units(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.binary()), *(pa.array(np.clip(np.floor(x), -EDGE, EDGE).astype(np.int32)) for x in at.T)], names=["vec_id", "unit", *(f"range{k}" for k in range(MOST_CUTS))])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return map_text(embeddings.select("vec_id", "embedding"), run, f"vec_id {kind}, unit binary, " + ", ".join(f"range{k} int" for k in range(MOST_CUTS)))


def cuts_for(rows: int) -> int:
    """Lines to cut for so many vectors: more rows make up for sending each to more tasks."""
    return min(MOST_CUTS, 1 + max(0, int(math.log(max(1, rows) / FIRST_CUT, CUT_RATIO))))


def block_links(distinct: DataFrame, rows: int, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Links among ``distinct`` (id, unit, range0.., copies): per task, for each id with links (id, links, to).

    A cell is one range of every cut line. Its own rows meet its own and those of neighbouring cells of a
    higher number; a cell with more than ``block`` rows on a side is cut into blocks by hash, and every block
    of one side meets every block of the other. ``links`` counts the linked rows with their copies; ``to`` is
    the least id that the row is joined with in this task, so that (id, to) is a spanning forest of the links.
    """
    cuts = cuts_for(rows)
    # one digit to the base 16 for each line, from 1 to 2 * EDGE + 1, so a neighbour's never carries over
    digits = [(F.col(f"range{k}") + EDGE + 1).cast("long") * 16**k for k in range(cuts)]
    home = digits[0]
    for d in digits[1:]:
        home = home + d
    steps = [0]
    for k in range(cuts):
        steps = [s + d * 16**k for s in steps for d in (-1, 0, 1)]
    homed = distinct.select("id", "unit", "copies", home.alias("home"), F.length("unit").alias("size"))
    met = F.explode(F.array(*(F.lit(s) for s in sorted(steps) if s <= 0)))
    sent = homed.withColumn("step", met).withColumn("cell", F.col("home") + F.col("step"))
    # numbers of rows by cell: at most (2 * EDGE + 3) ** cuts for each length of vectors
    counts = sent.groupBy("size", "cell").agg(F.count_if(F.col("step") == 0).alias("own"), F.count("*").alias("all")).where("own > 0")
    parts = materialise(counts.select("size", "cell", F.ceil(F.col("own") / block).alias("own_parts"), F.ceil(F.col("all") / block).alias("all_parts")))
    plan = parts.agg(F.count("*").alias("cells"), F.sum(F.col("own_parts") * F.col("all_parts")).alias("tasks")).first()
    dealt = sent.join(F.broadcast(parts) if plan.cells <= MOST_CELLS else parts, ["size", "cell"])
    i, j = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.col("own_parts")), F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.col("all_parts"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = F.when(F.col("step") == 0, F.transform(every("all_parts"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("first")))).otherwise(F.array().cast("array<struct<i:long,j:long,first:boolean>>"))
    yours = F.transform(every("own_parts"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("first")))
    dealt = dealt.withColumn("task", F.explode(F.concat(mine, yours))).select("size", "cell", "task.i", "task.j", "task.first", "id", "unit", "copies", (F.col("step") == 0).alias("own"))
    spark = distinct.sparkSession
    wanted = min(plan.tasks or 1, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first = group["first"].to_numpy()
        mine, yours = group[first], group[~first]
        if not len(mine) or not len(yours):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        return _compared(mine, yours, cosine)

    keys = ["size", "cell", "i", "j"]
    return dealt.repartition(int(wanted), *keys).groupBy(*keys).applyInPandas(compare, "id long, links long, to long")


def _compared(mine: pd.DataFrame, yours: pd.DataFrame, cosine: float) -> pd.DataFrame:
    x, y = _matrix(mine["unit"]), _matrix(yours["unit"])
    copies_x, copies_y, own = mine["copies"].to_numpy(), yours["copies"].to_numpy(), yours["own"].to_numpy()
    id_x, id_y = mine["id"].to_numpy(), yours["id"].to_numpy()
    ids, place = np.unique(np.concatenate([id_x, id_y]), return_inverse=True)
    at_x, at_y = place[: len(x)], place[len(x) :]
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))  # over ranks, so that roots are least ids
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(root: np.ndarray) -> np.ndarray:
        left, right = (np.concatenate(z) for z in zip(*held, strict=True))
        held.clear()
        return local_roots(len(root), np.concatenate([np.arange(len(root)), left]), np.concatenate([root, right]))

    for left, right in candidates(x, y, cosine):
        once = ~own[right] | (id_x[left] < id_y[right])  # rows of one cell stand on both sides
        left, right = left[once], right[once]
        links += np.bincount(at_x[left], copies_y[right], len(ids)).astype(np.int64) + np.bincount(at_y[right], copies_x[left], len(ids)).astype(np.int64)
        held.append((at_x[left], at_y[right]))
        if sum(len(z) for z, _ in held) >= HELD:
            root = merge(root)
    if held:
        root = merge(root)
    some = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[some], "links": links[some], "to": ids[root[some]]})


def groups(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors that point the same way bit for bit are compared once and counted with their copies. Vectors
    that are null, zero or hold null or non-finite components link with nothing; so do vectors of another
    length. Repeated vec_ids count as one vector each; a null vec_id is never kept and groups under the
    least id linked to it. An empty table gives no rows; further columns are not read. Only pairs with a
    cosine of ``cosine`` or more link; of those, pairs at the threshold itself are found with the chance
    ``recall_at_threshold``, nearer ones with a higher one. Ranges are made for COSINE; a lower ``cosine`` is
    an error, since their windows would be too narrow for it.
    """
    if cosine < COSINE:
        raise ValueError(f"windows are made for a cosine of {COSINE} or more")
    base = materialise(unit_vectors(embeddings))
    good = base.where("unit is not null")
    ranges = [F.first(f"range{k}").alias(f"range{k}") for k in range(MOST_CUTS)]
    distinct = materialise(good.groupBy("unit").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"), *ranges).select(F.coalesce("least", F.xxhash64("unit")).alias("id"), "least", "unit", "copies", *(f"range{k}" for k in range(MOST_CUTS))))
    found = materialise(block_links(distinct.drop("least"), distinct.count(), cosine, block))
    linked = connected(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = distinct.join(counted, "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id"))
    kind = embeddings.schema["vec_id"].dataType
    return base.select("vec_id", "unit").join(named, "unit", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").cast(kind).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
