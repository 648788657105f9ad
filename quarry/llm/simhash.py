"""SimHash near-duplicates: exact comparison of all fingerprints, tile against tile.

Distinct fingerprints are cut into tiles of one population count each. Fingerprints within a radius r have
population counts within r, so most tile pairs are never met; the others are compared whole with numpy's
exclusive-or and bit counts. A tile pair sends back a spanning forest of its links, never the links
themselves, and components are joined over those. ``keep_verified`` links only texts whose shingle sets are
similar enough as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import connected, local_roots, map_text, materialise, text_bytes

RADIUS = 3
SHINGLE = 3
#: The same for near-duplicates by shingle sets, which have at least NEAR_PARTS[0] / NEAR_PARTS[1] of both in common.
#: At a Jaccard of 0.8 the expected distance is 9.7 of 64 bits with a deviation of 2.9 if bits were independent.
NEAR_RADIUS = 16
NEAR_SHINGLE = 5
NEAR_PARTS = (4, 5)
#: Shingles of a text are counted by the first 6 bits of their hashes; texts with more shingles than MOST_COUNTED are not.
BUCKETS, MOST_COUNTED = 64, (1 << 16) - 1
#: Fingerprints in a tile; a tile pair is one task's work at a time and holds about 24 bytes for each.
TILE = 1 << 14
#: Rows and columns of a tile pair that are compared in one numpy call.
STRIP, SLICE = 32, 1 << 13
#: Documents of a group of possible copies that are compared in one task; a larger group is cut into blocks.
GROUP = 1024
#: Ids of dropped documents that are sent to all workers; more are joined.
SENT_IDS = 1 << 21


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words in order (of all words, if they are no more); big-endian."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)] if words else []
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], 42) for a, b in zip((end - length)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=">u8")


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash over word shingles; texts without words have 0."""
    return majority(shingle_hashes(text.lower().split()))  # bytes: lowers A-Z alone and splits at exactly \x20 and \x09-\x0D


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = text_bytes(b.column(1))
            whole = memoryview(raw)
            fps = [fingerprint(bytes(whole[x:y])) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_text(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within ``radius`` bits, strip by strip; each once if a and b are the same tile."""
    for i in range(0, len(a), STRIP):
        for j in range(i if same else 0, len(b), SLICE):
            x, y = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, j : j + SLICE]) <= radius)
            x, y = x + i, y + j
            if same:
                x, y = x[y > x], y[y > x]
            if len(x):
                yield x, y


def _joined(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots after further links."""
    return local_roots(len(root), np.concatenate([np.arange(len(root)), left]), np.concatenate([root, right]))


def _by_population(values: list) -> Column:
    """A value for each population count of ``fp``, from 0 to 64."""
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.bit_count("fp").cast("int") + 1)


def tiled(rows: DataFrame, tiles: int, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows of numbered tiles (column ``tile``), dealt to the tile pairs (i, j), i <= j, that they take part in.

    A tile meets itself, those from ``first`` to it and those from it to ``last`` (all, by default). A row's
    pairs follow from the numbers alone; no list of pairs is made anywhere. ``side`` is 0 for tile i, 1 for j.
    """
    first, last = F.lit(0) if first is None else first, F.lit(tiles - 1) if last is None else last
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    up = F.transform(F.sequence(F.col("tile"), last), lambda j: pair(F.col("tile"), j, 0))
    down = F.when(F.col("tile") > first, F.transform(F.sequence(first, F.greatest(first, F.col("tile") - 1)), lambda i: pair(i, F.col("tile"), 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    dealt = rows.withColumn("__pair", F.explode(F.concat(up, down))).select("__pair.i", "__pair.j", "__pair.side", *(c for c in rows.columns if c != "tile"))
    spark = rows.sparkSession
    wanted = min(tiles * (tiles + 1) // 2, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(max(1, wanted), "i", "j")  # a given number: these tasks are long, not large


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between ids of ``distinct`` (id long, fp long; fingerprints all different) that keep components whole.

    The plan needs the number of fingerprints for each of the 65 population counts, nothing else of the
    driver. Tiles are numbered by population count; one with more than ``tile`` fingerprints is cut into
    several tiles by hash.
    """
    counts = {r.pop: r.n for r in distinct.groupBy(F.bit_count("fp").alias("pop")).agg(F.count("*").alias("n")).collect()}
    cut = [-(-counts.get(p, 0) // tile) for p in range(65)]
    first = np.concatenate([[0], np.cumsum(cut)]).tolist()
    if not first[-1]:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    numbered = distinct.select("id", "fp", (_by_population(first[:-1]) + F.pmod(F.xxhash64("fp"), _by_population([max(1, c) for c in cut]))).alias("tile"))
    low = _by_population([first[max(0, p - radius)] for p in range(65)])
    high = _by_population([first[min(64, p + radius) + 1] - 1 for p in range(65)])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("side", kind="stable")
        fp, ids, n = rows["fp"].to_numpy().view(np.uint64), rows["id"].to_numpy(), int((rows["side"] == 0).sum())
        same = key[0] == key[1]
        root = np.arange(len(fp))
        for x, y in near_pairs(fp[:n], fp if same else fp[n:], radius, same):
            root = _joined(root, x, y if same else y + n)
        node = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": ids[node], "b": ids[root[node]]})

    return tiled(numbered, first[-1], low, high).groupBy("i", "j").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Fingerprint and near-duplicate group of every document.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links of
    ``radius`` bits at most, itself included. Null and empty texts have fingerprint zero and are linked
    like any other. Rows with a null doc_id get a row too; a group of such rows alone has a null
    component_id. Repeated rows are returned each. Copies meet as one fingerprint, so a text that a third
    of the rows share is compared once.
    """
    base = materialise(fingerprints(docs))
    distinct = materialise(base.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("id")))
    linked = connected(tile_links(distinct, radius, tile))
    named = distinct.join(linked.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    kind = docs.schema["doc_id"].dataType
    return base.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, all their columns, with one of each near-duplicate group: that of the least doc_id.

    Of rows that share that id one stays (by text). Rows without an id all stay: nothing could name them
    as another's copies.
    """
    return _stay(docs, groups(docs, radius).select("doc_id", "component_id"))


def _stay(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row of each doc_id that is its own component_id in ``marked``, and all rows without an id.

    Only ids that go travel: up to SENT_IDS of them to all workers, and the documents are filtered where they
    stand; with more, the documents are joined with them. Ids that several rows share are dealt with apart.
    """
    ids = marked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("component_id") != F.col("doc_id")).alias("gone"))
    apart = materialise(ids.where("gone or rows > 1"))
    seen = apart.agg(F.count("*").alias("n"), F.count_if(F.col("rows") > 1).alias("shared"), F.count_if((F.col("rows") > 1) & ~F.col("gone")).alias("again")).first()
    sent = apart.select(F.col("doc_id").alias("__gone"))
    out = docs.join(F.broadcast(sent) if seen.n <= SENT_IDS else sent, docs["doc_id"] == sent["__gone"], "left_anti")
    if seen.again:
        shared = apart.where("rows > 1 and not gone").select(F.col("doc_id").alias("__gone"))
        whole = docs.select(F.struct("*").alias("__row")).join(F.broadcast(shared) if seen.again <= SENT_IDS else shared, F.col("__row.doc_id") == shared["__gone"], "left_semi")
        one = Window.partitionBy("__row.doc_id").orderBy(F.xxhash64("__row.text"), F.col("__row.text"))
        out = out.unionAll(whole.withColumn("__rank", F.row_number().over(one)).where("__rank = 1").select("__row.*"))
    return out


# --- near-duplicates by shingle sets -----------------------------------------------------------


def _node(words: list[bytes]) -> int:
    """Signed hash that stands for all texts of the same words."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def near_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (texts of the same words share one), fp, and number and bucket counts of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = text_bytes(b.column(1))
            whole = memoryview(raw)
            nodes, fps, sizes, counts = [], [], [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = bytes(whole[x:y]).lower().split()
                h = shingle_hashes(words, NEAR_SHINGLE)
                own = np.unique(h.astype(np.uint64))
                nodes.append(_node(words))
                fps.append(majority(h))
                sizes.append(len(own))
                count = np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=BUCKETS) if len(own) <= MOST_COUNTED else np.full(BUCKETS, MOST_COUNTED)
                counts.append(count.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary())], names=["doc_id", "node", "fp", "size", "counts"]
            )

    return map_text(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, size long, counts binary")


def _possible(size: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs may be similar enough: their sizes and bucket counts bound what they can have in common from above."""
    p, q = NEAR_PARTS
    ok = q * np.minimum(size[x], size[y]) >= p * np.maximum(size[x], size[y])
    for i in range(0, len(x), 1 << 15):
        at = np.flatnonzero(ok[i : i + (1 << 15)]) + i
        both = np.minimum(counts[x[at]], counts[y[at]]).sum(axis=1, dtype=np.int64)
        uncounted = (size[x[at]] > MOST_COUNTED) & (size[y[at]] > MOST_COUNTED)
        ok[at] = uncounted | ((p + q) * both >= p * (size[x[at]] + size[y[at]]))
    return ok


#: Sizes of shingle sets are counted in classes this factor apart.
SIZE_STEP = 1.03


def size_tiles(classes: list[tuple[int, int, int, int]], tile: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Tiles of sets in order of size, for (class, rows, least size, greatest size) in order of class.

    First the tiles of each class (first tile, number of tiles); then for each tile the first and the last one
    whose sets can be similar to its own: the smaller of two similar sets has NEAR_PARTS of the larger at least.
    Small classes share a tile; one of more than ``tile`` rows is cut into several.
    """
    p, q = NEAR_PARTS
    places: list[tuple[int, int]] = []
    least, most = [], []
    room = 0
    for _, rows, low, high in classes:
        if rows <= room:
            room -= rows
            most[-1] = high
            places.append((len(most) - 1, 1))
        else:
            cut = -(-rows // tile)
            places.append((len(most), cut))
            least += [low] * cut
            most += [high] * cut
            room = tile - rows if cut == 1 else 0
    first = [next(i for i in range(t + 1) if p * least[t] <= q * most[i]) for t in range(len(most))]
    last = [max(j for j in range(t, len(most)) if p * least[j] <= q * most[t]) for t in range(len(most))]
    return places, first, last


def possible_links(distinct: DataFrame, radius: int = NEAR_RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that keep the components over pairs within ``radius`` bits that may be similar enough.

    ``distinct`` has node, fp, size and counts. A wide radius spans nearly all population counts, so tiles are
    cut along the size of the shingle sets: sets whose sizes differ by more than a quarter are never similar,
    and their tiles never meet. The driver plans over a few hundred classes of sizes.
    """
    which = F.floor(F.log(SIZE_STEP, F.col("size") + 1)).cast("int")
    classes = sorted((r.c, r.n, r.low, r.high) for r in distinct.groupBy(which.alias("c")).agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high")).collect())
    if not classes:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    places, first, last = size_tiles(classes, tile)
    at = {c: place for (c, *_), place in zip(classes, places, strict=True)}
    pick = lambda values, index: F.element_at(F.array(*(F.lit(int(v)) for v in values)), index + 1)
    every = range(classes[-1][0] + 1)
    own = pick([at.get(c, (0, 1))[0] for c in every], which) + F.pmod(F.xxhash64("node"), pick([at.get(c, (0, 1))[1] for c in every], which)).cast("int")
    numbered = distinct.select("node", "fp", "size", "counts", own.alias("tile"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("side", kind="stable")
        node, size, fp = rows["node"].to_numpy(), rows["size"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        counts = np.frombuffer(b"".join(rows["counts"]), np.uint16).reshape(-1, BUCKETS)
        n, same = int((rows["side"] == 0).sum()), key[0] == key[1]
        root = np.arange(len(node))
        for x, y in near_pairs(fp[:n], fp if same else fp[n:], radius, same):
            y = y if same else y + n
            new = root[x] != root[y]
            x, y = x[new], y[new]
            if len(x):
                ok = _possible(size, counts, x, y)
                if ok.any():
                    root = _joined(root, x[ok], y[ok])
        out = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": node[out], "b": node[root[out]]})

    return tiled(numbered, len(first), pick(first, F.col("tile")), pick(last, F.col("tile"))).groupBy("i", "j").applyInPandas(compare, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingle hashes have a Jaccard of at least NEAR_PARTS; exact."""
    p, q = NEAR_PARTS
    common = len(a) + len(b) - len(np.union1d(a, b))
    return (p + q) * common >= p * (len(a) + len(b))


def similar_roots(fp: np.ndarray, sets: list[np.ndarray], root: np.ndarray, first: int, radius: int) -> np.ndarray:
    """Roots over links between each of the first ``first`` rows and all rows: within ``radius`` bits, with similar sets.

    ``root`` says what is linked already; such pairs are not compared.
    """
    p, q = NEAR_PARTS
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(names), bool)
    for i in range(first):
        met = (root != root[i]) & (np.bitwise_count(fp ^ fp[i]) <= radius) & (q * np.minimum(size, size[i]) >= p * np.maximum(size, size[i]))
        if not met.any():
            continue
        mark[flat[at[i] : at[i + 1]]] = True
        for j in np.flatnonzero(met).tolist():
            if root[j] != root[i] and (p + q) * np.count_nonzero(mark[flat[at[j] : at[j + 1]]]) >= p * (size[i] + size[j]):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
        mark[flat[at[i] : at[i + 1]]] = False
    return root


def verified_links(maybe: DataFrame, shingles: DataFrame, radius: int = NEAR_RADIUS, group: int = GROUP) -> DataFrame:
    """Links (a, b) that keep the components over pairs of similar texts within each group of possible copies.

    ``maybe`` has root (the group), node and fp, ``shingles`` node and shingles. A group of at most ``group``
    texts is one task's work. Of a larger one every text is first compared with the group's leader, its least
    node, wherever it stands. Those that are not similar to it then meet all texts of the group, in blocks of
    ``group``; pairs of texts that are both similar to the leader are linked already. So the work of a group
    of true copies grows with its size alone, and no task holds more than two blocks.
    """
    sizes = maybe.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("leader"))
    rows = materialise(maybe.join(shingles, "node").join(sizes, "root"))
    lead = rows.where((F.col("n") > group) & (F.col("node") == F.col("leader"))).select("root", F.col("fp").alias("lead_fp"), F.col("shingles").alias("lead_shingles"))
    spark = maybe.sparkSession

    def compare(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["side", "node"], kind="stable")
        node, side, known = some["node"].to_numpy(), some["side"].to_numpy(), some["known"].to_numpy()
        # a text may stand on both sides; the leader's likes are one from the start
        names, place = np.unique(node, return_inverse=True)
        root = np.arange(len(node))
        for same in (place, np.where(known, -1, np.arange(len(node)))):
            _, first, back = np.unique(same, return_index=True, return_inverse=True)
            root = _joined(root, np.arange(len(node)), first[back])
        root = similar_roots(some["fp"].to_numpy().view(np.uint64), [np.frombuffer(x, np.uint64) for x in some["shingles"]], root, int((side == 0).sum()), radius)
        out = np.flatnonzero(node != node[root])
        return pd.DataFrame({"a": node[out], "b": node[root[out]]})

    def like_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, lead_fp = (b.column(i).to_numpy().view(np.uint64) for i in (4, 6))
            near = np.bitwise_count(fp ^ lead_fp) <= radius
            ok = [bool(n) and similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for n, x, y in zip(near, b.column(5), b.column(7), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(ok, pa.bool_())], names=[*b.schema.names[:6], "known"])

    small = rows.where(F.col("n") <= group).select("root", "node", "fp", "shingles", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.lit(False).alias("known"))
    if not lead.limit(1).count():
        return small.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long")
    large = rows.where(F.col("n") > group).join(lead, "root").select("root", "n", "leader", "node", "fp", "shingles", "lead_fp", "lead_shingles")
    large = materialise(map_text(large, like_leader, "root long, n long, leader long, node long, fp long, shingles binary, known boolean"))
    led = large.where("known and node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    rest = large.where("not known").groupBy("root").agg(F.ceil(F.count("*") / group).alias("rest"))
    blocks = large.join(rest, "root").withColumn("blocks", F.ceil(F.col("n") / group))
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = F.when(F.col("known"), F.array().cast("array<struct<i:int,j:int,side:int>>")).otherwise(F.transform(count("blocks"), lambda j: cell(F.pmod(F.xxhash64("node"), F.col("rest")), j, 0)))
    theirs = F.transform(count("rest"), lambda i: cell(i, F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")), 1))
    cut = blocks.withColumn("cell", F.explode(F.concat(mine, theirs))).select("root", "node", "fp", "shingles", "cell.i", "cell.j", "cell.side", "known")
    wanted = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return small.unionByName(cut).repartition(wanted, "root", "i", "j").groupBy("root", "i", "j").applyInPandas(compare, "a long, b long").unionAll(led)


def near_groups(docs: DataFrame, radius: int = NEAR_RADIUS, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """doc_id and component_id of every document with an id; the latter is the least doc_id reachable over links.

    Linked are texts of the same words, and texts within ``radius`` bits whose sets of 5-word shingles have a
    Jaccard of 0.8 or more, computed from the sets. What size and bucket counts rule out is not verified;
    the rest forms groups of possible copies, whose links are verified in blocks of bounded size.
    """
    base = materialise(near_sketches(docs).where("doc_id is not null"))
    distinct = materialise(base.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("counts").alias("counts")))
    maybe = materialise(connected(possible_links(distinct, radius, tile)).join(distinct.select("node", "doc_id", "fp"), "node"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = text_bytes(b.column(0))
            whole = memoryview(raw)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = bytes(whole[x:y]).lower().split()
                own = np.unique(shingle_hashes(words, NEAR_SHINGLE).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([_node(words)], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["node", "shingles"])

    wanted = materialise(maybe.select("doc_id").distinct())
    read = docs.join(F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted, "doc_id", "left_semi")  # up to so many ids, no text is shuffled
    texts = map_text(read.select("text"), shingles, "node long, shingles binary")
    texts = texts.groupBy("node").agg(F.first("shingles").alias("shingles"))
    linked = connected(verified_links(maybe.select("root", "node", "fp"), texts, radius, group))
    named = materialise(distinct.select("node", "doc_id").join(linked, "node", "left").withColumn("near", F.coalesce("root", "node")))
    least = named.groupBy("near").agg(F.min("doc_id").alias("component_id"))
    return base.select("doc_id", "node").join(named.select("node", "near").join(least, "near").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_verified(docs: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """As ``keep_one``, with the groups of ``near_groups``."""
    return _stay(docs, near_groups(docs, radius))
