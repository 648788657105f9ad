"""Substring join: which texts hold which phrases, without comparing every text with every phrase."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry._session import workers_see_package

#: Characters of phrases that one pass holds in each worker; more phrases take more passes.
BLOCK_CHARS = 8 << 20


def containing(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rows of ``texts`` (with a column key) once for each of ``phrases`` (query_id, phrase) that stands in key.

    One automaton of all phrases reads every text once. Empty phrases and null texts match nothing.
    """
    spark = texts.sparkSession
    workers_see_package(spark)
    good = phrases.where("phrase <> '' and query_id is not null").select(F.col("query_id").cast("long"), "phrase")
    total = good.agg(F.sum(F.char_length("phrase") + 16).alias("n")).first().n or 0
    blocks = -(-total // BLOCK_CHARS)
    keep = [c for c in texts.columns if c != "key"]
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep) + ", query_id long"
    out = None
    for i in range(blocks):
        part = good.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == i) if blocks > 1 else good
        asked: dict[str, list[int]] = {}
        for r in part.collect():
            asked.setdefault(r.phrase, []).append(r.query_id)
        if not asked:
            continue
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for phrase, ids in sent.value.items():
                machine.add_word(phrase, ids)
            machine.make_automaton()
            for b in batches:
                rows, ids = [], []
                for n, text in enumerate(b.column("key").to_pylist()):
                    for q in {q for _, qs in machine.iter(text or "") for q in qs}:
                        rows.append(n)
                        ids.append(q)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), pa.array(ids, pa.int64())], names=[*keep, "query_id"])

        found = texts.select(*keep, "key").mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return texts.select(*keep).limit(0).withColumn("query_id", F.lit(0).cast("long")) if out is None else out
