"""Corpus pipeline: toxicity, language, near-duplicates, benchmark leaks, packing.

Each stage takes what the one before kept, rereads it from Parquet, and decides by a corpus operator. All but
the last return the columns they were given, further ones and such with odd names included. An empty table, or
one of which an earlier stage kept nothing, gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, langid, packing, simhash, toxicity
from quarry.llm.common import prepare, shared_folder, table
from quarry.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labelled ones outside the held-out fifth.

    Null and empty texts have no hits and stay; rows without an id are scored like any other; repeated rows go
    or stay together; without a toxic label nothing goes.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mainly in a language that the corpus' own labels teach; without letters or in no such script, none.

    So null and empty texts go; rows without an id are judged like any other; without labelled languages all go.
    """
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash and 5-word shingles, that of the least id.

    Of rows that share that id one stays; rows without an id all stay, as nothing names them; texts without
    words are copies of each other.
    """
    return simhash.keep_verified(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10-word window with the benchmark.

    Null and empty texts share none and stay, as do all with an empty benchmark; copies go together.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 4096; null text counts as empty, repeated rows are packed each."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bestfit_packing", pack),
]

#: Learned models and fingerprints decide here, which SQL can't express; see the brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read again."""
    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
