"""Tables that many queries share: chunks and their lexical index, written once for each application and input.

They stand in the shared folder, so a lost executor loses nothing and no blocks stay in memory.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from quarry._session import shared_folder, table
from quarry.operators.postings import LexicalIndex
from quarry.plans import text_queries

_READY: dict[str, object] = {}


def _place(spark: SparkSession, sf_dir: str, what: str) -> str:
    """A folder of its own for what is made of these files by this application."""
    files = sorted(table(spark, sf_dir, "documents").inputFiles())
    key = hashlib.sha256("\n".join([spark.sparkContext.applicationId, what, *files]).encode()).hexdigest()[:24]
    return f"{shared_folder(spark)}/prepared-{key}"


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of all documents."""
    path = _place(spark, sf_dir, "chunks")
    if path not in _READY:
        text_queries.chunks_of(spark, sf_dir).write.mode("overwrite").parquet(path)
        _READY[path] = True
    return spark.read.parquet(path)


def index_of(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The lexical index of those chunks."""
    path = _place(spark, sf_dir, "index")
    if path not in _READY:
        made = LexicalIndex(spark, path)
        made.add(chunks_of(spark, sf_dir))
        _READY[path] = made
    return _READY[path]
