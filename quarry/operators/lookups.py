"""Look-ups and counts over the store: newest of a key, ids in a caller's order, tenant counts, line offsets, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of what no source found.
NO_RANK = 10**9
#: Statuses of a document on its way, in order, with their progress; the last ones end it. Fixed values.
PROGRESS = {"pending": 0, "parsing": 30, "chunking": 45, "embedding": 90, "ready": 100, "failed": 100, "needs_ocr": 100}
ENDS = ("ready", "failed", "needs_ocr")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the greatest ``order``, with the number of rows of the key. A partial aggregate, so copies never meet."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"), F.count("*").alias("versions")).select(key, "__row.*", "versions")


def in_order(asked: DataFrame, rows: DataFrame, key: str, by: str = "query_id") -> DataFrame:
    """Rows of the asked ids in the caller's order: ``asked`` has ``by`` and ids (an array); adds ord, from 0. Unknown ids are left out, repeated ones count once."""
    ids = asked.select(by, F.posexplode(F.array_distinct("ids")).alias("ord", key))
    return ids.join(rows, key)


def counts(rows: DataFrame, live: Column, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """All rows and the live ones of each tenant."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(live).alias("live"))


def best_rank(ranks: Column) -> Column:
    """Least rank in a map of ranks by source; NO_RANK if no source found it."""
    return F.coalesce(F.array_min(F.map_values(ranks)), F.lit(NO_RANK))


def line_offsets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank lines with the place of their first and behind their last character in the text: doc_id, line, char_start, char_end.

    Lines end with one line feed; a running sum inside the row, so nothing is shuffled.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<line:int,char_start:long,char_end:long>>").alias("out"))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    step = lambda a, x: F.struct((a["at"] + F.char_length(x["x"]) + 1).alias("at"), F.when(F.trim(x["x"]) == "", a["out"]).otherwise(F.array_append(a["out"], F.struct(x["i"].alias("line"), a["at"].alias("char_start"), (a["at"] + F.char_length(x["x"])).alias("char_end")))).alias("out"))
    return docs.select("doc_id", F.explode(F.aggregate(numbered, start, step, lambda a: a["out"])).alias("l")).select("doc_id", "l.line", "l.char_start", "l.char_end")


def statuses(changes: DataFrame) -> DataFrame:
    """Where each document stands after its status changes (document_id, seq, status): status, progress, done.

    A change counts if it goes forward; what has ended stays so, but for a new start (``parsing``) after a
    failure or a document that had to be recognised. The fold runs over one short array for each document.
    """
    place = F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))
    known = changes.where(F.col("status").isin(*PROGRESS))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "status"))), lambda s: s["status"])
    over = lambda s: s.isin(*ENDS)
    step = lambda now, new: F.when(over(now), F.when((now != "ready") & (new == "parsing"), new).otherwise(now)).otherwise(F.when(over(new) | (place[new] > place[now]), new).otherwise(now))
    folded = known.groupBy("document_id").agg(ordered.alias("s")).withColumn("status", F.aggregate("s", F.lit("pending"), step))
    return folded.select("document_id", "status", place[F.col("status")].alias("progress"), over(F.col("status")).alias("done"))


def last_turns(messages: DataFrame, by: str, order: str) -> DataFrame:
    """The last message of each conversation."""
    rest = [c for c in messages.columns if c != by]
    return messages.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("m")).select(by, "m.*")


def api_document(rows: DataFrame) -> DataFrame:
    """Documents as they are shown: the recognised pages and warnings stand beside the other fields, the tenant does not."""
    extra = lambda name, kind: F.from_json(F.get_json_object("meta", f"$.{name}"), kind)
    return rows.withColumns({"ocr_pages": F.coalesce(extra("ocr_pages", "array<int>"), F.array().cast("array<int>")), "warnings": F.coalesce(extra("parse_warnings", "array<string>"), F.array().cast("array<string>"))}).drop("meta", "tenant_id", "deleted_at")
