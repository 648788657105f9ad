"""Answers over retrieved evidence: extraction, citation checks, grading routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

REFUSAL = "The documents at hand do not answer this question."


def extractive(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers without a model: the best chunk and its citation, or a refusal.

    ``queries`` has query_id, ``evidence`` query_id, rank and content. Returns query_id, route, answer.
    """
    best = evidence.where("rank = 1").select("query_id", "content")
    answer = F.when(F.col("content").isNotNull(), F.concat("content", F.lit(" [1]"))).otherwise(F.lit(REFUSAL))
    route = F.when(F.col("content").isNotNull(), "generate").otherwise("refuse")
    return queries.join(best, "query_id", "left").select("query_id", route.alias("route"), answer.alias("answer"))


def verify(answers: DataFrame, evidence: DataFrame, with_quotes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Checks of cited numbers against the evidence.

    ``answers`` has query_id and answer, ``evidence`` query_id, rank, chunk_id and content. First result, a
    row for each valid citation: query_id, place (order of mention), rank, chunk_id, quote. Second, a row
    for each answer: query_id, cited, invalid (numbers without evidence, ascending), verified.
    """
    cited = answers.select("query_id", "answer", F.posexplode(X.citations(F.col("answer"))).alias("place", "rank"))
    found = cited.join(evidence.select("query_id", "rank", "chunk_id", "content"), ["query_id", "rank"], "left")
    quote = X.best_quote(F.col("answer"), F.col("content")) if with_quotes else F.lit(None).cast("string")
    good = found.where("chunk_id is not null").select("query_id", "place", "rank", "chunk_id", quote.alias("quote"))
    per = found.groupBy("query_id").agg(F.count("chunk_id").alias("cited"), F.array_sort(F.collect_set(F.when(F.col("chunk_id").isNull(), F.col("rank")))).alias("invalid"))
    out = answers.select("query_id").join(per, "query_id", "left")
    return good, out.select("query_id", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("invalid", F.array().cast("array<int>")).alias("invalid"), (F.coalesce("cited", F.lit(0)) > 0).alias("verified"))


def grade_route(has_chunks, verdict, attempts, limit: int, has_model: bool):  # noqa: ANN001, ANN201
    """Next step after retrieval: rewrite while nothing suffices and attempts are left, then refuse or generate.

    Without a model, or if grading failed (null verdict), what was found is used.
    """
    left = attempts < limit
    if not has_model:
        return F.when(has_chunks, "generate").when(left, "rewrite").otherwise("refuse")
    return (
        F.when(~has_chunks, F.when(left, "rewrite").otherwise("refuse"))
        .when(verdict.isNull() | (verdict == "sufficient"), "generate")
        .when(left, "rewrite")
        .otherwise("refuse")
    )


def known_route(route):  # noqa: ANN001, ANN201
    """A route, or generate if it is none."""
    return F.when(route.isin("rewrite", "generate", "refuse"), route).otherwise("generate")


def slices(rows: DataFrame, text: str, size: int = 8) -> DataFrame:
    """A text as events of ``size`` characters: the rows with part (from 0) and delta."""
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.substr(F.col(text), i + 1, F.lit(size))))
    return rows.select("*", F.posexplode(parts).alias("part", "delta"))


def span_provenance(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """How the pages of each span were read, and the least confidence among recognised ones.

    ``spans`` has span_id, document_id, page_start, page_end; ``pages`` (document_id, page, confidence) lists
    recognised pages. Returns span_id, extraction_method (native, ocr or mixed), ocr_confidence.
    """
    last = F.greatest("page_start", "page_end")
    joined = spans.join(pages.select("document_id", "page", "confidence"), (spans.document_id == pages.document_id) & F.col("page").between(F.col("page_start"), last), "left")
    return joined.groupBy("span_id").agg(
        F.when(F.count_distinct("page") == 0, "native").when(F.count_distinct("page") == F.max(last - F.col("page_start") + 1), "ocr").otherwise("mixed").alias("extraction_method"),
        F.min("confidence").alias("ocr_confidence"),
    )
