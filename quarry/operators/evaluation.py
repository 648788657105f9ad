"""Retrieval and answer metrics; every question counts in every denominator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.phrases import containing


def resolve_evidence(chunks: DataFrame, phrases: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Chunks that hold a question's phrase, compared by letters and digits: query_id, chunk_id, document_id.

    ``phrases`` has query_id and phrase; ``allowed`` (query_id, document_id) limits the documents of each.
    """
    keyed = chunks.select("chunk_id", "document_id", X.evidence_key(F.col("content")).alias("key"))
    wanted = phrases.select("query_id", X.evidence_key(F.col("phrase")).alias("phrase"))
    if allowed is not None:
        joined = keyed.join(wanted.join(allowed, "query_id"), "document_id").where("phrase <> '' and contains(key, phrase)")
        return joined.select("query_id", "chunk_id", "document_id").distinct()
    return containing(keyed, wanted).select("query_id", "chunk_id", "document_id").distinct()


def first_ranks(runs: DataFrame, gold: DataFrame, depth: int, arms: tuple[str, ...]) -> DataFrame:
    """arm, query_id and r: the first position of a gold chunk within the depth, null if there is none.

    Every question with gold has a row for every one of ``arms``.
    """
    found = runs.where(F.col("pos") <= depth).join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("arm", "query_id").agg(F.min("pos").alias("r"))
    asked = gold.select("query_id").distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    return asked.join(found, ["arm", "query_id"], "left")


def _share(hit) -> F.Column:  # noqa: ANN001
    return F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("int")), 6)


def metrics(runs: DataFrame, gold: DataFrame, arms: tuple[str, ...], at: tuple[int, ...] = (1, 3, 5, 10), depth: int = 10) -> DataFrame:
    """Share of questions with gold in the first k, and mean reciprocal rank, for every arm."""
    r = first_ranks(runs, gold, depth, arms)
    return r.groupBy("arm").agg(*(_share(F.col("r") <= k).alias(f"r_at_{k}") for k in at), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def funnel(runs: DataFrame, gold: DataFrame, arms: tuple[str, ...], at: tuple[int, ...] = (1, 5, 10, 30, 50), depth: int = 50) -> DataFrame:
    """Metrics by depth, and the shares that never came into the pool and that were lost behind the tenth place."""
    r = first_ranks(runs, gold, depth, arms)
    has, ten = F.avg(F.col("r").isNotNull().cast("int")), F.avg(F.coalesce(F.col("r") <= 10, F.lit(False)).cast("int"))
    return r.groupBy("arm").agg(
        *(_share(F.col("r") <= k).alias(f"r_at_{k}") for k in at), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.round(1 - has, 6).alias("missing_from_pool"), F.round(has - ten, 6).alias("lost_later")
    )


def golden_problems(golden: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contradictions of a question set: query_id, chunk_id (or null), problem.

    ``golden`` has query_id and type; ``gold`` query_id, chunk_id and gold_document_id.
    """
    none = F.lit(None).cast("long")
    problem = lambda df, name, chunk=none: df.select("query_id", chunk.alias("chunk_id"), F.lit(name).alias("problem"))
    known = gold.select("query_id", "chunk_id", "gold_document_id").join(chunks.select("chunk_id", "document_id"), "chunk_id", "left")
    free = F.col("type") == "unanswerable"
    has = gold.select("query_id").distinct()
    out = problem(golden.groupBy("query_id").count().where("count > 1"), "duplicate_id")
    out = out.unionAll(problem(known.where("document_id is null"), "unknown_chunk", F.col("chunk_id")))
    out = out.unionAll(problem(known.where("document_id <> gold_document_id"), "wrong_document", F.col("chunk_id")))
    out = out.unionAll(problem(golden.where(~free).join(has, "query_id", "left_anti"), "answerable_without_gold"))
    return out.unionAll(problem(golden.where(free).join(has, "query_id", "left_semi"), "unanswerable_with_gold"))


def refusal(rows: DataFrame) -> DataFrame:
    """One row of ratios over answers (type, route, n_citations, checked, grounded); an empty group gives 0."""
    free, refused = F.col("type") == "unanswerable", F.col("route") == "refuse"
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return rows.agg(
        ratio(F.count_if(free & refused & (F.col("n_citations") == 0)), F.count_if(free)).alias("refuse_accuracy"),
        F.count_if(free).alias("refuse_n"),
        ratio(F.count_if(~free & refused), F.count_if(~free)).alias("false_refuse_rate"),
        F.count_if(~free & refused).alias("false_refuse_n"),
        ratio(F.sum("grounded"), F.sum("checked")).alias("citation_groundedness"),
        F.coalesce(F.sum("checked"), F.lit(0)).alias("citations_checked"),
    )


def groundedness(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (chunk_id, quote, ...) of known chunks with grounded: the folded quote stands in its folded chunk."""
    quote = X.fold(F.coalesce("quote", F.lit("")))
    return citations.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("grounded", (quote != "") & F.contains(X.fold(F.col("content")), quote)).drop("content")


def oversampling(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Share of reference entries among missed and found hits against the corpus (columns: found, content)."""
    flag = X.is_reference_entry(F.col("content")).cast("double")
    base = corpus.agg(F.avg(flag).alias("corpus_share"))
    return hits.groupBy("found").agg(F.avg(flag).alias("share")).join(F.broadcast(base)).withColumn("ratio", F.col("share") / F.nullif(F.col("corpus_share"), F.lit(0.0)))


def refusal_causes(refused: DataFrame, gold: DataFrame, hits: DataFrame, depth: int = 5) -> DataFrame:
    """Refused questions (query_id) that have gold, and how many of them had none of it among their first hits."""
    wrong = refused.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    found = hits.where(F.col("rank") <= depth).join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("found", F.lit(True))
    return wrong.join(found, "query_id", "left").agg(F.count("*").alias("false_refusals"), F.count_if(F.col("found").isNull()).alias("not_retrieved"))


def channel_health(hits: DataFrame, top_k: int) -> DataFrame:
    """Of each arm: questions with hits, hits for each, mean of the best scores, and lists that are full."""
    return hits.groupBy("arm").agg(
        F.count_distinct("query_id").alias("answered"), F.round(F.count("*") / F.count_distinct("query_id"), 6).alias("mean_hits"),
        F.round(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 6).alias("mean_top_score"), F.count_if(F.col("rank") == top_k).alias("full_lists"),
    )


def without_chunks(run: DataFrame, bad: DataFrame) -> DataFrame:
    """A run as arm ``before``, and as ``after`` without some chunks, positions closed up."""
    left = run.join(bad.select("chunk_id"), "chunk_id", "left_anti")
    left = left.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    arm = lambda df, name: df.select(F.lit(name).alias("arm"), "query_id", "chunk_id", F.col("pos").cast("int").alias("pos"))
    return arm(run, "before").unionAll(arm(left, "after"))
