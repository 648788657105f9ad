"""Chunking, search, fusion, answers, records, jobs against plain versions of the rules."""

import hashlib
import io
import math
import random
import zipfile
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import ChunkSettings, QueueSettings, RetrievalSettings, from_environment, redacted
from quarry.operators import answers, chunking, conversations, evaluation, index, jobs, phrases, records, retrieval
from quarry.sources import files

NODE_DEFAULTS = {"type": "paragraph", "level": None, "section": "", "page_start": 1, "page_end": 1, "method": "native", "cells": None, "code_lang": None}


def node(text, **more):
    return NODE_DEFAULTS | {"text": text} | more


# --- chunking ----------------------------------------------------------------------------------


def test_packing_rules():
    p = chunking.Packer(ChunkSettings(target_tokens=10, max_tokens=20, overlap_tokens=2, parent_tokens=25))
    got = p.chunks([node("A", type="title", level=1), node("a" * 16), node("b" * 16), node("c" * 16), node("B", type="title", level=2), node("d" * 8), node("x", type="footer"), node("T", type="table"), node("C", type="title", level=1), node("e" * 44), node("  ")])
    assert [(c["content"], c["section_path"], c["node_type"]) for c in got] == [
        ("a" * 16 + "\n\n" + "b" * 16, "A", "paragraph"), ("c" * 16, "A", "paragraph"), ("d" * 8, "A > B", "paragraph"), ("T", "A > B", "table"), ("e" * 44, "C", "paragraph"),
    ]
    assert [c["chunk_index"] for c in got] == list(range(5)) and [c["parent_index"] for c in got] == [0, 0, 2, 2, 4]
    assert all(c["token_count"] == chunking.count_tokens(c["content"]) for c in got)
    two = p.chunks([node("a" * 8), node("b" * 8, method="ocr", page_end=3)])
    assert [c["method"] for c in two] == ["native", "ocr"]


def test_long_units():
    p = chunking.Packer(ChunkSettings(target_tokens=5, max_tokens=8, overlap_tokens=2))
    hard = p.chunks([node("x" * 100)])
    assert all(chunking.count_tokens(c["content"]) <= 8 for c in hard) and "".join([hard[0]["content"]] + [c["content"][8:] for c in hard[1:]]) == "x" * 100
    said = p.chunks([node("one two! three four five! six seven eight nine, ten eleven twelve thirteen, x!")])
    assert all(c["token_count"] <= 8 for c in said) and "".join("".join(c["content"].split()) for c in said) == "onetwo!threefourfive!sixseveneightnine,teneleventwelvethirteen,x!"
    cells = [["h1", "h2"]] + [[f"row{i}", "v" * 6] for i in range(6)]
    table = chunking.Packer(ChunkSettings(20, 30)).chunks([node(chunking.markdown(cells), type="table", cells=cells)])
    assert len(table) > 1 and all(c["content"].startswith("| h1 | h2 |\n| --- | --- |\n") for c in table) and sum(c["content"].count("row") for c in table) == 6
    code = chunking.Packer(ChunkSettings(10, 12)).chunks([node("\n".join(f"line{i} = {i}" for i in range(20)), type="code", code_lang="py")])
    assert len(code) > 1 and all(c["content"].startswith("```py\n") and c["content"].endswith("\n```") for c in code)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ,!。中", min_size=1, max_size=60), max_size=12))
def test_packing_keeps_all_text(texts):
    p = chunking.Packer(ChunkSettings(target_tokens=6, max_tokens=9, overlap_tokens=0))
    got = p.chunks([node(t) for t in texts])
    squeeze = lambda t: "".join(t.split())
    assert "".join(squeeze(c["content"]) for c in got) == "".join(map(squeeze, texts))
    assert all(c["token_count"] <= 12 for c in got)


def test_settings():
    with pytest.raises(ValueError):
        ChunkSettings(10, 5).clamped()
    assert ChunkSettings(256, 384, model_max=128).clamped().target_tokens == 128
    with pytest.raises(ValueError):
        RetrievalSettings(rrf_k=0)
    assert from_environment(QueueSettings).lease_seconds == 900
    assert redacted({"api_key": "x", "a": {"password": "y", "n": 1}}) == {"api_key": "***", "a": {"password": "***", "n": 1}}


def test_chunk_table(spark):
    docs = spark.createDataFrame([(3, "a\n\nb"), (4, None), (5, "")], "doc_id long, text string")
    got = chunking.finished(chunking.chunk_nodes(chunking.line_nodes(docs)), spark.createDataFrame([(3, "T")], "document_id long, doc_title string")).collect()
    assert [(r.chunk_id, r.document_id, r.content, r.embed_text) for r in got] == [(3 << 20, 3, "a\n\nb", "《T》\n\na\n\nb")]


# --- search ------------------------------------------------------------------------------------


def plain_bm25(chunks, query):
    tf = {i: Counter(index.tokenise(t)) for i, t in chunks.items()}
    n, avg = len(tf), sum(max(sum(c.values()), 1) for c in tf.values()) / len(tf)
    out = {}
    for i, c in tf.items():
        s = 0.0
        for term in set(index.tokenise(query)):
            if c[term]:
                df = sum(1 for x in tf.values() if x[term])
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * max(sum(c.values()), 1) / avg))
        if s:
            out[i] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark, monkeypatch):
    chunks = {1: "alpha beta beta gamma", 2: "alpha delta", 3: "epsilon", 4: None}
    df = spark.createDataFrame(list(chunks.items()), "chunk_id long, content string")
    del chunks[4]
    q = spark.createDataFrame([(1, "beta alpha"), (2, "alpha alpha"), (3, ""), (4, None)], "query_id long, text string")
    got = defaultdict(list)
    for r in index.bm25(df.where("content is not null"), q).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    assert got == {1: [(1, 1.486753), (2, 0.499176)], 2: [(2, 0.499176), (1, 0.363721)]}
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    many = {i: " ".join(rng.choices(words, k=rng.randrange(1, 30))) for i in range(200)}
    asked = {i: " ".join(rng.choices(words, k=4)) for i in range(20)}
    monkeypatch.setattr(index, "QUERY_BLOCK", 7)
    got = defaultdict(list)
    for r in index.bm25(spark.createDataFrame(list(many.items()), "chunk_id long, content string").repartition(3), spark.createDataFrame(list(asked.items()), "query_id long, text string"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    assert got == {i: plain_bm25(many, t)[:10] for i, t in asked.items()}
    assert index.bm25(df.limit(0), q).count() == 0 and index.bm25(df, q.limit(0)).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [None, 1.0])], "chunk_id long, dense array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, dense array<double>")
    assert [(r.chunk_id, r.score, r.rank) for r in index.dense(v, q, 2).orderBy("rank").collect()] == [(1, 1.0, 1), (2, 1.0, 2)]
    assert index.dense(v.limit(0), q).count() == 0


def test_index_tables(spark):
    base = spark.createDataFrame([(1, 7, 1, True, "a"), (2, 7, 1, False, "b"), (3, 8, 2, True, "c")], "chunk_id long, document_id long, tenant_id int, is_active boolean, content string")
    new = spark.createDataFrame([(2, 7, 1, True, "B"), (4, 9, 1, True, "d")], base.schema)
    once = index.upsert(base, new)
    assert sorted(r.content for r in once.collect()) == ["B", "a", "c", "d"] == sorted(r.content for r in index.upsert(once, new).collect())
    rest, n = index.delete_document(base, 7)
    assert rest.count() == 1 and n.first().deleted == 2
    assert {(r.chunk_id, r.missing_in) for r in index.reconcile(base, new).collect()} == {(1, "index"), (3, "index"), (4, "store")}
    assert index.active(base).count() == 1


def test_rrf_by_hand(spark):
    rows = [(1, "dense", c, 1.0, i + 1) for i, c in enumerate((10, 20, 30))] + [(1, "sparse", c, 1.0, i + 1) for i, c in enumerate((20, 10, 40))]
    hits = spark.createDataFrame(rows, "query_id long, channel string, chunk_id long, score double, rank int")
    got = [(r.chunk_id, r.score) for r in retrieval.rrf(hits).orderBy("pos").collect()]
    assert got == [(10, 0.032522475), (20, 0.032522475), (30, 0.015873016), (40, 0.015873016)]
    assert [r.chunk_id for r in retrieval.rrf(hits, weights={"sparse": 0}).orderBy("pos").collect()] == [10, 20, 30]
    with pytest.raises(ValueError):
        retrieval.rrf(hits, 0)
    assert [r.chunk_id for r in retrieval.candidates(retrieval.rrf(hits), RetrievalSettings(fused_top_k=1, channel_head=1)).orderBy("pos").collect()] == [10, 20]


def test_rerank_keeps_unscored(spark):
    pool = spark.createDataFrame([(1, c, p) for p, c in enumerate((5, 6, 7, 8), 1)], "query_id long, chunk_id long, pos int")
    scores = spark.createDataFrame([(1, 7, 0.9), (1, 6, 0.9)], "query_id long, chunk_id long, rerank_score double")
    assert [r.chunk_id for r in retrieval.rerank(pool, scores).orderBy("pos").collect()] == [6, 7, 5, 8]
    assert [r.chunk_id for r in retrieval.rerank(pool, None).orderBy("pos").collect()] == [5, 6, 7, 8]


def test_order_by_intent(spark):
    chunks = spark.createDataFrame([(1, "reference", 1), (2, "paragraph", 1), (3, "metadata", 2), (4, "paragraph", 3)], "chunk_id long, node_type string, document_id long")
    queries = {1: "how does it work", 2: "which author published it", 3: "papers by the same authors", 4: "which papers mention it"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    pool = spark.createDataFrame([(i, c, c) for i in queries for c in (1, 2, 3, 4)], "query_id long, chunk_id long, pos int")
    got = defaultdict(list)
    for r in retrieval.by_intent(pool, chunks, q).orderBy("query_id", "pos").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == {1: [2, 4, 1, 3], 2: [1, 2, 3, 4], 3: [3, 1, 2, 4], 4: [2, 4, 3, 1]}


def test_hydrate_dedupe_budget(spark):
    chunks = spark.createDataFrame([(1, "a  b", 1, 0), (2, "a b", 1, 0), (3, "", 2, 0), (4, "", 2, 0)], "chunk_id long, content string, document_id long, parent_index int")
    pool = spark.createDataFrame([(1, c, p) for p, c in enumerate((1, 2, 99, 3, 4, 5), 1)], "query_id long, chunk_id long, pos int")
    rows, missing = retrieval.hydrate(pool, chunks, 5)
    assert (missing.first().asked, missing.first().missing) == (5, 1)
    kept = retrieval.dedupe(rows)
    assert [(r.chunk_id, r.rank) for r in kept.orderBy("rank").collect()] == [(1, 1), (3, 2), (4, 3)]
    text = retrieval.context(kept.withColumn("label", F.lit("L")), 14).first()
    assert (text.n_blocks, text.context) == (1, "[1] L\na  b")
    assert {r.chunk_id: r.sibling_ids for r in retrieval.siblings(kept, chunks).collect()} == {1: [2], 3: [4], 4: [3]}
    assert [(r.chunk_id, r.rank) for r in retrieval.merge_rounds(spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, chunk_id long, rank int"), spark.createDataFrame([(1, 6, 1), (1, 7, 2), (1, 8, 3)], "query_id long, chunk_id long, rank int"), 2).orderBy("rank").collect()] == [(5, 1), (6, 2), (7, 3), (8, 4)]


def test_whole_line(spark):
    chunks = spark.createDataFrame([(1, "granular balls are fast", 1, "paragraph", ""), (2, "other words here", 2, "paragraph", ""), (3, "granular balls", 3, "reference", "")], "chunk_id long, content string, document_id long, node_type string, section_path string")
    q = spark.createDataFrame([(1, "granular balls", "balls fast"), (2, "  ", None), (3, "unknown", None)], "query_id long, text string, translated string")
    got = retrieval.retrieve(chunks, q, scorer=lambda pool: retrieval.overlap_scores(pool, chunks, q))
    assert [(r.query_id, r.chunk_id) for r in got.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 3)]
    with pytest.raises(ValueError):
        retrieval.search(chunks, q, use_sparse=False)
    pick = {r.query_id: r.rerank_text for r in retrieval.rerank_query(got.select("query_id", "chunk_id"), chunks, q).collect()}
    assert pick[1] == "balls fast" and pick[3] == "unknown"


def test_containing(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xyz"), (3, None)], "id int, key string")
    wanted = spark.createDataFrame([(1, "abc"), (2, "cab"), (3, ""), (4, "abc"), (5, "yz")], "query_id long, phrase string")
    for size in (1 << 20, 20):
        monkeypatch.setattr(phrases, "BLOCK_CHARS", size)
        assert {(r.id, r.query_id) for r in phrases.containing(texts, wanted).collect()} == {(1, 1), (1, 2), (1, 4), (2, 5)}


# --- answers -----------------------------------------------------------------------------------


def test_verify(spark):
    a = spark.createDataFrame([(1, "yes [2] and [1] and [9][2]"), (2, "none"), (3, "[4]")], "query_id long, answer string")
    e = spark.createDataFrame([(1, 1, 11, "first text"), (1, 2, 12, "second text")], "query_id long, rank int, chunk_id long, content string")
    good, out = answers.verify(a, e)
    assert [(r.rank, r.chunk_id) for r in good.orderBy("place").collect()] == [(2, 12), (1, 11)]
    assert {r.query_id: (r.cited, r.invalid, r.verified) for r in out.collect()} == {1: (2, [9], True), 2: (0, [], False), 3: (0, [4], False)}
    x = {r.query_id: r.route for r in answers.extractive(a, e).collect()}
    assert x == {1: "generate", 2: "refuse", 3: "refuse"}


def test_routes(spark):
    rows = spark.createDataFrame([(True, "sufficient", 0), (True, "insufficient", 0), (True, "insufficient", 2), (True, None, 0), (False, None, 0), (False, None, 2)], "has boolean, verdict string, tries int")
    got = [r.r for r in rows.select(answers.grade_route(F.col("has"), F.col("verdict"), F.col("tries"), 2, True).alias("r")).collect()]
    assert got == ["generate", "rewrite", "refuse", "generate", "rewrite", "refuse"]


def test_metrics(spark):
    runs = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 6, 2), ("a", 2, 9, 4), ("b", 1, 6, 1)], "arm string, query_id long, chunk_id long, pos int")
    gold = spark.createDataFrame([(1, 6, 1), (2, 9, 1), (3, 7, 1)], "query_id long, chunk_id long, document_id long")
    got = {r.arm: r for r in evaluation.metrics(runs, gold, ("a", "b")).collect()}
    assert (got["a"].r_at_1, got["a"].r_at_3, got["a"].r_at_5, got["a"].mrr) == (0.0, 0.333333, 0.666667, 0.25)
    assert (got["b"].r_at_1, got["b"].mrr) == (0.333333, 0.333333)
    golden = spark.createDataFrame([(1, "single_hop"), (1, "single_hop"), (4, "single_hop"), (2, "unanswerable")], "query_id long, type string")
    g = spark.createDataFrame([(1, 100, 1), (2, 9, 5)], "query_id long, chunk_id long, gold_document_id long")
    bad = evaluation.golden_problems(golden, g, spark.createDataFrame([(9, 1)], "chunk_id long, document_id long"))
    assert {(r.query_id, r.problem) for r in bad.collect()} == {(1, "duplicate_id"), (1, "unknown_chunk"), (2, "wrong_document"), (4, "answerable_without_gold"), (2, "unanswerable_with_gold")}


# --- conversations and tasks ---------------------------------------------------------------------


def test_task_fold(spark):
    turns = ["推荐人工智能方向的课", "时间不冲突的呢", "我的成绩怎么样", "谢谢你的长长的回答" * 9]
    s = conversations.fold_turns(turns[:2])
    assert s["task_type"] == "course_selection" and s["turn_count"] == 2 and s["goal"] == turns[0] and s["constraints"] == ["direction:人工智能", "preference:课程时间", "requirement:无课表冲突"]
    assert conversations.fold_turns(turns[:3])["task_type"] == "grade_query" and conversations.fold_turns(turns)["task_type"] == "general"
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns[:2])] + [(1, 9, "assistant", "成绩")], "thread_id long, seq long, role string, text string")
    r = conversations.fold_tasks(df).first()
    assert conversations.fold_turns(["选课", "yes, that one"], [None, "Which term?"])["turn_count"] == 2
    assert conversations.fold_turns(["选课", "yes, that one"], [None, "Done."])["turn_count"] == 1
    assert conversations.fold_turns(["选课", "x" * 81], [None, "Which term?"])["turn_count"] == 1
    assert (r.task_type, r.turn_count, r.last_user_input) == ("course_selection", 2, turns[1])
    c = df.select(conversations.classify(F.col("text")).alias("c"), conversations.constraints(F.col("text")).alias("k")).collect()
    assert c[0].c == "course_selection" and c[1].k == ["preference:课程时间", "requirement:无课表冲突"]
    need = df.select(conversations.missing_tools(F.lit("course_selection"), F.array(F.lit("preference:课程时间")), F.array(F.lit("search_courses"))).alias("m")).first().m
    assert need == ["check_schedule_conflict", "query_schedule"]


def test_messages(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1, 8)] + [(1, 8, "system", "x"), (1, 9, "user", " ")], "thread_id long, seq long, role string, text string")
    assert [r.seq for r in conversations.last_messages(m, 3).orderBy("place").collect()] == [5, 6, 7]
    turns = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "q2", ""), (2, 1, "q3", "a3")], "thread_id long, nth int, question string, answer string")
    got = {(r.thread_id, r.seq): r.text for r in conversations.append_turns(m, turns).where("seq > 9 or thread_id = 2").collect()}
    assert got == {(1, 10): "q", (1, 11): "a", (2, 1): "q3", (2, 2): "a3"}


# --- records -----------------------------------------------------------------------------------


def test_conflicts(spark):
    kind = "course_id string, course_code string, name string, meeting_times array<struct<weekday:int,start_time:string,end_time:string,weeks:array<int>>>"
    courses = spark.createDataFrame([("oak", "O1", "Oaks", [(3, "13:15", "15:00", [2, 4, 6])]), ("elm", "E1", "Elms", [(5, "10:00", "11:00", [1])])], kind)
    taken = spark.createDataFrame([("fir", "F1", "Firs", [(3, "14:30", "16:00", [6, 7])])], kind).withColumnRenamed("name", "course_name").withColumn("student_id", F.lit("s"))
    asked = spark.createDataFrame([("s", c) for c in ("oak", "elm", "none")], "student_id string, course_id string")
    got = {r.course_id: r for r in records.conflicts(asked, courses, taken).collect()}
    assert {k: (r.found, r.has_conflict) for k, r in got.items()} == {"oak": (True, True), "elm": (True, False), "none": (False, None)}
    (c,) = got["oak"].conflicts
    assert c.with_course_code == "F1" and [(o.weekday, o.start_time, o.end_time, o.weeks) for o in c.overlaps] == [(3, "14:30", "15:00", [6])]


def test_records(spark):
    courses = spark.createDataFrame([("c1", "AI_1", "Intro", 2.0, "s", "x"), ("c2", "AI2", "Deep", 4.0, "s", "y")], "course_id string, course_code string, name string, credits double, term string, category string").withColumns({"department": F.lit("d"), "description": F.lit(None).cast("string"), "tenant_id": F.lit(1)})
    found = records.search_courses(courses, keyword="ai_", credit_max=3)
    assert [r.course_id for r in found.collect()] == ["c1"] and "tenant_id" not in found.columns
    for bad in ({"limit": 0}, {"limit": 51}, {"credit_min": 3, "credit_max": 2}):
        with pytest.raises(ValueError):
            records.search_courses(courses, **bad)
    with pytest.raises(ValueError, match="missing_student"):
        records.grades(courses, "")
    assert records.put(courses, courses.limit(1).withColumn("name", F.lit("New")), ["course_id"]).count() == 2


# --- jobs --------------------------------------------------------------------------------------

JOB = "job_id long, status string, attempt int, max_attempts int, priority int, idempotency_key string, payload string, last_error string, document_id long, locked_by string, locked_until timestamp, next_run_at timestamp, started_at timestamp"


def at(text):
    return F.to_timestamp(F.lit(text))


def test_claim_finish_reap(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "queued", 0, 3, 0, "a", "p", None, None, None, None, t, None), (2, "queued", 0, 3, 5, "b", "p", None, None, None, None, t, None), (3, "queued", 2, 3, 5, "c", "p", None, None, None, None, dt.datetime(2025, 1, 1), None), (4, "running", 1, 3, 0, "d", "p", None, 9, "w", dt.datetime(2024, 1, 1, 0, 1), t, t)]
    table = spark.createDataFrame(rows, JOB)
    leased, after = jobs.claim(table, at("2024-01-01 00:00:10"), "w1", n=2)
    assert [(r.job_id, r.attempt, r.locked_by) for r in leased.collect()] == [(2, 1, "w1"), (1, 1, "w1")]
    assert after.count() == 4 and jobs.claim(after, at("2024-01-01 00:00:10"), "w2")[0].count() == 0
    results = spark.createDataFrame([(1, "timeout", "late", None), (2, None, None, 5), (4, "ingestion_error", "bad", None)], "job_id long, error_code string, error string, document_id long")
    done = {r.job_id: r for r in jobs.finish(after, results, at("2024-01-01 00:00:20")).collect()}
    assert [done[i].status for i in (1, 2, 3, 4)] == ["queued", "succeeded", "queued", "failed"]
    assert done[1].next_run_at == dt.datetime(2024, 1, 1, 0, 0, 25) and done[2].document_id == 5 and done[4].document_id == 9 and done[2].locked_by is None
    assert {r.job_id: r.status for r in jobs.reap(table, at("2024-01-01 00:02:00")).collect()}[4] == "queued"
    assert {r.job_id: r.status for r in jobs.reap(table, at("2024-01-01 00:00:30")).collect()}[4] == "running"
    new = spark.createDataFrame([("a", "n"), ("zz", "n")], "idempotency_key string, payload string")
    ended = spark.createDataFrame([(1, "succeeded", 1, 3, 0, "a", "p", None, 7, None, None, t, None)], JOB)
    live, gone = spark.createDataFrame([(7,)], "document_id long"), spark.createDataFrame([(8,)], "document_id long")
    assert {r.idempotency_key: r.status for r in jobs.enqueue(ended, new, live, at("2024-01-02 00:00:00")).collect()} == {"a": "succeeded", "zz": "queued"}
    assert {r.idempotency_key: (r.status, r.payload) for r in jobs.enqueue(ended, new, gone, at("2024-01-02 00:00:00")).collect()} == {"a": ("queued", "n"), "zz": ("queued", "n")}


def test_job_fold_and_stream(spark):
    from quarry.streaming.jobs import states_by_stream

    assert jobs.fold([("enqueue", 0), ("claim", 1), ("error", 2), ("claim", 3), ("claim", 8), ("success", 9)]) == ("succeeded", 2, 9)
    assert jobs.fold([("enqueue", 0)] + [x for i in range(3) for x in (("claim", 1000 * (i + 1)), ("error", 1000 * (i + 1) + 1))])[0] == "failed"
    assert jobs.fold([("enqueue", 0), ("claim", 1), ("lease_over", 500), ("lease_over", 902)]) == ("queued", 1, 902)
    rng = random.Random(4)
    rows = [(rng.randrange(12), i, rng.choice(("enqueue", "claim", "success", "error", "lease_over", "permanent_error")), float(i // 3 * 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, event string, seconds double")
    want = {j: jobs.fold((e, s) for _, _, e, s in sorted((r for r in rows if r[0] == j), key=lambda r: (r[3], r[1]))) for j in {r[0] for r in rows}}
    assert {r.job_id: (r.status, r.attempt, r.next_at) for r in jobs.fold_events(df).collect()} == want
    assert {r.job_id: (r.status, r.attempt, r.next_at) for r in states_by_stream(df).collect()} == want


# --- files -------------------------------------------------------------------------------------

MD = "# Guide\n\nintro *text*\nsecond line\n\n## Use\n\n- one\n- two\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quoted\n\n    indented\n"


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t><w:t>text</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_files(spark, tmp_path):
    given = {"a.md": MD.encode(), "b.txt": b"plain | text", "c.pdf": b"%PDF-1.7 x", "d.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "e.docx": docx(), "f.zip": b"PK\x03\x04 broken", "g.bin": b"\xff\xfe", "h.txt": b"\xff\xff", "i.docx": b"PK\x03\x04"}
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    sniffed = files.sniff(files.read_files(spark, str(tmp_path)))
    got = {r.name: r for r in files.parse(sniffed).collect()}
    assert {n: r.error for n, r in got.items()} == {"a.md": None, "b.txt": None, "c.pdf": "no_parser", "d.doc": "legacy_office", "e.docx": None, "f.zip": "unsupported", "g.bin": "unsupported", "h.txt": "unsupported", "i.docx": "unsupported"}
    a = [(n.type, n.text, n.section) for n in got["a.md"].nodes]
    assert a == [("title", "Guide", "Guide"), ("paragraph", "intro text\nsecond line", "Guide"), ("title", "Use", "Guide > Use"), ("list", "- one\n- two", "Guide > Use"), ("code", "x = 1", "Guide > Use"), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", "Guide > Use"), ("paragraph", "quoted", "Guide > Use"), ("code", "indented", "Guide > Use")]
    assert got["a.md"].title == "Guide" and got["a.md"].nodes[5].cells == [["a", "b"], ["1", "2"]]
    assert [(n.type, n.text) for n in got["e.docx"].nodes] == [("title", "Head"), ("paragraph", "Body text"), ("list", "item"), ("table", "| a | b |\n| --- | --- |")]
    docs = files.parse(sniffed).where("nodes is not null").select(F.monotonically_increasing_id().alias("document_id"), "nodes")
    assert chunking.chunk_nodes(docs).count() > 4


def test_landing(tmp_path):
    assert files.land_upload(str(tmp_path), "../x y.pdf", iter([b"a", b"b"]), 5).endswith("x_y.pdf")
    with pytest.raises(ValueError):
        files.land_upload(str(tmp_path), "big", iter([b"abc"] * 3), 5)
    assert not (tmp_path / "big").exists()
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), "../../etc")


# --- plans -------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    text = plan(entry.queries()["history_last_n"](spark, sf))
    assert "WindowGroupLimit" in text and "PushedFilters" in text
    assert "TakeOrderedAndProject" in plan(entry.queries()["job_claim_order"](spark, sf))
    top = plan(index.active(spark.createDataFrame([(1, True)], "tenant_id int, is_active boolean")))
    assert "Filter" in top
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_task_state_fold_reads_whole_messages(spark, tmp_path):
    from quarry.plans import state_queries

    said = "x" * 30 + " 那门课程的完整的问题"
    spark.createDataFrame([(1, 0, "user", said), (2, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.thread_id: r.last_user_input for r in state_queries.task_state_fold(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: sha(f"{state_queries.QUESTIONS[1]} {said}"), 2: sha(f"{state_queries.QUESTIONS[2]} ")}


# --- index in tables ---------------------------------------------------------------------------


def test_lexical_index_follows_its_documents(spark, tmp_path):
    from quarry.operators.postings import LexicalIndex

    def chunks(*rows):
        return spark.createDataFrame([(d * 10 + i, d, t) for d, i, t in rows], "chunk_id long, document_id long, content string")

    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma 向量"), (3, ""), (4, None), (5, "nowhere")], "query_id long, text string")
    made = LexicalIndex(spark, str(tmp_path / "index"), buckets=3, segment=2)
    assert made.search(asked).count() == 0 and made.stats() == (0, 1.0)
    first = [(1, 0, "alpha alpha beta"), (1, 1, "gamma delta"), (2, 0, "alpha 向量库"), (3, 0, None), (4, 0, "beta beta")]
    made.add(chunks(*first))
    now = {}
    for d, i, t in first:
        now.setdefault(d, []).append((d, i, t))

    def agree():
        table = chunks(*(r for rows in now.values() for r in rows))
        want = sorted(map(tuple, index.bm25(table, asked).collect()))
        assert sorted(map(tuple, made.search(asked).collect())) == want and want
        assert made.stats()[0] == table.count() and {r.chunk_id for r in made.directory().collect()} == {r.chunk_id for r in table.collect()}

    agree()
    made.add(chunks((1, 0, "alpha gamma")))  # in fewer chunks than before
    now[1] = [(1, 0, "alpha gamma")]
    agree()
    made.add(chunks((1, 0, "alpha gamma")))  # again is the same
    agree()
    made.remove(spark.createDataFrame([(2,), (99,)], "document_id long"))
    del now[2]
    agree()
    terms = made.term_stats(spark.createDataFrame([("alpha",), ("beta",), ("no",)], "term string")).collect()
    assert {r.term: (r.df, r.cf) for r in terms} == {"alpha": (1, 1), "beta": (1, 2)}
    made.remove(spark.createDataFrame([(d,) for d in now], "document_id long"))
    assert made.search(asked).count() == 0 and made.stats() == (0, 1.0)


def test_replacing_a_document_leaves_no_old_chunk(spark):
    schema = "chunk_id long, document_id long, tenant_id int"
    old = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 1), (1, 1, 2)], schema)
    now = index.replace_documents(old, spark.createDataFrame([(1, 1, 1)], schema))
    assert sorted(map(tuple, now.collect())) == [(1, 1, 1), (1, 1, 2), (3, 2, 1)]


def test_a_failing_channel_leaves_the_others(spark):
    table = spark.createDataFrame([(1, 1, "alpha beta", "paragraph"), (2, 2, "beta gamma", "paragraph")], "chunk_id long, document_id long, content string, node_type string")
    asked = spark.createDataFrame([(7, "beta gamma")], "query_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0])], "chunk_id long, dense array<double>")

    def broken(*_):
        raise ConnectionError("no such host")

    failures = {}
    got = retrieval.search(table, asked, vectors=vectors, query_vectors=vectors, lexical=None, scorer=broken, failures=failures)  # query vectors without ids
    assert [r.chunk_id for r in got.orderBy("pos").collect()] == [2, 1] and set(failures) == {"dense", "rerank"} and "no such host" in failures["rerank"]
    with pytest.raises(ConnectionError):
        retrieval.search(table, asked, lexical=broken)
