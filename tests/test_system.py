"""Layout, agent loop and the whole engine on small inputs."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.engine import BadRequest, Engine
from quarry.operators import agent, layout
from quarry.providers import ScriptedGenerator

LINE = "doc_id int, page int, line_no int, text string, top double, bottom double, x0 double, x1 double, size double, page_width double, page_height double"


def line(page, n, text, top, x0=50.0, x1=500.0, size=10.0):
    return (1, page, n, text, float(top), float(top) + size, float(x0), float(x1), float(size), 600.0, 800.0)


def test_furniture_and_paragraphs(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [line(page, 0, f"My Journal {page}", 20), line(page, 1, "1 Introduction" if page == 1 else "REFERENCES" if page == 3 else "plain", 110, size=14.0 if page != 2 else 10.0)]
        rows += [line(page, 2, "a long para-", 140), line(page, 3, "graph goes on", 152), line(page, 4, "another one", 200), line(page, 5, f"- {page} -", 780)]
    lines = spark.createDataFrame(rows, LINE)
    assert {r.key for r in layout.furniture(lines).collect()} == {"myjournal#", "#"}
    nodes = layout.paragraphs(layout.headings(layout.reading_order(layout.without_furniture(lines)))).orderBy("order").collect()
    assert [(n.type, n.text) for n in nodes] == [
        ("title", "1 Introduction"), ("paragraph", "a long paragraph goes on"), ("paragraph", "another one"),
        ("paragraph", "plain"), ("paragraph", "a long paragraph goes on"), ("paragraph", "another one"),
        ("title", "REFERENCES"), ("reference", "a long paragraph goes on"), ("reference", "another one"),
    ]


def test_two_columns(spark):
    rows = [line(1, i * 2, f"left {i}", 150 + 20 * i, 50, 280) for i in range(8)] + [line(1, i * 2 + 1, f"right {i}", 150 + 20 * i, 320, 550) for i in range(8)]
    got = [r.text for r in layout.reading_order(spark.createDataFrame(rows, LINE)).orderBy("pos").collect()]
    assert got == [f"left {i}" for i in range(8)] + [f"right {i}" for i in range(8)]
    rows.append(line(1, 99, "wide head", 225, 50, 550))
    got = [r.text for r in layout.reading_order(spark.createDataFrame(rows, LINE), recognised=True).orderBy("pos").collect()]
    assert got == [f"left {i}" for i in range(4)] + [f"right {i}" for i in range(4)] + ["wide head"] + [f"left {i}" for i in range(4, 8)] + [f"right {i}" for i in range(4, 8)]
    single = spark.createDataFrame([line(1, i, f"t{i}", 300 - 10 * i) for i in range(5)], LINE)
    assert [r.text for r in layout.reading_order(single).orderBy("pos").collect()] == ["t4", "t3", "t2", "t1", "t0"]
    few = [line(1, i, f"l{i}", 150 + 20 * i, 50, 280) for i in range(5)] + [line(1, 9 + i, f"r{i}", 150 + 20 * i, 320, 550) for i in range(5)]
    assert [r.text for r in layout.reading_order(spark.createDataFrame(few, LINE)).orderBy("pos").collect()] == [x for i in range(5) for x in (f"l{i}", f"r{i}")]
    apart = [line(1, i, f"l{i}", 150 + 60 * i, 50, 280) for i in range(5)] + [line(1, 9 + i, f"r{i}", 180 + 60 * i, 320, 550) for i in range(5)]
    assert [r.text for r in layout.reading_order(spark.createDataFrame(apart, LINE), recognised=True).orderBy("pos").collect()] == [x for i in range(5) for x in (f"l{i}", f"r{i}")]
    boxes = spark.createDataFrame([(1, 1, 0.0, 296.0, 600.0, 320.0)], "doc_id int, page int, x0 double, top double, x1 double, bottom double")
    assert layout.outside_tables(single, boxes).count() == 4


def test_recognition(spark):
    pages = spark.createDataFrame([("", 100.0, 0.0, False), ("", 100.0, 0.0, True), ("word " * 30, 100.0, 90.0, True), ("(cid:1)(cid:2)(cid:3)", 100.0, 0.0, False), ("word " * 9, 100.0, 60.0, True)], "text string, page_area double, image_area double, has_graphics boolean")
    assert [r.needs_ocr for r in layout.needs_recognition(pages).collect()] == [False, True, False, True, True]
    lines = spark.createDataFrame([(1, 1, "a", 0.9), (1, 1, "b", 0.8), (1, 1, " ", 0.1), (1, 2, "c", 0.2), (1, 2, "d", float("nan"))], "doc_id int, page int, text string, confidence double")
    got = {r.page: (r.accepted, r.rejected, r.mean_confidence, r.reason) for r in layout.recognition_stats(lines).collect()}
    assert got == {1: (2, 0, 0.85, None), 2: (0, 2, None, "ocr_low_confidence")}
    assert layout.refusal_reason(True, 5, 3, 1, 9, True) == "ocr_page_cap" and layout.refusal_reason(True, 1, 3, 1, 9, True) is None


# --- agent -------------------------------------------------------------------------------------


def tools(**changes):
    def search(arguments, context):
        if not 1 <= arguments.get("limit", 5) <= 50:
            raise ValueError("limit")
        return {"count": 1, "results": [{"chunk_id": 901, "content": "x"}, {"chunk_id": 902, "content": "y"}]}

    base = {
        "search_knowledge": agent.Tool("search_knowledge", "", search), "query_grades": agent.Tool("query_grades", "", lambda a, c: {"count": 2}, needs_student=True),
        "search_courses": agent.Tool("search_courses", "", lambda a, c: {"count": 0}), "slow": agent.Tool("slow", "", lambda a, c: time.sleep(1)), "broken": agent.Tool("broken", "", lambda a, c: 1 / 0),
    }
    return list((base | changes).values())


def call(name, **arguments):
    return {"tool_calls": [{"id": "1", "name": name, "arguments": arguments}]}


def test_direct_and_forced_lookup():
    assert agent.run(ScriptedGenerator([{"content": "hi"}]), tools(), ["hello"]).route == "direct"
    r = agent.run(ScriptedGenerator([{"content": "from memory"}, {"content": "see [2] and [2]"}]), tools(), ["学校的重修规定是什么"])
    assert (r.route, r.citations, r.task["task_type"], r.task["status"]) == ("generate", [{"chunk_id": 902, "rank": 2}], "knowledge_qa", "completed")
    assert agent.run(ScriptedGenerator([{"content": "x"}, {"content": "no number"}]), tools(), ["学校的重修规定是什么"]).route == "refuse"


def test_completion_and_errors():
    r = agent.run(ScriptedGenerator([{"content": "done"}, call("query_grades"), {"content": "60"}]), tools(), ["我的成绩怎么样"], context={"student_id": "S001"})
    assert r.route == "task" and [c["name"] for c in r.calls] == ["query_grades"] and r.iterations == 3 and r.task["completed_steps"] == ["query_grades#1"]
    r = agent.run(ScriptedGenerator([call("query_grades"), {"content": "which student?"}]), tools(), ["我的成绩怎么样"])
    assert r.errors == [{"tool": "query_grades", "error": "missing_student"}] and r.route == "error" and r.reason == "all_tools_failed"
    r = agent.run(ScriptedGenerator([call("search_knowledge", limit=0), call("search_knowledge", limit=10), {"content": "yes [1]"}]), tools(), ["hello"])
    assert [e["error"] for e in r.errors] == ["invalid_arguments"] and r.route == "generate"
    r = agent.run(ScriptedGenerator([call("nothing"), call("broken"), call("slow"), {"content": "x"}]), tools(), ["hello"], seconds=0.1)
    assert [e["error"] for e in r.errors] == ["unknown_tool", "internal_error", "timeout"]
    r = agent.run(ScriptedGenerator([call("search_courses")] * 9), tools(), ["推荐几门课"])
    assert (r.route, r.reason, r.iterations, len(r.calls)) == ("error", "max_iterations", 8, 8) and r.task["status"] == "failed"
    assert agent.run(ScriptedGenerator([]), tools(), ["hello"]).reason == "model_failed"
    assert agent.compact({"a": list(range(50)), "b": "x" * 900, "c": 1}) == {"a": list(range(20)), "b": "x" * 200, "c": 1}


# --- engine ------------------------------------------------------------------------------------


def test_engine(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "guide.md").write_text("# Guide\n\nGranular balls make classifiers fast.\n\n## Limits\n\nThe queue holds twenty jobs.\n")
    (source / "copy.md").write_text((source / "guide.md").read_text())
    (source / "scan.pdf").write_bytes(b"%PDF-1.7")
    (source / "other.bin").write_bytes(b"\xff\xfe")
    e = Engine(spark, str(tmp_path / "tables"))
    assert e.ready()["ready"] and e.health() == {"status": "ok"} and e.table("chunks").count() == 0
    got = {r.name.split(".")[1]: (r.status, r.progress) for r in e.ingest(str(source)).collect()}
    assert got == {"md": ("ready", 100), "pdf": ("needs_ocr", 100), "bin": ("failed", 100)}
    n = e.table("chunks").count()
    assert n == 2 and e.ingest(str(source), "*.md").count() == 0 and e.table("chunks").count() == n and e.reconcile().count() == 0
    q = spark.createDataFrame([(1, "how many jobs does the queue hold"), (2, "granular balls"), (3, " ")], "query_id long, text string")
    top = {r.query_id: r for r in e.retrieve(q).where("rank = 1").collect()}
    assert "twenty" in top[1].content and "Granular" in top[2].content and set(top) == {1, 2} and top[1].label == "Guide · Guide > Limits"
    a = e.ask("granular balls")
    assert a["route"] == "generate" and a["verified"] and a["citations"][0]["rank"] == 1
    with pytest.raises(BadRequest):
        e.ask("  ")
    with pytest.raises(BadRequest):
        e.retrieve(q, 51)
    assert e.reindex("green") == n and e.collection == "main"
    assert e.reindex("green", dry_run=False) == n and e.collection == "green"
    doc = e.documents().where("status = 'ready'").first().document_id
    one = e.document(doc)
    assert one["status"] == "ready" and e.by_hash(one["sha256"])["document_id"] == doc and e.document(-5) is None and e.by_hash("none") is None
    ids = [r.chunk_id for r in e.table("chunks").orderBy(F.desc("chunk_id")).collect()]
    assert [(r.chunk_id, r.ord) for r in e.chunks_in_order([ids[1], -9, ids[0]]).collect()] == [(ids[1], 0), (ids[0], 2)] and e.counts() == {"documents": 3, "chunks": n, "vectors": n}
    said = e.answer({1: "how many jobs does the queue hold", 2: "granular balls"})
    assert [(x.route, x.verified) for x in said] == [("generate", True)] * 2 and "twenty" in said[0].answer
    assert [t.name for t in e.tools()] == ["search_knowledge"] and agent.call_tool({t.name: t for t in e.tools()}, "search_knowledge", {"query": "granular balls"}, {})["data"]["count"] >= 1
    assert e.delete_document(doc) == n
    assert e.documents().where("status = 'ready'").count() == 0 and e.retrieve(q).count() == 0
    assert e.ingest(str(source), "*.md").count() == 1 and e.retrieve(q).where(F.col("query_id") == 1).count() > 0


# --- tools, answers in rounds, worker, providers ---------------------------------------------------


def academic(spark):
    from quarry.operators.tools import Records

    times = "array<struct<weekday:int,start_time:string,end_time:string,weeks:array<int>,location:string>>"
    c = spark.createDataFrame(
        [(1, "K1", "BIO-9", "Cell biology", 3.0, "t1", "core", "life", "", [(2, "10:00", "11:30", [1, 2, 3], "A")]), (1, "K2", "BIO-10", "Genetics", 4.0, "t1", "free", "life", "", [(4, "08:00", "09:00", [], "B")]), (2, "K3", "ART-1", "Drawing", 2.0, "t1", "free", "art", "", [])],
        f"tenant_id int, course_id string, course_code string, name string, credits double, term string, category string, department string, description string, meeting_times {times}",
    )
    g = spark.createDataFrame([(1, "u", "t1", "BIO-9", "passed", 3.0), (1, "v", "t1", "BIO-9", "failed", 3.0)], "tenant_id int, student_id string, term string, course_code string, status string, credits double")
    s = spark.createDataFrame([(1, "u", "X", "CHE-2", "Lab", "t1", [(2, "11:00", "12:00", [3, 4], "C")])], f"tenant_id int, student_id string, course_id string, course_code string, course_name string, term string, meeting_times {times}")
    e = spark.createDataFrame([(1, "u", "CHE-2", "t1")], "tenant_id int, student_id string, course_code string, term string").withColumns({"start_at": F.to_timestamp(F.lit("2030-01-02 09:00:00")), "end_at": F.to_timestamp(F.lit("2030-01-02 11:00:00"))})
    return Records(c, g, s, e)


def test_academic_tools(spark):
    from quarry.operators import tools as T

    made = {t.name: t for t in T.academic_tools(academic(spark))}
    u = {"tenant_id": 1, "student_id": "u"}
    call = lambda name, a, c=u: agent.call_tool(made, name, a, c)
    found = call("search_courses", {"keyword": "bio", "credit_min": 3, "limit": 5})
    assert found["success"] and [r["course_code"] for r in found["data"]["courses"]] == ["BIO-10", "BIO-9"] and found["data"]["count"] == 2
    assert call("search_courses", {"keyword": "drawing"})["data"]["count"] == 0  # another tenant's
    assert [r["status"] for r in call("query_grades", {})["data"]["grades"]] == ["passed"] and "tenant_id" not in call("query_grades", {})["data"]["grades"][0]
    assert call("query_schedule", {"term": "t1"})["data"]["count"] == 1 and call("query_schedule", {"term": "t9"})["data"]["count"] == 0
    assert call("query_exam", {"after": "2030-01-01"})["data"]["exams"][0]["start_at"] == "2030-01-02T09:00:00"
    clash = {r["course_id"]: r for r in call("check_schedule_conflict", {"course_ids": ["K1", "K2", "no"]})["data"]["results"]}
    assert clash["K1"]["has_conflict"] and clash["K1"]["conflicts"][0]["overlaps"][0]["weeks"] == [3] and clash["K2"]["has_conflict"] is False and clash["no"]["found"] is False
    for name, arguments in (("search_courses", {"limit": 0}), ("search_courses", {"colour": "red"}), ("query_grades", {"term": 3}), ("check_schedule_conflict", {}), ("check_schedule_conflict", {"course_ids": []})):
        assert call(name, arguments)["error"]["code"] == "invalid_arguments", name
    assert call("query_grades", {}, {"tenant_id": 1})["success"] is False
    assert T.schema_of("check_schedule_conflict")["required"] == ["course_ids"]


def test_knowledge_tool(spark):
    from quarry.operators import tools as T

    rows = spark.createDataFrame([(1, i, i * 10, 7, "Guide · Part 2 · p3", f"text {i}", 0.5) for i in (1, 2, 3)], "query_id long, rank int, chunk_id long, document_id long, label string, content string, score double")
    tool = {"search_knowledge": T.knowledge_tool(lambda q, k: rows, spark)}
    got = agent.call_tool(tool, "search_knowledge", {"query": " what ", "top_k": 2}, {})
    assert [(c["chunk_id"], c["title"]) for c in got["data"]["chunks"]] == [(10, "Guide"), (20, "Guide")] and got["data"]["count"] == 2
    assert agent.call_tool(tool, "search_knowledge", {"query": "x", "top_k": 99}, {})["error"]["code"] == "invalid_arguments"


def test_answers_in_rounds(spark):
    from quarry.operators import answering as A
    from quarry.providers import NoGenerator

    def retrieve(queries):
        known = {"red": [(1, 5, "red is a colour")], "blue": [(1, 6, "blue is a colour")], "grey": [(1, 7, "grey, perhaps")]}
        return spark.createDataFrame([(r.query_id, rank, chunk, text) for r in queries.collect() for rank, chunk, text in known.get(r.text.split()[-1], [])], "query_id long, rank int, chunk_id long, content string")

    plain = A.answer_all(spark, [A.State(1, "what is red", ""), A.State(2, "what is nothing", "")], retrieve, NoGenerator())
    assert [(s.route, s.verified, s.tries) for s in plain] == [("generate", True, 0), ("refuse", True, 1)] and plain[0].answer == "red is a colour [1]"
    said = lambda *texts: ScriptedGenerator([{"content": t} for t in texts])
    (s,) = A.answer_all(spark, [A.State(1, "the shade of grey", "")], retrieve, said('{"verdict": "insufficient"}', "tell me about blue", '{"verdict": "sufficient"}', "Blue [2], not [7]."))
    assert (s.route, s.tries, s.citations, s.invalid, s.verified) == ("generate", 1, [2], [7], False) and [c["chunk_id"] for c in s.chunks] == [7, 6]
    (s,) = A.answer_all(spark, [A.State(1, "the shade of grey", "")], retrieve, said('{"verdict": "insufficient"}', "the shade of grey"))  # no new wording
    assert s.route == "refuse" and s.verified
    (s,) = A.answer_all(spark, [A.State(1, "and that one", "", [{"role": "user", "content": "colours"}])], retrieve, said("what is red", "no json", "no json", "Red [1]."))
    assert s.query == "what is red" and s.answer == "Red [1]." and s.verified and any(t.startswith("grade failed") for t in s.trace)
    assert A.State.of(s.as_dict()) == s


def test_worker_runs_handlers(spark):
    import datetime as dt

    from quarry.operators import worker as W

    now = dt.datetime(2030, 1, 1)
    schema = "job_id long, idempotency_key string, job_type string, status string, attempt int, max_attempts int, priority int, payload string, document_id long, last_error string, locked_by string, locked_until timestamp, next_run_at timestamp, started_at timestamp"
    rows = [(i, f"k{i}", kind, "queued", 0, 3, 0, None, None, None, None, None, now - dt.timedelta(seconds=1), None) for i, kind in enumerate(["ingest", "odd", "breaks", "lost"], 1)]
    held = [spark.createDataFrame(rows, schema)]

    def write(df):
        held[0] = spark.createDataFrame(df.collect(), schema)

    def broken(job):
        raise OSError("later")

    def lost(job):
        raise W.Permanent("gone")

    made = W.Worker(spark, lambda: held[0], write, {"ingest": lambda job: 77, "breaks": broken, "lost": lost}, clock=lambda: now)
    assert made.run(drain=True) == 4
    got = {r.job_id: r for r in held[0].collect()}
    assert (got[1].status, got[1].document_id) == ("succeeded", 77) and (got[2].status, got[4].status) == ("failed", "failed") and "unknown_job_type" in got[2].last_error
    assert got[3].status == "queued" and got[3].next_run_at > now and "OSError" in got[3].last_error
    made.stop()
    assert made.run() == 0 and W.preflight({"repository": "memory", "index": "local"}) != [] and W.preflight({}) == []


def test_translator_counter_and_batches(spark):
    from quarry import providers as P

    model = ScriptedGenerator([{"content": '"vector  store"'}, {"content": "还是中文"}])
    t = P.ModelTranslator(model)
    q = spark.createDataFrame([(1, "向量库"), (2, "向量库"), (3, "plain"), (4, None)], "query_id long, text string")
    assert {r.query_id: r.translated for r in t.translate(q).collect()} == {1: "vector store", 2: "vector store", 3: None, 4: None}
    assert t.one("另一个") is None and t.one("另一个") is None and len(model.seen) == 2 and t.one("第三个") is None  # the script is over
    assert list(P.batches(range(5), 2)) == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        list(P.batches([], 0))
    import public_tokenizers

    exact = P.ExactTokens(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    assert [r.token_count for r in exact.column(df, "text").collect()] == [exact.count("hello world"), 0, 0] and exact.count("hello world") == 2
