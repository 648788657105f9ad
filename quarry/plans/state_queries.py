"""Queries over conversations, tasks, records and jobs.

The tables of the data folder stand in for the real ones: conversations for messages, part for courses,
orders for grades and exams, lineitem for meetings, events for job events. The rules are the engine's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry._session import table
from quarry.functions import text as X
from quarry.operators import answers, conversations, jobs, records
from quarry.plans.registry import query


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", "text")


@query(r"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')
SELECT conv_id AS thread_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM m WHERE back <= 12""")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve messages of every thread."""
    return conversations.last_messages(messages(spark, sf_dir), 12).select("thread_id", "seq", "role", "place")


@query(r"""
WITH b AS (SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS thread_id, last + k AS seq, CASE k WHEN 1 THEN 'user' ELSE 'assistant' END AS role FROM b, (VALUES (1), (2)) t(k) UNION ALL SELECT conv_id, turn, role FROM conversations""")
def append_turn_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with one more turn in every thread."""
    m = messages(spark, sf_dir)
    turns = m.groupBy("thread_id").agg(F.lit(1).alias("nth")).withColumns({"question": F.lit("q"), "answer": F.lit("a")})
    return conversations.append_turns(m, turns).select("thread_id", "seq", "role")


@query(r"""
WITH t AS (SELECT conv_id, turn, text, regexp_matches(text, '[?？]|多少|是什么|什么是|为什么|如何|怎么|怎样|哪个|哪些|哪一|是否|能否|可以吗|吗|呢|分别|区别|差别') AS asks, len(regexp_extract_all(text, '\S*[\x{4E00}-\x{9FFF}]\S*')) AS n FROM conversations)
SELECT conv_id, turn, (NOT asks AND n >= 4) AS salad, length(CASE WHEN regexp_replace(text, '\s+', '', 'g') <> '' AND NOT (NOT asks AND n >= 4) AND length(text) <= 4 * 20 + 50 THEN text ELSE repeat('x', 20) END) AS kept FROM t""")
def keyword_salad_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of rewritten queries: every message as a rewriting of a question of 20 characters."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.keyword_salad(F.col("text")).alias("salad"), F.char_length(X.rewrite_guard(F.lit("x" * 20), F.col("text"))).alias("kept"))


@query(r"""
WITH h AS (SELECT conv_id, turn, text, substr(text, 1, 300) AS head, regexp_extract(substr(text, 1, 300), '(?s)^(.*[。！？!?；;\n])', 1) AS cut FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) <= 300 THEN text WHEN length(cut) - 1 >= 150 THEN cut ELSE head END AS clipped FROM h""")
def clip_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut at 300 characters, at a sentence's end where one is near."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clip(F.col("text"), 300).alias("clipped"))


@query("""
SELECT conv_id, turn, part, substr(text, part * 8 + 1, 8) AS delta FROM (SELECT conv_id, turn, text, unnest(range(0, ceil(length(text) / 8.0)::BIGINT)) AS part FROM conversations WHERE role = 'assistant')""")
def sse_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as events of eight characters."""
    return answers.slices(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "text").select("conv_id", "turn", "part", "delta")


#: questions that show every kind of task; fixed values of a test
QUESTIONS = ("我距离毕业还差多少学分", "推荐几门人工智能方向的课", "我的成绩怎么样", "下学期课表时间冲突吗", "考试在哪个考场", "学校的重修规定是什么", "hello AI", "选课要不冲突，机器学习", "那门课程呢", "machine learning papers")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages, each with one of the fixed questions in front, so that every kind occurs."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    given = F.array(*map(F.lit, QUESTIONS))
    return c.select("conv_id", "turn", F.concat(F.element_at(given, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTIONS))) + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))


ASKED = "q AS (SELECT conv_id, turn, (" + repr(list(QUESTIONS)) + f")[(conv_id + turn) % {len(QUESTIONS)} + 1] || ' ' || coalesce(text, '') AS q FROM conversations WHERE role = 'user')"
KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in conversations.TASKS) + " ELSE 'general' END"
#: DuckDB's word boundaries know ASCII letters alone
BORDERED = [(n, p.replace(r"\bai\b", r"(?:^|[^\p{L}\p{N}_])ai(?:$|[^\p{L}\p{N}_])")) for n, p in conversations.CONSTRAINTS]
STATED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(q), '(?s){p}') THEN '{n}' END" for n, p in BORDERED) + "], lambda x: x IS NOT NULL)"


@query(
    f"WITH {ASKED} SELECT conv_id, turn, {KIND} AS task_type, regexp_matches(q, '{conversations.EXPLICIT_CORPUS}') OR (regexp_matches(q, '{conversations.SCHOOL}') AND regexp_matches(q, '{conversations.POLICY}')) OR (contains(q, '毕业') AND contains(q, '学分')) AS needs_documents FROM q"
)
def task_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of task of questions, and whether documents have to be searched."""
    return questions(spark, sf_dir).select("conv_id", "turn", conversations.classify(F.col("q")).alias("task_type"), conversations.requires_knowledge(F.col("q")).alias("needs_documents"))


@query(f"WITH {ASKED} SELECT conv_id, turn, coalesce(list_aggregate({STATED}, 'string_agg', ','), '') AS constraints FROM q")
def constraint_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints that questions state."""
    return questions(spark, sf_dir).select("conv_id", "turn", F.array_join(conversations.constraints(F.col("q")), ",").alias("constraints"))


#: short follow-ups, which carry on what stands; every third question is one
FOLLOW = ("那门课程呢", "ok then", "yes, that one")


@query(f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN coalesce(text, '') || CASE WHEN turn % 4 = 1 THEN ' ?' ELSE '' END
    WHEN (conv_id + turn) % 3 = 0 THEN ({list(FOLLOW)})[turn % 3 + 1]
    ELSE ({list(QUESTIONS)})[(conv_id + turn) % {len(QUESTIONS)} + 1] || ' ' || coalesce(text, '') END AS q FROM conversations WHERE role IN ('user', 'assistant')),
before AS (SELECT *, lag(role) OVER w AS r0, lag(q) OVER w AS q0 FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {KIND} AS kind, {STATED} AS stated,
  {KIND} = 'general' AND ((length(trim(q)) <= {conversations.FOLLOW_MOST} AND regexp_matches(lower(q), '{conversations.FOLLOW_UP}')) OR (coalesce(r0 = 'assistant' AND regexp_matches(rtrim(q0), '[?？]$'), false) AND length(trim(q)) <= {conversations.WAITING_MOST})) AS follows
  FROM before WHERE role = 'user'),
f AS (
  SELECT conv_id, n, kind AS task_type, q AS goal, stated AS held, 1 AS turn_count, q AS last_q FROM t WHERE n = 1
  UNION ALL
  SELECT t.conv_id, t.n, CASE WHEN kind = task_type OR follows THEN task_type ELSE kind END, CASE WHEN kind = task_type OR follows THEN goal ELSE q END,
    CASE WHEN kind = task_type OR follows THEN list_concat(held, list_filter(stated, lambda x: NOT list_contains(held, x))) ELSE stated END,
    CASE WHEN kind = task_type OR follows THEN turn_count + 1 ELSE 1 END, q FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1)
SELECT conv_id AS thread_id, task_type, sha256(goal) AS goal, array_to_string(held, ',') AS constraints, turn_count, sha256(last_q) AS last_user_input
FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS top FROM f) WHERE n = top""")
def task_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every thread's task after its questions; the assistant asks back now and then."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    text, at = F.coalesce("text", F.lit("")), F.col("conv_id") + F.col("turn")
    said = F.when(F.col("role") == "assistant", F.concat(text, F.when(F.col("turn") % 4 == 1, " ?").otherwise("")))
    said = said.when(at % 3 == 0, of(FOLLOW, F.col("turn") % 3)).otherwise(F.concat(of(QUESTIONS, F.pmod(at, F.lit(len(QUESTIONS)))), F.lit(" "), text))
    out = conversations.fold_tasks(c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", said.alias("text")))
    return out.select("thread_id", "task_type", F.sha2("goal", 256).alias("goal"), F.array_join("constraints", ",").alias("constraints"), "turn_count", F.sha2("last_user_input", 256).alias("last_user_input"))


@query(r"""
WITH a AS (SELECT conv_id, turn, text || ' [2] [' || (turn % 9) || '] [2] [7]' AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, list_aggregate(list_transform(list_filter(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x, i: list_position(regexp_extract_all(answer, '\[(\d+)\]', 1), x) = i), lambda x: x), 'string_agg', ',') AS cited FROM a""")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers of answers (some put behind each message) in order of mention."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [2] ["), (F.col("turn") % 9).cast("string"), F.lit("] [2] [7]"))
    return a.select("conv_id", "turn", F.array_join(X.citations(answer), ",").alias("cited"))


CITED = r"""
a AS (SELECT conv_id * 1048576 + turn AS query_id, list_distinct([2, turn % 9, 7]) AS ns FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id * 1048576 + c.turn AS query_id, unnest(range(1, 5)) AS rank FROM conversations c WHERE role = 'assistant'),
n AS (SELECT query_id, unnest(ns) AS rank FROM a)
"""


def cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers with cited numbers, and four pieces of evidence for each: quarters of the message itself."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("query_id", F.col("conv_id") * 1048576 + F.col("turn"))
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [2] ["), (F.col("turn") % 9).cast("string"), F.lit("] [2] [7]"))
    part = F.ceil(F.char_length("text") / 4).cast("int")
    piece = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(i.alias("rank"), F.substr(F.col("text"), (i - 1) * part + 1, part).alias("content"))))
    evidence = c.select("query_id", piece.alias("p")).select("query_id", "p.rank", (F.col("query_id") * 10 + F.col("p.rank")).alias("chunk_id"), "p.content")
    return c.select("query_id", answer.alias("answer")), evidence


@query(f"""
WITH {CITED}
SELECT query_id, count(e.rank) AS cited, coalesce(string_agg(n.rank::VARCHAR, ',' ORDER BY n.rank) FILTER (e.rank IS NULL), '') AS invalid, count(e.rank) > 0 AS verified FROM n LEFT JOIN e USING (query_id, rank) GROUP BY query_id""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid citations of every answer."""
    _, out = answers.verify(*cited(spark, sf_dir), with_quotes=False)
    return out.select("query_id", "cited", F.array_join("invalid", ",").alias("invalid"), "verified")


@query(r"""
WITH b AS (SELECT item_id, text, regexp_replace(text, '\s', '', 'g') AS t FROM benchmark),
ans AS (SELECT item_id, CASE WHEN length(t) >= 2 THEN list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) ELSE [] END AS g FROM (SELECT item_id, substr(t, length(t) // 2, 40) AS t FROM b)),
pos AS (SELECT item_id, text, unnest(range(0, greatest(length(text) - 60, 0) + 1, 20)) AS p FROM b),
pie AS (SELECT item_id, p, substr(text, p + 1, 60) AS piece, regexp_replace(substr(text, p + 1, 60), '\s', '', 'g') AS c FROM pos),
gr AS (SELECT item_id, p, piece, CASE WHEN length(c) >= 2 THEN list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) ELSE [] END AS h FROM pie),
sc AS (SELECT item_id, piece, p, CASE WHEN len(h) > 0 THEN len(list_intersect(h, g)) / len(h) ELSE -1 END AS s FROM gr JOIN ans USING (item_id))
SELECT item_id, piece AS quote FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, p) AS n FROM sc) WHERE n = 1""")
def best_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote of every benchmark text that supports forty characters from its middle."""
    b = table(spark, sf_dir, "benchmark")
    t = F.regexp_replace("text", r"\s", "")
    answer = F.substr(t, F.floor(F.char_length(t) / 2).cast("int"), F.lit(40))
    return b.select("item_id", X.best_quote(answer, F.col("text")).alias("quote"))


# --- records ------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS course_id, p_name AS name, p_brand AS category FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') OR contains(lower(p_type), 'a')) AND p_retailprice BETWEEN 900 AND 1500 ORDER BY p_name, p_partkey LIMIT 50""")
def course_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses (parts) by keyword and credit range (price), the first fifty (a limit is the feature)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("course_code"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("department"), F.lit("").alias("description"), F.col("p_retailprice").cast("double").alias("credits"), F.lit("t").alias("term"))
    return records.search_courses(p, keyword="A", credit_min=900, credit_max=1500, limit=50).select("course_id", "name", "category")


@query("SELECT o_orderkey AS course_code, o_orderstatus AS status, o_totalprice AS score FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def grade_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades (orders) of one student (customer) by status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student_id"), F.lit(1).alias("tenant_id"), F.col("o_orderkey").alias("course_code"), F.lit("t").alias("term"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))
    return records.grades(o, 7, status="F").select("course_code", "status", "score")


@query("""
SELECT o_orderkey AS course_code, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start_at FROM orders WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def exam_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams (orders) of one student from a time on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student_id"), F.lit(1).alias("tenant_id"), F.col("o_orderkey").alias("course_code"), F.col("o_orderdate").cast("timestamp").alias("start_at"), F.col("o_orderdate").cast("timestamp").alias("end_at"))
    return records.exams(o, 7, after=F.to_timestamp(F.lit("1995-01-01 00:00:00"))).select("course_code", "start_at")


@query("SELECT o_custkey AS student_id, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS passed_credits FROM orders GROUP BY o_custkey")
def credit_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed credits (prices of finished orders) of every student; an addition to the read model."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student_id"), F.when(F.col("o_orderstatus") == "F", "passed").alias("status"), F.col("o_totalprice").cast("double").alias("credits"))
    return records.credit_sum(o).withColumn("passed_credits", F.round("passed_credits", 2))


MEETINGS = """
m AS (SELECT l_orderkey AS student_id, l_linenumber AS course_id, 1 + l_partkey % 5 AS weekday, 480 + (l_suppkey % 20) * 30 AS start_, 480 + (l_suppkey % 20) * 30 + 60 + (l_partkey % 3) * 30 AS end_, range(1 + l_partkey % 3, 9 + l_partkey % 3) AS weeks FROM lineitem)
"""


@query(f"""
WITH {MEETINGS}
SELECT a.student_id, a.course_id, b.course_id AS with_course_id, a.weekday, greatest(a.start_, b.start_) AS start_, least(a.end_, b.end_) AS end_, len(list_intersect(a.weeks, b.weeks)) AS n_weeks
FROM m a JOIN m b ON a.student_id = b.student_id AND a.weekday = b.weekday AND a.course_id < b.course_id WHERE len(list_intersect(a.weeks, b.weeks)) > 0 AND greatest(a.start_, b.start_) < least(a.end_, b.end_)""")
def schedule_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings (order lines) of the same student (order) that overlap."""
    k = F.col("l_partkey") % 3
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("student_id"), F.col("l_linenumber").alias("course_id"), (1 + F.col("l_partkey") % 5).alias("weekday"),
        (480 + (F.col("l_suppkey") % 20) * 30).alias("start"), (480 + (F.col("l_suppkey") % 20) * 30 + 60 + k * 30).alias("end"), F.transform(F.sequence(1 + k, 8 + k), lambda x: x.cast("int")).alias("weeks"),
    )
    rows = records.overlaps(m, m, ["student_id"]).where("l_course_id < r_course_id")
    return rows.select("student_id", F.col("l_course_id").alias("course_id"), F.col("r_course_id").alias("with_course_id"), "weekday", F.col("start").alias("start_"), F.col("end").alias("end_"), F.size("weeks").alias("n_weeks"))


@query("""
WITH m AS (SELECT p_partkey AS course_id, 1 + p_partkey % 5 AS wd, 480 + (p_partkey % 10) * 50 AS s, 570 + (p_partkey % 10) * 50 AS e, 1 + p_partkey % 4 AS w0, 8 + p_partkey % 4 AS w1 FROM part),
taken AS (SELECT DISTINCT o_custkey AS student_id, l_partkey AS with_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
asked AS (SELECT c_custkey AS student_id, unnest([(c_custkey * 7) % 150 + 1, 1000000000 + c_custkey]) AS course_id FROM customer),
x AS (SELECT student_id, a.course_id, with_id, (least(c.e, n.e) - greatest(c.s, n.s)) * (least(c.w1, n.w1) - greatest(c.w0, n.w0) + 1) AS minutes
  FROM asked a JOIN m c USING (course_id) JOIN taken USING (student_id) JOIN m n ON n.course_id = with_id AND n.wd = c.wd WHERE greatest(c.s, n.s) < least(c.e, n.e) AND greatest(c.w0, n.w0) <= least(c.w1, n.w1)),
g AS (SELECT student_id, course_id, count(*) AS n, sum(minutes) AS minutes FROM x GROUP BY ALL)
SELECT student_id, course_id, m.wd IS NOT NULL AS found, CASE WHEN m.wd IS NOT NULL THEN n IS NOT NULL END AS has_conflict, coalesce(n, 0) AS n_conflicts, coalesce(g.minutes, 0)::BIGINT AS minutes
FROM asked LEFT JOIN m USING (course_id) LEFT JOIN g USING (student_id, course_id)""")
def schedule_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of two requested courses (one of them unknown) with every student's timetable; parts, customers and what they ordered stand for them."""
    key = F.col("p_partkey")
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60), m % 60)
    meeting = F.array(F.struct((1 + key % 5).cast("int").alias("weekday"), clock(480 + (key % 10) * 50).alias("start_time"), clock(570 + (key % 10) * 50).alias("end_time"), F.sequence((1 + key % 4).cast("int"), (8 + key % 4).cast("int")).alias("weeks")))
    courses = table(spark, sf_dir, "part").select(key.alias("course_id"), F.col("p_name").alias("course_code"), F.col("p_name").alias("name"), meeting.alias("meeting_times"))
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("course_id")).distinct()
    taken = own.join(courses, "course_id").withColumnRenamed("name", "course_name")
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("student_id"), F.explode(F.array((c * 7) % 150 + 1, F.lit(1_000_000_000) + c)).alias("course_id"))
    out = records.conflicts(asked, courses, taken)
    crossed = F.flatten(F.transform(F.coalesce("conflicts", F.array().cast(out.schema["conflicts"].dataType)), lambda x: x["overlaps"]))
    minutes = F.aggregate(crossed, F.lit(0).cast("long"), lambda a, o: a + ((X.minutes(o["end_time"]) - X.minutes(o["start_time"])) * F.size(o["weeks"])).cast("long"))
    return out.select("student_id", "course_id", "found", "has_conflict", F.coalesce(F.size("conflicts"), F.lit(0)).alias("n_conflicts"), minutes.alias("minutes"))


@query("SELECT * FROM (VALUES (1, 'native', -1.0), (2, 'ocr', 0.9), (3, 'mixed', 0.9), (4, 'mixed', 0.7)) t(span_id, extraction_method, ocr_confidence)")
def span_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How spans of pages were read (small literal tables)."""
    spans = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 2, 2), (3, 1, 1, 2), (4, 1, 2, 4)], "span_id int, document_id int, page_start int, page_end int")
    pages = spark.createDataFrame([(1, 2, 0.9), (1, 4, 0.7)], "document_id int, page int, confidence double")
    return answers.span_provenance(spans, pages).fillna(-1.0, ["ocr_confidence"])


@query(r"""
SELECT p_partkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || replace(p_name, '|', '\|') || ' |' || chr(10) || '| ' || p_brand || ' |  |' AS table_, 3 AS n_rows FROM part""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables of parts as Markdown and back; the last row is short."""
    cells = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("p_partkey").cast("string"), F.col("p_name")), F.array(F.col("p_brand")))
    t = table(spark, sf_dir, "part").select("p_partkey", X.table_markdown(cells).alias("table_"))
    return t.withColumn("n_rows", F.size(X.markdown_cells(F.col("table_"))))


# --- jobs ---------------------------------------------------------------------------------------

NOW = "2024-06-15 00:00:00"
JOBS = """
j AS (SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'queued' END AS status, (user_id % 5)::INT AS priority, ts AS next_run_at, (event_id % 6)::INT AS attempt, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 900 SECOND END AS locked_until FROM events)
"""


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs made of events: state by the id, priority by the user, time of the event."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 4
    return e.select(
        F.col("event_id").alias("job_id"), F.when(m == 0, "running").when(m == 1, "failed").otherwise("queued").alias("status"), (F.col("user_id") % 5).cast("int").alias("priority"), F.col("ts").cast("timestamp").alias("next_run_at"),
        (F.col("event_id") % 6).cast("int").alias("attempt"), F.when(m == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 900 SECOND")).alias("locked_until"), F.when(m == 0, "w").alias("locked_by"), F.lit(None).cast("timestamp").alias("started_at"),
    )


MEDIAN = "(SELECT quantile_disc(ts, 0.5) FROM events)"


@query(f"WITH {JOBS}, d AS (SELECT job_id, priority FROM j WHERE status = 'queued' AND next_run_at <= TIMESTAMP '{NOW}' ORDER BY priority DESC, job_id LIMIT 4) SELECT job_id, priority FROM d")
def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next four jobs (a batch is the feature)."""
    leased, _ = jobs.claim(job_rows(spark, sf_dir), F.to_timestamp(F.lit(NOW)), "w1")
    return leased.select("job_id", "priority")


@query("SELECT event_id AS job_id, least(5 * power(2, greatest(event_id % 12 - 1, 0)), 300)::DOUBLE AS delay FROM events")
def job_retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays before retries."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), X.backoff_seconds(F.col("event_id") % 12).alias("delay"))


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' AND locked_until < TIMESTAMP '{NOW}' THEN 'queued' ELSE status END AS status FROM j")
def job_lease_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after leases that are over were taken back."""
    return jobs.reap(job_rows(spark, sf_dir), F.to_timestamp(F.lit(NOW))).select("job_id", "status")


EVENT_OF = ("enqueue", "claim", "success", "error", "lease_over", "permanent_error")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of job events: the user is the job."""
    e = table(spark, sf_dir, "events")
    what = F.element_at(F.array(*map(F.lit, EVENT_OF)), (F.pmod(F.xxhash64("event_id"), F.lit(len(EVENT_OF))) + 1).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), "event_id", what.alias("event"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("seconds"))


@query()
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every job after its events; tested against a plain fold."""
    return jobs.fold_events(job_events(spark, sf_dir))


@query()
def job_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream that reads the events and stops when it has all; equal to the batch fold."""
    from quarry.streaming.jobs import states_by_stream

    return states_by_stream(job_events(spark, sf_dir))
