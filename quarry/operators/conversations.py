"""Messages by thread, and the state of tasks folded over a thread's turns."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry._session import workers_see_package

# Patterns that decide the kind of a task, in order; constraints; follow-ups; forced look-ups.
TASKS = (
    ("graduation_progress", "距离毕业|毕业进度|还差.{0,8}学分|已修.{0,12}学分"),
    ("course_selection", "选课|找.{0,10}课程|推荐.{0,10}课|方向的课|那.{0,8}(?:课程|课)呢"),
    ("grade_query", "成绩|绩点|挂科|不及格"),
    ("schedule_query", "课表|上课时间|课程冲突|时间冲突"),
    ("exam_query", "考试|考场|座位号|期末时间"),
    ("knowledge_qa", "知识库|已上传|文档|论文|学校.{0,8}(?:规定|要求)|重修规定|毕业.{0,8}(?:要求|需要).{0,8}学分"),
)
CONSTRAINTS = (
    ("direction:人工智能", r"人工智能|\bai\b"),
    ("course_interest:机器学习", "机器学习|machine learning"),
    ("preference:课程时间", "时间"),
    ("term:下学期", "下学期"),
    ("requirement:无课表冲突", "不冲突|不会.*冲突|冲突.*不会"),
)
#: Characters of a follow-up, and of one after a question of the assistant, at most.
FOLLOW_MOST, WAITING_MOST = 40, 80
FOLLOW_UP = "那|呢|这个|课程|时间|机器学习|人工智能|学分"
EXPLICIT_CORPUS = "知识库|已上传|上传的.{0,8}(?:文档|资料|论文)|根据.{0,12}(?:文档|资料|论文)|(?:文档|论文|手册|规定)中"
SCHOOL, POLICY = "学校|本校|校规|教务|学籍|培养方案", "规定|要求|重修|补考|毕业|学分|选课|退课|考试|成绩|奖学金|处分|请假|宿舍"
REQUIRED = {
    "graduation_progress": ("query_grades", "search_knowledge"),
    "course_selection": ("search_courses",),
    "grade_query": ("query_grades",),
    "schedule_query": ("query_schedule",),
    "exam_query": ("query_exam",),
    "knowledge_qa": ("search_knowledge",),
}
TYPE_OF_TOOL = {"search_knowledge": "knowledge_qa", "query_grades": "grade_query", "query_schedule": "schedule_query", "query_exam": "exam_query", "search_courses": "course_selection", "check_schedule_conflict": "course_selection"}


def classify(question: Column) -> Column:
    """Kind of task by the first pattern that is found; general if none is."""
    q, out = F.lower(question), None
    for name, pattern in TASKS:
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return out.otherwise("general")


def constraints(question: Column) -> Column:
    """Constraints that a question states, in order."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.array_compact(F.array(*(F.when(q.rlike(f"(?s){pattern}"), name) for name, pattern in CONSTRAINTS)))


def requires_knowledge(question: Column) -> Column:
    """Whether the documents have to be searched whatever the model says."""
    q = F.lower(question)
    return q.rlike(EXPLICIT_CORPUS) | (q.rlike(SCHOOL) & q.rlike(POLICY)) | (F.contains(q, F.lit("毕业")) & F.contains(q, F.lit("学分")))


def missing_tools(task_type: Column, constraints_: Column, successful: Column) -> Column:
    """Tools that a task still needs."""
    out = F.array().cast("array<string>")
    for name, tools in REQUIRED.items():
        out = F.when(task_type == name, F.array(*map(F.lit, tools))).otherwise(out)
    timed = (task_type == "course_selection") & F.arrays_overlap(constraints_, F.array(F.lit("preference:课程时间"), F.lit("requirement:无课表冲突")))
    out = F.when(timed, F.array(*map(F.lit, ("check_schedule_conflict", "query_schedule", "search_courses")))).otherwise(out)
    return F.array_sort(F.array_except(out, successful))


def last_messages(messages: DataFrame, n: int, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last ``n`` messages with text of every thread, of these roles, in order of seq."""
    good = messages.where(F.col("role").isin(*roles) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    back = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("seq")))
    return good.withColumn("back", back).where(F.col("back") <= n).withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("seq"))).drop("back")


def append_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages with new turns (thread_id, nth, question, answer) as two messages each; turns without an answer are skipped."""
    base = messages.groupBy("thread_id").agg(F.max("seq").alias("last"))
    good = turns.where("coalesce(answer, '') <> ''").withColumn("n", F.row_number().over(Window.partitionBy("thread_id").orderBy("nth")))
    pair = F.inline(F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
    new = good.join(base, "thread_id", "left").select("thread_id", "last", "n", pair)
    new = new.select("thread_id", (F.coalesce("last", F.lit(0)) + (F.col("n") - 1) * 2 + F.col("k")).alias("seq"), "role", "text")
    return messages.select("thread_id", "seq", "role", "text").unionByName(new)


# --- task state ---------------------------------------------------------------------------------


def _classify(text: str) -> str:
    return next((name for name, p in TASKS if re.search(p, text)), "general")


def fold_turns(questions: Iterable[str], answers: Iterable[str | None] = ()) -> dict:
    """State of a task after the user's turns of one thread: a turn of the same kind, or a follow-up, goes on with it.

    ``answers`` says what the assistant said before each question (null: nothing). A short turn of no kind of
    its own is a follow-up if it has a word of one, or if the assistant's last words asked for something.
    """
    state: dict = {"task_type": "general", "goal": None, "constraints": [], "slots": {}, "turn_count": 0, "last_user_input": None}
    for q, before in itertools.zip_longest(questions, answers):
        text = (q or "").casefold()
        kind = _classify(text)
        short = text.strip()
        waiting = (before or "").rstrip().endswith(("?", "？"))
        follows = kind == "general" and (len(short) <= FOLLOW_MOST and re.search(FOLLOW_UP, short) or waiting and len(short) <= WAITING_MOST)
        if state["turn_count"] and (kind == state["task_type"] or follows):
            state["turn_count"] += 1
        else:
            state = {"task_type": kind, "goal": q, "constraints": [], "slots": {}, "turn_count": 1}
        state["last_user_input"] = q
        for name, pattern in CONSTRAINTS:
            if re.search(pattern, text, re.S):
                if name not in state["constraints"]:
                    state["constraints"].append(name)
                key, value = name.split(":", 1)
                state["slots"][key] = value
    return state


def fold_tasks(messages: DataFrame) -> DataFrame:
    """thread_id, task_type, goal, constraints, turn_count and last_user_input after each thread's user messages.

    What a turn is (its kind, its constraints, whether it follows) is decided row by row in the JVM, with the
    assistant's words before it; only those few values are folded in order, so a long thread is a group of
    short rows whose texts were left behind, but for its goal and its last question.
    """
    workers_see_package(messages.sparkSession)
    thread = Window.partitionBy("thread_id").orderBy("seq")
    said = F.last(F.when(F.col("role") == "assistant", F.coalesce("text", F.lit(""))), True).over(thread.rowsBetween(Window.unboundedPreceding, -1))
    asked = F.max(F.when(F.col("role") == "user", F.col("seq"))).over(thread.rowsBetween(Window.unboundedPreceding, -1))
    talk = messages.where("thread_id is not null and role in ('user', 'assistant')").withColumn("said_seq", F.max(F.when(F.col("role") == "assistant", F.col("seq"))).over(thread.rowsBetween(Window.unboundedPreceding, -1)))
    talk = talk.withColumn("before", F.when(F.coalesce(F.col("said_seq") > asked, F.lit(True)), said))
    text = F.coalesce("text", F.lit(""))
    short = F.trim(F.lower(text))
    waiting = F.coalesce(F.rtrim(F.col("before")).rlike("[?？]$"), F.lit(False))
    follows = ((F.char_length(short) <= FOLLOW_MOST) & short.rlike(FOLLOW_UP)) | (waiting & (F.char_length(short) <= WAITING_MOST))
    kind = classify(text)
    turns = talk.where("role = 'user'").select("thread_id", "seq", kind.alias("kind"), (follows & (kind == "general")).alias("follows"), constraints(text).alias("stated"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        now, goal, count, held = None, None, 0, []
        for kind, follows, stated, seq in zip(*(rows.sort_values("seq")[c] for c in ("kind", "follows", "stated", "seq")), strict=True):
            if now is not None and (kind == now or follows):
                count += 1
            else:
                now, goal, count, held = kind, seq, 1, []
            held += [x for x in stated if x not in held]
        return pd.DataFrame({"thread_id": rows["thread_id"].iloc[:1].to_numpy(), "task_type": [now], "goal_seq": [goal], "constraints": [held], "turn_count": [count], "last_seq": [rows["seq"].max()]})

    folded = turns.groupBy("thread_id").applyInPandas(fold, "thread_id long, task_type string, goal_seq long, constraints array<string>, turn_count int, last_seq long")
    texts = messages.where("role = 'user'").select("thread_id", "seq", "text")
    one = lambda seq, name: texts.select("thread_id", F.col("seq").alias(seq), F.col("text").alias(name))
    return folded.join(one("goal_seq", "goal"), ["thread_id", "goal_seq"]).join(one("last_seq", "last_user_input"), ["thread_id", "last_seq"]).select("thread_id", "task_type", "goal", "constraints", "turn_count", "last_user_input")


def type_after_tool(tool: Column, current: Column) -> Column:
    """Kind of task after a tool ran; composite tasks stay."""
    out = current
    for name, kind in TYPE_OF_TOOL.items():
        out = F.when(tool == name, kind).otherwise(out)
    return F.when(current.isin("graduation_progress", "course_selection"), current).otherwise(out)


def status_after(answer: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(F.rtrim(answer).rlike("[?？]$"), "waiting_input").otherwise("completed")


def latest_tasks(versions: DataFrame) -> DataFrame:
    """The newest state of every (tenant_id, thread_id)."""
    newest = Window.partitionBy("tenant_id", "thread_id").orderBy(F.desc("version"))
    return versions.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
