"""Tools that the agent may call: five over academic records, one over the documents.

A tool checks its arguments, runs one query of ``records`` or of the retrieval line, and gives its rows with
their number. What the user may not choose (tenant and student) comes from the context, never from arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import records
from quarry.operators.agent import Tool, ToolError

#: Arguments of each tool: name, kinds, and whether it has to be given. Fixed values of the call format.
ARGUMENTS: dict[str, dict[str, tuple[tuple[type, ...], bool]]] = {
    "search_courses": {"keyword": ((str,), False), "term": ((str,), False), "department": ((str,), False), "category": ((str,), False), "course_ids": ((list,), False), "credit_min": ((int, float), False), "credit_max": ((int, float), False), "limit": ((int,), False)},
    "query_grades": {"term": ((str,), False), "status": ((str,), False), "course_code": ((str,), False)},
    "query_schedule": {"term": ((str,), False)},
    "query_exam": {"term": ((str,), False), "after": ((str,), False)},
    "check_schedule_conflict": {"course_ids": ((list,), True), "term": ((str,), False)},
    "search_knowledge": {"query": ((str,), True), "top_k": ((int,), False)},
}
#: Rows that a tool's answer holds, at most (the feature's own limits are below it).
MOST_ROWS = 200


@dataclass
class Records:
    """The read model of one tenant: courses, grades, schedule and exams."""

    courses: DataFrame
    grades: DataFrame
    schedule: DataFrame
    exams: DataFrame


def validated(name: str, arguments: dict) -> dict:
    """The arguments without nulls; ToolError if one is unknown, missing or of another kind."""
    known = ARGUMENTS[name]
    given = {k: v for k, v in arguments.items() if v is not None}
    if unknown := sorted(set(given) - set(known)):
        raise ToolError("invalid_arguments", f"unknown: {', '.join(unknown)}", True)
    for k, (kinds, needed) in known.items():
        if k not in given:
            if needed:
                raise ToolError("invalid_arguments", f"{k} is missing", True)
        elif isinstance(given[k], bool) or not isinstance(given[k], kinds) or given[k] in ("", []):
            raise ToolError("invalid_arguments", f"{k} has to be {' or '.join(x.__name__ for x in kinds)}", True)
    return given


def schema_of(name: str) -> dict:
    """JSON schema of a tool's arguments, for a model."""
    kinds = {str: "string", int: "integer", float: "number", list: "array"}
    known = ARGUMENTS[name]
    return {"type": "object", "properties": {k: {"type": kinds[types[-1]]} for k, (types, _) in known.items()}, "required": [k for k, (_, needed) in known.items() if needed], "additionalProperties": False}


def _found(rows: DataFrame, name: str) -> dict:
    found = [r.asDict(recursive=True) for r in rows.limit(MOST_ROWS).collect()]
    return {name: found, "count": len(found)}


def _of_student(rows: DataFrame, context: dict) -> DataFrame:
    return rows.where(F.col("tenant_id") == context.get("tenant_id", 1)) if "tenant_id" in rows.columns else rows


def academic_tools(read: Records) -> list[Tool]:
    """The five tools over the records."""

    def run(name: str, query: Callable[[dict, dict], DataFrame], rows: str) -> Callable[[dict, dict], dict]:
        def call(arguments: dict, context: dict) -> dict:
            given = validated(name, arguments)
            try:
                return _found(query(given, context), rows)
            except ValueError as e:  # the records' own checks of ranges
                raise ToolError("invalid_arguments", str(e), True) from None

        return call

    student = lambda c: c["student_id"]
    queries: dict[str, tuple[str, Callable[[dict, dict], DataFrame], str, bool]] = {
        "search_courses": ("Courses by keyword, term, department, category, ids and credits, with their meeting times.", lambda a, c: records.search_courses(_of_student(read.courses, c), **a), "courses", False),
        "query_grades": ("The student's grades by term, status or course.", lambda a, c: records.grades(_of_student(read.grades, c), student(c), **a), "grades", True),
        "query_schedule": ("The student's timetable of a term.", lambda a, c: records.schedule(_of_student(read.schedule, c), student(c), **a), "schedule", True),
        "query_exam": ("The student's exams from a time on.", lambda a, c: records.exams(_of_student(read.exams, c), student(c), **a), "exams", True),
        "check_schedule_conflict": ("Whether courses clash with the student's timetable.", lambda a, c: _conflicts(read, a, c), "results", True),
    }
    return [Tool(name, text, run(name, query, rows), needs_student) for name, (text, query, rows, needs_student) in queries.items()]


def _conflicts(read: Records, arguments: dict, context: dict) -> DataFrame:
    spark = read.courses.sparkSession
    kind = read.courses.schema["course_id"].dataType
    asked = spark.createDataFrame([(str(x),) for x in dict.fromkeys(arguments["course_ids"])], "course_id string").withColumn("course_id", F.col("course_id").cast(kind))
    asked = asked.withColumn("student_id", F.lit(context["student_id"]).cast(read.schedule.schema["student_id"].dataType))
    own = _of_student(read.schedule, context).where(F.col("student_id") == context["student_id"])
    if "term" in arguments:
        own = own.where(F.col("term") == arguments["term"])
    return records.conflicts(asked, _of_student(read.courses, context), own).drop("student_id").orderBy("course_code", "course_id")


def knowledge_chunk(row: dict) -> dict:
    """A retrieved row as the agent's evidence. Its title is what stands in the label before the first ``·``."""
    label = row.get("label") or ""
    return {"chunk_id": row["chunk_id"], "document_id": row.get("document_id"), "title": label.split(" · ")[0], "source": label, "content": row.get("content") or "", "score": row.get("score")}


def knowledge_tool(retrieve: Callable[[DataFrame, int], DataFrame], spark, most: int = 50) -> Tool:  # noqa: ANN001
    """Evidence from the documents for one query; ``retrieve`` gives ranked rows for a table of queries."""

    def call(arguments: dict, context: dict) -> dict:
        given = validated("search_knowledge", arguments)
        query, top_k = given["query"].strip(), given.get("top_k", 5)
        if not 1 <= len(query) <= 2000 or not 1 <= top_k <= most:
            raise ToolError("invalid_arguments", f"a query has 1 to 2000 characters, top_k is 1 to {most}", True)
        rows = retrieve(spark.createDataFrame([(1, query)], "query_id long, text string"), top_k)
        chunks = [knowledge_chunk(r.asDict()) for r in rows.orderBy("rank").limit(top_k).collect()]
        return {"chunks": chunks, "count": len(chunks)}

    return Tool("search_knowledge", "Search the documents for evidence that can be cited.", call)
