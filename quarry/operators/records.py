"""Read model of courses, grades, schedules and exams, with timetable conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

PRIVATE = ("tenant_id", "student_id")


def public(rows: DataFrame) -> DataFrame:
    """Without the columns that no answer shows."""
    return rows.drop(*PRIVATE)


def checked(limit: int = 10, credit_min: float | None = None, credit_max: float | None = None, student_id: str | None = "-") -> None:
    """ValueError with a code for arguments out of range, or a missing student."""
    if not 1 <= limit <= 50:
        raise ValueError("invalid_arguments: limit")
    if credit_min is not None and credit_max is not None and credit_min > credit_max:
        raise ValueError("invalid_arguments: credits")
    if not student_id:
        raise ValueError("missing_student")


def search_courses(
    courses: DataFrame, keyword: str | None = None, term: str | None = None, department: str | None = None, category: str | None = None,
    course_ids: list[str] | None = None, credit_min: float | None = None, credit_max: float | None = None, limit: int | None = 10,
) -> DataFrame:
    """Courses by all given criteria, in the order of (course_code, course_id). The keyword is plain text, in any case."""
    checked(limit if limit is not None else 1, credit_min, credit_max)
    out = courses
    for name, value in (("term", term), ("department", department), ("category", category)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if course_ids is not None:
        out = out.where(F.col("course_id").isin(course_ids))
    if credit_min is not None:
        out = out.where(F.col("credits") >= credit_min)
    if credit_max is not None:
        out = out.where(F.col("credits") <= credit_max)
    if keyword:
        found = F.lit(False)
        for c in ("course_code", "name", "category", "department", "description"):
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower()))
        out = out.where(found)
    out = public(out).orderBy("course_code", "course_id")
    return out if limit is None else out.limit(limit)


def grades(rows: DataFrame, student_id: str | int, term: str | None = None, status: str | None = None, course_code: str | None = None) -> DataFrame:
    checked(student_id=str(student_id))
    out = rows.where(F.col("student_id") == student_id)
    for name, value in (("term", term), ("status", status), ("course_code", course_code)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return public(out).orderBy("term", "course_code")


def schedule(rows: DataFrame, student_id: str | int, term: str | None = None) -> DataFrame:
    checked(student_id=str(student_id))
    out = rows.where(F.col("student_id") == student_id)
    return public(out if term is None else out.where(F.col("term") == term)).orderBy("course_code")


def exams(rows: DataFrame, student_id: str | int, after=None, term: str | None = None) -> DataFrame:  # noqa: ANN001
    """Exams from a time on, with ISO times."""
    checked(student_id=str(student_id))
    out = rows.where(F.col("student_id") == student_id)
    if after is not None:
        out = out.where(F.col("start_at") >= F.lit(after))
    if term is not None:
        out = out.where(F.col("term") == term)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return public(out).orderBy("start_at").withColumns({"start_at": iso("start_at"), "end_at": iso("end_at")})


def credit_sum(rows: DataFrame) -> DataFrame:
    """Passed credits by student."""
    return rows.groupBy("student_id").agg(F.sum(F.when(F.col("status") == "passed", F.col("credits")).otherwise(0.0)).alias("passed_credits"))


def overlaps(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Meetings of both sides that overlap: same keys ``on`` and weekday, common weeks or weeks unknown, times that cross.

    Both sides have ``on``, weekday, start and end (minutes) and weeks; columns of the left come with l_, of
    the right with r_. An equi-join on keys and weekday; the rest is its condition.
    """
    a = left.select(*on, "weekday", *(F.col(c).alias(f"l_{c}") for c in left.columns if c not in (*on, "weekday")))
    b = right.select(*on, "weekday", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in (*on, "weekday")))
    joined = a.join(b, [*on, "weekday"])
    unknown = (F.size(F.coalesce("l_weeks", F.array().cast("array<int>"))) == 0) | (F.size(F.coalesce("r_weeks", F.array().cast("array<int>"))) == 0)
    start, end = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    rows = joined.where((unknown | F.arrays_overlap("l_weeks", "r_weeks")) & (start < end))
    weeks = F.when(unknown, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_intersect("l_weeks", "r_weeks")))
    return rows.withColumns({"start": start, "end": end, "weeks": weeks})


def conflicts(requested: DataFrame, courses: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Conflicts of requested courses with a student's schedule.

    ``requested`` has student_id and course_id; ``courses`` course_id, course_code, name, meeting_times;
    ``scheduled`` student_id, course_id, course_code, course_name, meeting_times. Returns student_id,
    course_id, course_code, course_name, found, has_conflict (null if not found) and conflicts, an array of
    (with_course_id, with_course_code, with_course_name, overlaps), in the order of course codes.
    """
    meeting = lambda df: df.withColumn("m", F.explode("meeting_times")).withColumns({"weekday": F.col("m.weekday"), "start": X.minutes(F.col("m.start_time")), "end": X.minutes(F.col("m.end_time")), "weeks": F.col("m.weeks")}).drop("m", "meeting_times")
    asked = requested.join(courses.select("course_id", "course_code", "name", "meeting_times"), "course_id", "left")
    left = meeting(asked.select("student_id", "course_id", "meeting_times"))
    right = meeting(scheduled.select("student_id", F.col("course_id").alias("with_course_id"), F.col("course_code").alias("with_course_code"), F.col("course_name").alias("with_course_name"), "meeting_times"))
    crossed = overlaps(left, right, ["student_id"])
    one = F.struct("weekday", X.hhmm(F.col("start")).alias("start_time"), X.hhmm(F.col("end")).alias("end_time"), "weeks")
    pairs = crossed.groupBy("student_id", F.col("l_course_id").alias("course_id"), "r_with_course_code", "r_with_course_id", "r_with_course_name").agg(F.array_sort(F.collect_list(one)).alias("overlaps"))
    found = pairs.groupBy("student_id", "course_id").agg(F.array_sort(F.collect_list(F.struct(F.col("r_with_course_code").alias("with_course_code"), F.col("r_with_course_id").alias("with_course_id"), F.col("r_with_course_name").alias("with_course_name"), "overlaps"))).alias("conflicts"))
    out = asked.join(found, ["student_id", "course_id"], "left")
    is_found = F.col("course_code").isNotNull()
    return out.select("student_id", "course_id", "course_code", F.col("name").alias("course_name"), is_found.alias("found"), F.when(is_found, F.col("conflicts").isNotNull()).alias("has_conflict"), "conflicts")


def put(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with ``rows`` in place of those of the same natural key."""
    return table.join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(rows)
