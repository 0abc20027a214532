"""Lists, statistics, history and reports over assignments (see ``sources.assignments``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import half_up
from .scoring import percent


def tenant(school: str | None) -> Column:
    """Rows of the teacher's school and those without one; a teacher without a school sees all."""
    if not school:
        return F.lit(True)
    return (F.col("school") == school) | F.col("school").isNull() | (F.col("school") == "")


def filtered(rows: DataFrame, school: str | None = None, **equal: str | None) -> DataFrame:
    """Tenant filter and equality filters; blank filters are skipped."""
    given = [F.col(k) == v for k, v in equal.items() if v not in (None, "")]
    return rows.where(reduce(lambda a, b: a & b, given, tenant(school)))


def teacher_assignments(rows: DataFrame, school: str | None = None, **equal: str | None) -> DataFrame:
    """Newest first, ties by id."""
    return filtered(rows, school, **equal).orderBy(F.desc("submitted_at"), "id")


def lookup(rows: DataFrame, key: int, school: str | None = None) -> DataFrame:
    return filtered(rows, school).where(F.col("id") == key)


def batch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a batch of ids; unknown ids drop out, repeated ids count once."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def history_peers(rows: DataFrame, ids: DataFrame, most: int = 30, text: str | None = None) -> DataFrame:
    """Per subject and school of the batch: the newest scored rows outside it, of those with a text if a column is named."""
    scope = batch(rows, ids).select("subject", "school").distinct()
    kept = rows.where("status = 'scored'")
    kept = kept.where(F.col(text).isNotNull() & (F.col(text) != "")) if text else kept
    peers = kept.join(ids.select("id"), "id", "left_anti").join(scope, ["subject", "school"])
    order = Window.partitionBy("subject", "school").orderBy(F.desc("submitted_at"), "id")
    return peers.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def peers_of_batch(rows: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """What each submission of a batch is compared with: the batch's own rows of its subject and school and their history."""
    siblings = batch(rows, ids)
    return siblings.withColumn("origin", F.lit("sibling")).unionByName(history_peers(rows, ids, text=text).select(*siblings.columns, F.lit("history").alias("origin")))


def owned(rows: DataFrame, key: int, student: int) -> DataFrame:
    """A submission, if it is the student's own."""
    return rows.where((F.col("id") == key) & (F.col("student_id") == student))


def owned_by(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Of all (id, student) that ask for a submission the rows that are their own."""
    return rows.join(asked.select("id", F.col("student").alias("student_id")), ["id", "student_id"], "left_semi")


def of_student(rows: DataFrame, student: int) -> DataFrame:
    """A student's submissions, newest first."""
    return rows.where(F.col("student_id") == student).orderBy(F.desc("submitted_at"), "id")


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def public_users(users: DataFrame) -> DataFrame:
    """The fields of a user that others may see, e-mail in its normal form."""
    return users.select("id", "name", F.lower(F.trim("email")).alias("email"), "role", "school", "grade", "subject", "roll_number")


def assignment_view(rows: DataFrame) -> DataFrame:
    """The seventeen fields of a submission; flags and analysis are read from JSON, empty where they are missing or bad."""
    plain = ("id", "student_id", "student_name", "student_email", "student_grade", "student_school", "subject", "title", "notes", "status", "score", "grade_label")
    flags = flags_of("flags")
    analysis = F.coalesce(F.from_json("analysis", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(*plain, flags.alias("flags"), analysis.alias("analysis"), "feedback", "submitted_at", "scanned_at")


ROLES = ["student", "teacher"]


def invalid_users(users: DataFrame) -> DataFrame:
    """(id, error) of what a registration refuses, the first of its rules that a row breaks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    email = F.lower(F.trim("email"))
    error = F.lit(None).cast("string")
    rules = [*((blank(c), f"missing {c}") for c in ("name", "email", "password", "role")), (~F.col("role").isin(ROLES), "unknown role"), (F.length("password") < 6, "short password"), (~F.contains(email, F.lit("@")) | ~F.contains(email, F.lit(".")), "bad email")]
    for broken, name in reversed(rules):
        error = F.when(broken, name).otherwise(error)
    return users.select("id", error.alias("error")).where("error IS NOT NULL")


#: The header of the report file.
REPORT_COLUMNS = ["Rank", "Student Name", "Roll No", "Email", "Grade", "Subject", "Score", "Grade Label", "Originality%", "AI_Prob%", "Copy_Sim%", "HW_Consistency%", "OCR_Confidence%", "Flags", "Feedback", "Submitted At", "Scanned At"]


def full_report(rows: DataFrame) -> DataFrame:
    """The seventeen columns of the report over scored rows, ranked by score, ties by id; missing shares count as 0."""
    share = lambda c: F.concat(percent(F.coalesce(c, F.lit(0.0))), F.lit("%"))
    out = ["rank", "student_name", "roll_number", "email", "grade", "subject", "score", "grade_label", *(share(F.col(c)) for c in ("originality", "ai_probability", "copy_similarity", "hw_consistency", "ocr_confidence")), F.array_join("flags", "; "), "feedback", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss"), F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss")]
    return ranked(rows).select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(out, REPORT_COLUMNS, strict=True)])


def flags_of(stored: Column | str) -> Column:
    """Flags from JSON text, none where it is missing or bad."""
    return F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))


def dashboard_stats(rows: DataFrame, flagged: Column | None = None) -> DataFrame:
    """One row of counts and the average score, in one pass; a scored row counts as flagged if its ``flags`` are not empty."""
    flagged = F.size(flags_of("flags")) > 0 if flagged is None else flagged
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "submitted").alias("pending"), F.count_if(F.col("status") == "reviewing").alias("reviewing"), F.count_if(F.col("status") == "scored").alias("scored"),
        F.count_if((F.col("status") == "scored") & flagged).alias("flagged"), half_up(F.sum(F.round(F.col("score") * 10).cast("long")) / F.count("score") / 10.0, 2).alias("avg_score"),
    )


def score_histogram(rows: DataFrame) -> DataFrame:
    """Counts for the five bins, empty ones too."""
    bins = ["0-2", "3-4", "5-6", "7-8", "9-10"]
    s = F.col("score")
    at = F.when(s <= 2, 0).when(s <= 4, 1).when(s <= 6, 2).when(s <= 8, 3).otherwise(4)
    counts = rows.where(s.isNotNull()).groupBy(at.alias("n")).agg(F.count("*").alias("count"))
    names = rows.sparkSession.range(5).select(F.col("id").cast("int").alias("n"), F.array(*map(F.lit, bins))[F.col("id").cast("int")].alias("bin"))
    return names.join(counts, "n", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def ranked_report(rows: DataFrame, **equal: str | None) -> DataFrame:
    """Scored rows by score, ties by id, ranked from 1.

    Ranks add up without one task that holds all rows: scores have one digit, so counts of each score, a small table,
    give the first rank of each, and rows are numbered within a score and a range of ids.
    """
    return ranked(filtered(rows, **equal).where(F.col("status") == "scored")).select("rank", "id", "student_name", "grade", "subject", "score", "submitted_at")


def ranked(kept: DataFrame) -> DataFrame:
    """Adds ``rank`` by score, ties by id."""
    cells = kept.withColumn("cell", F.floor(F.col("id") / 65536))
    counts = cells.groupBy("score", "cell").agg(F.count("*").alias("n"))
    by_score = counts.groupBy("score").agg(F.sum("n").alias("n"))
    before = by_score.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("score", "above")
    start = counts.withColumn("left", F.coalesce(F.sum("n").over(Window.partitionBy("score").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("score", "cell", "left")
    own = F.row_number().over(Window.partitionBy("score", "cell").orderBy("id"))
    out = cells.withColumn("own", own).join(start, ["score", "cell"]).join(before, "score")
    return out.withColumn("rank", (F.col("own") + F.col("left") + F.col("above")).cast("long")).drop("own", "left", "above", "cell")


def student_stats(rows: DataFrame, latest: int = 5) -> DataFrame:
    """Per student: totals, average score with one digit, ids of the latest submissions."""
    order = Window.partitionBy("student_id").orderBy(F.desc("submitted_at"), "id")
    recent = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= latest).groupBy("student_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"].cast("string")).alias("ids"))
    totals = rows.groupBy("student_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "scored").alias("pending"), F.count_if(F.col("status") == "scored").alias("scored"), half_up(F.sum(F.round(F.col("score") * 10).cast("long")) / F.count("score") / 10.0, 1).alias("avg_score"))
    return totals.join(recent, "student_id").select("student_id", "total", "pending", "scored", "avg_score", F.array_join("ids", ",").alias("latest"))


def quality_checks(rows: DataFrame) -> DataFrame:
    """Violations of the table rules: repeated ids, unknown states, scores out of range or without a scored state."""
    repeated = rows.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.col("count").alias("n"))
    bad = rows.select(F.explode(F.array_compact(F.array(F.when(~F.coalesce(F.col("status").isin("submitted", "reviewing", "scored"), F.lit(False)), "unknown state"), F.when(~F.col("score").between(0, 10), "score out of range"), F.when((F.col("status") == "scored") != F.col("score").isNotNull(), "score and state differ")))).alias("rule")).select("rule", F.lit(1).cast("long").alias("n"))
    return repeated.unionAll(bad).groupBy("rule").agg(F.sum("n").alias("violations"))
