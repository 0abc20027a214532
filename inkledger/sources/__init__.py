"""Tables, files and sinks."""

from __future__ import annotations

import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as submissions: id, subject, school, cleaned text and its lower-case form."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("school"), F.coalesce(clean_text(F.col("text")), F.lit("")).alias("text")).withColumn("low", F.lower("text"))


#: Order states and the states of an assignment.
STATES = {"O": "submitted", "P": "reviewing", "F": "scored"}


def assignments(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Orders as assignments in their lifecycle, joined to their students (customers) and schools (nations).

    With ``status`` only those in that state, by a filter on the stored column that reaches the scan.
    """
    orders, customers, nations = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    if status is not None:
        orders = orders.where(F.col("o_orderstatus").isin([k for k, v in STATES.items() if v == status]))
    mapped = F.lit(None).cast("string")
    for code, name in STATES.items():
        mapped = F.when(F.col("o_orderstatus") == code, name).otherwise(mapped)
    score = F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") % 101) / F.lit(10.0))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), F.col("c_name").alias("student_name"), F.col("c_mktsegment").alias("subject"), F.col("o_orderpriority").alias("grade"), F.col("n_name").alias("school"),
        mapped.alias("status"), score.alias("score"), F.col("o_orderdate").alias("submitted_at"),
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder ``spark.checkpoint.dir``.

    Only a local session may leave it unset: its one machine then uses a temporary folder. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes what is no longer used. The shuffles that made the
    rows are freed at once: whoever reads the checkpoint needs none of them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    conf, freed = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(freed, None)
    conf.set(freed, "true")
    try:
        return df.select("*").checkpoint()  # a frame keeps the setting under which it was made
    finally:
        conf.unset(freed) if before is None else conf.set(freed, before)


def pdf_files(spark: SparkSession, path: str, most: int = 20 * 1024 * 1024) -> DataFrame:
    """Uploaded PDFs with their MD5, as binary rows; those over 20 MB are told by ``ingest_status`` and not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    plain = ("path", "modificationTime", "length")
    small = files.where(F.col("length") <= most).select(*plain, "content", F.md5("content").alias("md5"), F.lit("ok").alias("ingest_status"))
    large = files.where(F.col("length") > most).select(*plain, F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("md5"), F.lit("too large").alias("ingest_status"))
    return small.unionAll(large)


def fingerprints_json(rows: DataFrame, column: str) -> DataFrame:
    """Fingerprint vectors from JSON text; bad JSON gives null."""
    return rows.withColumn(column, F.from_json(column, "array<double>"))


def latest(events: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """Current state of rows kept as appended events: the newest of each key (updates and resubmissions append)."""
    order = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(t) for t in tie])
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: What a state event may carry; a reset clears all of it.
STATE = "status string, score double, grade_label string, flags string, analysis string, ocr_text string, feedback string, scanned_at timestamp, submitted_at timestamp"
TEXT_KEPT = 5000


def _event(rows: DataFrame, status: str, at: Column, **values: Column) -> DataFrame:
    cells = {n: values.get(n, F.lit(None)).cast(t) for n, t in (f.split() for f in STATE.split(", "))}
    return rows.select("id", at.cast("timestamp").alias("at"), *[(F.lit(status) if n == "status" else c).alias(n) for n, c in cells.items()])


def submitted(rows: DataFrame, at: Column) -> DataFrame:
    """First hand-in or resubmission: results are cleared, flags and analysis empty."""
    return _event(rows, "submitted", at, submitted_at=at, flags=F.lit("[]"), analysis=F.lit("{}"))


def reviewing(rows: DataFrame, at: Column) -> DataFrame:
    return _event(rows, "reviewing", at)


def scored(rows: DataFrame, at: Column) -> DataFrame:
    """Results of a scan (score, grade_label, feedback, text, flags, analysis as arrays or structs); 5,000 characters of the text are kept, none of a missing one."""
    text = F.coalesce(F.substring("text", 1, TEXT_KEPT), F.lit(""))
    return _event(rows, "scored", at, score=F.col("score"), grade_label=F.col("grade_label"), flags=F.to_json("flags"), analysis=F.to_json("analysis"), ocr_text=text, feedback=F.col("feedback"), scanned_at=at)


def current(events: DataFrame) -> DataFrame:
    """The state of each id after its events: the newest one, with the last hand-in time; equal times go by state."""
    stage = F.array_position(F.array(*map(F.lit, ("submitted", "reviewing", "scored"))), F.col("status"))
    newest = latest(events.withColumn("stage", stage), "id", "at", "stage").drop("stage", "submitted_at")
    hand_in = events.groupBy("id").agg(F.max("submitted_at").alias("submitted_at"))
    return newest.join(hand_in, "id")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows to append whose key is not taken yet (unique e-mail, unique id)."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def insert(incoming: DataFrame, path: str, key: str) -> None:
    """Append the rows of a Parquet table whose key is new to it; the folder may not exist yet."""
    spark = incoming.sparkSession
    try:
        fresh = new_rows(incoming, spark.read.schema(incoming.schema).parquet(path), key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = incoming.dropDuplicates([key])
    durable(fresh).write.mode("append").parquet(path)  # written once more, since a table can't be read and appended to at once


def write_fingerprints(rows: DataFrame, path: str, key: str = "id", vector: str = "fingerprint") -> None:
    """One JSON line for each submission that has a vector."""
    rows.where(F.col(vector).isNotNull()).select(key, vector).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A ranked report as CSV with a header; the ranks order the rows of its files."""
    report.sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame, *columns: str) -> Column:
    return F.to_json(F.struct(*(columns or rows.columns)))
