"""The conversion queue and its history."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(history: DataFrame, keep: int = 8) -> DataFrame:
    """The latest entry of each path, of these the newest (ties: by path). A top-k report."""
    latest = (history.groupBy("output_path").agg(F.max(F.struct("ts", "name", "warning")).alias("m")).select("m.name", "output_path", "m.ts", "m.warning"))
    return latest.orderBy(F.desc("ts"), "output_path").limit(keep)


def unqueued(history: DataFrame, queue: DataFrame) -> DataFrame:
    """Paths of the history that no finished entry of the queue has."""
    return history.select("output_path").distinct().join(queue.select("output_path").distinct(), "output_path", "left_anti")


def path_parts(df: DataFrame, col: str) -> DataFrame:
    name = F.regexp_extract(col, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"\.([^./]+)$", 1)
    return df.select(col, name.alias("filename"), F.regexp_replace(name, r"\.[^./]+$", "").alias("stem"), F.lower(ext).alias("extension"), (F.lower(ext) == "pdf").alias("is_pdf"))


def retry_schedule(attempts: DataFrame) -> DataFrame:
    """(key, attempt, delay_s) of (key, attempt, code): 3 s times the attempt, 15 s from the first reply that says too many requests."""
    o = W.partitionBy("key").orderBy("attempt")
    limited = F.max((F.col("code") == 429).cast("int")).over(o) == 1
    return attempts.select("key", "attempt", (F.when(limited, 15).otherwise(3) * F.col("attempt")).cast("bigint").alias("delay_s"))


def flags(queue: DataFrame) -> DataFrame:
    """queue (path, state, pages, has_text, started_at, finished_at) with active, finished, busy, its pill of pages and kind
    of text, and its duration as m:ss, null unless both ends are known."""
    n = F.col("pages")
    count = F.concat(n.cast("string"), F.when(n == 1, F.lit(" page")).otherwise(F.lit(" pages")))
    kind = F.when(F.col("has_text"), F.lit(" · text layer")).when(~F.col("has_text"), F.lit(" · scanned")).otherwise(F.lit(""))
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return (queue.withColumn("active", F.col("state") == "converting").withColumn("finished", F.col("state").isin("done", "failed", "cancelled"))
                 .withColumn("busy", F.col("state").isin("converting", "waiting")).withColumn("pill", F.concat(count, kind))
                 .withColumn("duration", F.concat(F.expr("({0}) div 60".format("unix_timestamp(finished_at) - unix_timestamp(started_at)")).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))))


def next_waiting(queue: DataFrame, group: str) -> DataFrame:
    """(group, path): of each queue the entry that has waited longest, by arrival, unless one is active."""
    idle = queue.groupBy(group).agg(F.bool_or(F.col("state") == "converting").alias("busy"), F.min_by("path", F.when(F.col("state") == "waiting", F.struct("arrival", "path"))).alias("path"))
    return idle.where("NOT busy AND path IS NOT NULL").select(group, "path")


def new_entries(queue: DataFrame, added: DataFrame) -> DataFrame:
    """Paths to add, without those that wait or convert already; each once."""
    pending = queue.where(F.col("state").isin("waiting", "converting")).select("path")
    return added.select("path").distinct().join(pending, "path", "left_anti")


def by_day(history: DataFrame, today: str) -> DataFrame:
    """history with is_today, by the day of the session's time zone; the day is given, so that a result can be repeated."""
    return history.withColumn("is_today", F.to_date("ts") == F.lit(today).cast("date"))


def diagnostics(df: DataFrame, stage: str, payload, at: str = "ts") -> DataFrame:
    """(doc_id, file, stage, payload): what a stage has to report of a document, under a file name with its time."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return df.select("doc_id", F.concat(stamp, F.lit(f"-{stage}.txt")).alias("file"), F.lit(stage).alias("stage"), payload.cast("string").alias("payload"))
