"""Quality of an answer against its source."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages as P

LONG = r"[A-Za-zÄÖÜäöüß]{12,}"


def long_words(df: DataFrame, key: str, text: str) -> DataFrame:
    w = F.regexp_extract_all(T.dehyphenate(F.col(text)), F.lit(LONG), F.lit(0))
    return df.select(key, F.explode(w).alias("w")).select(key, F.lower("w").alias("word")).distinct()


def markdown_labels(md: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sec, heading, line_no, label, content): lines `**label.** content` under their `## heading`."""
    l = md.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    o = W.partitionBy(key).orderBy("line_no")
    l = l.withColumn("h", F.when(F.startswith("line", F.lit("## ")), T.trim(F.substring("line", 4, 1_000_000))))
    l = l.withColumn("sec", F.count("h").over(o)).withColumn("heading", F.last("h", ignorenulls=True).over(o))
    pattern = r"^\*\*([^*]+?)\.?\*\*\s+(.*)$"
    return (l.where(F.col("line").rlike(pattern))
             .select(key, "sec", "heading", "line_no", F.regexp_extract("line", pattern, 1).alias("label"), F.regexp_extract("line", pattern, 2).alias("content")))


def coverage(source: DataFrame, answer: DataFrame) -> DataFrame:
    """(doc_id, n_source, n_covered, coverage) of two relations (doc_id, id)."""
    s = source.groupBy("doc_id").agg(F.count("*").alias("n_source"))
    c = source.join(answer, ["doc_id", "id"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_covered"))
    d = s.join(c, "doc_id", "left").na.fill(0, ["n_covered"])
    return d.withColumn("coverage", F.round(100.0 * F.col("n_covered") / F.greatest(F.lit(1), F.col("n_source")), 6))


def duplicate_labels(subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, label, n): numeric labels that a section holds more than once."""
    label = subs.select("doc_id", "sec_pos", T.norm_id(F.col("id")).alias("label")).where(r"label RLIKE '^[0-9]+(\\.[0-9]+)*$'")
    return label.groupBy("doc_id", "sec_pos", "label").agg(F.count("*").alias("n")).where("n > 1")


def order_flips(subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, before, label): numeric labels smaller than the numeric label before with the same stem."""
    d = subs.select("doc_id", "sec_pos", "sub_pos", T.norm_id(F.col("id")).alias("label")).where(r"label RLIKE '^[0-9]+(\\.[0-9]+)*$'")
    d = d.withColumn("before", F.lag("label").over(W.partitionBy("doc_id", "sec_pos").orderBy("sub_pos")))
    stem = lambda c: F.regexp_replace(c, r"[0-9]+$", "")
    last = lambda c: F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("bigint")
    return d.where((stem(F.col("label")) == stem(F.col("before"))) & (last(F.col("label")) < last(F.col("before"))))


def source_text(pages: DataFrame) -> DataFrame:
    return P.content_pages(pages).groupBy("doc_id").agg(P.joined(F.collect_list(F.struct("pos", F.col("text").alias("s"))), "\n").alias("text"))
