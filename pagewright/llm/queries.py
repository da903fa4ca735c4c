"""Queries of the text problems, each over its whole tables with the operators' production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, language, leakage, lookalike, personal, scans, sentences, truncation
from pagewright.sources import table


def contents(spark: SparkSession, d: str) -> DataFrame:
    """Subsections without the rows that only repeat one."""
    return table(spark, d, "subsections").select("sub_id", "source", "content").distinct()


def _free_text(spark: SparkSession, d: str) -> DataFrame:
    parties = table(spark, d, "parties").select("party_id", "name", "details").distinct()
    subs = table(spark, d, "subsections").select("sub_id", "content").distinct()
    one = lambda df, field, key, col: df.select(F.lit(field).alias("field"), F.col(key).alias("row_id"), F.col(col).alias("text"))
    return (one(subs, "subsections.content", "sub_id", "content").unionByName(one(parties, "parties.name", "party_id", "name"))
            .unionByName(one(parties, "parties.details", "party_id", "details")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(_free_text(spark, d), personal.learn(table(spark, d, "parties"), "name")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders."""
    return personal.redacted(_free_text(spark, d), personal.learn(table(spark, d, "parties"), "name"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "subsections"), "sub_id", "content").select(F.col("id").alias("sub_id"), "kind")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The texts as running paragraphs."""
    return scans.repaired(table(spark, d, "subsections"), "sub_id", "content").select(F.col("id").alias("sub_id"), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.same_look_pairs(table(spark, d, "subsections"), "sub_id", "content")
    return pairs.select(F.col("id_a").alias("sub_id_a"), F.col("id_b").alias("sub_id_b"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many stored spellings each consistent form has, where there are several."""
    f = lookalike.forms(table(spark, d, "subsections"), "content")
    return (f.groupBy("canonical").agg(F.count("*").alias("n_spellings"), F.countDistinct("visible").alias("n_visible"))
             .where("n_spellings > 1"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The subsections of every form with several spellings; any number of copies are one row each."""
    return lookalike.classes(table(spark, d, "subsections"), "sub_id", "content").withColumnRenamed("id", "sub_id")


def _ended(spark: SparkSession, d: str) -> DataFrame:
    subs = table(spark, d, "subsections").select(F.lit("subsections.content").alias("field"), F.col("sub_id").alias("id"), "source",
                                                 F.col("content").alias("text"))
    answers = table(spark, d, "answer").select(F.lit("answer._markdown").alias("field"), F.col("answer_id").alias("id"), "source",
                                               F.col("_markdown").alias("text"))
    return subs.distinct().unionByName(answers)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_ended(spark, d)).where("cut").select("field", F.col("id").alias("row_id")).distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts."""
    t = truncation.truncated(_ended(spark, d)).groupBy("field", "source").agg(
        F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("int")).alias("n_cut"),
        F.sum((F.col("cut") & F.col("fixed_length")).cast("int")).alias("n_cut_at_fixed_length"))
    return t.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6))


def p4_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which sources cut."""
    return truncation.hazards(_ended(spark, d)).where("significant")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "sentence_sample").select("sub_id").distinct()
    rows = table(spark, d, "subsections").select("sub_id", "content").join(judged, "sub_id").distinct()
    return sentences.sentences(rows, "sub_id", "content").select(F.col("id").alias("sub_id"), "end_pos").distinct()


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every subsection."""
    rows = table(spark, d, "subsections").select("sub_id", "content").distinct()
    s = sentences.sentences(rows, "sub_id", "content")
    return s.select(F.col("id").alias("sub_id"), "pos", "sentence", "end_pos")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    folder = spark.conf.get("pagewright.tokenizers", bpe.DEFAULT_DIR)
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text", f"{folder}/byte_bpe_50k.json")


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items of each document with the length of the passage."""
    return leakage.found(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "evalitem"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages present in each document, with confidence."""
    docs = table(spark, d, "documents")
    return language.present(docs, "doc_id", "text", "lang", language.fit(docs, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_languages(spark, d).where("label IS NULL OR label <> lang").select("doc_id", "lang").distinct()


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every run of one language in each document, with its confidence and number of full sentences; none is left out."""
    docs = table(spark, d, "documents")
    return language.spans(docs, "doc_id", "text", language.fit(docs, "doc_id", "text", "lang"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_repaired, p3_found, p3_forms, p3_classes, p4_found, p4_rates, p4_lengths, p5_found, p5_sentences, p6_ids, p7_found, p7_passages, p8_found, p8_languages,
                                    p8_segments)}


def oracle_sql() -> dict[str, str]:
    return {}
