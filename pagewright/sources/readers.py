"""Readers of files: whole texts, PDF bytes, Markdown, history; and the stream of dropped files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "name STRING, outputPath STRING, date TIMESTAMP, warning STRING"
PDF_GLOB = "*.[pP][dD][fF]"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): each file a row."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"^.*/", "").alias("source"), F.col("value").alias("text"))


def pages_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pages of dumped texts: what stands behind each marker line, with its number; a text without markers is page 1."""
    parts = F.split(text, r"(?m)(?=^--- Seite [0-9]+ von [0-9]+ ---$)")
    p = df.select(F.col(key).alias("doc_id"), F.posexplode(parts).alias("pos", "part")).where(r"part RLIKE '\\S'")
    number = F.coalesce(F.regexp_extract("part", r"^--- Seite ([0-9]{1,9})", 1).try_cast("int"), F.lit(1))
    body = F.regexp_replace(F.regexp_replace("part", r"^--- Seite [0-9]+ von [0-9]+ ---\n?", ""), r"\n+\z", "")
    return p.select("doc_id", number.alias("page_no"), "pos", body.alias("text"))


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, n_pages, error, content) of PDF files: a file that isn't one, is encrypted or holds no page has an error,
    not an exception. n_pages is the number of page objects, null where they are packed into object streams."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", PDF_GLOB).option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    crypt = F.contains(F.decode("content", "ISO-8859-1"), F.lit("/Encrypt"))
    text = F.decode("content", "ISO-8859-1")
    packed = F.contains(text, F.lit("/ObjStm"))
    count = F.size(F.regexp_extract_all(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"), F.lit(0)))
    n = F.when((head == "%PDF-") & ~crypt & ~(packed & (count == 0)), count)
    error = F.when(F.col("length") == 0, "empty").when(head != "%PDF-", "unreadable").when(crypt, "locked").when(n == 0, "empty")
    return d.select("path", "length", n.alias("n_pages"), error.alias("error"), "content")


def dropped(spark: SparkSession, path: str, at_once: int = 1) -> DataFrame:
    """Stream of PDF files put into a folder."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    return (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PDF_GLOB).option("maxFilesPerTrigger", at_once).load(path))


def history(spark: SparkSession, path: str) -> DataFrame:
    """History entries from JSON lines or a list; missing fields are null."""
    d = spark.read.schema(HISTORY).option("multiLine", "true").json(path)
    return d.select("name", F.col("outputPath").alias("output_path"), F.col("date").alias("ts"), "warning")
