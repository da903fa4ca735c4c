"""Sinks: one Markdown file for each document, and the history."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def save_markdown(df: DataFrame, folder: str, stem: str = "stem", markdown: str = "markdown") -> None:
    """Writes folder/<stem>.md for each row, on the executors, into a folder they share. A file appears whole or not at
    all, an older one is replaced; of several rows with one stem the greatest text stays, whatever the partitions are."""
    one = df.groupBy(F.col(stem).alias("stem")).agg(F.max(markdown).alias("markdown"))

    def write(rows: Iterable[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(r.markdown or "")
            os.replace(temporary, os.path.join(folder, f"{os.path.basename(r.stem)}.md"))

    one.where("stem IS NOT NULL").foreachPartition(write)


def save_history(df: DataFrame, path: str) -> None:
    df.select("name", F.col("output_path").alias("outputPath"), F.col("ts").alias("date"), "warning").write.mode("overwrite").json(path)
