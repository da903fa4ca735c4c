"""Replies of text models: outcomes, and answers inside damaged JSON."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = r"^\s*```[a-zA-Z]*\s*|\s*```\s*$"
SUBSECTIONS = "ARRAY<STRUCT<id: STRING, content: STRING>>"
ANSWER = {"title": "STRING", "reference": "STRING", "date": "STRING", "notary": "STRING", "annotations": "ARRAY<STRING>",
          "parties": "ARRAY<STRUCT<name: STRING, role: STRING, details: STRING>>", "sections": f"ARRAY<STRUCT<id: STRING, title: STRING, subsections: {SUBSECTIONS}>>",
          "signatures": "ARRAY<STRUCT<name: STRING, role: STRING>>", "subsections": SUBSECTIONS, "anchors": "ARRAY<STRUCT<id: STRING, start: STRING>>"}


def chat_outcome(df: DataFrame, col: str) -> DataFrame:
    """df with kind (success, providerError, truncated, empty), content, code and transient, from a body with choices. An
    error counts before the reason of the end; one without a code, or with 0, 429 or 500 and more, is transient."""
    schema = ("error STRUCT<code: STRING, message: STRING>, choices ARRAY<STRUCT<error: STRUCT<code: STRING, message: STRING>, finish_reason: STRING, message: STRUCT<content: STRING>>>")
    d = df.withColumn("_b", F.from_json(col, schema)).withColumn("_c", F.get("_b.choices", F.lit(0)))
    err = F.coalesce("_b.error", "_c.error")
    code = F.coalesce(err["code"].try_cast("int"), F.lit(0))
    content = F.col("_c.message.content")
    empty = F.trim(F.coalesce(content, F.lit(""))) == ""
    kind = F.when(err.isNotNull(), "providerError").when(F.col("_c.finish_reason") == "error", "providerError").when(F.col("_c.finish_reason") == "length", "truncated").when(empty, "empty").otherwise("success")
    return (d.withColumn("kind", kind).withColumn("code", F.when(err.isNotNull(), code))
             .withColumn("transient", F.when(err.isNotNull(), (code == 0) | (code == 429) | (code >= 500)).otherwise(kind == "providerError"))
             .withColumn("content", F.when(kind.isin("success", "truncated"), content)).drop("_b", "_c"))


def candidate_outcome(df: DataFrame, col: str) -> DataFrame:
    """As chat_outcome, from a body with candidates; an end for another reason than STOP or the length isn't transient."""
    schema = "candidates ARRAY<STRUCT<finishReason: STRING, content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>"
    d = df.withColumn("_c", F.get(F.from_json(col, schema)["candidates"], F.lit(0)))
    text = F.array_join(F.transform("_c.content.parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    reason = F.coalesce("_c.finishReason", F.lit("STOP"))
    kind = F.when(reason == "MAX_TOKENS", "truncated").when(reason != "STOP", "providerError").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("success")
    return d.withColumn("kind", kind).withColumn("content", F.when(kind.isin("success", "truncated"), text)).withColumn("transient", F.lit(False)).drop("_c")


def parse_ladder(df: DataFrame, col: str) -> DataFrame:
    """df with answer (a STRUCT of what an answer, a run of clauses or a list of anchors may hold) and rung: the text as it
    is, without fences, with control characters in strings allowed, its outermost braces, these with control characters;
    rung 0 if none is an object, then raw holds the text. A field of another shape than expected is null, the rest stays."""
    x = F.trim(F.coalesce(F.col(col), F.lit("")))
    bare = F.trim(F.regexp_replace(x, FENCE, ""))
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    loose = {"allowUnquotedControlChars": "true"}
    rungs = [(x, {}), (bare, {}), (bare, loose), (braces, {}), (braces, loose)]
    schema = ", ".join(f"{k} {t}" for k, t in ANSWER.items())

    def whole(text, options):
        # asked with a field that no answer has, so that no field's shape has a say
        bad = F.from_json(text, "_none STRING, _corrupt STRING", {**options, "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()
        return text.rlike(r"(?s)^\{.*\}$") & ~bad

    # a rung is tried only where those above it failed, and the answer is read once
    rung = reduce(lambda w, r: w.when(whole(*r[1]), r[0]), enumerate(rungs[1:], 2), F.when(whole(*rungs[0]), 1)).otherwise(0)
    d = df.withColumn("rung", rung)
    text = F.when(F.col("rung") == 1, x).when(F.col("rung").isin(2, 3), bare).when(F.col("rung").isin(4, 5), braces)
    return d.withColumn("answer", F.from_json(text, schema, loose)).withColumn("raw", F.when(F.col("rung") == 0, F.col(col)))
