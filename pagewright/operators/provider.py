"""Calls of an external text model behind an interface, on the executors.

A provider turns prompts into reply bodies; it is an object the executors can unpickle. Rows are spread over `width`
partitions, which bounds the calls in flight; order is kept by columns, not by arrival. A call is tried again after a
transient outcome, then with the fallback if there is one.
"""
from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import decode
from pagewright.operators import pages as P
from pagewright.session import written


class Provider(Protocol):
    def complete(self, system: str, prompt: str) -> tuple[str, str | None, int]:
        """(kind, content, code): kind is success, providerError, truncated or empty."""


@dataclass(frozen=True)
class Echo:
    """A provider that answers with the prompt, for tests; prompts that hold a word of `fails` fail so many times."""

    fails: tuple[tuple[str, int], ...] = ()

    def complete(self, system: str, prompt: str) -> tuple[str, str | None, int]:
        for word, code in self.fails:
            if word in prompt:
                return "providerError", None, code
        return ("success", prompt, 0) if prompt.strip() else ("empty", None, 0)


@dataclass(frozen=True)
class Printed:
    """A provider that reads the numbered lines of the prompt, for tests: their numbers and texts as anchors and as
    subsections. Prompts that hold a word of `broken` get an answer that can't be read."""

    broken: tuple[str, ...] = ()

    def complete(self, system: str, prompt: str) -> tuple[str, str | None, int]:
        if any(word in prompt for word in self.broken):
            return "success", "no object", 0
        rows = re.findall(r"(?m)^[ \t]*([0-9]{1,2}(?:\.[0-9]{1,2})+)\.?[ \t]+(\S.*(?:\n(?![ \t]*[0-9]{1,2}[. ]).*)*)", prompt)
        return "success", json.dumps({"anchors": [{"id": i, "start": t[:60]} for i, t in rows], "subsections": [{"id": i, "content": " ".join(t.split())} for i, t in rows],
                                      "sections": [{"id": "", "title": "", "subsections": [{"id": i, "content": " ".join(t.split())} for i, t in rows]}]}), 0


def delay(attempt: int, limited: bool) -> int:
    """Seconds to wait behind an attempt, from 1; longer once a reply said too many requests."""
    return (15 if limited else 3) * attempt


def worth(kind: Column, code: Column) -> Column:
    """worth_fallback() of columns."""
    return (kind == "empty") | ((kind == "providerError") & (code.isin(0, 429) | (code >= 500)))


def worth_fallback(kind: str, code: int) -> bool:
    return kind == "empty" or (kind == "providerError" and (code in (0, 429) or code >= 500))


OUT = "doc_id BIGINT, pos INT, kind STRING, content STRING, attempts INT"


def call(prompts: DataFrame, provider: Provider, system: str = "", attempts: int = 3, fallback: Provider | None = None, width: int = 4, wait=time.sleep,
         stop: Callable[[], bool] = lambda: False) -> DataFrame:
    """(doc_id, pos, kind, content, attempts) for each row of prompts (doc_id, pos, prompt). stop is asked before every call;
    once it says so, what is left comes out as cancelled, and what was answered stays."""

    def ask(who: Provider, prompt: str, tries: int) -> tuple[str, str | None, int, int]:
        limited = False
        for n in range(1, tries + 1):
            kind, content, code = who.complete(system, prompt)
            if not worth_fallback(kind, code) or n == tries:
                return kind, content, code, n
            limited = limited or code == 429
            wait(delay(n, limited))
        raise AssertionError

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                if stop():
                    rows.append((r.doc_id, r.pos, "cancelled", None, 0))
                    continue
                kind, content, code, n = ask(provider, r.prompt or "", attempts)
                if fallback is not None and worth_fallback(kind, code):
                    kind, content, _, more = ask(fallback, r.prompt or "", 2)
                    n += more
                rows.append((r.doc_id, r.pos, kind, content, n))
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "content", "attempts"])

    return prompts.select("doc_id", "pos", "prompt").repartition(width, "doc_id", "pos").mapInPandas(run, OUT)


def transcribe(pages: DataFrame, provider: Provider, **how) -> DataFrame:
    """(doc_id, markdown): pages without a text layer, one call each, joined in page order under a heading with the number;
    a page that was cut stays, marked."""
    asked = call(pages.select("doc_id", "pos", F.col("text").alias("prompt")), provider, **how)
    body = F.when(F.col("kind") == "truncated", F.concat(F.coalesce("content", F.lit("")), F.lit("\n\n*[…]*"))).otherwise(F.coalesce("content", F.lit("")))
    rows = asked.join(pages.select("doc_id", "pos", "page_no"), ["doc_id", "pos"]).select(
        "doc_id", F.struct("pos", F.concat(F.lit("## Seite "), F.col("page_no").cast("string"), F.lit("\n\n"), body).alias("s")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n\n---\n\n").alias("markdown"))


def answers(prompts: DataFrame, provider: Provider, **how) -> DataFrame:
    """(doc_id, pos, kind, content, answer, rung): the replies decoded; what can't be read is asked for once more, and is
    truncated if it still can't. Replies are written, as asking again gives others."""
    keep = ("doc_id", "pos", "kind", "content", "answer", "rung")
    first = written(decode.parse_ladder(call(prompts, provider, **how), "content").select(*keep))
    unread = (F.col("kind") == "success") & (F.col("rung") == 0)
    again = prompts.join(first.where(unread).select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")
    second = written(decode.parse_ladder(call(again, provider, **how), "content").select(*keep)).withColumn("kind", F.when(unread, "truncated").otherwise(F.col("kind")))
    return first.where(~unread).unionByName(second)


def extract(pages: DataFrame, provider: Provider, most: int = 160_000, **how) -> DataFrame:
    """As answers(), pos being the chunk: the pages of each document in chunks of at most `most` characters; a document of
    several pages of which a chunk was truncated is asked for anew in chunks of half the size or of half its own text."""
    part = ("doc_id", "pos", "kind", "content", "answer", "rung")
    size = P.content_pages(pages).groupBy("doc_id").agg(F.sum(F.length("text")).alias("total"), F.count("*").alias("n"))

    def prompts(of: DataFrame, limit: int) -> DataFrame:
        c = P.content_pages(of).join(P.chunks(of, limit), ["doc_id", "pos"])
        return c.groupBy("doc_id", F.col("chunk_no").alias("pos")).agg(P.joined(F.collect_list(F.struct("pos", F.col("text").alias("s"))), "\n\n").alias("prompt"))

    first = answers(prompts(pages, most), provider, **how)
    cut = first.where("kind = 'truncated'").select("doc_id").distinct().join(size.where("n > 1"), "doc_id").select("doc_id", F.least(F.lit(most // 2), F.expr("total div 2")).alias("half"))
    # documents of like size share a limit, so that the second pass is a few plans and not one for each document
    halves = [r.half for r in cut.select(F.expr("greatest(1, CAST(pow(2, floor(log2(greatest(half, 1)))) AS INT))").alias("half")).distinct().collect()]
    out = first.join(cut.select("doc_id"), "doc_id", "left_anti").select(*part)
    for limit in sorted(halves):
        mine = cut.where((F.col("half") >= limit) & (F.col("half") < 2 * limit)).select("doc_id")
        out = out.unionByName(answers(prompts(pages.join(mine, "doc_id", "left_semi"), limit), provider, **how).select(*part))
    return out


def anchors(pages: DataFrame, provider: Provider, **how) -> DataFrame:
    """(doc_id, pos, id, start): the numbers each page prints and the words behind them, in the order of the pages and of the
    reply. Asked of pages with clause numbers outside tables of contents, one call each; a failed page gives none."""
    p = P.content_pages(pages).where((F.size(T.clause_ids(F.col("text"))) > 0) & ~F.contains(F.lower("text"), F.lit(T.TOC)))
    got = decode.parse_ladder(call(p.select("doc_id", "pos", F.col("text").alias("prompt")), provider, attempts=2, **how), "content")
    one = got.select("doc_id", F.col("pos").alias("page"), F.posexplode("answer.anchors").alias("k", "a")).select("doc_id", "page", "k", "a.id", "a.start").where("id <> '' AND start <> ''")
    return one.select("doc_id", (F.col("page").cast("bigint") * 100_000 + F.col("k")).alias("pos"), "id", "start")


def runs(miss: DataFrame, pages: DataFrame, provider: Provider, most: int = 24, **how) -> DataFrame:
    """(doc_id, prefix, pos, id, content): for documents with 1 to `most` missing ids the clauses of the first numbers of
    these, three at most, read anew from the pages that show them."""
    from pagewright.operators import clauses

    few = miss.join(miss.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") <= most), "doc_id", "left_semi")
    first = clauses.by_major(few).select("doc_id", F.col("major").cast("string").alias("prefix"))
    near = clauses.retry_pages(few.select((F.concat_ws("/", "doc_id", F.split_part("id", F.lit("."), F.lit(1)))).alias("doc_id"), "id"),
                               P.content_pages(pages).join(first, "doc_id").select(F.concat_ws("/", "doc_id", "prefix").alias("doc_id"), "page_no", "pos", "text"))
    asked = near.select(F.split_part("doc_id", F.lit("/"), F.lit(1)).cast("bigint").alias("doc_id"), F.split_part("doc_id", F.lit("/"), F.lit(2)).alias("prefix"), "page_no")
    text = asked.join(P.content_pages(pages), ["doc_id", "page_no"]).groupBy("doc_id", F.col("prefix").cast("int").alias("pos")).agg(
        P.joined(F.collect_list(F.struct(F.col("pos").alias("p"), F.col("text").alias("s"))), "\n").alias("prompt"))
    got = decode.parse_ladder(call(text, provider, **how), "content")
    one = got.select("doc_id", F.col("pos").cast("string").alias("prefix"), F.posexplode("answer.subsections").alias("pos", "x"))
    return one.select("doc_id", "prefix", "pos", "x.id", "x.content")
