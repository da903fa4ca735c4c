"""Clause numbers: what the pages show against what the sections hold. Ids are compared by document."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages as P

GATE = 5  # distinct ids a source must show before it is audited
RETRY = 24  # most missing ids worth another extraction


def source_ids(pages: DataFrame) -> DataFrame:
    return P.content_pages(pages).select("doc_id", F.explode(T.clause_ids(F.col("text"))).alias("id")).distinct()


def label_ids(sections: DataFrame, subs: DataFrame) -> DataFrame:
    label = sections.select("doc_id", "id").unionByName(subs.select("doc_id", "id")).distinct()
    return label.select("doc_id", F.explode(T.clause_ids(F.col("id"))).alias("id")).distinct()


def gated(source: DataFrame) -> DataFrame:
    return source.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= GATE).select("doc_id")


def _with_neighbour(ids: DataFrame, pool: DataFrame) -> DataFrame:
    """Ids of which a sibling or the parent is in the pool; neighbours are exploded into one equi-join."""
    near = ids.select("doc_id", "id", F.explode(T.neighbours(F.col("id"))).alias("near"))
    return near.join(pool.select("doc_id", F.col("id").alias("near")), ["doc_id", "near"], "left_semi").select("doc_id", "id").distinct()


def missing(source: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, id): ids of the source that no label has, with a neighbour in the source."""
    gone = source.join(gated(source), "doc_id", "left_semi").join(labels, ["doc_id", "id"], "left_anti")
    return _with_neighbour(gone, source)


def invented(source: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, id): labels that the source shows not even with spaces between the parts, with a neighbour among the labels."""
    extra = labels.join(gated(source), "doc_id", "left_semi").join(source, ["doc_id", "id"], "left_anti")
    ids = extra.groupBy("doc_id").agg(F.collect_list("id").alias("ids"))  # the text meets all ids of its document in one row
    rows = ids.join(whole_text(pages), "doc_id", "left")
    unseen = F.expr("filter(ids, i -> NOT coalesce(regexp_like(text, replace(i, '.', '\\\\s*\\\\.\\\\s*')), false))")
    return _with_neighbour(rows.select("doc_id", F.explode(unseen).alias("id")), labels)


def whole_text(pages: DataFrame) -> DataFrame:
    return P.content_pages(pages).groupBy("doc_id").agg(P.joined(F.collect_list(F.struct("pos", F.col("text").alias("s"))), "\n\n").alias("text"))


def by_major(miss: DataFrame, runs: int = 3) -> DataFrame:
    """(doc_id, major, n, ids): missing ids of one document grouped by their first number, in numeric order, the first runs."""
    m = miss.withColumn("c", T.comps(F.col("id"))).withColumn("major", F.col("c")[0])
    g = m.groupBy("doc_id", "major").agg(F.count("*").cast("bigint").alias("n"),
                                         F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "id"))), lambda x: x["id"]), ",").alias("ids"))
    return (g.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("major"))).where(F.col("rn") <= runs).drop("rn"))


def locations(miss: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, id, page_no): the first page outside the table of contents that shows the id, else the first that does."""
    shown = P.content_pages(pages).select("doc_id", "page_no", "pos", F.contains(F.lower("text"), F.lit(T.TOC)).alias("toc"),
                                          F.explode(T.clause_ids(F.col("text"))).alias("id"))
    return (shown.join(miss, ["doc_id", "id"], "left_semi").groupBy("doc_id", "id")
                 .agg(F.min_by("page_no", F.struct("toc", "pos")).alias("page_no")))


def retry_pages(miss: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, page_no): pages to look at again: those showing a missing id, each followed by its successor, outside
    tables of contents or, if none is, anywhere; the first in order of discovery."""
    p = P.content_pages(pages).withColumn("next_no", F.lead("page_no").over(W.partitionBy("doc_id").orderBy("pos")))
    p = p.withColumn("toc", F.contains(F.lower("text"), F.lit(T.TOC)))
    shown = p.select("doc_id", "pos", "page_no", "next_no", "toc", F.explode(T.clause_ids(F.col("text"))).alias("id"))
    hit = shown.join(miss, ["doc_id", "id"], "left_semi").select("doc_id", "pos", "page_no", "next_no", "toc").distinct()
    hit = hit.withColumn("all_toc", F.min(F.col("toc").cast("int")).over(W.partitionBy("doc_id")) == 1).where("all_toc OR NOT toc")
    out = hit.select("doc_id", "pos", F.posexplode(F.array("page_no", "next_no")).alias("k", "page_no")).where("page_no IS NOT NULL")
    first = out.groupBy("doc_id", "page_no").agg(F.min(F.struct("pos", "k")).alias("o"))
    return (first.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("o"))).where(F.col("rn") <= most).select("doc_id", "page_no"))


def _counted(n, one: str, more: str):
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(more))


def _listed(a, caps: int):
    """The first elements of an array of strings, and how many there are besides."""
    n = F.size(a)
    return F.concat(F.array_join(F.slice(a, 1, caps), ", "), F.when(n > caps, F.concat(F.lit(" and "), (n - caps).cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def warnings(miss: DataFrame, inv: DataFrame, bare: DataFrame | None = None, places: DataFrame | None = None, lost: DataFrame | None = None) -> DataFrame:
    """(doc_id, warning): what a reader should check: missing and invented numbers with their page of places (doc_id, id,
    page_no) if it is known, ten of each at most; sections of bare (doc_id, section) with numbers of their own making, eight;
    items of lost (doc_id, pos, line_no, token, page_no) without a place, six; and what to do."""

    def ids(df, what, one, more, tail):
        d = df.join(places, ["doc_id", "id"], "left") if places is not None else df.withColumn("page_no", F.lit(None).cast("int"))
        text = F.concat("id", F.when(F.col("page_no").isNotNull(), F.concat(F.lit(" (page "), F.col("page_no").cast("string"), F.lit(")"))).otherwise(F.lit("")))
        g = d.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(T.comps(F.col("id")).alias("c"), text.alias("s")))).alias("a")).withColumn("a", F.transform("a", lambda x: x["s"]))
        return g.select("doc_id", F.concat(_counted(F.size("a"), one, more), F.lit(" "), _listed(F.col("a"), 10), F.lit(tail)).alias(what))

    d = ids(miss, "missing", "Missing from the result: clause", "Missing from the result: clauses", ".")
    d = d.join(ids(inv, "invented", "Not printed in the source: clause", "Not printed in the source: clauses", "."), "doc_id", "full")
    parts = ["missing", "invented"]
    if bare is not None:
        g = bare.groupBy("doc_id").agg(F.array_sort(F.collect_set("section")).alias("a"))
        g = g.select("doc_id", F.concat(F.lit("Numbered without print: paragraphs of "), _counted(F.size("a"), "section ", "sections "), _listed(F.col("a"), 8), F.lit(".")).alias("bare"))
        d, parts = d.join(g, "doc_id", "full"), [*parts, "bare"]
    d = d.withColumn("advice", F.when(F.coalesce(*parts).isNotNull(), F.lit("Compare these places with the source or convert it again.")))
    parts.append("advice")
    if lost is not None:
        one = F.struct("pos", "line_no", F.concat(F.lit('"'), "token", F.lit('" (page '), F.col("page_no").cast("string"), F.lit(")")).alias("s"))
        g = lost.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("a"))
        g = g.select("doc_id", F.concat(_counted(F.size("a"), "List item ", "List items "), F.array_join(F.slice("a", 1, 6), ", "), F.lit(" could not be placed; compare with the source.")).alias("lost"))
        d, parts = d.join(g, "doc_id", "full"), [*parts, "lost"]
    return d.select("doc_id", F.concat_ws(" ", *parts).alias("warning"))


GAP = "[\\s\u00ad\\-.,;:()'\"„“/]*"  # fixed value: what may stand between a number and the letters of its text


def shows_number(number, content, source):
    """Whether the source prints a number right before the first 24 letters and figures of the content, so that it is the
    document's own; with fewer than four of them there is nothing to judge by, and it counts as printed."""
    key = F.substring(T.fold(F.coalesce(content, F.lit(""))), 1, 24)
    pattern = F.concat(F.lit("(?iu)(?<![0-9.,])"), number, F.lit("[.)]?" + GAP), T.gap_pattern(key, GAP))
    return (F.length(key) < 4) | F.coalesce(F.regexp_like(source, pattern), F.lit(False))


def bare_numbered(sections: DataFrame, subs: DataFrame, source: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, section): sections with a numbered id of two components or more in which a subsection has a bare
    number that the pages don't print before its text, though the source doesn't show the joined id, or the section has that
    id spelt out besides. The text of a document meets the few bare numbers of the document in one row."""
    sec = sections.select("doc_id", "sec_pos", T.norm_id(F.col("id")).alias("section")).where(r"section RLIKE '^[0-9]+(\\.[0-9]+)+$'").distinct()
    sub = subs.select("doc_id", "sec_pos", T.norm_id(F.col("id")).alias("sid"), "content")
    bare = sec.join(sub.where("sid RLIKE '^[0-9]{1,2}$'"), ["doc_id", "sec_pos"]).withColumn("full", F.concat_ws(".", "section", "sid"))
    bare = bare.join(gated(source), "doc_id", "left_semi")
    seen = source.select("doc_id", F.col("id").alias("full"), F.lit(True).alias("shown"))
    spelt = sub.select("doc_id", "sec_pos", F.col("sid").alias("full")).distinct().withColumn("spelt", F.lit(True))
    j = bare.join(seen, ["doc_id", "full"], "left").join(spelt, ["doc_id", "sec_pos", "full"], "left").where("shown IS NULL OR spelt")
    one = j.groupBy("doc_id").agg(F.collect_list(F.struct("sec_pos", "section", "sid", "content")).alias("a")).join(whole_text(pages), "doc_id")
    own = F.filter("a", lambda x: ~shows_number(x["sid"], x["content"], F.col("text")))
    return one.select("doc_id", F.explode(own).alias("x")).select("doc_id", "x.sec_pos", "x.section").distinct()
