"""Sections and subsections: numbering, folding, duplicates, items. Order is (sec_pos, sub_pos) within a document."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages as P

SECTION = ("doc_id", "sec_pos")
LETTER = r"^\p{Ll}$"
ENUMERATOR = r"^([a-z]{1,2}\.|\((?:[ivxlcdm]+|[a-z]{1,2}|[0-9]{1,2})\))(\s)"
CLAUSE_START = r"^[0-9]{1,2}(\.[0-9]{1,2})*\.?(\s|$)"


def _islands(subs: DataFrame, flag) -> DataFrame:
    """Running number of blocks: a break at a row with a number goes before the rows without one that lead to it."""
    o = W.partitionBy(*SECTION).orderBy("sub_pos")
    before, behind = o.rowsBetween(W.unboundedPreceding, -1), o.rowsBetween(0, W.unboundedFollowing)
    d = subs.select(*SECTION, "sub_pos", T.comps(F.col("id")).alias("c"))
    d = d.withColumn("p", F.last("c", ignorenulls=True).over(before))
    d = d.withColumn("f", F.when(F.col("c").isNotNull(), F.when(F.col("p").isNotNull() & flag(F.col("p"), F.col("c")), 1).otherwise(0)))
    d = d.withColumn("nf", F.first("f", ignorenulls=True).over(behind)).withColumn("lc", F.lag("c").over(o)).withColumn("i", F.row_number().over(o))
    d = d.withColumn("st", F.when((F.col("nf") == 1) & ((F.col("i") == 1) | F.col("lc").isNotNull()), 1).otherwise(0))
    return d.select(*SECTION, "sub_pos", F.sum("st").over(o).alias("block"))


def blocks(subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, block): a block ends where a numeric id isn't greater than the last one."""
    return _islands(subs, lambda p, c: ~(p < c))


def families(subs: DataFrame) -> DataFrame:
    """As blocks, where the first component changes."""
    return _islands(subs, lambda p, c: p[0] != c[0])


def contents_table(sections: DataFrame) -> DataFrame:
    """Sections that are tables of contents."""
    label = F.lower(F.concat_ws(" ", "id", "title"))
    return sections.where(F.contains(label, F.lit(T.TOC))).select(*SECTION).distinct()


def restarts(subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, n_ids): subsections at which numbering starts again at 1, the run up to the next start
    holding two or more strictly ascending ids. A run that doesn't vetoes its own start and all behind it."""
    o = W.partitionBy(*SECTION).orderBy("sub_pos")
    d = subs.select(*SECTION, "sub_pos", T.comps(F.col("id")).alias("c")).where("c IS NOT NULL")
    d = d.withColumn("p", F.lag("c").over(o)).withColumn("re", (F.col("p").isNotNull() & ~(F.col("p") < F.col("c")) & (F.col("c") == F.array(F.lit(1)))))
    d = d.withColumn("scope", F.sum(F.col("re").cast("int")).over(o))
    g = d.groupBy(*SECTION, "scope").agg(F.min("sub_pos").alias("sub_pos"), F.count("*").alias("n_ids"), F.bool_and(F.col("re") | (F.col("p") < F.col("c"))).alias("up"))
    clean = F.bool_and((F.col("scope") == 0) | (F.col("n_ids") >= 2) & F.col("up")).over(W.partitionBy(*SECTION).orderBy("scope"))
    return g.withColumn("clean", clean).where("scope > 0 AND clean").select(*SECTION, "sub_pos", "n_ids")


def demote_letters(sections: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, into): sections with one lower-case letter as id that are items of the section before, which has a
    lettered subsection itself or by an earlier fold. The sections of a document are folded in order; only positions and
    flags travel."""
    has = subs.groupBy(*SECTION).agg(F.bool_or(_letter()).alias("lettered"))
    d = sections.groupBy(*SECTION).agg(F.max("id").alias("id")).join(has, [*SECTION], "left")
    d = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_pos", _letter().alias("letter"), F.coalesce("lettered", F.lit(False)).alias("lettered")))).alias("s"))
    zero = F.expr("named_struct('head', CAST(NULL AS INT), 'lettered', false, 'out', CAST(array() AS ARRAY<STRUCT<sec_pos: INT, into: INT>>))")

    def step(a, x):
        folds = x["letter"] & a["head"].isNotNull() & a["lettered"]
        one = F.struct(x["sec_pos"].cast("int").alias("sec_pos"), a["head"].alias("into"))
        return F.struct(F.when(folds, a["head"]).otherwise(x["sec_pos"].cast("int")).alias("head"), (folds | x["lettered"]).alias("lettered"),
                        F.when(folds, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return d.select("doc_id", F.explode(F.aggregate("s", zero, step)["out"]).alias("o")).select("doc_id", "o.sec_pos", "o.into")


def _letter():
    return F.regexp_replace(F.trim(F.coalesce("id", F.lit(""))), r"\.+$", "").rlike(LETTER)


def demoted(sections: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, id, content): the subsections after demote_letters(): a folded section becomes a subsection
    with its letter, its title and the contents that have no id; those with an id follow."""
    fold = demote_letters(sections, subs)
    head = sections.groupBy(*SECTION).agg(F.max("id").alias("s_id"), F.max("title").alias("title"))
    s = subs.select(*SECTION, "sub_pos", "id", F.coalesce("content", F.lit("")).alias("content")).join(fold, [*SECTION], "left")
    bare = F.col("into").isNotNull() & (T.norm_id(F.col("id")) == "")
    kept = s.where(~bare).select("doc_id", F.coalesce("into", "sec_pos").alias("to"), "sec_pos", F.lit(1).alias("k"), "sub_pos", "id", "content")
    texts = s.where(bare & (F.col("content") != "")).groupBy(*SECTION).agg(P.joined(F.collect_list(F.struct("sub_pos", F.col("content").alias("s"))), "\n").alias("texts"))
    items_ = fold.join(head, [*SECTION]).join(texts, [*SECTION], "left").select(
        "doc_id", F.col("into").alias("to"), "sec_pos", F.lit(0).alias("k"), F.lit(-1).alias("sub_pos"), F.regexp_replace(F.trim("s_id"), r"\.+$", "").alias("id"),
        F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), "texts").alias("content"))
    o = W.partitionBy("doc_id", "to").orderBy("sec_pos", "k", "sub_pos", "id", "content")
    return kept.unionByName(items_).select("doc_id", F.col("to").alias("sec_pos"), (F.row_number().over(o) - 1).alias("sub_pos"), "id", "content")


def duplicated_items(subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos): enumerated subsections whose folded text, 12 characters or more, an earlier subsection of
    the section contains. Looked up in the joined text of the section, so no pairs of subsections are made."""
    d = subs.select(*SECTION, "sub_pos", F.coalesce("id", F.lit("")).alias("id"), T.fold(F.coalesce("content", F.lit(""))).alias("n"))
    o = W.partitionBy(*SECTION).orderBy("sub_pos").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum(F.length("n") + 1).over(o), F.lit(0)))
    whole = d.groupBy(*SECTION).agg(P.joined(F.collect_list(F.struct("sub_pos", F.col("n").alias("s"))), "|").alias("whole"))
    item = d.where(F.col("id").rlike(r"^\(|^[a-z]{1,2}$") & (F.length("n") >= 12))
    return item.join(whole, [*SECTION]).where(F.expr("instr(whole, n)") <= F.col("start")).select(*SECTION, "sub_pos")


def merge_scalars(parts: DataFrame, order: str, scalars: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """One row for each document: of each scalar the first that isn't blank, of each list all elements in order of the parts."""
    first = [F.get(F.transform(F.array_sort(F.collect_list(F.when(~T.blank(F.col(c)), F.struct(order, F.col(c).alias("s"))))), lambda x: x["s"]), F.lit(0)).alias(c) for c in scalars]
    all_of = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(c), F.array()).alias("s")))), lambda x: x["s"])).alias(c) for c in lists]
    return parts.groupBy("doc_id").agg(*first, *all_of)


def merge_sections(parts: DataFrame) -> DataFrame:
    """(doc_id, part, sec, out_section) of (doc_id, part, sec, id, title): a section goes on with the last one if it has the
    same non-empty id, or is the first of a later part without id and title."""
    o = W.partitionBy("doc_id").orderBy("part", "sec")
    i, t = F.trim(F.coalesce("id", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    d = parts.select("doc_id", "part", "sec", i.alias("id"), t.alias("t")).withColumn("rn", F.row_number().over(o))
    d = d.withColumn("hc", (F.col("part") > 0) & (F.col("sec") == 0) & (F.col("id") == "") & (F.col("t") == ""))
    d = d.withColumn("lid", F.last(F.when(~F.col("hc") | (F.col("rn") == 1), F.col("id")), ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("st", F.when((F.col("rn") == 1) | F.col("hc"), 0).when((F.col("id") != "") & (F.col("id") == F.col("lid")), 0).otherwise(1))
    return d.select("doc_id", "part", "sec", F.sum("st").over(o).alias("out_section"))


def merged_subsections(parts: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, out_section, id, title, sub_pos, sub_id, content): the sections of merge_sections() with the subsections of
    all their parts, subs (doc_id, part, sec, sub_pos, id, content), in order; id and title are those of the first part."""
    m = merge_sections(parts)
    first = m.join(parts, ["doc_id", "part", "sec"]).groupBy("doc_id", "out_section").agg(F.min(F.struct("part", "sec", "id", "title")).alias("f"))
    rows = m.join(subs, ["doc_id", "part", "sec"]).withColumn("k", F.row_number().over(W.partitionBy("doc_id", "out_section").orderBy("part", "sec", "sub_pos")) - 1)
    return (rows.select("doc_id", "out_section", F.col("k").alias("sub_pos"), F.col("id").alias("sub_id"), "content")
                .join(first.select("doc_id", "out_section", F.col("f.id").alias("id"), F.col("f.title").alias("title")), ["doc_id", "out_section"], "right"))


def items(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, page_no, line_no, token, id, text, key, anchor, anchor_id): enumerated items of the pages. An item opens at a line with an
    enumerator and eight characters behind it, holds the lines up to a clause start or the page's end; blank lines don't
    count. anchor is the fingerprint of the item before, anchor_id its id; items without a fingerprint go after serving as
    anchor. An id keeps its brackets."""
    l = P.lines(pages).where(~T.blank(F.col("line")))
    token = F.regexp_extract("line", ENUMERATOR, 1)
    tail = T.trim(F.substring("line", F.length(token) + F.lit(1), F.length("line")))
    l = l.withColumn("token", F.when((token != "") & (F.length(tail) >= 8), token)).withColumn("tail", tail)
    l = l.withColumn("event", (F.col("token").isNotNull() | T.trim(F.col("line")).rlike(CLAUSE_START)).cast("int"))
    l = l.withColumn("grp", F.sum("event").over(W.partitionBy("doc_id", "pos").orderBy("line_no")))
    part = F.when(F.col("token").isNotNull(), F.col("tail")).otherwise(F.col("line"))
    g = l.groupBy("doc_id", "pos", "page_no", "grp").agg(F.min("line_no").alias("line_no"), F.max("token").alias("token"),
                                              P.joined(F.collect_list(F.struct("line_no", part.alias("s"))), "\n").alias("raw")).where("token IS NOT NULL")
    g = g.select("doc_id", "pos", "page_no", "line_no", "token", F.regexp_replace("token", r"\.$", "").alias("id"), T.reflow(F.col("raw")).alias("text"))
    o = W.partitionBy("doc_id").orderBy("pos", "line_no")
    g = g.withColumn("key", T.fingerprint(F.col("text"), 32, 12)).withColumn("anchor", F.lag("key").over(o)).withColumn("anchor_id", F.lag("id").over(o))
    return g.where("key IS NOT NULL")


def item_hits(found: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, sec_pos, sub_pos, same_id): subsections of the document that contain an item's fingerprint."""
    n = subs.select("doc_id", "sec_pos", "sub_pos", T.norm_id(F.lower("id")).alias("sid"), T.fold("content").alias("n"))
    j = found.join(n, "doc_id").where(F.contains("n", F.col("key")))
    return j.select("doc_id", "pos", "line_no", "sec_pos", "sub_pos", (F.col("sid") == F.lower("id")).alias("same_id"))


def insertion_targets(found: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, sec_pos, sub_pos): where an item that no subsection contains goes: behind the last subsection
    that contains its anchor, in a section without the item's id; of several those with the anchor's own id come first."""
    hit = item_hits(found, subs).select("doc_id", "pos", "line_no").distinct()
    lost = found.join(hit, ["doc_id", "pos", "line_no"], "left_anti").where("anchor IS NOT NULL")
    n = subs.select("doc_id", "sec_pos", "sub_pos", T.norm_id(F.lower("id")).alias("sid"), T.fold("content").alias("n"))
    at = lost.join(n, "doc_id").where(F.contains("n", F.col("anchor"))).select(
        "doc_id", "pos", "line_no", (F.col("sid") == F.lower("anchor_id")).alias("own"), F.lower("id").alias("sid"), "sec_pos", "sub_pos")
    free = at.join(n.select("doc_id", "sec_pos", "sid").distinct(), ["doc_id", "sec_pos", "sid"], "left_anti")
    return free.groupBy("doc_id", "pos", "line_no").agg(F.max(F.struct("own", "sec_pos", "sub_pos")).alias("m")).select("doc_id", "pos", "line_no", "m.sec_pos", "m.sub_pos")


def front_matter(sections: DataFrame) -> DataFrame:
    return sections.where(T.blank(F.col("id")) & T.blank(F.col("title"))).select(*SECTION).distinct()


def front_matter_missing(pages: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines of the first page with a key of 24 characters that no text of the document contains."""
    first = P.lines(pages).withColumn("f", F.min("pos").over(W.partitionBy("doc_id"))).where("pos = f")
    line = first.select("doc_id", "line_no", "line", T.fingerprint(F.col("line"), 64, 24).alias("key")).where("key IS NOT NULL")
    whole = subs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(T.fold(F.coalesce("content", F.lit(""))))), "|").alias("whole"))
    return line.join(whole, "doc_id").where(~F.contains("whole", F.col("key"))).select("doc_id", "line_no", "line")


def heading_like(c):
    return ((F.length(c) <= 80) & ~c.rlike(r"[,;]") & c.rlike(r"^[^\p{L}]*\p{Lu}") & ~c.rlike(r"[.,;:–—-]$") & ~c.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2})+"))


def heading_above(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, above, heading_like): of each line with a clause number, the nearest line above that has four
    letters and is no page marker, on its page or the one before."""
    rank = P.content_pages(pages).select("doc_id", "pos", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("rank"))
    l = P.lines(pages).join(rank, ["doc_id", "pos"]).withColumn("t", T.trim(F.col("line")))
    o = W.partitionBy("doc_id").orderBy("pos", "line_no").rowsBetween(W.unboundedPreceding, -1)
    read = (T.letters(F.col("t")) >= 4) & ~F.startswith("t", F.lit("--- Seite "))
    l = l.withColumn("up", F.last(F.when(read, F.struct("rank", "t")), ignorenulls=True).over(o)).withColumn("above", F.col("up.t"))
    return l.where(F.col("t").rlike(CLAUSE_START)).where("above IS NOT NULL AND rank - up.rank <= 1").select("doc_id", "pos", "line_no", "above", heading_like(F.col("above")).alias("heading_like"))


def misfiled(subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, id): a letter other than a that opens a section of which the next subsection is the item a,
    by its id or by its text."""
    o = W.partitionBy(*SECTION).orderBy("sub_pos", "id", "content")
    n = subs.select(*SECTION, "sub_pos", T.norm_id(F.col("id")).alias("id"), F.row_number().over(o).alias("rn"), T.norm_id(F.lead("id").over(o)).alias("next_id"), T.trim(F.lead("content").over(o)).alias("next"))
    a = (F.col("next_id") == "a") | F.coalesce(F.col("next").rlike(r"^a[.)]\s"), F.lit(False))
    return n.where((F.col("rn") == 1) & F.col("id").rlike(r"^\p{L}$") & (F.col("id") != "a") & a).select(*SECTION, "sub_pos", "id")


def splice_window(sections: DataFrame, subs: DataFrame, run: DataFrame, prefix: str) -> DataFrame:
    """(doc_id, sec_pos, lo, hi, score): where a run (doc_id, id, content) of the prefix's number belongs: of the stretches of
    such numbers in one section, tables of contents left out, the first with the most openings of 48 folded characters
    that the run has, two at least; lo and hi are its first and last match by place in the section. The openings of a
    run travel to its document as one array."""
    key = lambda c: F.substring(T.fold(F.coalesce(c, F.lit(""))), 1, 48)
    keys = run.select("doc_id", key(F.col("content")).alias("k")).where("length(k) >= 12").groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("k").alias("keys")).where("n >= 2")
    o = W.partitionBy(*SECTION).orderBy("sub_pos", "id", "content")
    d = subs.join(contents_table(sections), [*SECTION], "left_anti").join(keys, "doc_id").withColumn("rn", F.row_number().over(o)).withColumn("k", key(F.col("content")))
    hit = (F.length("k") >= 12) & F.exists("keys", lambda x: F.startswith(x, F.col("k")) | F.startswith(F.col("k"), x))
    d = d.select(*SECTION, "rn", hit.alias("hit"), (F.split_part(T.norm_id(F.col("id")), F.lit("."), F.lit(1)) == prefix).alias("inside")).where("inside")
    d = d.withColumn("block", F.col("rn") - F.row_number().over(W.partitionBy(*SECTION).orderBy("rn")))
    e = d.groupBy(*SECTION, "block").agg(F.count(F.when(F.col("hit"), 1)).alias("score"), F.min(F.when(F.col("hit"), F.col("rn"))).alias("lo"), F.max(F.when(F.col("hit"), F.col("rn"))).alias("hi")).where("score >= 2")
    best = e.groupBy("doc_id").agg(F.max_by(F.struct("sec_pos", "lo", "hi", "score"), F.struct("score", -F.col("sec_pos"), -F.col("lo"))).alias("b"))
    return best.select("doc_id", "b.*")


def run_segments(run: DataFrame) -> DataFrame:
    """(doc_id, segment, ids): runs (doc_id, pos, id) cut where an id comes again in its segment."""
    d = run.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("r"))
    zero = F.expr("named_struct('done', CAST(array() AS ARRAY<ARRAY<STRING>>), 'open', CAST(array() AS ARRAY<STRING>))")

    def step(a, x):
        again = F.array_contains(a["open"], x["id"])
        return F.struct(F.when(again, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(again, F.array(x["id"])).otherwise(F.array_append(a["open"], x["id"])).alias("open"))

    cut = d.select("doc_id", F.aggregate("r", zero, step, lambda a: F.concat(a["done"], F.array(a["open"]))).alias("s"))
    return cut.select("doc_id", F.posexplode("s").alias("segment", "ids")).select("doc_id", "segment", F.array_join("ids", ",").alias("ids"))
