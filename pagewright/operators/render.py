"""Markdown of a document, and the kinds of its lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages as P


# Headings and labels of a rendered document.
FIELDS = (("reference", "Aktenzeichen"), ("date", "Stand"), ("notary", "Notar/in"))
PARTIES, NOTES, SIGNED, RAW = "Beteiligte", "Anmerkungen (Reviewer-Kommentare)", "Unterschriften", "Raw Response"


def sections_markdown(sections: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, markdown): `## heading` for each section but front matter, which has neither id nor title, then its
    subsections: labelled `**id.** content` unless the id is empty or is a text that the content begins with; front matter
    without a label gets a short lead word in bold. A subsection without a section counts as front matter."""
    sec = sections.select("doc_id", "sec_pos", F.lit(-1).alias("sub_pos"), T.heading(F.col("id"), F.col("title")).alias("h"),
                          ((T.undotted(F.col("id")) == "") & (T.trim(F.coalesce("title", F.lit(""))) == "")).alias("front")).distinct()
    heads = sec.where("NOT front").select("doc_id", "sec_pos", "sub_pos", T.trim(F.concat(F.lit("## "), F.col("h"))).alias("s"))
    front = F.coalesce("front", F.lit(True))
    i = T.undotted(F.col("id"))
    body = F.replace(F.coalesce("content", F.lit("")), F.lit("- , "), F.lit("-, "))
    plain = (i == "") | (i.rlike(r"[\p{L}\p{M}]") & F.startswith(T.norm_id(body), T.norm_id(i)))
    text = F.when(plain, F.when(front, T.bold_label(body)).otherwise(body)).otherwise(F.concat(F.lit("**"), i, F.lit(".** "), body))
    rows = subs.join(sec.select("doc_id", "sec_pos", "front"), ["doc_id", "sec_pos"], "left").select("doc_id", "sec_pos", "sub_pos", text.alias("s"))
    return heads.unionByName(rows).groupBy("doc_id").agg(P.joined(F.collect_list(F.struct("sec_pos", "sub_pos", "s")), "\n\n").alias("markdown"))


def parties_markdown(parties: DataFrame) -> DataFrame:
    """(doc_id, parties) of (doc_id, pos, name, role, details): each party's role and name, details on a line below."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    s = F.concat(F.lit("**"), text("role"), F.lit(":** "), F.coalesce("name", F.lit("N/A")), F.when(text("details") != "", F.concat(F.lit("\n  "), text("details"))).otherwise(""))
    return parties.select("doc_id", "pos", s.alias("s")).groupBy("doc_id").agg(P.joined(F.collect_list(F.struct("pos", "s")), "\n\n").alias("parties"))


def document(answers: DataFrame, key: str, body: DataFrame, parties: DataFrame) -> DataFrame:
    """(key, markdown) of answers (key, doc_id, name, title, reference, date, notary, annotations, signatures, _markdown,
    raw_response), of sections_markdown() and of parties_markdown(). An answer that is Markdown already stands below the
    document's name; a null title is that name; what is null or empty is left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    signer = F.transform("signatures", lambda x: F.array_join(F.filter(F.array(x["name"], x["role"]), lambda y: y.isNotNull() & (y != "")), " — "))
    head = lambda h: F.lit(f"## {h}\n\n")
    blocks = F.array_compact(F.array(
        F.concat(F.lit("# "), F.coalesce("title", "name")), *[F.when(text(c) != "", F.concat(F.lit(f"**{label}:** "), F.col(c))) for c, label in FIELDS],
        F.when(F.col("parties").isNotNull(), F.concat(head(PARTIES), F.col("parties"))), F.col("body"),
        F.when(some("annotations"), F.concat(F.lit("---\n\n"), head(NOTES), listed(F.col("annotations")))),
        F.when(some("signatures"), F.concat(head(SIGNED), listed(signer))), F.when(F.col("raw_response").isNotNull(), F.concat(head(RAW), F.col("raw_response")))))
    whole = F.when(F.col("_markdown").isNotNull(), F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.col("_markdown"))).otherwise(F.concat(F.array_join(blocks, "\n\n"), F.lit("\n")))
    d = answers.join(body.withColumnRenamed("markdown", "body"), "doc_id", "left").join(parties, "doc_id", "left")
    return d.select(key, whole.alias("markdown"))


def classify_lines(md: DataFrame, key: str, text: str, most_chars: int = 60_000, most_lines: int = 600) -> DataFrame:
    """(key, line_no, kind, level) of the lines a preview shows: fences, text inside them, blanks, rules, tables, headings,
    ordered and bulleted items, quotes, text. The caps are those of the preview."""
    l = md.select(key, F.posexplode(F.split(F.substring(text, 1, most_chars), "\n")).alias("line_no", "line")).where(F.col("line_no") < most_lines)
    t = T.trim(F.col("line"))
    fence = F.startswith(t, F.lit("```"))
    l = l.withColumn("inside", F.coalesce(F.sum(fence.cast("int")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2 == 1)
    kind = (F.when(fence, "fence").when(F.col("inside"), "code").when(t == "", "blank").when(t.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule").when(t.rlike(r"^\|"), "table")
            .when(t.rlike(r"^#{1,6} "), "heading").when(t.rlike(r"^[0-9]{1,3}[.)] "), "ordered").when(t.rlike(r"^[-*+] "), "bullet").when(t.rlike(r"^>"), "quote").otherwise("text"))
    return l.select(key, "line_no", kind.alias("kind"), F.when(kind == "heading", F.length(F.regexp_extract(t, "^(#+)", 1))).otherwise(0).alias("level"))
