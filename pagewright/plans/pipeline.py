"""A whole conversion: pages and extracted sections to Markdown with a warning."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import clauses, pages, provider, render, repair, structure
from pagewright.operators.repair import Item, Sec
from pagewright.session import written

SHARE = 2, 5  # least part of the source's text that a mended document keeps


def missing_ids(source: list[str], secs: list[Sec]) -> set[str]:
    """Ids of the source, of those with a neighbour there, that no label has; none for sources below the gate."""
    shown = set(source)
    if len(shown) < clauses.GATE:
        return set()
    labels = {i for s in secs for label in (s.id, *(x[0] for x in s.subs)) for i in repair.clause_ids(label)}
    return {i for i in shown - labels if repair.neighbours(i) & shown}


def _size(secs: list[Sec]) -> int:
    return sum(len(s.title) + sum(len(c) for _, c in s.subs) for s in secs)


def mend(secs: list[Sec], pages_: list[str], items: list[Item], anchors: list[tuple[str, str]], source: list[str]) -> tuple[list[Sec], list[Item], bool]:
    """One document's sections: stray letters and duplicates folded, numbering scopes split, front matter and items recovered,
    numbers bound to paragraphs unless more ids are missing or too much text is, scopes split once more; with the items
    without a place, and whether a scope was split."""
    total = sum(map(len, pages_))
    secs, first = repair.split_scopes(repair.drop_duplicates(repair.demote(secs)), pages_)
    secs, lost = repair.repair_items(repair.recover_front(secs, pages_), items)
    if len(anchors) >= 2 and len(set(source)) >= clauses.GATE:
        new, done = repair.rebind(secs, anchors)
        if done and len(missing_ids(source, new)) <= len(missing_ids(source, secs)) and _size(new) * SHARE[1] >= total * SHARE[0]:
            secs = new
    secs, second = repair.split_scopes(secs, pages_)
    return secs, lost, bool(first or second)


def mended(rel: DataFrame, content: DataFrame, anchors: DataFrame, source: DataFrame) -> DataFrame:
    """repair.OUT of repair.relation(), of pages, of anchors and of the ids of the pages: mend() of every document, in one pass
    over documents; note holds whether a scope was split and the items without a place as JSON."""

    def fold(secs, texts, items, found, ids):
        secs, lost, split = mend(secs, repair.page_texts(texts), repair.page_items(items), repair.page_anchors(found), [x["id"] for x in ids])
        return secs, json.dumps({"split": split, "lost": [dict(pos=k, line_no=0, token=x.token, page_no=x.page) for k, x in enumerate(lost)]})

    return repair.by_document(rel, {"pages": pages.content_pages(content), "items": structure.items(content), "anchors": anchors, "source": source}, fold)


NOTE = "split BOOLEAN, lost ARRAY<STRUCT<pos: INT, line_no: INT, token: STRING, page_no: INT>>"


def _pair(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (rel.select("doc_id", "sec_pos", F.col("section").alias("id"), "title").distinct(), rel.where("sub_pos IS NOT NULL").select("doc_id", "sec_pos", "sub_pos", "id", "content"))


def convert(page: DataFrame, sections: DataFrame, subs: DataFrame, anchors: DataFrame | None = None, reader: provider.Provider | None = None) -> DataFrame:
    """(doc_id, markdown, warning): furniture off, each document mended in one pass, clauses that are still missing read anew
    by the reader, if there is one, and spliced in, then rendered and audited. Without anchors the reader is asked for
    them, if there is one. No id and no text is lost: repairs that would lose any are not taken."""
    content = written(pages.strip_furniture(page))
    rel = repair.relation(sections, subs)
    if anchors is None:
        anchors = written(provider.anchors(content, reader)) if reader else content.select("doc_id", F.lit(0).alias("pos"), F.lit("").alias("id"), F.lit("").alias("start")).limit(0)
    src = written(clauses.source_ids(content))
    m = written(mended(rel, content, anchors, src))
    rel = repair.flat(m).drop("note")
    note = m.select("doc_id", F.from_json("note", NOTE).alias("n"))
    if reader:
        gone = written(clauses.missing(src, clauses.label_ids(*_pair(rel))))
        rel = repair.spliced(rel, written(provider.runs(gone, content, reader)), gone).select("doc_id", "sec_pos", "sub_pos", "section", "title", "id", "content")
    rel = written(rel)
    sec, sub = _pair(rel)
    lab = written(clauses.label_ids(sec, sub))
    miss, inv = written(clauses.missing(src, lab)), written(clauses.invented(src, lab, content))
    # what a split moves below a heading is judged as it stood before
    before = clauses.bare_numbered(sections, subs, src, content).join(note.where("n.split").select("doc_id"), "doc_id", "left_semi")
    bare = clauses.bare_numbered(sec, sub, src, content).unionByName(before)
    lost = note.select("doc_id", F.explode("n.lost").alias("x")).select("doc_id", "x.*")
    places = clauses.locations(miss.unionByName(inv), content)
    return render.sections_markdown(sec, sub).join(clauses.warnings(miss, inv, bare, places, lost), "doc_id", "left")
