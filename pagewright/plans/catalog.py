"""The registered queries of the core and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import clauses, pages, structure
from pagewright.plans import details, oracle, planted, second, stateful
from pagewright.session import written
from pagewright.sources import table

CHUNK = 2_000  # characters of a chunk in the query: test documents are short


def _page(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page")


def _sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sections")


def _subs(s: SparkSession, d: str) -> DataFrame:
    """Subsections without repeated rows."""
    return table(s, d, "subsections").select("sub_id", "doc_id", "sec_pos", "sub_pos", "id", "content").distinct()


def _missing(s, d):
    return clauses.missing(clauses.source_ids(_page(s, d)), clauses.label_ids(_sections(s, d), _subs(s, d)))


def _invented(s, d):
    return clauses.invented(clauses.source_ids(_page(s, d)), clauses.label_ids(_sections(s, d), _subs(s, d)), _page(s, d))


def reference_is_furniture(s, d):
    """References of answers that were made of page furniture."""
    a = table(s, d, "answer").select("answer_id", "doc_id", "reference")
    return pages.is_furniture(a, "reference", pages.furniture_keys(_page(s, d))).select("answer_id", "furniture")


def clause_ids_gate(s, d):
    src = clauses.source_ids(_page(s, d))
    m = _missing(s, d).groupBy("doc_id").agg(F.count("*").alias("n_missing"))
    g = src.groupBy("doc_id").agg(F.count("*").alias("n_ids")).join(m, "doc_id", "left").na.fill(0, ["n_missing"])
    return g.select("doc_id", "n_ids", "n_missing", (F.col("n_ids") >= clauses.GATE).alias("audited"),
                    F.col("n_missing").between(1, clauses.RETRY).alias("retried"))


def _bare(s, d):
    return clauses.bare_numbered(*planted.bare(s, d), clauses.source_ids(_page(s, d)), _page(s, d))


def audit_warning(s, d):
    """All that a reader is told, sections with bare numbers and items without a place being the planted ones."""
    src, lab = written(clauses.source_ids(_page(s, d))), written(clauses.label_ids(_sections(s, d), _subs(s, d)))
    miss, inv = written(clauses.missing(src, lab)), written(clauses.invented(src, lab, _page(s, d)))
    items = structure.items(planted.pages_of_items(s, d)).where("doc_id % 7 = 0")
    placed = structure.item_hits(items, planted.thinned(s, d)).select("doc_id", "pos", "line_no").distinct()
    places = clauses.locations(miss.unionByName(inv), _page(s, d))
    bare = clauses.bare_numbered(*planted.bare(s, d), src, _page(s, d))
    return clauses.warnings(miss, inv, bare, places, items.join(placed, ["doc_id", "pos", "line_no"], "left_anti"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    return second.score_report(s, d)


QUERIES = {
    "page_inspect": lambda s, d: pages.inspect(_page(s, d)),
    "page_text_dump": lambda s, d: pages.dump(_page(s, d)),
    "page_marker_roundtrip": lambda s, d: (pages.dump(_page(s, d)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
                                           .select("doc_id", pages.marker_page(F.col("line")).alias("page_no")).where("page_no IS NOT NULL")),
    "furniture_keys": lambda s, d: pages.furniture_keys(_page(s, d)),
    "furniture_strip": lambda s, d: pages.strip_furniture(_page(s, d)),
    "reference_is_furniture": reference_is_furniture,
    "chunk_plan": lambda s, d: pages.chunks(_page(s, d), CHUNK),
    "clause_ids_extract": lambda s, d: clauses.source_ids(_page(s, d)),
    "clause_ids_missing": _missing,
    "clause_ids_invented": _invented,
    "clause_ids_gate": clause_ids_gate,
    "missing_by_major": lambda s, d: clauses.by_major(_missing(s, d)),
    "clause_page_locations": lambda s, d: clauses.locations(_missing(s, d), _page(s, d)),
    "retry_pages": lambda s, d: clauses.retry_pages(_missing(s, d), _page(s, d)),
    "audit_warning": audit_warning,
    "bare_numbered_sections": _bare,
}


def queries() -> dict:
    return QUERIES | second.QUERIES | details.QUERIES | stateful.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | second.SQL | details.SQL | stateful.SQL
