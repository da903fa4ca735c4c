"""Queries of the repairs that SQL can't express."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import pages, provider, repair
from pagewright.plans import pipeline
from pagewright.sources import table
from pagewright.streaming import queue

OUT = ("doc_id", "sec_pos", "sub_pos", "section", "title", "id", "content", "note")


def _rel(s, d):
    return repair.relation(table(s, d, "sections"), table(s, d, "subsections"))


def _anchors(s, d):
    """Numbers and opening words as the pages print them."""
    return provider.anchors(pages.strip_furniture(table(s, d, "page")), provider.Printed(), width=8)


def _splice(s, d):
    """Sections that lost every third subsection, mended by runs of all subsections with the missing ids' first number."""
    rel = _rel(s, d)
    ids = rel.where("id RLIKE '^[1-9][0-9]?[.][1-9][0-9]?$' AND content RLIKE '\\\\S'")
    lost = ids.where("sub_pos % 3 = 1").select("doc_id", "id").distinct()
    kept = rel.where("NOT coalesce(sub_pos % 3 = 1 AND id RLIKE '^[1-9][0-9]?[.][1-9][0-9]?$' AND content RLIKE '\\\\S', false)")
    runs = ids.select("doc_id", F.split_part("id", F.lit("."), F.lit(1)).alias("prefix"), (F.col("sec_pos") * 1000 + F.col("sub_pos")).alias("pos"), "id", "content")
    return repair.spliced(kept, runs, lost).select(*OUT)


def _convert(s, d):
    """Sections that lost some subsections, mended by what the pages print."""
    subs = table(s, d, "subsections").where("NOT coalesce(sub_id % 9 = 4 AND id RLIKE '^[1-9][.][1-9]', false)")
    return pipeline.convert(table(s, d, "page"), table(s, d, "sections"), subs, reader=provider.Printed())


def _extract(s, d):
    """Documents read in chunks; one chunk in some can't be read, is asked for again and then in halves."""
    got = provider.extract(table(s, d, "page"), provider.Printed(broken=("Inhaltsverzeichnis",)), most=2_000, width=8)
    subs = F.flatten(F.transform("answer.sections", lambda x: x["subsections"]))
    return got.select("doc_id", "pos", "kind", "rung", F.size(F.coalesce(subs, F.array())).alias("n_subsections"))


def _transcribe(s, d):
    """Pages of documents without a text layer, by the provider of the tests."""
    scanned = table(s, d, "doc").where("NOT has_text_layer").select("doc_id")
    return provider.transcribe(pages.content_pages(table(s, d, "page")).join(scanned, "doc_id", "left_semi"), provider.Echo(), width=8)


QUERIES = {
    "convert_documents": _convert, "extract_documents": _extract, "extract_anchors": _anchors,
    "transcribe_pages": _transcribe,
    "item_repair": lambda s, d: repair.repaired_items(_rel(s, d), table(s, d, "page")).select(*OUT),
    "scope_split": lambda s, d: repair.scoped(_rel(s, d), table(s, d, "page")).select(*OUT),
    "front_matter_recovery": lambda s, d: repair.with_front(_rel(s, d), table(s, d, "page")).select(*OUT),
    "splice_runs": _splice,
    "rebind_clauses": lambda s, d: repair.rebound(_rel(s, d), _anchors(s, d)).select(*OUT),
    "queue_state_fold": lambda s, d: queue.fold(queue.commands_of_events(table(s, d, "events"))).select("path", "state", "applied", "ignored", F.unix_timestamp("finished_at").alias("finished_s")),
}

# the moves of streaming.queue as rows
_MOVES = ", ".join(f"('{a}', '{c}', '{b}')" for (a, c), b in queue.MOVES.items())
SQL = {
    "queue_state_fold": f"""WITH RECURSIVE mv(a, c, b) AS (VALUES {_MOVES}),
e AS (SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CAST(ts AS TIMESTAMP) AS ts,
  ['add', 'start', 'finish', 'fail', 'cancel', 'retry', 'large', 'confirm', 'decline', 'remove'][CAST(event_id % 10 AS INT) + 1] AS command FROM events),
f AS (SELECT e.path, e.rn, coalesce(m.b, '') AS state, CASE WHEN m.b IS NULL THEN 0 ELSE 1 END AS applied, CASE WHEN m.b IS NULL THEN 1 ELSE 0 END AS ignored, CAST(NULL AS TIMESTAMP) AS finished_at
    FROM e LEFT JOIN mv m ON m.a = '' AND m.c = e.command WHERE e.rn = 1
  UNION ALL SELECT e.path, e.rn, coalesce(m.b, f.state), f.applied + CASE WHEN m.b IS NULL THEN 0 ELSE 1 END, f.ignored + CASE WHEN m.b IS NULL THEN 1 ELSE 0 END,
    CASE WHEN m.b IS NULL THEN f.finished_at WHEN m.b IN ('done', 'failed', 'cancelled') AND f.state = 'converting' THEN e.ts WHEN m.b = 'waiting' THEN NULL ELSE f.finished_at END
    FROM f JOIN e ON e.path = f.path AND e.rn = f.rn + 1 LEFT JOIN mv m ON m.a = f.state AND m.c = e.command)
SELECT path, state, CAST(applied AS BIGINT) AS applied, CAST(ignored AS BIGINT) AS ignored, CAST(floor(epoch(finished_at)) AS BIGINT) AS finished_s FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rn DESC) AS n FROM f) WHERE n = 1""",
}
