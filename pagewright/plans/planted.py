"""Relations made of the tables, with cases that the tables themselves don't have; each in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.sources import table

NORM = r"regexp_replace(coalesce({0}, ''), '^[ .]+|[ .]+$', '', 'g')"


def _sections(s, d):
    return table(s, d, "sections").select("doc_id", "sec_pos", "id", "title").distinct()


def _subs(s, d):
    return table(s, d, "subsections").select("doc_id", "sec_pos", "sub_pos", "id", "content").distinct()


def labels(s, d):
    """Numbers of order lines as labels of one section for each order: they repeat and go back."""
    label = F.concat((F.col("l_orderkey") % 97 + 1).cast("string"), F.lit("."), (F.col("l_partkey") % 9 + 1).cast("string"))
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("sec_pos"), F.col("l_linenumber").alias("sub_pos")).agg(F.min(label).alias("id"))


LABELS = "SELECT l_orderkey AS doc_id, 0 AS sec_pos, l_linenumber AS sub_pos, min(CAST(l_orderkey % 97 + 1 AS VARCHAR) || '.' || CAST(l_partkey % 9 + 1 AS VARCHAR)) AS id FROM lineitem GROUP BY 1, 2, 3"


def renumbered(s, d):
    """Subsections with numbers that start again, some of them in runs that don't ascend."""
    k = F.row_number().over(W.partitionBy("doc_id", "sec_pos").orderBy("sub_pos", "id", "content")) - 1
    return _subs(s, d).select("doc_id", "sec_pos", "sub_pos", "content", (k * (1 + F.col("doc_id") % 2) % (3 + F.col("sec_pos") % 2) + 1).cast("string").alias("id"))


RENUMBERED = """SELECT doc_id, sec_pos, sub_pos, CAST((row_number() OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos, id, content) - 1) * (1 + doc_id % 2) % (3 + sec_pos % 2) + 1 AS VARCHAR) AS id
  FROM (SELECT DISTINCT doc_id, sec_pos, sub_pos, id, content FROM subsections)"""


def lettered(s, d):
    """Sections of which some have the letter of an enumeration as their id."""
    stray = (F.col("sec_pos") >= 1) & (F.col("doc_id") % 3 != 0)
    return _sections(s, d).withColumn("id", F.when(stray, F.concat(F.char(97 + F.col("sec_pos")), F.lit("."))).otherwise(F.col("id")))


LETTERED = "SELECT DISTINCT doc_id, sec_pos, CASE WHEN sec_pos >= 1 AND doc_id % 3 <> 0 THEN chr(97 + sec_pos) || '.' ELSE id END AS id, title FROM sections"


def doubled(s, d):
    """Subsections with the text of an enumerated one in front of its section once more."""
    sub = _subs(s, d)
    return sub.unionByName(sub.where("id IN ('b', '(2)')").select("doc_id", "sec_pos", F.lit(-1).alias("sub_pos"), F.lit("").alias("id"), "content"))


DOUBLED = """SELECT DISTINCT doc_id, sec_pos, sub_pos, id, content FROM subsections
  UNION ALL SELECT DISTINCT doc_id, sec_pos, -1, '', content FROM subsections WHERE id IN ('b', '(2)')"""


def thinned(s, d):
    """Subsections without every second enumerated one."""
    return _subs(s, d).where("id IS NULL OR id NOT IN ('b', 'd', '(2)', '(4)')")


THINNED = "SELECT DISTINCT doc_id, sec_pos, sub_pos, id, content FROM subsections WHERE id IS NULL OR id NOT IN ('b', 'd', '(2)', '(4)')"


def bare(s, d):
    """(sections, subsections): sections with a number of two parts over subsections with a bare one, and sections of which
    the only subsection is a heading that the pages print behind its number."""
    sec = _sections(s, d).withColumn("n", T.norm_id(F.col("id"))).where("n RLIKE '^[0-9]{1,2}$'")
    printed = sec.where("doc_id % 2 = 0")
    sections = sec.select("doc_id", "sec_pos", F.concat("n", F.lit(".1")).alias("id"), "title").unionByName(
        printed.select("doc_id", (F.col("sec_pos") + 1000).alias("sec_pos"), F.concat("n", F.lit(".7")).alias("id"), "title"))
    last = F.regexp_extract("id", r"^[0-9]+\.([0-9]+)$", 1)
    subs = _subs(s, d).select("doc_id", "sec_pos", F.when(last != "", last).otherwise(F.col("id")).alias("id"), "content").unionByName(
        printed.select("doc_id", (F.col("sec_pos") + 1000).alias("sec_pos"), F.col("n").alias("id"), F.col("title").alias("content")))
    return sections, subs


BARE = rf"""pn AS (SELECT DISTINCT doc_id, sec_pos, {NORM.format('id')} AS n, title FROM sections WHERE regexp_matches({NORM.format('id')}, '^[0-9]{{1,2}}$')),
bsec AS (SELECT doc_id, sec_pos, n || '.1' AS section FROM pn UNION ALL SELECT doc_id, sec_pos + 1000, n || '.7' FROM pn WHERE doc_id % 2 = 0),
bsub AS (SELECT DISTINCT doc_id, sec_pos, {NORM.format("CASE WHEN regexp_extract(id, '^[0-9]+[.]([0-9]+)$', 1) <> '' THEN regexp_extract(id, '^[0-9]+[.]([0-9]+)$', 1) ELSE id END")} AS sid, content FROM subsections
  UNION ALL SELECT doc_id, sec_pos + 1000, n, title FROM pn WHERE doc_id % 2 = 0)"""


def pages_of_items(s, d):
    """One page for each document with its enumerated subsections, a line each."""
    sub = _subs(s, d).where("id RLIKE '^([a-z]|[(][0-9][)])$' AND content IS NOT NULL")
    line = F.concat("id", F.when(F.startswith("id", F.lit("(")), " ").otherwise(". "), F.replace("content", F.lit("\n"), F.lit(" ")))
    one = sub.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_pos", "sub_pos", line.alias("s")))).alias("a"))
    return one.select("doc_id", F.lit(1).alias("page_no"), F.lit(0).alias("pos"), F.array_join(F.transform("a", lambda x: x["s"]), "\n").alias("text"))


PAGES_OF_ITEMS = """page AS (SELECT doc_id, 1 AS page_no, 0 AS pos, string_agg(id || CASE WHEN starts_with(id, '(') THEN ' ' ELSE '. ' END || replace(content, chr(10), ' '), chr(10) ORDER BY sec_pos, sub_pos, id, content) AS text
  FROM (SELECT DISTINCT doc_id, sec_pos, sub_pos, id, content FROM subsections) WHERE regexp_matches(id, '^([a-z]|[(][0-9][)])$') AND content IS NOT NULL GROUP BY 1)"""
