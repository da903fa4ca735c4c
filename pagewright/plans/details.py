"""Queries of single steps that others are made of, with their SQL."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import clauses, history, pages, structure
from pagewright.operators import provider as prov
from pagewright.plans import planted
from pagewright.plans.oracle import BARE, CLEAN, IDS, KEYS, WARNING, fold, trim
from pagewright.plans.second import COMPS, NORM, PLANTED_ITEMS, REFLOW, SUB
from pagewright.sources import table

TODAY = "2021-03-01"  # the day of history_today_split


def _page(s, d):
    return table(s, d, "page")


def _subs(s, d):
    return table(s, d, "subsections").select("doc_id", "sec_pos", "sub_pos", "id", "content").distinct()


def _sections(s, d):
    return table(s, d, "sections").select("doc_id", "sec_pos", "id", "title").distinct()


# -- the queue ------------------------------------------------------------------------------------

STATES = ("waiting", "awaitingConfirmation", "converting", "done", "failed", "cancelled")


def _queue(s, d):
    """Events as queue entries of users."""
    state = F.get(F.array(*[F.lit(x) for x in STATES]), (F.col("event_id") % 6).cast("int"))
    start = F.to_timestamp("ts")
    return table(s, d, "events").select(
        F.col("user_id"), F.col("event_id").cast("string").alias("path"), F.col("event_id").alias("arrival"), state.alias("state"), (F.col("event_id") % 150).alias("pages"),
        F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False).alias("has_text"), start.alias("started_at"),
        F.when(F.col("event_id") % 4 > 0, start + F.make_dt_interval(secs=F.col("event_id") % 7000)).alias("finished_at"))


def queue_flags(s, d):
    return history.flags(_queue(s, d)).select("path", "active", "finished", "busy", "pill", "duration")


def queue_next(s, d):
    return history.next_waiting(_queue(s, d).where("user_id % 2 = 0 OR state <> 'converting'"), "user_id")


def queue_new_entries(s, d):
    q = _queue(s, d)
    return history.new_entries(q, q.where("arrival % 5 < 3").unionByName(q.where("arrival % 7 = 1")))


def fallback_policy(s, d):
    kind = F.get(F.array(*[F.lit(x) for x in ("success", "empty", "providerError", "truncated")]), (F.col("event_id") % 4).cast("int"))
    code = F.get(F.array(*[F.lit(x) for x in (0, 400, 429, 500, 503, 404)]), (F.col("event_id") % 6).cast("int"))
    e = table(s, d, "events").select("event_id", kind.alias("kind"), code.alias("code"))
    return e.withColumn("worth", prov.worth(F.col("kind"), F.col("code")))


def history_json(s, d):
    """History entries written as JSON and read back; a missing warning stays missing."""
    h = table(s, d, "history")
    entry = F.to_json(F.struct("name", F.col("output_path").alias("outputPath"), "warning"))
    back = F.from_json(entry, "name STRING, outputPath STRING, warning STRING")
    return h.select(entry.alias("entry"), back.alias("b")).select("b.name", F.col("b.outputPath").alias("output_path"), "b.warning", F.contains("entry", F.lit('"warning"')).alias("has_warning"))


def history_today_split(s, d):
    return history.by_day(table(s, d, "history"), TODAY).groupBy("is_today", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


# -- pages and lines ------------------------------------------------------------------------------

def first_page_containing(s, d):
    """The first page that shows the first text of each document's sections behind its leading front matter."""
    sec = _sections(s, d).select("doc_id", "sec_pos", (T.blank(F.col("id")) & T.blank(F.col("title"))).alias("front"))
    body = sec.groupBy("doc_id").agg(F.min(F.when(~F.col("front"), F.col("sec_pos"))).alias("start"))
    key = _subs(s, d).withColumn("key", T.fingerprint(F.col("content"), 32, 12)).where("key IS NOT NULL").join(body, "doc_id").where("sec_pos >= start")
    key = key.groupBy("doc_id").agg(F.min_by("key", F.struct("sec_pos", "sub_pos", "key")).alias("key"))
    p = pages.content_pages(_page(s, d)).withColumn("n", T.fold(F.col("text"))).join(key, "doc_id").where(F.contains("n", F.col("key")))
    return p.groupBy("doc_id", "key").agg(F.min("pos").alias("pos"))


def positional_zip(s, d):
    """Pages beside what is left of them without furniture, by place, and how many lines went."""
    raw = pages.content_pages(_page(s, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("raw"))
    kept = pages.strip_furniture(_page(s, d)).select("doc_id", "pos", F.col("text").alias("kept"))
    z = raw.select("doc_id", F.posexplode("raw").alias("k", "x")).select("doc_id", "k", "x.pos", "x.text").join(kept, ["doc_id", "pos"], "left")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(F.col(c), "\n")))
    return z.select("doc_id", "k", "pos", (n("text") - n("kept")).alias("gone"))


def paragraph_starts(s, d):
    """Paragraphs of each page: a new one behind a full stop before a capital, the rest reflowed, and where each begins in the
    folded text of its page."""
    l = pages.lines(_page(s, d)).withColumn("t", T.trim(F.col("line"))).where("t <> ''")
    o = W.partitionBy("doc_id", "pos").orderBy("line_no")
    new = F.endswith(F.lag("t").over(o), F.lit(".")) & F.col("t").rlike(r"^\p{Lu}")
    l = l.withColumn("new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("paragraph", F.sum("new").over(o))
    g = l.groupBy("doc_id", "pos", "paragraph").agg(pages.joined(F.collect_list(F.struct("line_no", F.col("t").alias("s"))), "\n").alias("raw"))
    g = g.select("doc_id", "pos", "paragraph", T.reflow(F.col("raw")).alias("text"))
    before = W.partitionBy("doc_id", "pos").orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)
    return g.select("doc_id", "pos", "paragraph", F.md5("text").alias("text_md5"), F.coalesce(F.sum(F.length(T.fold(F.col("text")))).over(before), F.lit(0)).alias("start"))


def open_section_carry(s, d):
    """The section that is open behind each: its own label, or the last one that had any."""
    label = T.trim(F.concat(F.coalesce("id", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    o = W.partitionBy("doc_id").orderBy("sec_pos")
    return _sections(s, d).select("doc_id", "sec_pos", F.last(F.when(label != "", label), ignorenulls=True).over(o).alias("open"))


def keys_longest_first(s, d):
    k = pages.furniture_keys(_page(s, d))
    o = W.partitionBy("doc_id").orderBy(F.desc(F.length("key")), "key")
    return k.select("doc_id", "key", F.row_number().over(o).alias("place"))


def preview_caps(s, d):
    """The lines a preview may show, how many there are besides, and what they hold in bold; twenty of the bold parts."""
    md = table(s, d, "answer").select("answer_id", F.col("_markdown").alias("md")).where("md IS NOT NULL")
    lines = F.split(F.substring("md", 1, 60_000), "\n")
    bold = F.flatten(F.transform(F.slice(lines, 1, 600), T.bold_spans))
    return md.select("answer_id", F.least(F.size(lines), F.lit(600)).alias("shown"), F.greatest(F.size(lines) - 600, F.lit(0)).alias("hidden"), F.array_join(F.slice(bold, 1, 20), "|").alias("bold"),
                     F.size(bold).alias("n_bold"))


def text_codec(s, d):
    t = F.substring("text", 1, 300)
    return table(s, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"[\r\n]", "").alias("plain"), T.base64url(t).alias("url"), F.decode(F.unbase64(F.base64(F.encode(t, "UTF-8"))), "UTF-8").alias("back"))


def chunk_math(s, d):
    """Number and size of the parts that each document is cut into."""
    t = pages.content_pages(_page(s, d)).groupBy("doc_id").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("total"))
    return t.select("doc_id", "total", F.ceil(F.col("total") / 2000.0).cast("bigint").alias("parts"), F.expr("total div ((total + 1999) div 2000) + 1").alias("target"),
                    F.expr("(total * 2) div 5").alias("least"), F.round(100.0 * F.col("total") / F.greatest(F.lit(1), F.col("total") + 1000), 6).alias("percent"))


# -- ids, labels, sections --------------------------------------------------------------------------

def id_set_relations(s, d):
    """Ids of the pages and of the labels as sets, by document."""
    a = clauses.source_ids(_page(s, d)).groupBy("doc_id").agg(F.collect_set("id").alias("a"))
    b = clauses.label_ids(_sections(s, d), _subs(s, d)).groupBy("doc_id").agg(F.collect_set("id").alias("b"))
    none = F.array().cast("array<string>")
    j = a.join(b, "doc_id", "full").select("doc_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return j.select("doc_id", F.size(F.array_except("a", "b")).alias("only_source"), F.size(F.array_except("b", "a")).alias("only_labels"), F.size(F.array_intersect("a", "b")).alias("both"),
                    F.size(F.array_union("a", "b")).alias("either"), (~F.arrays_overlap("a", "b")).alias("disjoint"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


def id_normalization(s, d):
    """Ids in several spellings, their parts, and contents that begin with their id without it."""
    k = F.col("sub_pos") % 4
    ident = F.coalesce("id", F.lit(""))
    spelt = F.when(k == 0, F.concat(F.lit(" "), ident, F.lit(". "))).when(k == 1, F.concat(ident, F.lit("."))).otherwise(ident)
    content = F.coalesce("content", F.lit(""))
    lead = F.when(k == 0, F.concat(ident, F.lit(". "), content)).when(k == 1, F.concat(ident, F.lit(".500 EUR"))).when(k == 2, F.concat(ident, F.lit("\t"), content)).otherwise(content)
    r = table(s, d, "subsections").select("sub_id", "doc_id", "sec_pos", "sub_pos", "id", "content").distinct().select("sub_id", "sub_pos", spelt.alias("id"), lead.alias("content"))
    c = T.comps(F.col("id"))
    return r.select("sub_id", T.norm_id(F.col("id")).alias("norm"), F.array_join(c.cast("array<string>"), "/").alias("parts"), F.split_part(T.norm_id(F.col("id")), F.lit("."), F.lit(1)).alias("family"),
                    F.md5(T.strip_leading_id(F.col("content"), F.col("id"))).alias("content_md5"), T.literal_pattern(F.col("id")).alias("pattern"),
                    F.concat(F.coalesce(F.size(c), F.lit(0)).cast("string"), T.plural(F.coalesce(F.size(c), F.lit(0)), " part", " parts")).alias("counted"))


def dictionary_ops(s, d):
    """Labels of each document counted, grouped by their first number, the first section of each standing."""
    l = _subs(s, d).select("doc_id", "sec_pos", "sub_pos", T.norm_id(F.col("id")).alias("label")).where("label RLIKE '^[0-9]+[.][0-9]+$'").withColumn("family", F.split_part("label", F.lit("."), F.lit(1)))
    return l.groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min_by("sec_pos", F.struct("sec_pos", "sub_pos")).alias("first_section"))


def exactly_one_candidate(s, d):
    """Labels that one section of their document holds, and no other."""
    l = _subs(s, d).select("doc_id", "sec_pos", T.norm_id(F.col("id")).alias("label")).where("label <> ''")
    return l.groupBy("doc_id", "label").agg(F.count_distinct("sec_pos").alias("n"), F.min("sec_pos").alias("sec_pos")).where("n = 1").select("doc_id", "label", "sec_pos")


def flag_union(s, d):
    """Sections flagged before or behind a split, each once, in the order of their text."""
    flagged = clauses.bare_numbered(*planted.bare(s, d), clauses.source_ids(_page(s, d)), _page(s, d)).select("doc_id", "section")
    before = _sections(s, d).select("doc_id", F.concat(T.norm_id(F.col("id")), F.lit(".1")).alias("section")).where("section RLIKE '^[0-9]' AND doc_id % 4 = 0")
    g = flagged.unionByName(before).groupBy("doc_id").agg(F.array_sort(F.collect_set("section")).alias("a"))
    return g.select("doc_id", F.array_join("a", ",").alias("sections"))


def anchor_order_guard(s, d):
    """Whether the numbers of each document's sections ascend in the order of the text, sorted by number and by place."""
    l = _subs(s, d).select("doc_id", "sec_pos", "sub_pos", T.comps(F.col("id")).alias("c")).where("c IS NOT NULL")
    by_id, by_place = W.partitionBy("doc_id", "sec_pos").orderBy("c", "sub_pos"), W.partitionBy("doc_id", "sec_pos").orderBy("sub_pos", "c")
    r = l.select("doc_id", "sec_pos", F.row_number().over(by_id).alias("a"), F.row_number().over(by_place).alias("b"), F.lag("c").over(by_place).alias("p"), "c")
    return r.groupBy("doc_id", "sec_pos").agg(F.bool_and(F.col("a") == F.col("b")).alias("in_order"), F.bool_and(F.coalesce(F.col("p") < F.col("c"), F.lit(True))).alias("strict"), F.count("*").alias("n"))


def slice_between_positions(s, d):
    """Each section's joined text cut at the places where its subsections begin, found one behind the other."""
    whole = _subs(s, d).where("trim(content) <> ''").groupBy("doc_id", "sec_pos").agg(pages.joined(F.collect_list(F.struct("sub_pos", F.col("content").alias("s"))), " ; ").alias("text"))
    probe = _subs(s, d).where("trim(content) <> ''").select("doc_id", "sec_pos", "sub_pos", F.substring("content", 1, 20).alias("key"))
    found = probe.join(whole, ["doc_id", "sec_pos"]).withColumn("at", F.expr("instr(text, key)"))
    found = found.groupBy("doc_id", "sec_pos", "at").agg(F.first("text").alias("text"))
    end = F.lead("at").over(W.partitionBy("doc_id", "sec_pos").orderBy("at"))
    cut = found.select("doc_id", "sec_pos", "at", F.substring(F.col("text"), F.col("at"), F.coalesce(end, F.length("text") + 1) - F.col("at")).alias("s"))
    return cut.select("doc_id", "sec_pos", F.col("at").alias("place"), F.md5(T.slice_trim(F.col("s"))).alias("slice_md5"))


def section_surgery(s, d):
    """Arrays of ids by section: one put in behind the first, the second taken out, two replaced, one appended, what leads up
    to the first number, and the first that is a number."""
    a = _subs(s, d).groupBy("doc_id", "sec_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_pos", F.coalesce("id", F.lit("")).alias("id")))), lambda x: x["id"]).alias("a")).where("size(a) >= 3")
    text = lambda c: F.array_join(c, "|")
    n = F.size("a")
    number = lambda x: x.rlike(r"^[0-9]")
    first = F.coalesce(F.get(F.filter(F.transform("a", lambda x, k: F.when(number(x), k)), lambda x: x.isNotNull()), F.lit(0)), n)
    return a.select("doc_id", "sec_pos", text(F.array_insert("a", 2, F.lit("new"))).alias("inserted"), text(F.concat(F.slice("a", 1, 1), F.slice(F.col("a"), F.lit(3), n))).alias("removed"),
                    text(F.concat(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.slice(F.col("a"), F.lit(3), n))).alias("replaced"), text(F.array_append("a", F.lit("end"))).alias("appended"),
                    text(F.slice(F.col("a"), F.lit(1), first)).alias("prefix"), F.get(F.filter("a", number), F.lit(0)).alias("first_number"))


def misfiled_items(s, d):
    """Letters beyond a that open a section of which the next subsection is its a."""
    sub = _subs(s, d).where("sec_pos >= 0").withColumn("id", F.when((F.col("sub_pos") == 0) & (F.col("doc_id") % 2 == 0), F.lit("c")).otherwise(F.col("id")))
    sub = sub.withColumn("id", F.when((F.col("sub_pos") == 1) & (F.col("doc_id") % 6 == 0), F.lit("a.")).otherwise(F.col("id")))
    return structure.misfiled(sub)


def _fresh(s, d):
    """A fresh run of the clauses of number 1 of each document."""
    return _subs(s, d).where("id RLIKE '^1[.][1-9]' AND length(content) > 30").select("doc_id", "sec_pos", "sub_pos", "id", "content")


def splice_window(s, d):
    """Where a fresh run of number 1 belongs in each document."""
    run = _fresh(s, d).where("sub_pos % 3 <> 2")
    return structure.splice_window(_sections(s, d), _subs(s, d).withColumn("id", F.when(F.col("sub_pos") % 4 == 3, F.concat(F.lit("2."), F.col("sub_pos").cast("string"))).otherwise(F.col("id"))), run, "1")


def sanitize_run(s, d):
    """The parts of fresh runs, cut where an id comes again; the ids of order lines are such runs."""
    l = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.min(F.concat(F.lit("1."), (F.col("l_partkey") % 4 + 1).cast("string"))).alias("id"))
    return structure.run_segments(l)


QUERIES = {f.__name__: f for f in (queue_flags, queue_next, queue_new_entries, fallback_policy, history_json, history_today_split, first_page_containing, positional_zip, paragraph_starts, open_section_carry,
                                   keys_longest_first, preview_caps, text_codec, chunk_math, id_set_relations, id_normalization, dictionary_ops, exactly_one_candidate, flag_union, anchor_order_guard,
                                   slice_between_positions, section_surgery, misfiled_items, splice_window, sanitize_run)}
QUEUE = """q AS (SELECT user_id, CAST(event_id AS VARCHAR) AS path, event_id AS arrival, ['waiting', 'awaitingConfirmation', 'converting', 'done', 'failed', 'cancelled'][CAST(event_id % 6 AS INT) + 1] AS state, event_id % 150 AS pages,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_text, CASE WHEN event_id % 4 > 0 THEN event_id % 7000 END AS secs FROM events)"""
COMPS2 = "list_transform(list_filter(string_split({0}, '.'), lambda x: x <> ''), lambda x: CAST(x AS INT))"

SQL = {
    "queue_flags": f"""WITH {QUEUE} SELECT path, state = 'converting' AS active, state IN ('done', 'failed', 'cancelled') AS finished, state IN ('converting', 'waiting') AS busy,
  pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END || CASE WHEN has_text THEN ' · text layer' WHEN NOT has_text THEN ' · scanned' ELSE '' END AS pill, (secs // 60) || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') AS duration FROM q""",
    "queue_next": f"""WITH {QUEUE}, r AS (SELECT * FROM q WHERE user_id % 2 = 0 OR state <> 'converting')
SELECT user_id, path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS rn FROM r WHERE state = 'waiting' AND user_id NOT IN (SELECT user_id FROM r WHERE state = 'converting')) WHERE rn = 1""",
    "queue_new_entries": f"WITH {QUEUE} SELECT DISTINCT path FROM q WHERE (arrival % 5 < 3 OR arrival % 7 = 1) AND path NOT IN (SELECT path FROM q WHERE state IN ('waiting', 'converting'))",
    "fallback_policy": """WITH e AS (SELECT event_id, ['success', 'empty', 'providerError', 'truncated'][CAST(event_id % 4 AS INT) + 1] AS kind, CAST([0, 400, 429, 500, 503, 404][CAST(event_id % 6 AS INT) + 1] AS INT) AS code FROM events)
SELECT event_id, kind, code, kind = 'empty' OR (kind = 'providerError' AND (code IN (0, 429) OR code >= 500)) AS worth FROM e""",
    "history_json": "SELECT name, output_path, warning, warning IS NOT NULL AS has_warning FROM history",
    "history_today_split": f"SELECT CAST(ts AS DATE) = DATE '{TODAY}' AS is_today, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM (SELECT CAST(ts AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts FROM history) GROUP BY 1, 2",
    "first_page_containing": f"""WITH {CLEAN}, {SUB}, st AS (SELECT doc_id, min(sec_pos) FILTER (regexp_matches(coalesce(id, ''), '[^\\s\\p{{Z}}]') OR regexp_matches(coalesce(title, ''), '[^\\s\\p{{Z}}]')) AS start FROM sec GROUP BY 1),
k AS (SELECT doc_id, sec_pos, sub_pos, substr({fold('content')}, 1, 32) AS key FROM sub JOIN st USING (doc_id) WHERE length({fold('content')}) >= 12 AND sec_pos >= start),
f AS (SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec_pos, sub_pos, key) AS rn FROM k) WHERE rn = 1)
SELECT f.doc_id, f.key, min(pos) AS pos FROM f JOIN cp p ON p.doc_id = f.doc_id AND contains({fold('p.text')}, f.key) GROUP BY 1, 2""",
    "positional_zip": f"""WITH {KEYS}, fl AS (SELECT k.*, f.key IS NOT NULL AS furniture, row_number() OVER (PARTITION BY k.doc_id, k.key ORDER BY pos, line_no) AS rn FROM kd k LEFT JOIN fk f ON f.doc_id = k.doc_id AND f.key = k.key),
st AS (SELECT doc_id, pos, count(*) AS n, bool_or(regexp_matches(line, '[^\\s\\p{{Z}}]')) AS some FROM fl WHERE NOT furniture OR rn = 1 GROUP BY 1, 2)
SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.pos) - 1 AS INT) AS k, c.pos, CAST(len(string_split(c.text, chr(10))) - CASE WHEN s.some THEN s.n ELSE 0 END AS INT) AS gone FROM cp c LEFT JOIN st s USING (doc_id, pos)""",
    "paragraph_starts": f"""WITH {CLEAN}, l AS (SELECT doc_id, pos, line_no, {trim('line')} AS t FROM ln),
m AS (SELECT *, CASE WHEN ends_with(lag(t) OVER w, '.') AND regexp_matches(t, '^\\p{{Lu}}') THEN 1 ELSE 0 END AS new FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id, pos ORDER BY line_no)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, pos ORDER BY line_no) AS paragraph FROM m),
g AS (SELECT doc_id, pos, paragraph, string_agg(t, chr(10) ORDER BY line_no) AS raw FROM p GROUP BY 1, 2, 3), r AS (SELECT doc_id, pos, CAST(paragraph AS BIGINT) AS paragraph, {REFLOW.format('raw')} AS text FROM g)
SELECT doc_id, pos, paragraph, md5(text) AS text_md5, CAST(coalesce(sum(length({fold('text')})) OVER (PARTITION BY doc_id, pos ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r""",
    "open_section_carry": f"""WITH {SUB} SELECT doc_id, sec_pos, last_value(nullif({trim("coalesce(id, '') || ' ' || coalesce(title, '')")}, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec_pos) AS open FROM sec""",
    "keys_longest_first": f"WITH {KEYS} SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, key) AS INT) AS place FROM fk",
    "preview_caps": r"""WITH a AS (SELECT answer_id, string_split(substr(_markdown, 1, 60000), chr(10)) AS l FROM answer WHERE _markdown IS NOT NULL),
b AS (SELECT *, flatten(list_transform(l[1:600], lambda x: CASE WHEN len(string_split(x, '**')) % 2 = 1 THEN list_filter(string_split(x, '**'), lambda y, i: i % 2 = 0) ELSE [] END)) AS bold FROM a)
SELECT answer_id, CAST(least(len(l), 600) AS INT) AS shown, CAST(greatest(len(l) - 600, 0) AS INT) AS hidden, array_to_string(bold[1:20], '|') AS bold, CAST(len(bold) AS INT) AS n_bold FROM b""",
    "text_codec": "SELECT doc_id, base64(encode(substr(text, 1, 300))) AS plain, rtrim(replace(replace(base64(encode(substr(text, 1, 300))), '+', '-'), '/', '_'), '=') AS url, substr(text, 1, 300) AS back FROM documents WHERE text IS NOT NULL",
    "chunk_math": f"""WITH {CLEAN}, t AS (SELECT doc_id, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS total FROM cp GROUP BY 1)
SELECT doc_id, total, CAST(ceil(total / 2000.0) AS BIGINT) AS parts, total // ((total + 1999) // 2000) + 1 AS target, (total * 2) // 5 AS least, round(100.0 * total / greatest(1, total + 1000), 6) AS percent FROM t""",
    "id_set_relations": f"""WITH {IDS}, u AS (SELECT coalesce(s.doc_id, l.doc_id) AS doc_id, s.id AS a, l.id AS b FROM src s FULL JOIN lab l ON s.doc_id = l.doc_id AND s.id = l.id)
SELECT doc_id, CAST(count(*) FILTER (b IS NULL) AS INT) AS only_source, CAST(count(*) FILTER (a IS NULL) AS INT) AS only_labels, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS INT) AS both, CAST(count(*) AS INT) AS either,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) = 0 AS disjoint, count(*) FILTER (b IS NULL) = 0 AS subset FROM u GROUP BY 1""",
    "id_normalization": f"""WITH s0 AS (SELECT DISTINCT sub_id, doc_id, sec_pos, sub_pos, coalesce(id, '') AS i, coalesce(content, '') AS c FROM subsections),
s1 AS (SELECT sub_id, CASE sub_pos % 4 WHEN 0 THEN ' ' || i || '. ' WHEN 1 THEN i || '.' ELSE i END AS id, CASE sub_pos % 4 WHEN 0 THEN i || '. ' || c WHEN 1 THEN i || '.500 EUR' WHEN 2 THEN i || chr(9) || c ELSE c END AS content FROM s0),
s2 AS (SELECT *, {NORM.format('id')} AS n, {trim('content')} AS t, {COMPS} AS comps FROM s1), s3 AS (SELECT *, substr(t, length(n) + 1) AS rest FROM s2), s4 AS (SELECT *, regexp_replace(rest, '^\\.', '') AS dotted FROM s3)
SELECT sub_id, n AS norm, array_to_string(comps, '/') AS parts, split_part(n, '.', 1) AS family, md5(CASE WHEN n <> '' AND starts_with(t, n) AND NOT regexp_matches(dotted, '^[0-9]') AND (rest = '' OR regexp_matches(rest, '^\\.?[\\s\\p{{Z}}]|^\\.$')) THEN {trim('dotted')} ELSE t END) AS content_md5,
regexp_replace(id, '([\\\\.\\[\\]{{}}()*+?^$|/-])', '\\\\\\1', 'g') AS pattern, coalesce(len(comps), 0) || CASE WHEN coalesce(len(comps), 0) = 1 THEN ' part' ELSE ' parts' END AS counted FROM s4""",
    "dictionary_ops": f"""WITH {SUB}, l AS (SELECT DISTINCT doc_id, sec_pos, sub_pos, {NORM.format('id')} AS label, content FROM sub WHERE regexp_matches({NORM.format('id')}, '^[0-9]+[.][0-9]+$'))
SELECT doc_id, split_part(label, '.', 1) AS family, count(*) AS n, count(DISTINCT label) AS labels, min(sec_pos) AS first_section FROM l GROUP BY 1, 2""",
    "exactly_one_candidate": f"WITH {SUB} SELECT doc_id, {NORM.format('id')} AS label, min(sec_pos) AS sec_pos FROM sub WHERE {NORM.format('id')} <> '' GROUP BY 1, 2 HAVING count(DISTINCT sec_pos) = 1",
    "flag_union": f"""WITH {BARE}, u AS (SELECT doc_id, section FROM bare UNION SELECT doc_id, {NORM.format('id')} || '.1' FROM sections WHERE regexp_matches({NORM.format('id')}, '^[0-9]') AND doc_id % 4 = 0)
SELECT doc_id, string_agg(section, ',' ORDER BY section) AS sections FROM u GROUP BY 1""",
    "anchor_order_guard": f"""WITH {SUB}, l AS (SELECT DISTINCT doc_id, sec_pos, sub_pos, content, {COMPS2.format(NORM.format('id'))} AS c FROM sub WHERE regexp_matches({NORM.format('id')}, '^[0-9]+([.][0-9]+)*$')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_pos ORDER BY c, sub_pos) AS a, row_number() OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos, c) AS b, lag(c) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos, c) AS p FROM l)
SELECT doc_id, sec_pos, bool_and(a = b) AS in_order, bool_and(coalesce(p < c, true)) AS strict, count(*) AS n FROM r GROUP BY 1, 2""",
    "slice_between_positions": f"""WITH {SUB}, s AS (SELECT DISTINCT doc_id, sec_pos, sub_pos, id, content FROM sub WHERE trim(content) <> ''),
w AS (SELECT doc_id, sec_pos, string_agg(content, ' ; ' ORDER BY sub_pos, content) AS text FROM s GROUP BY 1, 2),
f AS (SELECT DISTINCT doc_id, sec_pos, instr(text, substr(content, 1, 20)) AS place, text FROM s JOIN w USING (doc_id, sec_pos)),
c AS (SELECT doc_id, sec_pos, place, substr(text, place, coalesce(lead(place) OVER (PARTITION BY doc_id, sec_pos ORDER BY place), length(text) + 1) - place) AS s FROM f)
SELECT doc_id, sec_pos, CAST(place AS INT) AS place, md5(regexp_replace(s, '^[\\s\\p{{Z}},;:–-]+|[\\s\\p{{Z}},;:–-]+$', '', 'g')) AS slice_md5 FROM c""",
    "section_surgery": f"""WITH {SUB}, g AS (SELECT doc_id, sec_pos, list(coalesce(id, '') ORDER BY sub_pos, coalesce(id, '')) AS a FROM (SELECT DISTINCT doc_id, sec_pos, sub_pos, id, content FROM sub) GROUP BY 1, 2 HAVING count(*) >= 3),
h AS (SELECT *, list_filter(a, lambda x: regexp_matches(x, '^[0-9]')) AS nums, list_position(list_transform(a, lambda x: regexp_matches(x, '^[0-9]')), true) AS n FROM g)
SELECT doc_id, sec_pos, array_to_string(a[1:1] || ['new'] || a[2:], '|') AS inserted, array_to_string(a[1:1] || a[3:], '|') AS removed, array_to_string(['x', 'y', 'z'] || a[3:], '|') AS replaced, array_to_string(a || ['end'], '|') AS appended,
  array_to_string(CASE WHEN coalesce(n, 0) = 0 THEN a WHEN n = 1 THEN [] ELSE a[1:n - 1] END, '|') AS prefix, nums[1] AS first_number FROM h""",
    "misfiled_items": f"""WITH {SUB}, m AS (SELECT DISTINCT doc_id, sec_pos, sub_pos, CASE WHEN sub_pos = 1 AND doc_id % 6 = 0 THEN 'a.' WHEN sub_pos = 0 AND doc_id % 2 = 0 THEN 'c' ELSE id END AS id, content FROM sub),
n AS (SELECT *, lead(id) OVER w AS nid, lead(content) OVER w AS ncontent, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY doc_id, sec_pos ORDER BY sub_pos, id, content))
SELECT doc_id, sec_pos, sub_pos, {NORM.format('id')} AS id FROM n WHERE rn = 1 AND regexp_matches({NORM.format('id')}, '^[\\p{{L}}]$') AND {NORM.format('id')} <> 'a' AND ({NORM.format('nid')} = 'a' OR regexp_matches({trim("coalesce(ncontent, '')")}, '^a[.)]\\s'))""",
    "splice_window": f"""WITH {SUB}, s AS (SELECT DISTINCT doc_id, sec_pos, sub_pos, CASE WHEN sub_pos % 4 = 3 THEN '2.' || sub_pos ELSE id END AS id, content FROM sub),
run AS (SELECT DISTINCT doc_id, {NORM.format('id')} AS rid, substr({fold('content')}, 1, 48) AS key FROM sub WHERE regexp_matches(id, '^1[.][1-9]') AND length(content) > 30 AND sub_pos % 3 <> 2),
many AS (SELECT doc_id FROM run WHERE length(key) >= 12 GROUP BY 1 HAVING count(*) >= 2),
a AS (SELECT s.*, {NORM.format('s.id')} AS nid, substr({fold("coalesce(s.content, '')")}, 1, 48) AS k, row_number() OVER (PARTITION BY s.doc_id, s.sec_pos ORDER BY sub_pos, s.id, s.content) AS rn FROM s JOIN many USING (doc_id)
  WHERE (s.doc_id, s.sec_pos) NOT IN (SELECT doc_id, sec_pos FROM sec WHERE contains(lower(concat_ws(' ', id, title)), 'inhaltsverzeichnis'))),
b AS (SELECT *, split_part(nid, '.', 1) = '1' AS inside, length(k) >= 12 AND EXISTS (SELECT 1 FROM run r WHERE r.doc_id = a.doc_id AND length(r.key) >= 12 AND (starts_with(r.key, a.k) OR starts_with(a.k, r.key))) AS hit FROM a),
c AS (SELECT *, rn - row_number() OVER (PARTITION BY doc_id, sec_pos ORDER BY rn) AS block FROM b WHERE inside),
e AS (SELECT doc_id, sec_pos, block, count(*) FILTER (hit) AS score, min(rn) FILTER (hit) AS lo, max(rn) FILTER (hit) AS hi FROM c GROUP BY 1, 2, 3 HAVING count(*) FILTER (hit) >= 2)
SELECT doc_id, sec_pos, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sec_pos, lo) AS n FROM e) WHERE n = 1""",
    "sanitize_run": """WITH RECURSIVE l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos, id FROM (SELECT l_orderkey, l_linenumber, min('1.' || (l_partkey % 4 + 1)) AS id FROM lineitem GROUP BY 1, 2)),
f AS (SELECT doc_id, pos, id, [id] AS seen, 0 AS segment FROM l WHERE pos = 1
  UNION ALL SELECT l.doc_id, l.pos, l.id, CASE WHEN list_contains(f.seen, l.id) THEN [l.id] ELSE list_append(f.seen, l.id) END, f.segment + CASE WHEN list_contains(f.seen, l.id) THEN 1 ELSE 0 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1)
SELECT doc_id, CAST(segment AS INT) AS segment, string_agg(id, ',' ORDER BY pos) AS ids FROM f GROUP BY 1, 2""",
    "audit_warning": f"""WITH {WARNING}, lost AS (WITH {PLANTED_ITEMS} SELECT * FROM items WHERE doc_id % 7 = 0 AND (doc_id, pos, line_no) NOT IN (SELECT doc_id, pos, line_no FROM hits)),
lost_w AS (SELECT doc_id, CASE WHEN count(*) = 1 THEN 'List item ' ELSE 'List items ' END || array_to_string((list('"' || token || '" (page ' || page_no || ')' ORDER BY pos, line_no))[1:6], ', ') || ' could not be placed; compare with the source.' AS w FROM lost GROUP BY 1)
SELECT doc_id, concat_ws(' ', m.w, i.w, b.w, CASE WHEN coalesce(m.w, i.w, b.w) IS NOT NULL THEN 'Compare these places with the source or convert it again.' END, l.w) AS warning
FROM missing_w m FULL JOIN invented_w i USING (doc_id) FULL JOIN bare_w b USING (doc_id) FULL JOIN lost_w l USING (doc_id)""",
}
