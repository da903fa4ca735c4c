"""Queries of structure, score, rendering, decoding and history, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import decode, history, pages, render, score, structure
from pagewright.plans import planted
from pagewright.plans.oracle import CLEAN, IDS, fold, letters, trim
from pagewright.sources import table

LINES = 3  # sections of a part in the merge query


def _page(s, d):
    return table(s, d, "page")


def _sections(s, d):
    return table(s, d, "sections").select("doc_id", "sec_pos", "id", "title").distinct()


def _subs(s, d):
    return table(s, d, "subsections").select("sub_id", "doc_id", "sec_pos", "sub_pos", "id", "content").distinct()


def score_report(s: SparkSession, d: str) -> DataFrame:
    """One row for each document with clause ids: what the sections cover of the pages, in ids and in long words, and how
    the labels stand."""
    subs, none = _subs(s, d), F.array().cast("array<string>")
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(T.dehyphenate(c), F.lit(score.LONG), F.lit(0)), F.lower))
    src = score.source_text(_page(s, d)).select("doc_id", T.clause_ids(F.col("text")).alias("ids"), words(F.col("text")).alias("words")).where("size(ids) > 0")
    label = subs.select("doc_id", "sec_pos", "id", words(F.coalesce("content", F.lit(""))).alias("words")).unionByName(_sections(s, d).select("doc_id", "sec_pos", "id", none.alias("words")))
    ans = label.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(T.clause_ids(F.coalesce("id", F.lit("")))))).alias("labels"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("have"))
    toc = structure.contents_table(_sections(s, d))
    own = subs.join(toc, ["doc_id", "sec_pos"], "left_anti")
    dup = score.duplicate_labels(own).groupBy("doc_id").agg(F.count("*").alias("n_duplicates"))
    flip = score.order_flips(own).groupBy("doc_id").agg(F.count("*").alias("n_flips"))
    out = src.join(ans, "doc_id", "left").join(dup, "doc_id", "left").join(flip, "doc_id", "left").na.fill(0, ["n_duplicates", "n_flips"])
    n = lambda a: F.size(a).cast("bigint")
    out = out.select("doc_id", n(F.col("ids")).alias("n_source"), n(F.array_intersect("ids", F.coalesce("labels", none))).alias("n_covered"), n(F.col("words")).alias("n_words"),
                     n(F.array_intersect("words", F.coalesce("have", none))).alias("n_recalled"), "n_duplicates", "n_flips")
    percent = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)
    return out.withColumn("coverage", percent("n_covered", "n_source")).withColumn("recall", percent("n_recalled", "n_words"))


def score_missing_words(s, d):
    words = score.long_words(score.source_text(_page(s, d)), "doc_id", "text")
    have = score.long_words(_subs(s, d).where("content IS NOT NULL"), "doc_id", "content")
    return words.join(have, ["doc_id", "word"], "left_anti")


def merge_answer_scalars(s, d):
    m = structure.merge_scalars(table(s, d, "answer"), "answer_id", ("title", "reference", "date", "notary"), ("annotations",))
    return m.withColumn("annotations", F.array_join("annotations", "|"))


def merge_sections(s, d):
    sec = _sections(s, d).select("doc_id", F.expr(f"sec_pos div {LINES}").alias("part"), F.expr(f"sec_pos % {LINES}").alias("sec"), "id", "title")
    return structure.merge_sections(sec)


def _markdown(s, d):
    return render.sections_markdown(_sections(s, d), _subs(s, d))


def _named(s, d):
    """Answers with the name of their document, without the file's ending."""
    name = F.regexp_replace(F.regexp_extract("source_name", r"([^/]*)$", 1), r"\.[^./]+$", "")
    return table(s, d, "answer").drop("source").join(table(s, d, "doc").select("doc_id", name.alias("name")), "doc_id", "left")


def _parties(s, d):
    return table(s, d, "parties").select("party_id", "doc_id", "pos", "name", "role", "details").distinct()


def render_markdown(s, d):
    """Each answer as a whole document; of every fifth the raw reply stands below it."""
    a = _named(s, d).withColumn("raw_response", F.when(F.col("answer_id") % 5 == 0, F.concat(F.lit("{"), F.coalesce("title", F.lit("")))))
    return render.document(a, "answer_id", _markdown(s, d), render.parties_markdown(_parties(s, d)))


def markdown_labels(s, d):
    return score.markdown_labels(_markdown(s, d), "doc_id", "markdown").select("doc_id", "sec", "line_no", "label", "content")


def _answers(s, d):
    return table(s, d, "answer").select("answer_id", F.col("_markdown").alias("md")).where("md IS NOT NULL")


def completeness_guard(s, d):
    total = pages.content_pages(_page(s, d)).groupBy("doc_id").agg(F.sum(F.length("text")).alias("total"))
    md = _markdown(s, d).select("doc_id", F.length("markdown").cast("bigint").alias("rendered"))
    j = total.join(md, "doc_id", "left").na.fill(0, ["rendered"])
    return j.withColumn("rejected", F.expr("rendered < (total * 2) div 5")).withColumn("second_most", F.expr("least(80000, total div 2)"))


def label_text(s, d):
    """The labels that each answer claims, as they stand; null for answers that are Markdown and for those without sections."""
    lab = _sections(s, d).select("doc_id", "sec_pos", F.lit(-1).alias("sub_pos"), F.col("id").alias("s")).unionByName(_subs(s, d).select("doc_id", "sec_pos", "sub_pos", F.col("id").alias("s")))
    g = lab.groupBy("doc_id").agg(pages.joined(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("sec_pos", "sub_pos", "s"))), "\n").alias("labels"))
    return table(s, d, "answer").join(g, "doc_id", "left").select("answer_id", F.when(F.col("_markdown").isNull(), F.col("labels")).alias("labels"))


def outcome_chat(s, d):
    """Bodies made of answers: some with errors or cut ends."""
    body = F.to_json(F.struct(F.when(F.col("answer_id") % 11 == 0, F.struct(F.when(F.col("answer_id") % 2 == 0, 429).otherwise(400).alias("code"), F.lit("no").alias("message"))).alias("error"),
                              F.array(F.struct(F.when(F.col("answer_id") % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
                                               F.struct(F.col("title").alias("content")).alias("message"))).alias("choices")))
    df = table(s, d, "answer").select("answer_id", "title", body.alias("body"))
    return decode.chat_outcome(df, "body").select("answer_id", "kind", F.coalesce("code", F.lit(-1)).alias("code"), "content", "transient")


def outcome_candidates(s, d):
    reason = F.when(F.col("answer_id") % 5 == 0, "MAX_TOKENS").when(F.col("answer_id") % 13 == 0, "SAFETY").otherwise("STOP")
    body = F.to_json(F.struct(F.array(F.struct(reason.alias("finishReason"), F.struct(F.array(F.struct(F.col("title").alias("text")), F.struct(F.col("reference").alias("text"))).alias("parts"))
                                               .alias("content"))).alias("candidates")))
    df = table(s, d, "answer").select("answer_id", body.alias("body"))
    return decode.candidate_outcome(df, "body").select("answer_id", "kind", "content")


def parse_json_ladder(s, d):
    """Whole answers inside replies that are whole, fenced, with raw line breaks in a string, inside other words, both, or no
    objects."""
    sub = _subs(s, d).groupBy("doc_id", "sec_pos").agg(F.array_sort(F.collect_list(F.struct("sub_pos", "id", "content"))).alias("x"))
    sec = _sections(s, d).join(sub, ["doc_id", "sec_pos"], "left").select("doc_id", F.struct(
        "sec_pos", "id", "title", F.transform(F.coalesce("x", F.array()), lambda y: F.struct(y["id"].alias("id"), y["content"].alias("content"))).alias("subsections")).alias("x"))
    whole = sec.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("sections"))
    a = table(s, d, "answer").join(whole, "doc_id", "left").withColumn("notary", F.lit("before@@behind"))
    js = F.to_json(F.struct("title", "reference", "notary", "annotations", "signatures", F.transform("sections", lambda x: x.dropFields("sec_pos")).alias("sections")))
    broken = F.replace(js, F.lit("@@"), F.lit("\n"))
    k = F.col("answer_id") % 6
    around = lambda x: F.concat(F.lit('He said "here": '), x, F.lit(" Done."))
    raw = (F.when(k == 0, js).when(k == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(k == 2, broken).when(k == 3, around(js)).when(k == 4, around(broken)).otherwise(F.lit("no object")))
    out = decode.parse_ladder(a.select("answer_id", raw.alias("reply")), "reply")
    subs = F.flatten(F.transform("answer.sections", lambda x: x["subsections"]))
    text = F.array_join(F.transform(subs, lambda y: F.concat(F.coalesce(y["id"], F.lit("")), F.lit(":"), F.coalesce(y["content"], F.lit("")))), "|")
    return out.select("answer_id", "rung", F.col("answer.title").alias("title"), F.replace("answer.notary", F.lit("\n"), F.lit("@@")).alias("notary"),
                      F.size(F.coalesce("answer.signatures", F.array())).alias("n_signatures"), F.size(F.coalesce("answer.sections", F.array())).alias("n_sections"),
                      F.md5(F.coalesce(text, F.lit(""))).alias("subsections_md5"), "raw")


def demote_letter_sections(s, d):
    """The subsections after stray letter sections went back into their enumerations."""
    return structure.demoted(planted.lettered(s, d), _subs(s, d)).withColumn("content", F.md5(F.coalesce("content", F.lit(""))))


def merge_parts(s, d):
    """Sections of three to a part put together again, with their subsections."""
    part = lambda df: df.withColumn("part", F.expr(f"sec_pos div {LINES}")).withColumn("sec", F.expr(f"sec_pos % {LINES}"))
    m = structure.merged_subsections(part(_sections(s, d)).select("doc_id", "part", "sec", "id", "title"), part(_subs(s, d)).select("doc_id", "part", "sec", "sub_pos", "id", "content"))
    return m.select("doc_id", "out_section", "id", "title", "sub_pos", "sub_id", F.md5("content").alias("content_md5"))


def text_fold(s, d):
    c = _subs(s, d).where("content IS NOT NULL")
    return c.select("sub_id", F.md5(T.fold(F.col("content"))).alias("fold_md5"), T.fingerprint(F.col("content"), 32, 12).alias("fingerprint"),
                    T.norm_id(F.col("id")).alias("norm_id"), F.array_join(T.comps(F.col("id")).cast("array<string>"), ".").alias("numeric"))


def id_kinds(s, d):
    i = F.trim(F.coalesce("id", F.lit("")))
    return _subs(s, d).select("sub_id", F.regexp_replace(i, r"\.+$", "").rlike(structure.LETTER).alias("letter"), i.rlike(r"^\(|^[a-z]{1,2}$").alias("enumerator"),
                              F.split_part(T.norm_id(F.col("id")), F.lit("."), F.lit(1)).alias("family"))


def heading_candidates(s, d):
    t = pages.lines(_page(s, d)).withColumn("t", T.trim(F.col("line"))).where(T.letters(F.col("t")) >= 4)
    return t.where(structure.heading_like(F.col("t"))).select("doc_id", "pos", "line_no", F.col("t").alias("heading"))


def retry_schedule(s, d):
    e = table(s, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt"),
                                     F.when(F.col("event_id") % 17 == 0, 429).otherwise(500).alias("code"))
    return history.retry_schedule(e.withColumnRenamed("user_id", "key"))


def reflow_text(s, d):
    return pages.content_pages(_page(s, d)).select("doc_id", "pos", F.md5(T.reflow(F.col("text"))).alias("reflow_md5"))


QUERIES = {
    "score_report": score_report, "score_missing_words": score_missing_words,
    "score_duplicate_labels": lambda s, d: score.duplicate_labels(planted.labels(s, d)), "score_order_flips": lambda s, d: score.order_flips(planted.labels(s, d)),
    "numbering_blocks": lambda s, d: structure.blocks(_subs(s, d)), "family_segments": lambda s, d: structure.families(_subs(s, d)),
    "numbering_restarts": lambda s, d: structure.restarts(planted.renumbered(s, d)), "demote_letter_sections": demote_letter_sections, "merge_parts": merge_parts,
    "letter_sections": lambda s, d: structure.demote_letters(planted.lettered(s, d), _subs(s, d)),
    "dedupe_enumerations": lambda s, d: structure.duplicated_items(planted.doubled(s, d)), "merge_answer_scalars": merge_answer_scalars, "merge_sections": merge_sections,
    "enumeration_items": lambda s, d: structure.items(_page(s, d)), "item_presence": lambda s, d: structure.item_hits(structure.items(_page(s, d)), _subs(s, d)),
    "item_insertion_target": lambda s, d: structure.insertion_targets(structure.items(planted.pages_of_items(s, d)), planted.thinned(s, d)),
    "front_matter_sections": lambda s, d: structure.front_matter(_sections(s, d)), "front_matter_missing": lambda s, d: structure.front_matter_missing(_page(s, d), _subs(s, d)),
    "heading_candidates": heading_candidates, "heading_above_line": lambda s, d: structure.heading_above(_page(s, d)),
    "render_markdown": render_markdown, "render_sections": _markdown, "markdown_labels": markdown_labels, "preview_classify": lambda s, d: render.classify_lines(_answers(s, d), "answer_id", "md"),
    "completeness_guard": completeness_guard, "label_text": label_text, "outcome_chat": outcome_chat, "outcome_candidates": outcome_candidates, "parse_json_ladder": parse_json_ladder,
    "text_fold_fingerprint": text_fold, "enumerator_ids": id_kinds, "history_newest": lambda s, d: history.newest(table(s, d, "history")).select("name", "output_path", F.unix_timestamp("ts").alias("epoch_s"), "warning"),
    "history_unqueued": lambda s, d: history.unqueued(table(s, d, "history"), table(s, d, "history").where("warning IS NOT NULL")),
    "path_parts": lambda s, d: history.path_parts(table(s, d, "history").select("output_path").distinct(), "output_path"), "retry_schedule": retry_schedule, "reflow_text": reflow_text,
}

SUB = "sub AS (SELECT DISTINCT sub_id, doc_id, sec_pos, sub_pos, id, content FROM subsections),\nsec AS (SELECT DISTINCT doc_id, sec_pos, id, title FROM sections)"
NORM = r"regexp_replace(coalesce({0}, ''), '^[ .]+|[ .]+$', '', 'g')"
COMPS = r"(CASE WHEN len(list_filter(string_split({0}, '.'), lambda x: x <> '')) > 0 AND len(list_filter(string_split({0}, '.'), lambda x: x <> '' AND NOT regexp_matches(x, '^[+]?[0-9]{{1,9}}$'))) = 0 THEN list_transform(list_filter(string_split({0}, '.'), lambda x: x <> ''), lambda x: CAST(x AS INT)) END)".format(NORM.format("id"))
DEHYPH = r"regexp_replace(regexp_replace(regexp_replace({0}, '\x{{ad}}[\s\p{{Z}}]*', '', 'g'), '([a-zäöüß])-\s*\n\s*([a-zäöüß])', '\1\2', 'g'), '([a-zäöüß])-([a-zäöüß])', '\1\2', 'g')"
WORDS = "SELECT DISTINCT doc_id, lower(w) AS word FROM (SELECT doc_id, unnest(regexp_extract_all({0}, '[A-Za-zÄÖÜäöüß]{{12,}}')) AS w FROM {1})"
DUP = f"SELECT doc_id, sec_pos, label, count(*) AS n FROM (SELECT doc_id, sec_pos, {NORM.format('id')} AS label FROM sub) WHERE regexp_matches(label, '^[0-9]+(\\.[0-9]+)*$') GROUP BY 1, 2, 3 HAVING count(*) > 1"
FLIP = rf"""SELECT doc_id, sec_pos, sub_pos, label, before FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos) AS before FROM
  (SELECT doc_id, sec_pos, sub_pos, {NORM.format('id')} AS label FROM sub) WHERE regexp_matches(label, '^[0-9]+(\.[0-9]+)*$'))
  WHERE regexp_replace(label, '[0-9]+$', '') = regexp_replace(before, '[0-9]+$', '') AND TRY_CAST(regexp_extract(label, '([0-9]+)$', 1) AS BIGINT) < TRY_CAST(regexp_extract(before, '([0-9]+)$', 1) AS BIGINT)"""
WORD_CTES = f"""{IDS}, {SUB},
txt AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM cp GROUP BY 1),
sw AS ({WORDS.format(DEHYPH.format('text'), 'txt')}), aw AS ({WORDS.format(DEHYPH.format('content'), 'sub')})"""


def islands(flag: str) -> str:
    return f"""WITH {SUB}, s AS (SELECT doc_id, sec_pos, sub_pos, {COMPS} AS c FROM sub),
a AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
b AS (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN p IS NOT NULL AND {flag} THEN 1 ELSE 0 END AS f FROM a),
g AS (SELECT *, first_value(f IGNORE NULLS) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf,
  lag(c) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos) AS lc, row_number() OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos) AS i FROM b)
SELECT doc_id, sec_pos, sub_pos, CAST(sum(CASE WHEN nf = 1 AND (i = 1 OR lc IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos) AS BIGINT) AS block FROM g"""


REFLOW = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\p{{Zs}}\t]*\n[\s\p{{Zs}}]*', chr(10), 'g'), '(\p{{Ll}})-\n(\p{{Ll}})', '\1\2', 'g'), '\n+', ' ', 'g'), '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g')"
ITEMS = CLEAN + rf""", {SUB},
l0 AS (SELECT *, regexp_extract(line, '^([a-z]{{1,2}}\.|\((?:[ivxlcdm]+|[a-z]{{1,2}}|[0-9]{{1,2}})\))(\s)', 1) AS tk FROM ln WHERE regexp_matches(line, '[^\s\p{{Z}}]')),
l1 AS (SELECT *, {trim('substr(line, length(tk) + 1)')} AS tail FROM l0),
l2 AS (SELECT *, CASE WHEN tk <> '' AND length(tail) >= 8 THEN tk END AS token FROM l1),
l3 AS (SELECT *, sum(CASE WHEN token IS NOT NULL OR regexp_matches({trim('line')}, '^[0-9]{{1,2}}(\.[0-9]{{1,2}})*\.?(\s|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY line_no) AS grp FROM l2),
i0 AS (SELECT doc_id, pos, page_no, grp, min(line_no) AS line_no, max(token) AS token, string_agg(CASE WHEN token IS NOT NULL THEN tail ELSE line END, chr(10) ORDER BY line_no) AS raw FROM l3 GROUP BY 1, 2, 3, 4),
i1 AS (SELECT doc_id, pos, page_no, CAST(line_no AS INT) AS line_no, token, regexp_replace(token, '\.$', '', 'g') AS id, {REFLOW.format('raw')} AS text FROM i0 WHERE token IS NOT NULL),
i2 AS (SELECT *, CASE WHEN length({fold('text')}) >= 12 THEN substr({fold('text')}, 1, 32) END AS key FROM i1),
items AS (SELECT * FROM (SELECT *, lag(key) OVER w AS anchor, lag(id) OVER w AS anchor_id FROM i2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos, line_no)) WHERE key IS NOT NULL),
sf AS (SELECT doc_id, sec_pos, sub_pos, {NORM.format('lower(id)')} AS sid, {fold('content')} AS n FROM sub),
hits AS (SELECT i.doc_id, i.pos, i.line_no, s.sec_pos, s.sub_pos, s.sid = lower(i.id) AS same_id FROM items i JOIN sf s ON s.doc_id = i.doc_id AND contains(s.n, i.key))"""
PLANTED_ITEMS = f"{planted.PAGES_OF_ITEMS}, " + ITEMS.replace(SUB, f"sub AS ({planted.THINNED})")
HEAD_I = r"regexp_replace(trim(coalesce(id, '')), '\.+$', '')"
TRIM_ALL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
UNDOT = r"regexp_replace(coalesce({0}, ''), '\.+$', '')"
MD = SUB + rf""",
h0 AS (SELECT doc_id, sec_pos, {UNDOT.format('id')} AS i, coalesce(title, '') AS t FROM sec),
h AS (SELECT DISTINCT doc_id, sec_pos, i = '' AND {trim('t')} = '' AS front, {trim(r"regexp_replace(CASE WHEN starts_with(" + NORM.format('t') + ", " + NORM.format('i') + r") THEN t ELSE i || ' ' || t END, '^([0-9]+(?:\.[0-9]+)*)\.(\s)', '\1\2')")} AS h FROM h0),
b0 AS (SELECT s.*, coalesce(h.front, true) AS front, {UNDOT.format('id')} AS i, replace(coalesce(content, ''), '- , ', '-, ') AS body FROM sub s LEFT JOIN h USING (doc_id, sec_pos)),
rows_ AS (SELECT doc_id, sec_pos, -1 AS sub_pos, {trim("'## ' || h")} AS s FROM h WHERE NOT front
  UNION ALL SELECT doc_id, sec_pos, sub_pos, CASE WHEN i = '' OR (regexp_matches(i, '[\p{{L}}\p{{M}}]') AND starts_with({NORM.format('body')}, {NORM.format('i')}))
    THEN CASE WHEN front THEN regexp_replace({TRIM_ALL.format('body')}, '(?s)^(\p{{Lu}}[^:.\n]{{1,39}}):[\p{{Zs}}\t]*(.*)$', '**\1:** \2') ELSE body END ELSE '**' || i || '.** ' || body END AS s FROM b0),
md AS (SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY sec_pos, sub_pos, s) AS markdown FROM rows_ GROUP BY 1)"""
NL = "chr(10) || chr(10)"
RENDER = MD + rf""",
pt AS (SELECT doc_id, string_agg('**' || coalesce(role, '') || ':** ' || coalesce(name, 'N/A') || CASE WHEN coalesce(details, '') <> '' THEN chr(10) || '  ' || details ELSE '' END, {NL} ORDER BY pos) AS parties
  FROM (SELECT DISTINCT party_id, doc_id, pos, name, role, details FROM parties) GROUP BY 1),
an AS (SELECT a.*, regexp_replace(regexp_extract(d.source_name, '([^/]*)$', 1), '\.[^./]+$', '') AS name, CASE WHEN answer_id % 5 = 0 THEN '{{' || coalesce(title, '') END AS raw_response FROM answer a LEFT JOIN (SELECT doc_id, source_name FROM doc) d USING (doc_id))"""
DEMOTE = rf"""{SUB}, lsec AS ({planted.LETTERED}), x AS (SELECT doc_id, sec_pos, regexp_matches({HEAD_I}, '^\p{{Ll}}$') AS letter FROM (SELECT doc_id, sec_pos, max(id) AS id FROM lsec GROUP BY 1, 2)),
y AS (SELECT doc_id, sec_pos, bool_or(regexp_matches({HEAD_I}, '^\p{{Ll}}$')) AS lettered FROM sub GROUP BY 1, 2),
z AS (SELECT doc_id, sec_pos, letter, coalesce(lettered, false) AS lettered, row_number() OVER (PARTITION BY doc_id ORDER BY sec_pos) AS rn FROM x LEFT JOIN y USING (doc_id, sec_pos)),
fold AS (SELECT doc_id, sec_pos, rn, sec_pos AS head, lettered, false AS folds FROM z WHERE rn = 1
  UNION ALL SELECT z.doc_id, z.sec_pos, z.rn, CASE WHEN z.letter AND f.lettered THEN f.head ELSE z.sec_pos END, (z.letter AND f.lettered) OR z.lettered, z.letter AND f.lettered FROM fold f JOIN z ON z.doc_id = f.doc_id AND z.rn = f.rn + 1)"""
LIKE = r"(length({0}) <= 80 AND NOT regexp_matches({0}, '[,;]') AND regexp_matches({0}, '^[^\p{{L}}]*\p{{Lu}}') AND NOT regexp_matches({0}, '[.,;:–—-]$') AND NOT regexp_matches({0}, '^[0-9]{{1,2}}(\.[0-9]{{1,2}})+'))"

SQL = {
    "score_report": f"""WITH {WORD_CTES}, own AS (SELECT * FROM sub WHERE (doc_id, sec_pos) NOT IN (SELECT doc_id, sec_pos FROM sec WHERE contains(lower(concat_ws(' ', id, title)), 'inhaltsverzeichnis'))),
dup AS ({DUP.replace('FROM sub)', 'FROM own)')}), flip AS ({FLIP.replace('FROM sub)', 'FROM own)')}),
cov AS (SELECT doc_id, count(*) AS n_source, count(*) FILTER ((doc_id, id) IN (SELECT doc_id, id FROM lab)) AS n_covered FROM src GROUP BY 1),
w AS (SELECT s.doc_id, count(*) AS n_words, count(a.word) AS n_recalled FROM sw s LEFT JOIN aw a USING (doc_id, word) GROUP BY 1)
SELECT c.doc_id, n_source, n_covered, round(100.0 * n_covered / greatest(1, n_source), 6) AS coverage, coalesce(n_words, 0) AS n_words, coalesce(n_recalled, 0) AS n_recalled,
  coalesce(d.n, 0) AS n_duplicates, coalesce(f.n, 0) AS n_flips, round(100.0 * coalesce(n_recalled, 0) / greatest(1, coalesce(n_words, 0)), 6) AS recall
FROM cov c LEFT JOIN w USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM dup GROUP BY 1) d USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM flip GROUP BY 1) f USING (doc_id)""",
    "score_missing_words": f"WITH {WORD_CTES} SELECT doc_id, word FROM sw WHERE (doc_id, word) NOT IN (SELECT doc_id, word FROM aw)",
    "score_duplicate_labels": f"WITH sub AS ({planted.LABELS}) {DUP}", "score_order_flips": f"WITH sub AS ({planted.LABELS}) {FLIP}",
    "numbering_blocks": islands("NOT (p < c)"), "family_segments": islands("p[1] <> c[1]"),
    "numbering_restarts": f"""WITH sub AS ({planted.RENUMBERED}), s AS (SELECT doc_id, sec_pos, sub_pos, {COMPS} AS c FROM sub),
a AS (SELECT *, lag(c) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos) AS p FROM s WHERE c IS NOT NULL),
b AS (SELECT *, coalesce(p IS NOT NULL AND NOT (p < c) AND c = [1], false) AS re FROM a),
g AS (SELECT *, sum(CAST(re AS INT)) OVER (PARTITION BY doc_id, sec_pos ORDER BY sub_pos) AS scope FROM b),
r AS (SELECT doc_id, sec_pos, scope, min(sub_pos) AS sub_pos, count(*) AS n_ids, count(*) >= 2 AND bool_and(re OR p < c) AS good FROM g GROUP BY 1, 2, 3)
SELECT doc_id, sec_pos, sub_pos, n_ids FROM r WHERE scope > 0 AND NOT EXISTS (SELECT 1 FROM r e WHERE e.doc_id = r.doc_id AND e.sec_pos = r.sec_pos AND e.scope BETWEEN 1 AND r.scope AND NOT e.good)""",
    "letter_sections": f'WITH RECURSIVE {DEMOTE} SELECT doc_id, sec_pos, head AS "into" FROM fold WHERE folds',
    "demote_letter_sections": rf"""WITH RECURSIVE {DEMOTE},
f AS (SELECT doc_id, sec_pos, head AS "into" FROM fold WHERE folds),
j AS (SELECT s.*, f."into", f."into" IS NOT NULL AND {NORM.format('s.id')} = '' AS bare FROM (SELECT doc_id, sec_pos, sub_pos, id, coalesce(content, '') AS content FROM sub) s LEFT JOIN f USING (doc_id, sec_pos)),
tx AS (SELECT doc_id, sec_pos, string_agg(content, chr(10) ORDER BY sub_pos, content) AS texts FROM j WHERE bare AND content <> '' GROUP BY 1, 2),
u AS (SELECT doc_id, coalesce("into", sec_pos) AS "to", sec_pos, 1 AS k, sub_pos, id, content FROM j WHERE NOT bare
  UNION ALL SELECT doc_id, "into", sec_pos, 0, -1, {HEAD_I}, concat_ws(chr(10), nullif(title, ''), texts) FROM f JOIN (SELECT doc_id, sec_pos, max(id) AS id, max(title) AS title FROM lsec GROUP BY 1, 2) USING (doc_id, sec_pos) LEFT JOIN tx USING (doc_id, sec_pos))
SELECT doc_id, "to" AS sec_pos, CAST(row_number() OVER (PARTITION BY doc_id, "to" ORDER BY sec_pos, k, sub_pos, id NULLS FIRST, content) - 1 AS INT) AS sub_pos, id, md5(content) AS content FROM u""",
    "dedupe_enumerations": rf"""WITH sub AS ({planted.DOUBLED}), n AS (SELECT doc_id, sec_pos, sub_pos, coalesce(id, '') AS id, {fold("coalesce(content, '')")} AS n FROM sub)
SELECT DISTINCT a.doc_id, a.sec_pos, a.sub_pos FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.sec_pos = b.sec_pos AND b.sub_pos < a.sub_pos AND contains(b.n, a.n)
WHERE regexp_matches(a.id, '^\(|^[a-z]{{1,2}}$') AND length(a.n) >= 12""",
    "merge_answer_scalars": "SELECT doc_id, " + ", ".join(f"arg_min({c}, answer_id) FILTER (regexp_matches({c}, '[^\\s\\p{{Z}}]')) AS {c}" for c in ("title", "reference", "date", "notary"))
    + ", array_to_string(flatten(list(coalesce(annotations, []) ORDER BY answer_id)), '|') AS annotations FROM answer GROUP BY 1",
    "merge_sections": f"""WITH {SUB}, m AS (SELECT doc_id, CAST(sec_pos // {LINES} AS BIGINT) AS part, sec_pos % {LINES} AS sec, trim(coalesce(id, '')) AS id, trim(coalesce(title, '')) AS t FROM sec),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, sec) AS rn, (part > 0 AND sec = 0 AND id = '' AND t = '') AS hc FROM m),
b AS (SELECT *, last_value(CASE WHEN NOT hc OR rn = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lid FROM a)
SELECT doc_id, part, sec, CAST(sum(CASE WHEN rn = 1 OR hc THEN 0 WHEN id <> '' AND id = lid THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY rn) AS BIGINT) AS out_section FROM b""",
    "enumeration_items": f"WITH {ITEMS} SELECT doc_id, pos, page_no, line_no, token, id, text, key, anchor, anchor_id FROM items",
    "item_presence": f"WITH {ITEMS} SELECT * FROM hits",
    "item_insertion_target": f"""WITH {PLANTED_ITEMS},
lost AS (SELECT * FROM items WHERE anchor IS NOT NULL AND (doc_id, pos, line_no) NOT IN (SELECT doc_id, pos, line_no FROM hits)),
at_ AS (SELECT l.doc_id, l.pos, l.line_no, lower(l.id) AS sid, s.sid = lower(l.anchor_id) AS own, s.sec_pos, s.sub_pos FROM lost l JOIN sf s ON s.doc_id = l.doc_id AND contains(s.n, l.anchor)),
free AS (SELECT * FROM at_ a WHERE NOT EXISTS (SELECT 1 FROM sf s WHERE s.doc_id = a.doc_id AND s.sec_pos = a.sec_pos AND s.sid = a.sid))
SELECT doc_id, pos, line_no, sec_pos, sub_pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, line_no ORDER BY own DESC, sec_pos DESC, sub_pos DESC) AS rn FROM free) WHERE rn = 1""",
    "front_matter_sections": r"SELECT DISTINCT doc_id, sec_pos FROM sections WHERE NOT regexp_matches(coalesce(id, ''), '[^\s\p{Z}]') AND NOT regexp_matches(coalesce(title, ''), '[^\s\p{Z}]')",
    "front_matter_missing": f"""WITH {CLEAN}, {SUB}, fp AS (SELECT *, min(pos) OVER (PARTITION BY doc_id) AS f FROM ln),
k AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line, substr({fold('line')}, 1, 64) AS key FROM fp WHERE pos = f AND length({fold('line')}) >= 24),
n AS (SELECT doc_id, {fold("coalesce(content, '')")} AS n FROM sub)
SELECT doc_id, line_no, line FROM k WHERE EXISTS (SELECT 1 FROM n WHERE n.doc_id = k.doc_id) AND NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = k.doc_id AND contains(n.n, k.key))""",
    "heading_candidates": f"WITH {CLEAN}, t AS (SELECT doc_id, pos, CAST(line_no AS INT) AS line_no, {trim('line')} AS t FROM ln) SELECT doc_id, pos, line_no, t AS heading FROM t WHERE {letters('t')} >= 4 AND {LIKE.format('t')}",
    "heading_above_line": rf"""WITH {CLEAN}, rk AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM cp), t AS (SELECT ln.doc_id, ln.pos, rank, CAST(line_no AS INT) AS line_no, {trim('line')} AS t FROM ln JOIN rk USING (doc_id, pos)),
a AS (SELECT *, last_value(CASE WHEN {letters('t')} >= 4 AND NOT starts_with(t, '--- Seite ') THEN {{'rank': rank, 't': t}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM t)
SELECT doc_id, pos, line_no, up.t AS above, {LIKE.format('up.t')} AS heading_like FROM a WHERE up IS NOT NULL AND rank - up.rank <= 1 AND regexp_matches(t, '^[0-9]{{1,2}}(\.[0-9]{{1,2}})*\.?(\s|$)')""",
    "render_sections": f"WITH {MD} SELECT doc_id, markdown FROM md",
    "render_markdown": f"""WITH {RENDER} SELECT answer_id, CASE WHEN _markdown IS NOT NULL THEN '# ' || name || {NL} || _markdown ELSE concat_ws({NL}, '# ' || coalesce(title, name),
  CASE WHEN coalesce(reference, '') <> '' THEN '**Aktenzeichen:** ' || reference END, CASE WHEN coalesce(date, '') <> '' THEN '**Stand:** ' || date END, CASE WHEN coalesce(notary, '') <> '' THEN '**Notar/in:** ' || notary END,
  '## Beteiligte' || {NL} || parties, markdown,
  CASE WHEN len(annotations) > 0 THEN '---' || {NL} || '## Anmerkungen (Reviewer-Kommentare)' || {NL} || array_to_string(list_transform(annotations, lambda x: '- ' || x), chr(10)) END,
  CASE WHEN len(signatures) > 0 THEN '## Unterschriften' || {NL} || array_to_string(list_transform(signatures, lambda x: '- ' || array_to_string(list_filter([x.name, x.role], lambda y: y IS NOT NULL AND y <> ''), ' — ')), chr(10)) END,
  '## Raw Response' || {NL} || raw_response) || chr(10) END AS markdown FROM an LEFT JOIN md USING (doc_id) LEFT JOIN pt USING (doc_id)""",
    "merge_parts": f"""WITH {SUB}, m AS (SELECT doc_id, CAST(sec_pos // {LINES} AS BIGINT) AS part, CAST(sec_pos % {LINES} AS BIGINT) AS sec, id, title, trim(coalesce(id, '')) AS i, trim(coalesce(title, '')) AS t FROM sec),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, sec) AS rn, (part > 0 AND sec = 0 AND i = '' AND t = '') AS hc FROM m),
b AS (SELECT *, last_value(CASE WHEN NOT hc OR rn = 1 THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lid FROM a),
o AS (SELECT *, CAST(sum(CASE WHEN rn = 1 OR hc THEN 0 WHEN i <> '' AND i = lid THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY rn) AS BIGINT) AS out_section FROM b),
f AS (SELECT doc_id, out_section, arg_min(id, rn) AS x, min(rn) AS rn FROM o GROUP BY 1, 2),
r AS (SELECT o.doc_id, o.out_section, CAST(row_number() OVER (PARTITION BY o.doc_id, o.out_section ORDER BY part, sec, s.sub_pos) - 1 AS INT) AS sub_pos, s.id AS sub_id, md5(s.content) AS content_md5
  FROM o JOIN sub s ON s.doc_id = o.doc_id AND s.sec_pos = o.part * {LINES} + o.sec)
SELECT f.doc_id, f.out_section, p.id, p.title, r.sub_pos, r.sub_id, r.content_md5 FROM f JOIN o p ON p.doc_id = f.doc_id AND p.rn = f.rn LEFT JOIN r ON r.doc_id = f.doc_id AND r.out_section = f.out_section""",
    "parse_json_ladder": f"""WITH {SUB}, n AS (SELECT doc_id, CAST(count(*) AS INT) AS n FROM sec GROUP BY 1),
t AS (SELECT doc_id, string_agg(coalesce(b.id, '') || ':' || coalesce(b.content, ''), '|' ORDER BY s.sec_pos, b.sub_pos, b.id NULLS FIRST, b.content NULLS FIRST) AS x FROM sec s JOIN sub b USING (doc_id, sec_pos) GROUP BY 1),
k AS (SELECT *, answer_id % 6 = 5 AS none FROM answer)
SELECT answer_id, CAST(CASE answer_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 0 END AS INT) AS rung, CASE WHEN NOT none THEN title END AS title, CASE WHEN NOT none THEN 'before@@behind' END AS notary,
CAST(CASE WHEN none THEN 0 ELSE coalesce(len(signatures), 0) END AS INT) AS n_signatures, CASE WHEN none THEN 0 ELSE coalesce(n.n, 0) END AS n_sections, md5(CASE WHEN none THEN '' ELSE coalesce(x, '') END) AS subsections_md5,
CASE WHEN none THEN 'no object' END AS raw FROM k LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "markdown_labels": rf"""WITH {MD}, l AS (SELECT doc_id, unnest(range(len(string_split(markdown, chr(10))))) AS line_no, unnest(string_split(markdown, chr(10))) AS line FROM md),
s AS (SELECT *, count(*) FILTER (starts_with(line, '## ')) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM l)
SELECT doc_id, sec, CAST(line_no AS INT) AS line_no, regexp_extract(line, '^\*\*([^*]+?)\.?\*\*\s+(.*)$', 1) AS label, regexp_extract(line, '^\*\*([^*]+?)\.?\*\*\s+(.*)$', 2) AS content
FROM s WHERE regexp_matches(line, '^\*\*([^*]+?)\.?\*\*\s+(.*)$')""",
    "preview_classify": rf"""WITH l0 AS (SELECT answer_id, string_split(substr(_markdown, 1, 60000), chr(10)) AS a FROM answer WHERE _markdown IS NOT NULL),
l AS (SELECT answer_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM l0), m AS (SELECT answer_id, CAST(line_no AS INT) AS line_no, {trim('line')} AS t FROM l WHERE line_no < 600),
f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY answer_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM m),
k AS (SELECT *, CASE WHEN starts_with(t, '```') THEN 'fence' WHEN inside THEN 'code' WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^(-{{3,}}|\*{{3,}}|_{{3,}})$') THEN 'rule' WHEN starts_with(t, '|') THEN 'table'
  WHEN regexp_matches(t, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(t, '^[0-9]{{1,3}}[.)] ') THEN 'ordered' WHEN regexp_matches(t, '^[-*+] ') THEN 'bullet' WHEN starts_with(t, '>') THEN 'quote' ELSE 'text' END AS kind FROM f)
SELECT answer_id, line_no, kind, CAST(CASE WHEN kind = 'heading' THEN length(regexp_extract(t, '^(#+)', 1)) ELSE 0 END AS INT) AS level FROM k""",
    "completeness_guard": f"""WITH {CLEAN}, {MD}, t AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS total FROM cp GROUP BY 1)
SELECT doc_id, total, coalesce(length(markdown), 0) AS rendered, coalesce(length(markdown), 0) < (total * 2) // 5 AS rejected, least(80000, total // 2) AS second_most FROM t LEFT JOIN md USING (doc_id)""",
    "label_text": f"""WITH {SUB}, l AS (SELECT doc_id, sec_pos, -1 AS sub_pos, id AS s FROM sec UNION ALL SELECT doc_id, sec_pos, sub_pos, id FROM sub),
g AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY sec_pos, sub_pos, s), '') AS labels FROM l GROUP BY 1)
SELECT answer_id, CASE WHEN _markdown IS NULL THEN labels END AS labels FROM answer LEFT JOIN g USING (doc_id)""",
    "outcome_chat": """SELECT answer_id, CASE WHEN answer_id % 11 = 0 THEN 'providerError' WHEN answer_id % 7 = 0 THEN 'truncated' WHEN trim(coalesce(title, '')) = '' THEN 'empty' ELSE 'success' END AS kind,
CASE WHEN answer_id % 11 = 0 THEN CASE WHEN answer_id % 2 = 0 THEN 429 ELSE 400 END ELSE -1 END AS code, CASE WHEN answer_id % 11 = 0 THEN NULL WHEN answer_id % 7 = 0 OR trim(coalesce(title, '')) <> '' THEN title END AS content,
CASE WHEN answer_id % 11 = 0 THEN answer_id % 2 = 0 ELSE false END AS transient FROM answer""",
    "outcome_candidates": """SELECT answer_id, CASE WHEN answer_id % 5 = 0 THEN 'truncated' WHEN answer_id % 13 = 0 THEN 'providerError' WHEN trim(t) = '' THEN 'empty' ELSE 'success' END AS kind,
CASE WHEN answer_id % 5 = 0 OR (answer_id % 13 <> 0 AND trim(t) <> '') THEN t END AS content FROM (SELECT answer_id, coalesce(title, '') || coalesce(reference, '') AS t FROM answer)""",
    "text_fold_fingerprint": f"""WITH {SUB} SELECT sub_id, md5({fold('content')}) AS fold_md5, CASE WHEN length({fold('content')}) >= 12 THEN substr({fold('content')}, 1, 32) END AS fingerprint,
{NORM.format('id')} AS norm_id, array_to_string({COMPS}, '.') AS numeric FROM sub WHERE content IS NOT NULL""",
    "enumerator_ids": rf"""WITH {SUB} SELECT sub_id, regexp_matches({HEAD_I}, '^\p{{Ll}}$') AS letter, regexp_matches(trim(coalesce(id, '')), '^\(|^[a-z]{{1,2}}$') AS enumerator, split_part({NORM.format('id')}, '.', 1) AS family FROM sub""",
    "history_newest": "SELECT name, output_path, CAST(epoch(ts) AS BIGINT) AS epoch_s, warning FROM (SELECT *, row_number() OVER (PARTITION BY output_path ORDER BY ts DESC, name DESC, warning DESC NULLS LAST) AS rn FROM history) WHERE rn = 1 ORDER BY ts DESC, output_path LIMIT 8",
    "history_unqueued": "SELECT DISTINCT output_path FROM history WHERE output_path NOT IN (SELECT output_path FROM history WHERE warning IS NOT NULL AND output_path IS NOT NULL)",
    "path_parts": r"""WITH p AS (SELECT DISTINCT output_path, regexp_extract(output_path, '([^/]*)$', 1) AS filename FROM history)
SELECT output_path, filename, regexp_replace(filename, '\.[^./]+$', '') AS stem, lower(regexp_extract(filename, '\.([^./]+)$', 1)) AS extension, lower(regexp_extract(filename, '\.([^./]+)$', 1)) = 'pdf' AS is_pdf FROM p""",
    "retry_schedule": """WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN event_id % 17 = 0 THEN 429 ELSE 500 END AS code FROM events)
SELECT key, CAST(attempt AS INT) AS attempt, CAST((CASE WHEN max(CASE WHEN code = 429 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY attempt) = 1 THEN 15 ELSE 3 END) * attempt AS BIGINT) AS delay_s FROM e""",
    "reflow_text": f"WITH {CLEAN} SELECT doc_id, pos, md5({REFLOW.format('text')}) AS reflow_md5 FROM cp",
}
