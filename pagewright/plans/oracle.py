"""SQL of the page and clause queries, for comparison."""
from __future__ import annotations

from pagewright.plans import planted

ID = r"'^([1-9][0-9]?(?:\.[1-9][0-9]?){1,3})(?:$|\.$|\.[.,])'"


def ids(text: str) -> str:
    return f"""list_distinct(list_filter(list_transform(regexp_extract_all({text}, '[0-9.,]+'), lambda r: regexp_extract(r, {ID}, 1)), lambda x: x <> ''))"""


TRIM = r"regexp_replace({0}, '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g')"
NOT_BLANK = r"regexp_matches(text, '[^\s\p{Z}]')"


def trim(x: str) -> str:
    return TRIM.format(x)


def key_of(t: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({t}), '\p{{N}}+', '#', 'g'), '[\p{{Zs}}\t]+', ' ', 'g')"


def letters(t: str) -> str:
    return rf"length(regexp_replace({t}, '[^\p{{L}}\p{{M}}]', '', 'g'))"


def fold(t: str) -> str:
    return rf"regexp_replace(lower({t}), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')"


CLEAN = """clean AS (SELECT DISTINCT doc_id, page_no, pos, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS text FROM page),
cp AS (SELECT * FROM clean WHERE """ + NOT_BLANK + """),
ln AS (SELECT doc_id, page_no, pos, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM cp)"""
KEYS = CLEAN + f""",
lk AS (SELECT *, {trim('line')} AS t FROM ln),
kd AS (SELECT *, CASE WHEN length(t) > 0 AND length(t) <= 120 AND {letters('t')} >= 4 THEN {key_of('t')} END AS key FROM lk),
npg AS (SELECT doc_id, count(*) AS n FROM cp GROUP BY 1),
fk AS (SELECT k.doc_id, k.key, count(DISTINCT pos) AS pages FROM kd k JOIN npg USING (doc_id) WHERE key IS NOT NULL GROUP BY k.doc_id, k.key, n
       HAVING n >= 3 AND count(DISTINCT pos) >= greatest(3, (n + 1) // 2))"""
DUMP = CLEAN + """,
tot AS (SELECT doc_id, max(page_no) AS total FROM clean GROUP BY 1),
dump AS (SELECT doc_id, string_agg('--- Seite ' || page_no || ' von ' || total || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS text FROM cp JOIN tot USING (doc_id) GROUP BY 1)"""
IDS = CLEAN + f""",
src AS (SELECT DISTINCT doc_id, unnest({ids('text')}) AS id FROM cp),
lab AS (SELECT DISTINCT doc_id, unnest({ids('id')}) AS id FROM (SELECT doc_id, id FROM sections UNION SELECT doc_id, id FROM subsections) WHERE id IS NOT NULL),
gate AS (SELECT doc_id FROM src GROUP BY 1 HAVING count(*) >= 5)"""


def near(of: str, pool: str, name: str) -> str:
    return f""",
{name}_p AS (SELECT doc_id, id, string_split(id, '.') AS p FROM {of}),
{name}_n AS (SELECT doc_id, id, array_to_string(list_append(p[1:-2], CAST(CAST(p[-1] AS INT) - 1 AS VARCHAR)), '.') AS near FROM {name}_p WHERE CAST(p[-1] AS INT) > 1
  UNION ALL SELECT doc_id, id, array_to_string(list_append(p[1:-2], CAST(CAST(p[-1] AS INT) + 1 AS VARCHAR)), '.') FROM {name}_p
  UNION ALL SELECT doc_id, id, array_to_string(p[1:-2], '.') FROM {name}_p WHERE len(p) > 2),
{name} AS (SELECT DISTINCT n.doc_id, n.id FROM {name}_n n JOIN {pool} q ON q.doc_id = n.doc_id AND q.id = n.near)"""


MISSING = IDS + """,
gone AS (SELECT * FROM src WHERE doc_id IN (SELECT doc_id FROM gate) AND (doc_id, id) NOT IN (SELECT doc_id, id FROM lab))""" + near("gone", "src", "miss")
INVENTED = MISSING + r""",
full_text AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM cp GROUP BY 1),
extra AS (SELECT l.doc_id, l.id FROM lab l JOIN gate USING (doc_id) LEFT JOIN full_text f USING (doc_id) WHERE (l.doc_id, l.id) NOT IN (SELECT doc_id, id FROM src)
  AND NOT coalesce(regexp_matches(f.text, replace(l.id, '.', '\s*\.\s*')), false))""" + near("extra", "lab", "inv")
NUM = "list_transform(string_split({0}, '.'), lambda x: CAST(x AS INT))"


GAP = "[\\s\u00ad\\-.,;:()''\"„“/]*".replace("\\\\", "\\")
KEY24 = "substr(" + fold("coalesce(content, '')") + ", 1, 24)"
BARE = IDS + f""", {planted.BARE},
btext AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM cp GROUP BY 1),
bc AS (SELECT s.doc_id, s.sec_pos, s.section, b.sid, b.content, s.section || '.' || b.sid AS full_id FROM bsec s JOIN bsub b ON b.doc_id = s.doc_id AND b.sec_pos = s.sec_pos JOIN gate g ON g.doc_id = s.doc_id
  WHERE regexp_matches(b.sid, '^[0-9]{{1,2}}$')),
bare AS (SELECT DISTINCT b.doc_id, b.sec_pos, b.section FROM bc b JOIN btext t USING (doc_id)
  WHERE ((b.doc_id, b.full_id) NOT IN (SELECT doc_id, id FROM src) OR (b.doc_id, b.sec_pos, b.full_id) IN (SELECT doc_id, sec_pos, sid FROM bsub))
  AND NOT (length({KEY24}) < 4 OR regexp_matches(t.text, '(?i)(?:^|[^0-9.,])' || b.sid || '[.)]?{GAP}' || array_to_string(string_split({KEY24}, ''), '{GAP}'))))"""


def listed(of: str, what: str, one: str, more: str) -> str:
    return f"""{what}_l AS (SELECT doc_id, list(i.id || coalesce(' (page ' || p.page_no || ')', '') ORDER BY {NUM.format('i.id')}) AS a FROM {of} i LEFT JOIN place p USING (doc_id, id) GROUP BY 1),
{what}_w AS (SELECT doc_id, CASE WHEN len(a) = 1 THEN '{one} ' ELSE '{more} ' END || array_to_string(a[1:10], ', ') || CASE WHEN len(a) > 10 THEN ' and ' || (len(a) - 10) || ' more' ELSE '' END || '.' AS w FROM {what}_l)"""


WARNING = INVENTED + BARE.removeprefix(IDS) + f""",
pl AS (SELECT doc_id, page_no, pos, contains(lower(text), 'inhaltsverzeichnis') AS toc, unnest({ids('text')}) AS id FROM cp),
place AS (SELECT doc_id, id, arg_min(page_no, (toc, pos)) AS page_no FROM pl GROUP BY 1, 2),
{listed('miss', 'missing', 'Missing from the result: clause', 'Missing from the result: clauses')}, {listed('inv', 'invented', 'Not printed in the source: clause', 'Not printed in the source: clauses')},
bare_l AS (SELECT doc_id, list_sort(list(DISTINCT section)) AS a FROM bare GROUP BY 1),
bare_w AS (SELECT doc_id, 'Numbered without print: paragraphs of ' || CASE WHEN len(a) = 1 THEN 'section ' ELSE 'sections ' END || array_to_string(a[1:8], ', ') || CASE WHEN len(a) > 8 THEN ' and ' || (len(a) - 8) || ' more' ELSE '' END || '.' AS w FROM bare_l)"""


SQL = {
    "page_inspect": f"WITH {CLEAN} SELECT doc_id, count(*) AS n_pages, bool_or({NOT_BLANK}) AS has_text, NOT bool_or({NOT_BLANK}) AND count(*) > 100 AS needs_confirmation FROM clean GROUP BY 1",
    "page_text_dump": f"WITH {DUMP} SELECT doc_id, text FROM dump",
    "page_marker_roundtrip": f"WITH {CLEAN} SELECT doc_id, page_no FROM cp",
    "furniture_keys": f"WITH {KEYS} SELECT doc_id, key, pages FROM fk",
    "furniture_strip": f"""WITH {KEYS},
fl AS (SELECT k.*, f.key IS NOT NULL AS furniture, row_number() OVER (PARTITION BY k.doc_id, k.key ORDER BY pos, line_no) AS rn FROM kd k LEFT JOIN fk f ON f.doc_id = k.doc_id AND f.key = k.key),
st AS (SELECT doc_id, page_no, pos, string_agg(line, chr(10) ORDER BY line_no) AS text FROM fl WHERE NOT furniture OR rn = 1 GROUP BY 1, 2, 3)
SELECT * FROM st WHERE {NOT_BLANK}""",
    "reference_is_furniture": f"""WITH {KEYS}, ks AS (SELECT doc_id, list(key ORDER BY length(key) DESC, key) AS keys FROM fk GROUP BY 1),
r AS (SELECT answer_id, reference, keys, list_reduce(list_prepend({key_of(trim('reference'))}, keys), lambda a, x: replace(a, x, ' ')) AS rest FROM answer LEFT JOIN ks USING (doc_id))
SELECT answer_id, coalesce(keys IS NOT NULL AND regexp_matches(reference, '[^\\s\\p{{Z}}]') AND {letters('rest')} < 4, false) AS furniture FROM r""",
    "chunk_plan": f"""WITH RECURSIVE {CLEAN},
p AS (SELECT doc_id, pos, length(text) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM cp),
t AS (SELECT doc_id, sum(len) + 2 * (count(*) - 1) AS total, count(*) AS n FROM p GROUP BY 1),
k AS (SELECT doc_id, CAST((total + 1999) // 2000 AS BIGINT) AS k, CAST((total // ((total + 1999) // 2000)) + 1 AS BIGINT) AS target, total <= 2000 OR n = 1 AS one FROM t),
f AS (SELECT p.doc_id, p.pos, p.rn, 0 AS chunk_no, CAST(p.len + 2 AS BIGINT) AS cur FROM p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.pos, p.rn, f.chunk_no + CASE WHEN NOT one AND f.cur + p.len > target AND f.chunk_no < k.k - 1 THEN 1 ELSE 0 END,
    CAST(CASE WHEN NOT one AND f.cur + p.len > target AND f.chunk_no < k.k - 1 THEN 0 ELSE f.cur END + p.len + 2 AS BIGINT)
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.rn = f.rn + 1 JOIN k ON k.doc_id = f.doc_id)
SELECT doc_id, pos, chunk_no FROM f""",
    "clause_ids_extract": f"WITH {IDS} SELECT doc_id, id FROM src",
    "clause_ids_missing": f"WITH {MISSING} SELECT doc_id, id FROM miss",
    "clause_ids_invented": f"WITH {INVENTED} SELECT doc_id, id FROM inv",
    "clause_ids_gate": f"""WITH {MISSING} SELECT s.doc_id, s.n AS n_ids, coalesce(m.n, 0) AS n_missing, s.n >= 5 AS audited, coalesce(m.n, 0) BETWEEN 1 AND 24 AS retried
FROM (SELECT doc_id, count(*) AS n FROM src GROUP BY 1) s LEFT JOIN (SELECT doc_id, count(*) AS n FROM miss GROUP BY 1) m USING (doc_id)""",
    "missing_by_major": f"""WITH {MISSING},
g AS (SELECT doc_id, CAST(string_split(id, '.')[1] AS INT) AS major, count(*) AS n, string_agg(id, ',' ORDER BY {NUM.format('id')}) AS ids FROM miss GROUP BY 1, 2)
SELECT doc_id, major, n, ids FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY major) AS rn FROM g) WHERE rn <= 3""",
    "clause_page_locations": f"""WITH {MISSING},
shown AS (SELECT doc_id, page_no, pos, contains(lower(text), 'inhaltsverzeichnis') AS toc, unnest({ids('text')}) AS id FROM cp)
SELECT doc_id, id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY toc, pos) AS rn FROM shown JOIN miss USING (doc_id, id)) WHERE rn = 1""",
    "retry_pages": f"""WITH {MISSING},
pg AS (SELECT *, lead(page_no) OVER (PARTITION BY doc_id ORDER BY pos) AS next_no, contains(lower(text), 'inhaltsverzeichnis') AS toc FROM cp),
shown AS (SELECT doc_id, pos, page_no, next_no, toc, unnest({ids('text')}) AS id FROM pg),
hit AS (SELECT DISTINCT doc_id, pos, page_no, next_no, toc FROM shown JOIN miss USING (doc_id, id)),
ok AS (SELECT * FROM (SELECT *, bool_and(toc) OVER (PARTITION BY doc_id) AS all_toc FROM hit) WHERE all_toc OR NOT toc),
o AS (SELECT doc_id, pos, 0 AS k, page_no FROM ok UNION ALL SELECT doc_id, pos, 1, next_no FROM ok WHERE next_no IS NOT NULL),
f AS (SELECT doc_id, page_no, min((pos, k)) AS o FROM o GROUP BY 1, 2)
SELECT doc_id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rn FROM f) WHERE rn <= 4""",
    "bare_numbered_sections": f"WITH {BARE} SELECT doc_id, sec_pos, section FROM bare",
}
