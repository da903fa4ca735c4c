"""Repairs of one document's sections that depend on their own earlier steps; run by document in Python.

A document's sections are a list of Sec(id, title, subs), subs a list of [id, content]. The folds keep the folded text of
each subsection beside it and refresh it where they write. A document is repaired in one task, as its order is its meaning.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import pages as P
from pagewright.operators import structure

TOC = "inhaltsverzeichnis"


@dataclass
class Sec:
    id: str
    title: str
    subs: list[list[str]] = field(default_factory=list)


@dataclass(frozen=True)
class Item:
    token: str
    id: str
    text: str
    key: str
    anchor: str | None
    anchor_id: str | None = None
    page: int = 0


class _Kept(dict):
    """Character to whether it is a letter, a mark or a number, filled on demand."""

    def __missing__(self, c: str) -> bool:
        got = self[c] = unicodedata.category(c)[0] in "LMN"
        return got


_kept = _Kept()


def fold(s: str) -> str:
    return "".join(filter(_kept.__getitem__, unicodedata.normalize("NFC", s).lower()))


def places(s: str) -> tuple[str, list[int]]:
    """The fold of a text and the place in it of each of the fold's characters; a letter goes with the marks behind it."""
    low = s.lower()
    if len(low) == len(s) and unicodedata.is_normalized("NFC", s):
        at = [k for k, c in enumerate(low) if _kept[c]]
        return "".join([low[k] for k in at]), at
    out, at = [], []
    for m in _with_marks(s):
        for c in unicodedata.normalize("NFC", m.group()).lower():
            if _kept[c]:
                out.append(c)
                at.append(m.start())
    return "".join(out), at


_with_marks = re.compile("(?s).[\u0300-\u036f]*").finditer


_runs = re.compile(r"[0-9.,]+").findall
_clause = re.compile(r"([1-9][0-9]?(?:\.[1-9][0-9]?){1,3})(?:$|\.$|\.[.,])").match


def clause_ids(s: str | None) -> set[str]:
    """As functions.text.clause_ids."""
    return {m[1] for r in _runs(s or "") if (m := _clause(r))}


def neighbours(ident: str) -> set[str]:
    """As functions.text.neighbours."""
    *stem, last = ident.split(".")
    near = {".".join([*stem, str(int(last) + k)]) for k in (-1, 1) if int(last) + k > 0}
    return near | ({".".join(stem)} if len(stem) > 1 else set())


def norm_id(s: str | None) -> str:
    return (s or "").strip(" .")


def numeric(s: str | None) -> tuple[int, ...] | None:
    parts = [p for p in norm_id(s).split(".") if p]
    return tuple(map(int, parts)) if parts and all(re.fullmatch(r"\+?[0-9]+", p) for p in parts) else None


def strip_id(content: str, ident: str) -> str:
    """Content without the id in front of it, unless a digit follows or the id is glued to text."""
    m = re.match(re.escape(ident) + r"(?:\.(?![0-9])|(?=\s|$))\s*", content.strip()) if ident else None
    rest = content.strip()
    return rest[m.end():].strip() if m and (m.end() == len(rest) or rest[m.end() - 1:m.end()].isspace() or rest[m.end():m.end() + 1].isspace()) else rest


# -- runs of clauses ------------------------------------------------------------------------------

def sanitize(run: list[list[str]], prefix: str, wanted: set[str]) -> list[list[str]] | None:
    """The usable part of an extracted run: ids of the prefix with content. Where ids repeat it is cut at each repeat, and
    the one part that holds all wanted ids is taken; none if there isn't exactly one, or it has a single clause."""
    rows = [[norm_id(i), strip_id(c or "", norm_id(i))] for i, c in run]
    rows = [r for r in rows if r[0] and r[0].split(".")[0] == prefix and r[1]]
    parts: list[list[list[str]]] = [[]]
    for r in rows:
        if any(r[0] == x[0] for x in parts[-1]):
            parts.append([])
        parts[-1].append(r)
    if len(parts) > 1:
        parts = [p for p in parts if wanted and wanted <= {x[0] for x in p}]
    return parts[0] if len(parts) == 1 and len(parts[0]) >= 2 else None


def toc(sec: Sec) -> bool:
    return TOC in f"{sec.id} {sec.title}".lower()


def splice(secs: list[Sec], run: list[list[str]], prefix: str) -> list[Sec] | None:
    """The sections with the run in place of the stretch of one section that matches it best: subsections of the prefix's
    number next to each other of which two openings or more match the run's, widened by neighbours with an id of the run; the
    first of the best. None if nothing matches so; tables of contents are left alone."""
    keys = [k for _, c in run if len(k := fold(c)[:48]) >= 12]
    if len(keys) < 2:
        return None
    ids = {norm_id(i) for i, _ in run}
    best: tuple[int, int, int, int] | None = None
    for s, sec in enumerate(secs):
        if toc(sec):
            continue
        marks = []
        for i, c in sec.subs:
            k = fold(c)[:48]
            same = len(k) >= 12 and any(k.startswith(x) or x.startswith(k) for x in keys)
            marks.append((norm_id(i).split(".")[0] == prefix, same, norm_id(i) in ids))
        k = 0
        while k < len(marks):
            if not marks[k][0]:
                k += 1
                continue
            end = k
            while end < len(marks) and marks[end][0]:
                end += 1
            hits = [j for j in range(k, end) if marks[j][1]]
            if len(hits) >= 2 and (best is None or len(hits) > best[0]):
                lo, hi = hits[0], hits[-1] + 1
                while lo > k and marks[lo - 1][2]:
                    lo -= 1
                while hi < end and marks[hi][2]:
                    hi += 1
                best = (len(hits), s, lo, hi)
            k = end
    if best is None:
        return None
    _, s, lo, hi = best
    out = [Sec(x.id, x.title, list(x.subs)) for x in secs]
    out[s].subs[lo:hi] = [list(r) for r in run]
    return out


# -- items ----------------------------------------------------------------------------------------

class Board:
    """Sections with the folded text of every subsection."""

    def __init__(self, secs: list[Sec]):
        self.secs = [Sec(s.id, s.title, [list(x) for x in s.subs]) for s in secs]
        self.folds = [[fold(x[1]) for x in s.subs] for s in self.secs]

    def front(self, s: int) -> bool:
        return not self.secs[s].id.strip() and not self.secs[s].title.strip()

    def containing(self, key: str) -> list[tuple[int, int]]:
        return [(s, k) for s, row in enumerate(self.folds) for k, f in enumerate(row) if key in f]

    def sub_id(self, at: tuple[int, int]) -> str:
        return norm_id(self.secs[at[0]].subs[at[1]][0]).lower()

    def insert(self, s: int, k: int, sub: list[str]) -> None:
        self.secs[s].subs.insert(k, sub)
        self.folds[s].insert(k, fold(sub[1]))

    def remove(self, s: int, k: int) -> list[str]:
        self.folds[s].pop(k)
        return self.secs[s].subs.pop(k)

    def write(self, s: int, k: int, sub: list[str]) -> None:
        self.secs[s].subs[k] = sub
        self.folds[s][k] = fold(sub[1])

    def target(self, item: Item) -> tuple[int, int] | None:
        """Behind the last subsection that holds the item's anchor, in a section that lacks the item's id; those that have the
        anchor's own id come first."""
        if not item.anchor:
            return None
        free = [at for at in self.containing(item.anchor) if all(self.sub_id((at[0], k)) != item.id.lower() for k in range(len(self.secs[at[0]].subs)))]
        own = [at for at in free if item.anchor_id is None or self.sub_id(at) == item.anchor_id.lower()]
        return max(own or free, default=None)


def _shown(item: Item, content: str) -> bool:
    """Whether the content prints the item's token in front of its opening."""
    head = fold(item.text)[:16]
    if len(head) < 8:
        return False
    gap = r"[^\w]*"
    return re.search(re.escape(item.token) + gap + gap.join(map(re.escape, head)), content, re.I) is not None


def _misfiled(board: Board, at: tuple[int, int], item: Item) -> bool:
    """A single letter other than a opens a section of which the next subsection is the item a."""
    s, k = at
    subs = board.secs[s].subs
    if k or len(item.id) != 1 or not item.id.isalpha() or item.id.lower() == "a" or len(subs) < 2:
        return False
    return board.sub_id((s, 1)) == "a" or re.match(r"a[.)]\s", subs[1][1]) is not None


def repair_items(secs: list[Sec], items: list[Item]) -> tuple[list[Sec], list[Item]]:
    """Items of the pages back in their sections, one after the other, each seeing what those before it changed; and the
    items that found no place."""
    board, lost = Board(secs), []
    for item in items:
        hits = board.containing(item.key)
        own = [h for h in hits if board.sub_id(h) == item.id.lower()]
        if own:
            if all(_misfiled(board, h, item) for h in own):
                to = board.target(item)
                if to and to[0] != own[0][0]:
                    sub = board.remove(*own[0])
                    board.insert(to[0], to[1] + 1, sub)
            continue
        if any(_shown(item, board.secs[s].subs[k][1]) for s, k in hits):
            continue
        body = [h for h in hits if not board.front(h[0])]
        if body:
            s, k = body[0]
            ident, content = board.secs[s].subs[k]
            folded, at = places(content)
            start = folded.find(item.key)
            if start < 0:  # folded otherwise than it is cut
                continue
            cut = at[start]
            head = content[:cut].rstrip()
            tail = content[cut:].strip()
            if not head.strip():
                if not norm_id(ident):
                    board.write(s, k, [item.id, tail])
            else:
                board.write(s, k, [ident, head.strip()])
                board.insert(s, k + 1, [item.id, tail])
            continue
        if hits:
            continue
        to = board.target(item)
        if to:
            board.insert(to[0], to[1] + 1, [item.id, item.text])
        else:
            lost.append(item)
    return board.secs, lost


# -- numbering scopes -----------------------------------------------------------------------------

def _lines(page: str) -> list[str]:
    return [x.strip(" \t ") for x in page.split("\n")]


def _letters(s: str) -> int:
    return sum(unicodedata.category(c)[0] in "LM" for c in s)


def _skipped(line: str) -> bool:
    return line.startswith("--- Seite ") or _letters(line) < 4


def heading_like(line: str) -> bool:
    first = next((c for c in line if c.isalpha()), "")
    return len(line) <= 80 and not set(line) & set(",;") and first.isupper() and line[-1:] not in tuple(".,;:-–—") and not re.match(r"[0-9]{1,2}(\.[0-9]{1,2})+", line)


def heading_above(key: str, pages: list[str]) -> str | None:
    """The one heading over every printed place of a text; none if a place has another or none. A line is a heading if
    the line above it, if there is one, closes a sentence."""
    rows = [(line, p) for p, page in enumerate(pages) for line in _lines(page)]
    found: set[str | None] = set()
    folded, start = [], []
    size = 0
    for line, _ in rows:
        start.append(size)
        folded.append(fold(line))
        size += len(folded[-1])
    whole, at = "".join(folded), -1
    while (at := whole.find(key, at + 1)) >= 0:
        row = max(k for k in range(len(rows)) if start[k] <= at and folded[k])
        above = [rows[k][0] for k in range(row - 1, -1, -1) if not _skipped(rows[k][0]) and rows[row][1] - rows[k][1] <= 1]
        head = above[0] if above and start[row] == at and heading_like(above[0]) else None
        if head and len(above) > 1:
            closing = above[1].rstrip()
            word = re.search(r"([^\W\d_]+)\.$", closing)
            if closing[-1:] not in tuple(".;:!?") or (closing[-1:] == "." and (not word or len(word[1]) < 3)):
                head = None
        found.add(head)
    return found.pop() if len(found) == 1 else None


def split_scopes(secs: list[Sec], pages: list[str]) -> tuple[list[Sec], list[str]]:
    """Sections in which numbering starts again at 1 cut there, the printed heading above as the title of the new one."""
    todo, out, heads = list(secs)[::-1], [], []
    while todo:
        sec = todo.pop()
        cut = None if toc(sec) else _restart(sec)
        head = heading_above(fold(sec.subs[cut][1])[:32], pages) if cut is not None and len(fold(sec.subs[cut][1])) >= 12 else None
        if head is None:
            out.append(sec)
            continue
        front, back = [list(x) for x in sec.subs[:cut]], [list(x) for x in sec.subs[cut:]]
        last = front[-1]
        if last[1].strip() == head and numeric(last[0]) is None:
            front.pop()
        elif re.search(r"\s" + re.escape(head) + r"\s*$", last[1]):
            last[1] = last[1].rstrip()[:-len(head)].rstrip()
        if not front:
            out.append(sec)
            continue
        heads.append(head)
        out.append(Sec(sec.id, sec.title, front))
        todo.append(Sec("", head, back))
    return out, heads


def _restart(sec: Sec) -> int | None:
    ids = [(k, n) for k, (i, _) in enumerate(sec.subs) if (n := numeric(i))]
    if len(sec.subs) < 3:
        return None
    for j in range(1, len(ids)):
        if ids[j][1] == (1,) and ids[j][1] <= ids[j - 1][1]:
            run = [ids[j][1]]
            for _, n in ids[j + 1:]:
                if n == (1,):
                    break
                run.append(n)
            return ids[j][0] if len(run) >= 2 and all(a < b for a, b in zip(run, run[1:])) else None
    return None


# -- binding of numbers to paragraphs ---------------------------------------------------------------

def recut(block: list[list[str]], anchors: list[tuple[str, str]]) -> list[list[str]] | None:
    """A block cut anew at the openings that the pages print behind its numbers: all or nothing. Openings of 12 folded
    characters may stand anywhere, of 6 only at the start of a paragraph; the numbers found must ascend in the order of their
    places, and every number of the block must be among them."""
    have = {n for i, _ in block if (n := numeric(i))}
    if len(have) < 2:
        return None
    majors = {n[0] for n in have}
    if not have <= {numeric(i) for i, _ in anchors}:
        return None
    cand = sorted(((n, i, fold(t)[:48]) for i, t in anchors if (n := numeric(i)) and n[0] in majors), key=lambda c: c[0])
    paragraphs = [c.strip() for _, c in block if c.strip()]
    text = " ".join(paragraphs)
    folded, at = places(text)
    starts, size = set(), 0
    for p in paragraphs:
        starts.add(size)
        size += len(fold(p))
    cursor, cuts = 0, []
    for n, i, key in cand:
        if len(key) < 6:
            continue
        pos = folded.find(key, cursor)
        while pos >= 0 and len(key) < 12 and pos not in starts:
            pos = folded.find(key, pos + 1)
        if pos >= 0:
            cuts.append((n, norm_id(i), pos))
            cursor = pos + 1
    if len(cuts) < 2 or any(a[0] >= b[0] for a, b in zip(cuts, cuts[1:])) or not have <= {c[0] for c in cuts}:
        return None
    edge = [at[c[2]] for c in cuts] + [len(text)]
    trim = " \t\n,;:-–"
    out = [[c[1], text[a:b].strip(trim) if b < len(text) else text[a:b].strip()] for c, a, b in zip(cuts, edge, edge[1:])]
    intro = text[:edge[0]].strip(trim)
    return None if not all(c for _, c in out) else ([["", intro]] if intro else []) + out


def blocks_of(subs: list[list[str]], new: callable) -> list[list[list[str]]]:
    """Stretches of subsections; one without number goes with the number behind it."""
    out, held, last = [[]], [], None
    for sub in subs:
        n = numeric(sub[0])
        if n is None:
            held.append(sub)
            continue
        if last is not None and new(last, n):
            out.append([])
        out[-1] += held + [sub]
        held, last = [], n
    out[-1] += held
    return [b for b in out if b]


def rebind(secs: list[Sec], anchors: list[tuple[str, str]]) -> tuple[list[Sec], int]:
    """Blocks of ascending numbers cut anew, or, where a block can't be, its parts of one first number; and how many were."""
    out, done = [], 0
    for sec in secs:
        if toc(sec) or len(sec.subs) < 2:
            out.append(sec)
            continue
        subs = []
        for block in blocks_of(sec.subs, lambda a, b: b <= a):
            whole = recut(block, anchors)
            for part in ([block] if whole else blocks_of(block, lambda a, b: a[0] != b[0])):
                got = whole or recut(part, anchors)
                done += got is not None and got != part
                subs += got or part
        out.append(Sec(sec.id, sec.title, subs))
    return out, done


# -- stray letters and duplicates -------------------------------------------------------------------

def _letter(ident: str) -> str | None:
    x = ident.strip().rstrip(".")
    return x if len(x) == 1 and x.isalpha() and x.islower() else None


def demote(secs: list[Sec]) -> list[Sec]:
    """Sections that are a letter of the enumeration in front of them, back in it."""
    out: list[Sec] = []
    for sec in secs:
        letter = _letter(sec.id)
        if not letter or not out or not any(_letter(i) for i, _ in out[-1].subs):
            out.append(Sec(sec.id, sec.title, [list(x) for x in sec.subs]))
            continue
        bare = [c for i, c in sec.subs if not norm_id(i) and c]
        out[-1].subs += [[letter, "\n".join(([sec.title] if sec.title else []) + bare)], *([i, c] for i, c in sec.subs if norm_id(i))]
    return out


def drop_duplicates(secs: list[Sec]) -> list[Sec]:
    """Sections without enumerated subsections of which an earlier one of the section holds the whole text."""
    out = []
    for sec in secs:
        kept, seen = [], []
        for i, c in sec.subs:
            f = fold(c)
            if len(f) >= 12 and re.match(r"\(|[^\W\d_]{1,2}$", norm_id(i)) and norm_id(i) == norm_id(i).lower() and any(f in x for x in seen):
                continue
            kept.append([i, c])
            seen.append(f)
        out.append(Sec(sec.id, sec.title, kept))
    return out


def recover_front(secs: list[Sec], pages: list[str]) -> list[Sec]:
    """Prose that stands before the first body text on its page and that no section holds, in front."""
    board = Board(secs)
    start = next((s for s in range(len(board.secs)) if not board.front(s)), len(board.secs))
    key = next((f[:32] for row in board.folds[start:] for f in row if len(f) >= 12), None)
    page = next((p for p in pages if key in fold(p)), None) if key else None
    if page is None:
        return board.secs
    folded, at = places(page)
    cut = folded.find(key)
    above = _lines(page[:at[cut]] if cut >= 0 else "")
    clause = re.compile(r"[0-9]{1,2}(\.[0-9]{1,2})*\.?(\s|$)").match
    while above and (not above[-1] or clause(above[-1])):
        above.pop()
    prose: list[str] = []
    for line in reversed(above):
        if not line or line.isdigit() or clause(line) or line.startswith("--- Seite ") or len(line) < (10 if prose else 25):
            break
        prose.insert(0, line)
    paragraphs: list[list[str]] = []
    for line in prose:
        if not paragraphs or (paragraphs[-1][-1].endswith(".") and line[:1].isupper()):
            paragraphs.append([])
        paragraphs[-1].append(line)
    texts = [re.sub(r"\s*\n\s*", " ", re.sub(r"([a-zäöüß])-\s*\n\s*([a-zäöüß])", r"\1\2", "\n".join(p))) for p in paragraphs]
    new = [["", t] for t in texts if len(fold(t)) >= 24 and len(t) >= 40 and not board.containing(fold(t)[:64])]
    if new:
        front = next((s for s in range(len(board.secs)) if board.front(s)), None)
        if front is None:
            board.secs.insert(0, Sec("", "", new))
        else:
            board.secs[front].subs += new
    return board.secs


# -- on DataFrames ------------------------------------------------------------------------------

ARRAYS = {"secs": ("sec_pos", "sub_pos", "section", "title", "id", "content"), "pages": ("pos", "text"), "items": ("pos", "line_no", "page_no", "token", "id", "text", "key", "anchor", "anchor_id"),
          "anchors": ("pos", "id", "start"), "source": ("id",), "runs": ("prefix", "pos", "id", "content"), "wanted": ("id",)}
OUT = "doc_id BIGINT, secs ARRAY<STRUCT<sec_pos: INT, sub_pos: INT, section: STRING, title: STRING, id: STRING, content: STRING>>, note STRING"


def to_rows(secs: list[Sec]) -> list[dict]:
    return [dict(sec_pos=s, sub_pos=k, section=x.id, title=x.title, id=i, content=c) for s, x in enumerate(secs) for k, (i, c) in (enumerate(x.subs) if x.subs else [(None, (None, None))])]


def to_sections(rows: list[dict]) -> list[Sec]:
    out: dict[int, Sec] = {}
    for r in sorted(rows, key=lambda r: (r["sec_pos"], -1 if r["sub_pos"] is None else r["sub_pos"], r["id"] or "", r["content"] or "")):
        sec = out.setdefault(r["sec_pos"], Sec(r["section"] or "", r["title"] or "", []))
        if r["sub_pos"] is not None:
            sec.subs.append([r["id"] or "", r["content"] or ""])
    return list(out.values())


def by_document(rel: DataFrame, parts: dict[str, DataFrame], fold: Callable) -> DataFrame:
    """OUT of fold(sections, rows of each part) for every document of rel. A document is one row with an array of each part's
    rows, so that all are grouped and joined by doc_id alone, and many documents go to Python at once."""
    d = None
    for name, df in ({"secs": rel} | parts).items():
        one = df.groupBy("doc_id").agg(F.collect_list(F.struct(*ARRAYS[name])).alias(name))
        d = one if d is None else d.join(one, "doc_id", "left")
    names = list(parts)

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                secs, note = fold(to_sections(row["secs"]), *(row[n] or [] for n in names))
                out.append(dict(doc_id=row["doc_id"], secs=to_rows(secs), note=note))
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return d.mapInArrow(run, OUT)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("secs", pa.list_(pa.struct([("sec_pos", pa.int32()), ("sub_pos", pa.int32()), *((x, pa.string()) for x in ("section", "title", "id", "content"))]))), ("note", pa.string())])


def flat(m: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, section, title, id, content, note) of OUT."""
    return m.select("doc_id", F.explode("secs").alias("x"), "note").select("doc_id", "x.*", "note")


def page_texts(rows: list[dict]) -> list[str]:
    return [p["text"] for p in sorted(rows, key=lambda p: p["pos"])]


def page_items(rows: list[dict]) -> list[Item]:
    return [Item(i["token"], i["id"], i["text"], i["key"], i["anchor"], i["anchor_id"], i["page_no"]) for i in sorted(rows, key=lambda i: (i["pos"], i["line_no"]))]


def page_anchors(rows: list[dict]) -> list[tuple[str, str]]:
    return [(x["id"], x["start"]) for x in sorted(rows, key=lambda x: x["pos"])]


def relation(sections: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, sub_pos, section, title, id, content): subsections beside their section's id and title; a section
    without any has a row of nulls. Repeated rows count once; of different rows of one section the greatest stands."""
    head = sections.groupBy("doc_id", "sec_pos").agg(F.max(F.struct("id", "title")).alias("h")).select("doc_id", "sec_pos", F.col("h.id").alias("section"), "h.title")
    return subs.select("doc_id", "sec_pos", "sub_pos", "id", "content").distinct().join(head, ["doc_id", "sec_pos"], "full").select(
        "doc_id", "sec_pos", "sub_pos", "section", "title", "id", "content")


def repaired_items(rel: DataFrame, pages: DataFrame) -> DataFrame:
    """The relation after repair_items, note holding the number of items without a place."""

    def fold_(secs, items):
        secs, lost = repair_items(secs, page_items(items))
        return secs, str(len(lost))

    return flat(by_document(rel, {"items": structure.items(pages)}, fold_))


def scoped(rel: DataFrame, pages: DataFrame) -> DataFrame:
    """The relation after split_scopes, note holding the headings of new sections."""

    def fold_(secs, texts):
        secs, heads = split_scopes(secs, page_texts(texts))
        return secs, "; ".join(heads)

    return flat(by_document(rel, {"pages": P.content_pages(pages)}, fold_))


def with_front(rel: DataFrame, pages: DataFrame) -> DataFrame:
    return flat(by_document(rel, {"pages": P.content_pages(pages)}, lambda secs, texts: (recover_front(secs, page_texts(texts)), "")))


def rebound(rel: DataFrame, anchors: DataFrame) -> DataFrame:
    """The relation after rebind with anchors (doc_id, pos, id, start), note holding the number of stretches cut anew."""

    def fold_(secs, found):
        secs, n = rebind(secs, page_anchors(found))
        return secs, str(n)

    return flat(by_document(rel, {"anchors": anchors}, fold_))


def adopt_runs(secs: list[Sec], runs: dict[str, list[list[str]]], wanted: set[str], most: int = 3) -> tuple[list[Sec], int]:
    """Sections with freshly extracted runs of the missing ids' first numbers, the first few by number; each is taken by
    itself, if it holds all that is missing of its number, leaves fewer ids missing and keeps two fifths of the text."""
    size = lambda ss: sum(len(c) for x in ss for _, c in x.subs)
    gone = lambda ss: len(wanted - {norm_id(i) for x in ss for i, _ in x.subs})
    taken = 0
    for prefix in sorted({w.split(".")[0] for w in wanted}, key=int)[:most]:
        mine = {w for w in wanted if w.split(".")[0] == prefix}
        run = sanitize(runs.get(prefix, []), prefix, mine)
        new = splice(secs, run, prefix) if run and mine <= {i for i, _ in run} else None
        if new and gone(new) < gone(secs) and size(new) >= size(secs) * 2 // 5:
            secs, taken = new, taken + 1
    return secs, taken


def spliced(rel: DataFrame, runs: DataFrame, missing: DataFrame) -> DataFrame:
    """The relation after adopt_runs with runs (doc_id, prefix, pos, id, content) and missing (doc_id, id); note holds the
    number of runs taken. More than 24 missing ids are left alone."""
    few = missing.groupBy("doc_id").agg(F.count_distinct("id").alias("n")).where("n <= 24").select("doc_id")

    def fold_(secs, runs, wanted):
        parts: dict[str, list] = {}
        for r in sorted(runs, key=lambda r: (r["prefix"], r["pos"])):
            parts.setdefault(r["prefix"], []).append([r["id"], r["content"]])
        secs, taken = adopt_runs(secs, parts, {w["id"] for w in wanted}) if parts and wanted else (secs, 0)
        return secs, str(taken)

    return flat(by_document(rel, {"runs": runs.join(few, "doc_id", "left_semi"), "wanted": missing.join(few, "doc_id", "left_semi")}, fold_))
