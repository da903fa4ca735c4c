"""Traces of scanning in texts.

Skip-gram vectors are learnt from all texts: the counts of words near each other, gathered once for each form of a
sentence with masked figures, make the matrix of positive pointwise mutual information whose factors are the vectors
that skip-gram with one negative sample converges to. A rare word is linked to a frequent one if plausible
edits of glyphs lead from one to the other, which holds if both fold to one skeleton; it is corrected where the
vectors of the words around it agree with the frequent word. Page furniture is told by its look, or by texts that hold
the line in different places and across their sentences; what is left flows into paragraphs.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import written

RATIO = 30  # times that the frequent word must be more frequent
LEAST_TARGET = 30  # occurrences of the frequent word
COMMON = 1e-4  # part of all words from which a word has a vector; so at most 1 / COMMON words have one
FREQUENT = 4e-6  # part of all words from which a word is taken as known; so at most 1 / FREQUENT words are sent around
DIMS, NEGATIVES, NEAR = 50, 1, 2  # with one negative sample for each pair the matrix is shifted by log 1, that is not at all; 5 turn down true misreadings
FIT = 0.1  # least cosine of a word's neighbours with the frequent word
UNBROKEN = 5  # a word is no misreading if one in so many of its occurrences is in a text without line breaks
REPEATS = 3  # texts that hold a line
SALTS = 8  # parts of the texts that hold one header
SAME_WORD = 0.5  # part of a line's occurrences with one word before it, or behind it, from which it belongs to that word
BREAKS = 0.2  # least part of a header's places between lines where the sentence runs on across it

# Glyphs that scanners take for one another, by the glyph that stands for the group.
GLYPHS = {"1": "l", "I": "l", "i": "l", "|": "l", "!": "l", "0": "o", "O": "o", "c": "e", "f": "t", "b": "h", "u": "n", "9": "g", "q": "g",
          "5": "s", "S": "s", "8": "B", "rn": "m", "vv": "w", "cl": "d", "ii": "ü"}
_single = {k: v for k, v in GLYPHS.items() if len(k) == 1}
_word = re.compile(r"[^\W_]+(?:[¨!|][^\W_]*)*")
_text = _word.findall
_diaeresis = {"a¨": "ä", "o¨": "ö", "u¨": "ü", "A¨": "Ä", "O¨": "Ö", "U¨": "Ü"}
_break = re.compile(r"[-‐¬\xad][ \t]*\n[ \t]*(?=[a-zäöüß])")
_digits = re.compile(r"\d+")
# numbers that stand alone; a figure inside a word may be a misread letter
_numbers = re.compile(r"\d(?<![^\W_]\d)[\d.,/]*(?![^\W_])")
_pieces = _numbers.split

NUMBER = r"\d{1,4}"
_pageno = re.compile(rf"^[ \t]*(?:[-–—\[(][ \t]*{NUMBER}[ \t]*[-–—\])]|(?:Seite|Blatt|Page|S\.|p\.)[ \t]*{NUMBER}(?:[ \t]*(?:von|/|of)[ \t]*{NUMBER})?|"
                     rf"{NUMBER}[ \t]*(?:/|von)[ \t]*{NUMBER})[ \t]*$", re.I).match
_bare = re.compile(rf"^[ \t]*{NUMBER}[ \t]*$").match
_with_no = re.compile(rf"(?:[ \t]+[–—|·-][ \t]*|[ \t]{{2,}})(?:(?:Seite|Blatt|S\.|Page)[ \t]*)?{NUMBER}(?:[ \t]*(?:/|von|of)[ \t]*{NUMBER})?[ \t]*$|^[ \t]*(?:Seite[ \t]*)?{NUMBER}(?:[ \t]*/[ \t]*{NUMBER})?"
                      rf"(?:[ \t]{{2,}}|[ \t]*[–—|·][ \t]*)(?=\D)", re.I)
_signs = re.compile(r"[ \t][|·•][ \t]").search
_dated = re.compile(r"\bStand \d\d/\d{4}$|\bFassung \d{4}$").search
_register = re.compile(r"UR-N[Rr]\. ?\d+").match
_capitals = re.compile(r"[^a-zäöüß\n]{0,3}(?:[A-ZÄÖÜ]{3,}[^a-zäöüß\n]*)$").match
_own = re.compile(r"(?:und|oder|bzw|sowie|als|bis|noch|wie|et|and|or|ou|en|of)\b").match
_ENDS = frozenset(".,;:!?“”»«)-‐¬\xad…")
_numbered_item = re.compile(r"\w{1,2}[.)] ").match
_closes = re.compile(r"[.:!?“”»«)…]$").search
_plain_words = re.compile(r"[^\W_]+").findall
# Words behind which the line runs on, so that it is no header.
_runs_on = re.compile(r"(?<!\w)(?:d(?:er|ie|as|en|em|es)|eine?[mnrs]?|und|oder|sowie|bzw\.|von|vo[mr]|z(?:u|um|ur)|a[mn]|auf|aus|bei|beim|bis|durch|für|gegen|i[mn]|ins|mit|nach|ohne|seit|über|um|unter|"
                      r"wegen|als|wie|wenn|dass|sofern|soweit|the|an?|of|to|on|by|for|and|or|with)$", re.I).search


def pieces(text: str) -> list[str]:
    """The text between numbers, broken words joined and umlauts made of two signs composed. Pieces recur, so what is
    to be done with their words is done once for each."""
    return _pieces(_composed(_joined(text)))


def _joined(text: str) -> str:
    return _break.sub("", text) if "\n" in text else text


def _composed(text: str) -> str:
    if "¨" in text:
        for a, b in _diaeresis.items():
            text = text.replace(a, b)
    return text


def _without_no(line: str) -> str:
    """A line without the page number at one of its ends."""
    x = line.strip()
    return _with_no.sub("", line) if x and (x[-1].isdigit() or x[0].isdigit() or x[:5].lower() == "seite") else line


def line_key(line: str) -> str:
    return _digits.sub("#", _without_no(line).strip().lower())


def _look(s: str) -> bool:
    return bool((("|" in s or "·" in s or "•" in s) and _signs(s)) or (s[-1:].isdigit() and _dated(s)) or _register(s) or _capitals(s))


def skeleton(word: Column) -> Column:
    x = F.translate(word, "".join(_single), "".join(_single.values()))
    for a, b in (("ü", "ll"), ("Ü", "ll"), ("rn", "m"), ("vv", "w"), ("el", "d")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def layout(lines: list[str]) -> tuple[set[str], list[tuple[int, str, bool]], list[bool]]:
    """(kinds found, lines that may be headers as number, key and whether they hold a page number, furniture for sure by
    line)."""
    n = len(lines)
    kinds: set[str] = set()
    maybe: list[tuple[int, str, bool]] = []
    sure = [False] * n
    prose = sum(len(x) > 25 for x in lines) > 0
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if _pageno(s):
            kinds.add("pageno")
            sure[k] = True
        elif _bare(s):
            beside = [lines[j] for j in (k - 1, k + 1) if 0 <= j < n]
            if prose and not any(_bare(x.strip()) for x in beside) and not (k and lines[k - 1].rstrip().endswith(":")):
                kinds.add("pageno")
                sure[k] = True
        elif n > 1:
            open_end = s[-1] not in _ENDS
            bare = _without_no(line)
            numbered = open_end and bare != line
            bare = bare.strip()
            if s[-1] not in ".,;“" and _look(bare):
                kinds.add("header")
                sure[k] = True
                if numbered:
                    kinds.add("pageno")
            elif open_end and (numbered or s[0].isupper()) and not _numbered_item(s) and not _runs_on(bare[-8:]):  # the longest of these words has six letters
                maybe.append((k, _digits.sub("#", bare.lower()), numbered))
    for k in range(n - 1):
        s = lines[k].rstrip()
        if len(s) > 1 and s[-1] in "-‐¬\xad" and s[-2].isalpha():
            following = next((x.lstrip() for j, x in enumerate(lines[k + 1:k + 5], k + 1) if not sure[j] and x.strip()), "")
            later = [x.lstrip() for x in lines[k + 2:k + 4]]
            if s[-1] != "-" or (following[:1].islower() and not _own(following)):
                kinds.add("hyphen")
            elif following[:1].isupper() and any(x[:1].islower() and not _own(x) for x in later[:1]) and line_key(following) in {m for _, m, _ in maybe} and len(following) < 45:
                kinds.add("hyphen")
    return kinds, maybe, sure


def surroundings(lines: list[str], maybe: list[tuple[int, str, bool]], sure: list[bool]) -> list[tuple[str, str]]:
    """(kind, word) of what tells whether the lines that may be headers are: the line, once for a text (line); the line with
    the word before it (before) and behind it (after), furniture left out; whether it stands between lines (between), and
    whether a sentence runs on from the one above to the one below (breaks)."""
    out = [("line", key) for key in {key for _, key, _ in maybe}]
    if not maybe:
        return out
    stay = [k for k, x in enumerate(lines) if x.strip() and not sure[k]]
    at = {k: j for j, k in enumerate(stay)}
    for k, key, _ in maybe:
        j = at[k]
        above = lines[stay[j - 1]].strip() if j else ""
        below = lines[stay[j + 1]].strip() if j + 1 < len(stay) else ""
        for kind, words, n in (("before", above, -1), ("after", below, 0)):
            w = _plain_words(words.lower())
            if w:
                out.append((kind, f"{key}\n{_digits.sub('#', w[n])}"))
        if above and below:
            out.append(("between", key))
            if not _closes(above) and not below[0].isupper():
                out.append(("breaks", key))
    return out


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
              .where(r"id IS NOT NULL AND t RLIKE '\\S'"))


def read(src: DataFrame) -> DataFrame:
    """Rows (kind, word, n, id, at, numbered) of texts (id, t), which are laid out but once. Counts: words with their number
    of occurrences (word), of those in texts without line breaks (flat), and lines that may be headers with their number of
    texts (line) and their surroundings(). Marks of a text, n null: hyphen, header and pageno that are sure, the numbers of the
    lines that are furniture for sure (sure), and the lines that may be headers (maybe)."""

    def run(batches):
        broken: Counter = Counter()
        flat: Counter = Counter()
        lines: Counter = Counter()
        for b in batches:
            kinds, words, ids, at, numbers = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if "\n" in t.strip():
                    broken.update(pieces(t))
                    split = t.split("\n")
                    found, maybe, sure = layout(split)
                    lines.update(surroundings(split, maybe, sure))
                    marks = [*((k, None, None, None) for k in found), *(("maybe", x, k, no) for k, x, no in maybe),
                             *(("sure", None, k, None) for k, x in enumerate(sure) if x)]
                    for kind, x, k, no in marks:
                        kinds.append(kind), words.append(x), ids.append(i), at.append(k), numbers.append(no)
                else:
                    flat.update(pieces(t))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.nulls(n, pa.int64()), pa.array(ids, pa.int64()),
                                              pa.array(at, pa.int32()), pa.array(numbers, pa.bool_())], names=_READ)
            if len(broken) + len(flat) + len(lines) > 200_000:
                yield _counts(broken, flat, lines)
                broken.clear()
                flat.clear()
                lines.clear()
        yield _counts(broken, flat, lines)

    return src.mapInArrow(run, "kind STRING, word STRING, n BIGINT, id BIGINT, at INT, numbered BOOLEAN")


_READ = ["kind", "word", "n", "id", "at", "numbered"]


def vocabulary(rows: DataFrame) -> DataFrame:
    """(kind, word, n): the counts of read()."""
    return rows.where("n IS NOT NULL").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _counts(broken: Counter, flat: Counter, lines: Counter) -> pa.RecordBatch:
    found: Counter = Counter()
    unbroken: Counter = Counter()
    for pieces_, counters in ((broken, (found,)), (flat, (found, unbroken))):
        for piece, n in pieces_.items():
            for w in _text(piece):
                for c in counters:
                    c[w] += n
    kinds = ["word"] * len(found) + ["flat"] * len(unbroken) + [k for k, _ in lines]
    k = len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([*found, *unbroken, *(x for _, x in lines)], pa.string()),
                                       pa.array([*found.values(), *unbroken.values(), *lines.values()], pa.int64()), pa.nulls(k, pa.int64()),
                                       pa.nulls(k, pa.int32()), pa.nulls(k, pa.bool_())], names=_READ)


def in_headers(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """The marks of lines that are headers. A header that a large part of the texts holds is spread over salts."""
    heads = headers(vocab).select("word", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt"))
    maybe = rows.where("kind = 'maybe'").select("word", F.pmod(F.hash("id", "at"), F.lit(SALTS)).alias("salt"), "id", "at", "numbered")
    return maybe.join(heads, ["word", "salt"])


def headers(vocab: DataFrame) -> DataFrame:
    """(word): the lines that are headers, by shares, which copies of a clause don't change: REPEATS texts hold the line, no
    word stands before or behind most of its occurrences, as it does where the line is part of a clause, and it breaks
    sentences, as the first line of a clause doesn't."""
    n = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
    share = lambda kind: F.max(n(kind)) / F.sum(n(kind))
    return (vocab.where("kind IN ('line', 'before', 'after', 'between', 'breaks')").groupBy(F.substring_index("word", "\n", 1).alias("word"))
                 .agg(F.max(n("line")).alias("texts"), share("before").alias("before"), share("after").alias("after"),
                      F.max(n("between")).alias("between"), F.max(n("breaks")).alias("breaks"))
                 .where((F.col("texts") >= REPEATS) & (F.col("before") <= SAME_WORD) & (F.col("after") <= SAME_WORD)
                        & (F.col("breaks") >= BREAKS * F.col("between"))).select("word"))


def words_of(vocab: DataFrame) -> int:
    return vocab.where("kind = 'word'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def frequent(total: int) -> float:
    """Occurrences from which a word is taken as known, and as one that others may be misreadings of."""
    return max(LEAST_TARGET, FREQUENT * total)


def links(vocab: DataFrame, total: int) -> DataFrame:
    """(word, target, n, n_target): rare words with the frequent word of their skeleton. Scanned pages keep their lines, so
    a word that texts without line breaks use too is a word of its own."""
    flat = vocab.where("kind = 'flat'").select("word", F.col("n").alias("n_flat"))
    v = vocab.where("kind = 'word'").where(F.col("word").rlike(r"\p{L}.*[\p{L}]") & (F.length("word") >= 3)).withColumn("sk", skeleton(F.col("word")))
    top = (v.where(F.col("word").rlike(r"^\p{L}+$")).groupBy("sk").agg(F.max_by("word", F.struct("n", "word")).alias("target"), F.max("n").alias("n_target"))
            .where(F.col("n_target") >= frequent(total)))
    return (v.join(top, "sk").where(f"word <> target AND n * {RATIO} <= n_target").where(F.lower("word") != F.lower("target"))
             .join(flat, "word", "left").where(f"coalesce(n_flat, 0) * {UNBROKEN} < n").select("word", "target", "n", "n_target"))


def vectors(pairs: list[tuple[int, int, float]], n: int, negatives: float = NEGATIVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context vectors from the counts of pairs of the n common words, and each word's part of all contexts; a
    pair counts for both of its words."""
    m = np.zeros((n, n), dtype=np.float64)
    for a, b, k in pairs:
        m[a, b] += k
        m[b, a] += k
    total = max(1.0, m.sum())
    out = np.log(np.maximum(m, 1e-9) * total / np.maximum(np.outer(m.sum(1), m.sum(0)), 1e-9)) - np.log(negatives)
    out = np.where(m > 0, np.maximum(out, 0), 0)
    u, s, vt = np.linalg.svd(out, full_matrices=False) if n <= 3000 else _top(out)
    d = min(DIMS, len(s))
    return u[:, :d] * np.sqrt(s[:d]), vt[:d].T * np.sqrt(s[:d]), m.sum(0) / total


def _top(m: np.ndarray):
    """Leading factors of a large matrix by subspace iteration."""
    q = np.linalg.qr(m @ np.random.default_rng(3).standard_normal((m.shape[1], DIMS + 10)))[0]
    for _ in range(3):
        q = np.linalg.qr(m @ (m.T @ q))[0]
    u, s, vt = np.linalg.svd(q.T @ m, full_matrices=False)
    return q @ u, s, vt


def found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id BIGINT, kind STRING): hyphen, misread, header and pageno of each text, once each.

    Null, empty and blank texts and null ids have none; repeated rows give their kinds once, several texts of one id each
    by itself.
    """
    src = _source(df, id_col, text_col)
    rows = written(read(src))
    vocab = written(vocabulary(rows))
    misread = misreads(src, vocab).select("id", F.lit("misread").alias("kind"))
    line = in_headers(rows, vocab).select("id", F.explode(F.when(F.col("numbered"), F.array(F.lit("header"), F.lit("pageno")))
                                                           .otherwise(F.array(F.lit("header")))).alias("kind"))
    sure = rows.where("kind IN ('hyphen', 'header', 'pageno') AND n IS NULL").select("id", "kind")
    return sure.unionByName(misread).unionByName(line).distinct()


def misreads(src: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, word, target, n): in texts (id, t) the n-th occurrence of a linked word in its text, from 0, where the vectors of
    the words around it agree with the target. The vectors of common words are factors of the counts of their pairs; any
    other target's vector is made of its own pairs with the common words."""
    spark = src.sparkSession
    total = words_of(vocab)
    link = written(links(vocab, total))
    word = vocab.where("kind = 'word'")
    common = [r.word for r in word.where(F.col("n") >= max(1.0, COMMON * total)).orderBy("word").select("word").toLocalIterator()]
    known = [r.word for r in word.where(F.col("n") >= frequent(total)).join(link.select("word"), "word", "left_anti").orderBy("word").select("word").toLocalIterator()]
    size = len(common)
    number = {w: k for k, w in enumerate(common)}
    for w in known:
        number.setdefault(w, len(number))
    share_known, share_number = spark.sparkContext.broadcast(set(known)), spark.sparkContext.broadcast(number)

    def run(batches):
        known, number = share_known.value, share_number.value
        seen: Counter = Counter()
        unknown: dict[str, list] = {}

        def odd(piece):
            """Unknown words of a piece, each with the common words around it."""
            w = _text(piece)
            return [(x, [c for y in (*w[max(0, k - NEAR):k], *w[k + 1:k + 1 + NEAR]) if (c := number.get(y, size)) < size])
                    for k, x in enumerate(w) if x not in known and len(x) >= 3 and not x.isdigit()]

        for b in batches:
            ids, ws, near, nth = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = pieces(t)
                times: dict[str, int] = {}
                seen.update(parts)
                for part in parts:
                    got = unknown.get(part)
                    if got is None:
                        if len(unknown) > 200_000:
                            unknown.clear()
                        got = unknown[part] = odd(part)
                    for x, around in got:
                        times[x] = times.get(x, -1) + 1
                        ids.append(i), ws.append(x), near.append(around), nth.append(times[x])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.string()), pa.array(near, pa.list_(pa.int32())), pa.array(nth, pa.int64())],
                                             names=["id", "word", "near", "n"])
            if len(seen) > 100_000:
                yield _pairs(seen, number, size)
                seen.clear()
        yield _pairs(seen, number, size)

    marks = written(src.mapInArrow(run, "id BIGINT, word STRING, near ARRAY<INT>, n BIGINT"))
    pair = marks.where("word IS NULL").groupBy(F.col("near")[0].alias("a"), F.col("near")[1].alias("b")).agg(F.sum("n").alias("n"))
    pair = written(pair)
    word_vectors, context_vectors, weight = vectors([(r.a, r.b, float(r.n)) for r in pair.where(F.greatest("a", "b") < size).toLocalIterator()], size)
    share_vectors = spark.sparkContext.broadcast((word_vectors, context_vectors, weight))

    def fold_in(batches):
        _, cs, weight = share_vectors.value
        for b in batches:
            out = []
            for near, ns in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = np.array(ns, dtype=np.float64)
                pmi = np.maximum(np.log(n / (n.sum() * np.maximum(weight[near], 1e-12))) - np.log(NEGATIVES), 0)
                out.append((pmi @ cs[near]).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["target", "vector"])

    ids = spark.createDataFrame([(w, k) for w, k in number.items() if k >= size], "target STRING, k INT") if len(number) > size else None
    targets = link.select("target").distinct()
    own = None
    if ids is not None:
        far = pair.where(F.greatest("a", "b") >= size).select(F.greatest("a", "b").alias("k"), F.least("a", "b").alias("near"), "n").groupBy("k", "near").agg(F.sum("n").alias("n"))
        own = (far.groupBy("k").agg(F.collect_list("near").alias("near"), F.collect_list("n").alias("n")).join(ids.join(targets, "target", "left_semi"), "k")
                  .select("target", "near", "n").mapInArrow(fold_in, "target STRING, vector ARRAY<DOUBLE>"))

    def fits(batches):
        ws, cs, _ = share_vectors.value
        number = share_number.value
        for b in batches:
            keep = []
            for at, (target, near, own) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist())):
                k = number.get(target, size)
                w = ws[k] if k < size else np.array(own) if own else None
                if w is not None and near:
                    c = cs[near].mean(0)
                    norm = float(np.linalg.norm(c) * np.linalg.norm(w))
                    if norm > 0 and float(c @ w) / norm < FIT:
                        continue
                keep.append(at)
            yield b.select(["id", "word", "target", "n"]).take(pa.array(keep, pa.int64()))

    cand = marks.where("word IS NOT NULL").join(link.select("word", "target"), "word").select("id", "word", "target", "n", "near")
    cand = cand.join(own, "target", "left") if own is not None else cand.withColumn("vector", F.lit(None).cast("array<double>"))
    return cand.select("id", "word", "target", "n", "near", "vector").mapInArrow(fits, "id BIGINT, word STRING, target STRING, n BIGINT")


def _pairs(seen: Counter, number: dict[str, int], common: int) -> pa.RecordBatch:
    """Counts of numbered words within NEAR words of each other, in the order of the text; one of them at least common."""
    get, size = number.get, max(1, len(number))
    ids: list[int] = []
    sizes: list[int] = []
    gap = [-1] * NEAR
    for piece in seen:
        w = [get(x, -1) for x in _text(piece)]
        ids += w
        ids += gap
        sizes.append(len(w) + NEAR)
    x = np.array(ids, dtype=np.int64)
    n = np.repeat(np.fromiter(seen.values(), np.float64, len(seen)), sizes)
    keys, weights = [], []
    for d in range(1, NEAR + 1):
        ok = (x[:-d] >= 0) & (x[d:] >= 0) & (np.minimum(x[:-d], x[d:]) < common)
        keys.append(x[:-d][ok] * size + x[d:][ok])
        weights.append(n[:-d][ok])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(weights), minlength=len(key)).astype(np.int64)
    k = len(key)
    both = np.stack([key // size, key % size], axis=1).astype(np.int32).ravel()
    near = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * k + 1, 2, dtype=np.int32)), pa.array(both, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), near, pa.array(total, pa.int64())], names=["id", "word", "near", "n"])


def repaired(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id BIGINT, text STRING): the texts with furniture removed, broken words joined, misread words corrected and lines
    joined into paragraphs. The furniture is that of found(); what is a misread is judged in the texts without it, at each
    place by the vectors of the words around. Several texts of one id are repaired each by itself."""
    src = written(_source(df, id_col, text_col).distinct().withColumn("row", F.monotonically_increasing_id()))
    rows = written(read(src.select(F.col("row").alias("id"), "t")))
    vocab = written(vocabulary(rows))

    def clean(batches):
        for b in batches:
            out = []
            for t, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if gone:
                    drop = set(gone)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
                out.append(_composed(_joined(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["row", "id", "t"])

    gone = (rows.where("kind = 'sure'").select("id", "at").unionByName(in_headers(rows, vocab).select("id", "at"))
                .groupBy(F.col("id").alias("row")).agg(F.collect_set("at").alias("gone")))
    composed = F.col("t")
    for a, c in _diaeresis.items():
        composed = F.replace(composed, F.lit(a), F.lit(c))
    one = src.where(~F.contains("t", F.lit("\n"))).select("row", "id", F.when(F.contains("t", F.lit("¨")), composed).otherwise(F.col("t")).alias("t"))
    several = src.where(F.contains("t", F.lit("\n"))).join(gone, "row", "left").select("row", "id", "t", "gone").mapInArrow(clean, "row BIGINT, id BIGINT, t STRING")
    text = written(one.unionByName(several))
    misread = misreads(text.select(F.col("row").alias("id"), "t"), vocab)
    fix = misread.groupBy(F.col("id").alias("row")).agg(F.collect_list(F.struct("word", "n", "target")).alias("fix"))

    def run(batches):
        for b in batches:
            out = []
            for t, fix in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if fix:
                    t = _corrected(t, {(x["word"], x["n"]): x["target"] for x in fix})
                out.append(_paragraphs(" ", t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return text.join(fix, "row", "left").select("id", "t", "fix").mapInArrow(run, "id BIGINT, text STRING")


_paragraphs = re.compile(r"(?<![:;])[ \t]*\n[ \t]*(?![-•(]?\w{1,2}[.)]\s|[-•]\s|\d+\s*$)").sub


def _corrected(text: str, fix: dict[tuple[str, int], str]) -> str:
    """The text with the n-th occurrences of words replaced, words being those of its pieces."""
    times: Counter = Counter()

    def one(m):
        w = m.group()
        times[w] += 1
        return fix.get((w, times[w] - 1), w)

    out, at = [], 0
    for m in _numbers.finditer(text):
        out += [_word.sub(one, text[at:m.start()]), m.group()]
        at = m.end()
    return "".join([*out, _word.sub(one, text[at:])])
