"""Languages of documents and of the segments inside them, by hierarchical discrimination.

First the family is chosen (one linear support vector machine for each against the rest), then one-versus-one
machines vote among the languages of that family. All machines score a word by its own weights, those of the word
and of the letter trigrams inside it, so a segment's score is the mean over its words and each distinct word is
scored once. The machines are fitted on a bounded sample of labelled documents, twice: labels that the first fit
contradicts are left out of the second.
"""
from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt"), "slavic": ("pl",)}
# What labels call the languages, beside the two-letter code and a region behind it.
NAMES = {"de": "deu ger german deutsch", "en": "eng english", "fr": "fra fre french français francais",
         "it": "ita italian italiano", "es": "spa spanish español espanol castellano", "pt": "por portuguese português",
         "nl": "nld dut dutch nederlands", "pl": "pol polish polski"}
DIMS = 4096
SAMPLE_DOCS, SAMPLE_SEGMENTS = 120, 400  # labelled documents and segments of each language that the fit may see
SEGMENTS_READ, LONGEST = 5, 4000  # segments of one document that the fit may see, and characters of one
LEAST_WORDS = 4  # words of a segment that is judged by itself
SURE = 0.6  # confidence from which a full sentence counts for a language beside the main one
SENTENCES = 2  # full sentences that make a language present

LANGS = [x for f in FAMILIES.values() for x in f]
PAIRS = [(f, a, b) for f, ls in FAMILIES.items() for a, b in combinations(ls, 2)]
_cut = re.compile(r"[ \n\t](?:(?<=\n)\n*|(?:(?<=[^\W\d_]{3}[.!?].)|(?<=[^\W\d_]{3}[.!?][)\"“”»«].)|(?<=\d{3}[.!?].)|(?<=[)][.!?].))[ \t]*(?=[^\W\d_a-zà-ÿ])"
                  r"|(?<=[?!…].)(?=[¿¡«]))", re.S).split
_figures = re.compile(r"\d+").sub
_words = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").findall
_ended = re.compile(r"[.!?…][)\"“”»«’']*\s*$").search


def label_language(label: Column) -> Column:
    """The language a label names: code, code with a region or name, in any case; null if it names none known."""
    x = F.lower(F.trim(label))
    base = F.regexp_extract(x, r"^([\p{L}]+)(?:[-_ ].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(base.isin(lang, *names.split()), lang).otherwise(out)
    return out


def features(word: str) -> list[int]:
    w = f"^{word}$"
    marks = [c for c in word if not c.isascii()]
    return [crc32(x.encode()) % DIMS for x in (w, *(w[i:i + 3] for i in range(len(w) - 2)), *marks, *marks)]


def segments(text: str) -> list[str]:
    """Lines, cut at sentence ends."""
    return [s for s in _cut(text) if s and not s.isspace()]


def _vector(words: list[str]) -> np.ndarray:
    x = np.zeros(DIMS, dtype=np.float32)
    for w in words:
        f = features(w.lower())
        np.add.at(x, f, 1.0 / (len(f) * len(words)))
    return x


def _machine(x: np.ndarray, y: np.ndarray, soft: float = 0.05, epochs: int = 20) -> np.ndarray:
    """The linear machine with squared hinge loss for labels y in {-1, 1}, by coordinate descent in the dual."""
    w = np.zeros(x.shape[1], dtype=np.float32)
    alpha, size = np.zeros(len(y)), (x * x).sum(1) + soft
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = max(0.0, alpha[i] - (y[i] * float(x[i] @ w) - 1 + soft * alpha[i]) / size[i])
            if abs(new - alpha[i]) > 1e-6:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-2:
            break
    return w


class Model:
    """Weights: a column for each family, then one for each pair."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.row: dict[str, int] = {}
        self.segments: dict[str, tuple] = {}
        self.table = np.zeros((1024, weights.shape[1]), dtype=np.float32)

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.__init__(weights)

    def word(self, w: str) -> int:
        if len(self.row) >= 500_000:
            self.row.clear()
        k = self.row[w] = len(self.row)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.weights[features(w.lower())].mean(0)
        return k

    def judge(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and confidence of each list of words (none empty)."""
        if not parts:
            return np.zeros(0, int), np.zeros(0)
        if len(self.row) > 400_000:
            self.row.clear()
        get, add = self.row.get, self.word
        rows = [k if (k := get(w)) is not None else add(w) for p in parts for w in p]
        sizes = np.array([len(p) for p in parts])
        score = np.add.reduceat(self.table[rows], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        sure = 1 / (1 + np.exp(-4 * score))
        fam = sure[:, :len(FAMILIES)]
        best = fam.argmax(1)
        total = np.maximum(fam.sum(1), 1e-9)
        lang, conf = np.zeros(len(parts), int), np.zeros(len(parts))
        for f, (name, langs) in enumerate(FAMILIES.items()):
            at = np.flatnonzero(best == f)
            votes = np.zeros((len(at), len(langs)))
            for k, (family, a, b) in enumerate(PAIRS):
                if family == name:
                    p = sure[at, len(FAMILIES) + k]
                    for who, q in ((a, p), (b, 1 - p)):
                        votes[:, langs.index(who)] += (q > 0.5) + 1e-3 * q
            won = votes.argmax(1)
            least = np.ones(len(at))
            for k, (family, a, b) in enumerate(PAIRS):
                if family == name:
                    p = sure[at, len(FAMILIES) + k]
                    least = np.where(won == langs.index(a), np.minimum(least, p), least)
                    least = np.where(won == langs.index(b), np.minimum(least, 1 - p), least)
            lang[at] = [LANGS.index(langs[j]) for j in won]
            conf[at] = fam[at, f] / total[at] * least
        return lang, conf


_fitted: dict[tuple, "Model"] = {}


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int, str, list[str]]]:
    """(language, hash, id, segments): of each language the SAMPLE_DOCS labelled documents with the least hash of the id (of
    several texts of one id the first), and of each up to SEGMENTS_READ segments spread over it, none longer than LONGEST,
    so that what the driver takes is bounded. Exact and the same on every run: the hash is bounded by the number of
    documents to about eight times as many as wanted, and the bound raised for languages that are short by it."""
    d = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).cast("string").alias("d"), F.col(text_col).cast("string").alias("t"),
                  label_language(F.col(label_col)).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    most = 2**63 - 1
    counts = {r.l: r.n for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}  # at most a row for each language
    bounds = {lang: _bound(8 * SAMPLE_DOCS / n) for lang, n in counts.items()}

    def cut(batches):
        for b in batches:
            parts = []
            for t in b.column(3).to_pylist():
                ws = [s for s in segments(t) if len(s) <= LONGEST and len(_words(s)) >= LEAST_WORDS]
                parts.append(ws[::len(ws) // 4 or 1][:SEGMENTS_READ])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(parts, pa.list_(pa.string()))], names=["l", "h", "d", "s"])

    out: list[tuple] = []
    while bounds:
        below = reduce(lambda x, y: x | y, [(F.col("l") == lang) & (F.col("h") <= h) for lang, h in bounds.items()])
        one = d.where(below).groupBy("l", "h", "d").agg(F.min("t").alias("t"))
        least = one.withColumn("rn", F.row_number().over(W.partitionBy("l").orderBy("h", "d"))).where(F.col("rn") <= SAMPLE_DOCS)
        rows = [tuple(r) for r in least.select("l", "h", "d", "t").mapInArrow(cut, "l STRING, h BIGINT, d STRING, s ARRAY<STRING>").collect()]
        got = Counter(r[0] for r in rows)
        done = {lang for lang, h in bounds.items() if got[lang] >= SAMPLE_DOCS or h == most}
        out += [r for r in rows if r[0] in done]
        bounds = {lang: _bound(8 * ((h + 2**63) / 2**64)) for lang, h in bounds.items() if lang not in done}
    return sorted(out)


def _bound(part: float) -> int:
    """The hash below which about this part of all hashes lie."""
    return 2**63 - 1 if part >= 1 else int(part * 2**64) - 2**63


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """From sample() of each language. The same sample gives the same machines, which are fitted once."""
    rows = sample(df, id_col, text_col, label_col)
    key = tuple(rows and [hash(str(rows))])
    if key not in _fitted:
        if len(_fitted) > 20:
            _fitted.clear()
        _fitted[key] = _machines(rows)
    return _fitted[key]


def _machines(rows: list[tuple[str, int, str, list[str]]]) -> Model:
    found: dict[str, list[list[str]]] = {x: [] for x in LANGS}
    for lang, _, _, parts in rows:
        if len(found[lang]) < SAMPLE_SEGMENTS:
            found[lang] += map(_words, parts)
    x, y = [], []
    for k, lang in enumerate(LANGS):
        for w in found[lang][:SAMPLE_SEGMENTS]:
            x.append(_vector(w))
            y.append(k)
    x, y = np.array(x, dtype=np.float32).reshape(-1, DIMS), np.array(y, dtype=int)
    scale = np.float32(1 / max(1e-6, np.sqrt((x * x).sum(1)).max(initial=0)))
    keep = np.ones(len(y), bool)
    weights = np.zeros((DIMS, len(FAMILIES) + len(PAIRS)), dtype=np.float32)
    for _ in range(2):
        names = np.array(LANGS)[y] if len(y) else np.array([], str)
        sides = [(np.isin(names, ls), np.ones(len(y), bool)) for ls in FAMILIES.values()]
        sides += [(names == a, np.isin(names, (a, b))) for _, a, b in PAIRS]
        for k, (one, both) in enumerate(sides):
            at = np.flatnonzero(both & keep)
            if len(at):
                weights[:, k] = _machine(scale * x[at], np.where(one[at], 1.0, -1.0)) * scale
        model = Model(weights)
        words = [w for lang in LANGS for w in found[lang][:SAMPLE_SEGMENTS]]
        lang, _ = model.judge(words)
        keep = lang == y
    return Model(weights)


def _document(model: Model, texts: list[str | None]) -> list[list[tuple[int, str, float, int, bool]]]:
    """For each text its segments: (language number, segment, confidence, words, full sentence). A segment of fewer
    than LEAST_WORDS words takes the language of the one before it, or of the next; in a text without a longer one the
    longest is judged. Segments that differ in figures alone are judged once."""
    cache = model.segments
    if len(cache) > 200_000:
        cache.clear()
    split = [segments(t) if t else [] for t in texts]
    keys = [[_figures("0", s) for s in segs] for segs in split]
    new = {k: _words(k) for ks in keys for k in ks if k not in cache}
    for k, w in new.items():
        cache[k] = (None, 0.0, len(w), bool(_ended(k)) and len(w) >= LEAST_WORDS)
    long = [k for k, w in new.items() if len(w) >= LEAST_WORDS]
    for k, g, c in zip(long, *model.judge([new[k] for k in long])):
        cache[k] = (int(g), float(c), *cache[k][2:])
    out = []
    for segs, ks in zip(split, keys):
        rows = [[g, s, c, n, full] for s, (g, c, n, full) in zip(segs, map(cache.__getitem__, ks))]
        if rows and all(r[0] is None for r in rows):
            longest = max(rows, key=lambda r: r[3])
            if longest[3]:
                g, c = model.judge([_words(longest[1])])
                longest[0], longest[2] = int(g[0]), float(c[0])
        last = next((r[0] for r in rows if r[0] is not None), None)
        for r in rows:
            if r[0] is None:
                r[0] = last
            last = r[0]
        out.append(rows)
    return out


SPANS = "doc_id BIGINT, pos INT, lang STRING, confidence DOUBLE, sentences INT, words INT, segment STRING"


def spans(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(doc_id, pos, lang, confidence, sentences, words, segment): the runs of segments in one language, in order.
    Texts that are null, blank or without a letter have none; repeated rows are judged once each."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rows = []
            ids = b.column(0).to_pylist()
            for d, segs in zip(ids, _document(shared.value, b.column(1).to_pylist())):
                runs = []
                for g, s, c, n, full in segs:
                    if g is None:
                        continue
                    if runs and runs[-1][0] == g:
                        r = runs[-1]
                        r[1], r[2], r[3] = r[1] + c * n, r[2] + full, r[3] + n
                        r[4].append(s)
                    else:
                        runs.append([g, c * n, int(full), n, [s]])
                rows += [(d, k, LANGS[r[0]], r[1] / max(1, r[3]), r[2], r[3], "\n".join(r[4])) for k, r in enumerate(runs)]
            yield from pa.Table.from_pandas(pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])
                                            .astype({"doc_id": "int64", "pos": "int32", "sentences": "int32", "words": "int32",
                                                     "confidence": "float64", "lang": "object", "segment": "object"}),
                                            schema=_ARROW, preserve_index=False).to_batches()

    src = df.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t")).where("d IS NOT NULL")
    return src.mapInArrow(run, SPANS)


_ARROW = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()),
                    ("sentences", pa.int32()), ("words", pa.int32()), ("segment", pa.string())])


def present(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Model) -> DataFrame:
    """(doc_id, lang, label, main BOOLEAN, confidence, sentences, words): the languages present in each document, the
    one with most words first (ties: alphabet), and every other with at least SENTENCES full sentences; label is the
    language that the document's label names, null if none. Repeated rows of one id count once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = []
            for d, lab, segs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(),
                                    _document(shared.value, b.column(1).to_pylist())):
                by: dict[int, list] = {}
                for g, _, c, n, full in segs:
                    if g is not None:
                        t = by.setdefault(g, [0.0, 0, 0])
                        t[0], t[1], t[2] = t[0] + c * n, t[1] + (full and c >= SURE), t[2] + n
                if by:
                    top = min(by, key=lambda g: (-by[g][2], LANGS[g]))
                    out += [(d, LANGS[g], lab, g == top, t[0] / max(1, t[2]), t[1], t[2]) for g, t in by.items()
                            if g == top or t[1] >= SENTENCES]
            names = ["doc_id", "lang", "label", "main", "confidence", "sentences", "words"]
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int32(), pa.int32()]
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    src = df.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t"),
                    label_language(F.col(label_col)).alias("l")).where("d IS NOT NULL")
    return src.mapInArrow(run, "doc_id BIGINT, lang STRING, label STRING, main BOOLEAN, confidence DOUBLE, sentences INT, words INT")
