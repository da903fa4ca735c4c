"""Test passages inside training texts, by a distributed positional inverted index.

The words of the test items are numbered; of every training text the positions of these words are found. The
number of texts with each word is counted over all texts, and in every window of an item its rarest words are its
probes. The lists of these words, (term, text, positions), are the index: a table spread and sorted by term, those of
heavy terms over salts. The lists that the probes ask for meet by text, where the items' own places are subtracted from
the positions; where probes of enough weight agree on the offset, up to what a page header or struck words shift, text
and item are a candidate. Candidates are matched over all words of the item: the best chain of words in the order of the
item, weighted by their rarity.
"""
from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalike import visible_form
from pagewright.session import written

WINDOW = 20  # words of the shortest passage
PROBES = 4  # probes among the words of a window
HITS = 3  # probes that must agree
AGREE = 0.6  # part of the weight of the probes of the item's lightest window that must agree
NEAR = 0.8  # part of the weight of some window that must be near at the offset
SLACK = 24  # words by which the offset may drift inside a passage
GAP_ITEM, GAP_TEXT = 4, 30  # longest run of unmatched words between two matched ones
SHARE = 0.86  # least part of a passage's words, and of their weight, that must match
MOST_ITEM_WORDS = 2_000_000  # words of test items that are sent to every executor; more are taken in blocks
SALTS = 8  # parts of the index that one term is spread over

_fold = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "á": "a", "à": "a", "â": "a", "ã": "a", "å": "a",
                       "ç": "c", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i",
                       "ñ": "n", "ó": "o", "ò": "o", "ô": "o", "õ": "o", "ú": "u", "ù": "u", "û": "u", "œ": "oe",
                       "æ": "ae", "ą": "a", "ć": "c", "ę": "e", "ł": "l", "ń": "n", "ś": "s", "ź": "z", "ż": "z"}
                      | dict.fromkeys("'’.,;:!?()[]{}\"„“”«»‚‘/\\|*_-–—…█■#", None))
_broken = re.compile(r"[-‐¬\xad]\s*\n\s*(?=[a-zäöüß])").sub


def fold(word: str) -> str:
    """A word without what makes no difference: look-alike characters, case, accents and marks."""
    if not word.isascii():
        word = visible_form(word)
    return word.lower().translate(_fold)


def parts(text: str) -> list[str]:
    """The words as they stand, those broken across lines joined."""
    if "\n" in text and any(b in text for b in ("-\n", "¬\n", "\xad\n", "‐\n")):
        text = _broken("", text)
    return text.split()


class Numbers(dict):
    """Word as it stands to its number among the items' words, 0 if it is none of them; filled on demand and
    emptied at a bound."""

    def __init__(self, vocab: dict[str, int], bound: int = 500_000):
        self.vocab, self.bound = vocab, bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = self.vocab.get(fold(word), 0)
        return got

    def __reduce__(self):
        return Numbers, (self.vocab, self.bound)


def _number(items: list[tuple[int, str]]) -> tuple[dict[str, int], dict[int, list[int]]]:
    """Words of the items to numbers from 1, in the order of the words; items to their words' numbers."""
    split = {i: [f for w in parts(t) if (f := fold(w))] for i, t in items}
    vocab = {w: k + 1 for k, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
    return vocab, {i: [vocab[w] for w in ws] for i, ws in split.items()}


def chain(item: list[int], terms: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[int, float, float]:
    """(words of the item from the first to the last matched, part of them matched, part of their weight matched)
    of the best passage: a chain of equal words in the order of both, with short gaps. The best has most weight
    matched less the weight missed inside it."""
    places = defaultdict(list)
    for i, t in enumerate(item):
        places[t].append(i)
    points = [(int(p), i) for t, p in zip(terms, at) for i in reversed(places.get(int(t), ()))]
    w = weight[item]
    before = np.concatenate([[0.0], np.cumsum(w)])
    best: list[tuple[float, int, int, float]] = []  # score, first item word, words matched, weight matched
    recent: list[int] = []
    top, lo = (0.0, 0, 0, 0.0, 0), 0
    for k, (p, i) in enumerate(points):
        got = (w[i], i, 1, w[i])
        while lo < k and points[lo][0] < p - GAP_TEXT:
            lo += 1
        for j in range(lo, k):
            q, h = points[j]
            if h < i <= h + GAP_ITEM and q < p and best[j][0] > 0:
                s = best[j]
                score = s[0] + w[i] - (before[i] - before[h + 1]) - 0.1 * max(0, abs((p - q) - (i - h)) - 1)
                if score > got[0]:
                    got = (score, s[1], s[2] + 1, s[3] + w[i])
        best.append(got)
        if got[0] > top[0]:
            top = (*got, i)
    if not best or top[2] == 0:
        return 0, 0.0, 0.0
    span = top[4] - top[1] + 1
    return span, top[2] / span, top[3] / (before[top[4] + 1] - before[top[1]])


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.int32()))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.int64)
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), values


class Lists:
    """The probes of the items by term: item number, place in the item; and the weight that must agree."""

    def __init__(self, items: dict[int, list[int]], probes: list[tuple[int, int, int]], idf: np.ndarray):
        self.ids = np.array(sorted(items), dtype=np.int64)
        number = {i: n for n, i in enumerate(self.ids.tolist())}
        p = np.array(sorted((t, number[i], k) for i, t, k in probes), dtype=np.int64).reshape(-1, 3)
        self.item, self.place = p[:, 1], p[:, 2]
        self.start = np.searchsorted(p[:, 0], np.arange(len(idf) + 1))
        self.idf = idf
        self.items = [np.array(items[i], dtype=np.int64) for i in self.ids.tolist()]
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        self.window = np.zeros(len(self.words))  # weight of the window of an item that begins at a word
        for x, at in zip(self.items, self.begin.tolist()):
            if size := min(WINDOW, len(x)):
                self.window[at:at + len(x) - size + 1] = np.convolve(idf[x], np.ones(size), "valid")
        self.least = np.zeros(len(self.ids))
        self.probes = np.bincount(self.item, minlength=len(self.ids))
        marked = {(i, k) for i, _, k in probes}
        for n, i in enumerate(self.ids.tolist()):
            ws = items[i]
            w = np.array([idf[t] if (i, k) in marked else 0.0 for k, t in enumerate(ws)])
            size = min(WINDOW, len(w))
            sums = np.convolve(w, np.ones(size), "valid") if size else np.zeros(1)
            self.least[n] = AGREE * sums.min(initial=np.inf) if size else np.inf


def agreeing(lists: Lists, terms: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """(item number, bin) where probes of enough weight have offsets in one bin; each hit counts in the two bins around it."""
    terms, at = terms.astype(np.int64), at.astype(np.int64)
    first, n = lists.start[terms], lists.start[terms + 1] - lists.start[terms]
    total = int(n.sum())
    if not total:
        return []
    which = np.repeat(np.arange(len(terms)), n)
    row = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + first[which]
    item, place = lists.item[row], lists.place[row]
    b = (at[which] - place) // SLACK
    low = int(b.min())
    bins = int(b.max()) - low + 2
    group, member = np.unique(np.concatenate([item * bins + b - low, item * bins + b - low + 1]), return_inverse=True)
    places = int(place.max()) + 1
    once, index = np.unique(member * places + np.tile(place, 2), return_index=True)  # a probe counts once in a bin
    of = once // places
    got = np.bincount(of, np.tile(lists.idf[terms[which]], 2)[index], minlength=len(group))
    who = group // bins
    ok = (np.bincount(of, minlength=len(group)) >= np.minimum(HITS, lists.probes[who])) & (got >= lists.least[who])
    return [(int(g // bins), int(g % bins) + low) for g in group[ok]]


def near(lists: Lists, keys: np.ndarray, pairs: list[tuple[int, int]]) -> list[int]:
    """The items of (item number, bin) of which a whole window is near at the offset: each of its words is looked up in the
    text within the drift, in whatever order, so that no passage is lost. keys are the sorted places of a text by term."""
    found: set[int] = set()
    n, b = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    size = lists.sizes[n]
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(size) // 500_000)) + 1):
        m, long = n[part], size[part]
        start = np.cumsum(long) - long
        place = np.arange(int(long.sum())) - np.repeat(start, long)
        row = np.repeat(lists.begin[m], long) + place
        low = lists.words[row] * (1 << 32) + np.maximum(0, np.repeat((b[part] - 2) * SLACK, long) + place)
        at = keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)]
        hit = (at >= low) & (at <= low + 4 * SLACK)
        sums = np.concatenate([[0.0], np.cumsum(hit * lists.idf[lists.words[row]])])
        window = np.repeat(np.minimum(WINDOW, long), long)
        first = np.flatnonzero(place <= np.repeat(long, long) - window)  # where a window begins
        ok = sums[first + window[first]] - sums[first] >= NEAR * lists.window[row[first]] - 1e-9
        found.update(np.repeat(m, long)[first[ok]].tolist())
    return sorted(found)


def found(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
          share: float = SHARE) -> DataFrame:
    """(doc_id BIGINT, item_id BIGINT, span INT, matched DOUBLE, weight DOUBLE): the documents that hold an item or
    a passage of at least WINDOW running words of it, with the length of the passage and the parts of its words and
    of their weight that match.

    An item shorter than WINDOW words must be there as a whole. Null, empty and blank texts and items match nothing;
    repeated rows count once, also items of one id with several texts, of which the first by order stands; the items
    are sent to every executor, those of a set of more than MOST_ITEM_WORDS words in blocks, one after the other. Other
    columns aren't read.
    """
    test = (items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t"))
                 .where("i IS NOT NULL AND t IS NOT NULL").groupBy("i").agg(F.min("t").alias("t")))
    size = test.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0))).first()[0]
    texts = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    if size <= MOST_ITEM_WORDS:
        return _found(texts, test, share)
    blocks = 2 * -(-size // MOST_ITEM_WORDS)
    return reduce(DataFrame.unionByName, [_found(texts, test.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k), share) for k in range(blocks)])


RESULT = "doc_id BIGINT, item_id BIGINT, span INT, matched DOUBLE, weight DOUBLE"


def _found(texts: DataFrame, test: DataFrame, share: float) -> DataFrame:
    spark = texts.sparkSession
    rows = sorted((r.i, r.t) for r in test.toLocalIterator())
    vocab, numbered = _number(rows)
    share_vocab = spark.sparkContext.broadcast(vocab)

    def lists(batches):
        get = Numbers(share_vocab.value).__getitem__
        for b in batches:
            ids = [np.fromiter(map(get, parts(t)), np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _ragged(ids)], names=["d", "x"])

    read = written(texts.mapInArrow(lists, "d BIGINT, x ARRAY<INT>"))

    def counts(batches):
        n = len(share_vocab.value) + 1
        total = np.zeros(n, dtype=np.int64)
        for b in batches:
            row, x = _flat(b.column(0))
            total += np.bincount(np.unique(row * n + x) % n, minlength=n)
            total[0] += b.num_rows - np.count_nonzero(np.bincount(row[x == 0], minlength=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["term", "n"])

    df = np.zeros(len(vocab) + 1)
    for r in read.select("x").mapInArrow(counts, "term INT, n BIGINT").groupBy("term").agg(F.sum("n")).collect():
        df[r[0]] = r[1]  # a number for each word of the items, whatever the texts are
    idf = np.log((df[0] + 1) / (df + 1)) + 0.3
    probes: list[tuple[int, int, int]] = []
    worth = np.zeros(len(vocab) + 1)  # what a hit of a term counts towards HITS: all of it for the probes of short items
    for i, ws in numbered.items():
        chosen: set[int] = set()
        for s in range(max(1, len(ws) - WINDOW + 1)):
            part = range(s, min(len(ws), s + WINDOW))
            chosen.update(sorted(part, key=lambda k: (df[ws[k]], k))[:PROBES])
        probes += [(i, ws[k], k) for k in sorted(chosen)]
        for k in chosen:
            worth[ws[k]] = max(worth[ws[k]], 1 if len(chosen) >= HITS else HITS)
    share_worth = spark.sparkContext.broadcast(worth)

    def postings(batches):
        """The lists of the probes' terms (term, places), and of texts that enough of them are in the whole list (terms,
        places) under term 0."""
        worth = share_worth.value
        for b in batches:
            row, x = _flat(b.column(1))
            hits = np.bincount(row, worth[x], minlength=b.num_rows)
            ids, term, terms, places = [], [], [], []
            start = np.searchsorted(row, np.arange(b.num_rows + 1))
            none = np.zeros(0, np.int32)
            for k in np.flatnonzero(hits >= HITS):
                d, y = b.column(0)[k].as_py(), x[start[k]:start[k + 1]]
                at = np.flatnonzero(y)
                ids.append(d), term.append(0), terms.append(y[at].astype(np.int32)), places.append(at.astype(np.int32))
                at = at[worth[y[at]] > 0]
                at = at[np.argsort(y[at], kind="stable")]
                cut = np.flatnonzero(np.diff(y[at])) + 1
                for p in np.split(at, cut):
                    ids.append(d), term.append(int(y[p[0]])), terms.append(none), places.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(term, pa.int32()), _ragged(terms), _ragged(places)], names=["d", "term", "terms", "places"])

    cores = 2 * spark.sparkContext.defaultParallelism
    marks = written(read.mapInArrow(postings, "d BIGINT, term INT, terms ARRAY<INT>, places ARRAY<INT>"))
    index = written(marks.where("term > 0").select("term", F.pmod(F.xxhash64("d"), F.lit(SALTS)).alias("salt"), "d", "places")
                         .repartition("term", "salt").sortWithinPartitions("term", "d"))
    share_lists = spark.sparkContext.broadcast(Lists(numbered, probes, idf))

    def agree(batches):
        lists = share_lists.value
        for b in batches:
            ids, who, bins = [], [], []
            for d, hits in zip(b.column(0).to_pylist(), b.column(1)):
                h = hits.values
                sizes = np.diff(h.field(1).offsets.to_numpy())
                terms = np.repeat(h.field(0).to_numpy(), sizes)
                at = h.field(1).flatten().to_numpy()
                for n, k in agreeing(lists, terms, at):
                    ids.append(d), who.append(n), bins.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(who, pa.int32()), pa.array(bins, pa.int32())], names=["d", "n", "bin"])

    by_text = index.groupBy("d").agg(F.collect_list(F.struct("term", "places")).alias("hits"))
    cand = by_text.mapInArrow(agree, "d BIGINT, n INT, bin INT").groupBy("d").agg(F.collect_list(F.struct("n", "bin")).alias("c"))

    def match(batches):
        lists = share_lists.value
        for b in batches:
            out = defaultdict(list)
            row, terms_of = _flat(b.column(1))
            places_of = _flat(b.column(2))[1]
            start = np.searchsorted(row, np.arange(b.num_rows + 1))
            for k, (d, pairs) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                terms, at = terms_of[start[k]:start[k + 1]], places_of[start[k]:start[k + 1]]
                keys = np.sort(terms * (1 << 32) + at)
                for n in near(lists, keys, [(p["n"], p["bin"]) for p in pairs]):
                    ws = lists.items[n]
                    span, part, weight = chain(ws.tolist(), terms, at, lists.idf)
                    if span >= min(WINDOW, len(ws)) and min(part, weight) >= share:
                        for c, v in zip(("doc_id", "item_id", "span", "matched", "weight"), (d, int(lists.ids[n]), span, part, weight)):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(out[k], t) for k, t in (("doc_id", pa.int64()), ("item_id", pa.int64()), ("span", pa.int32()),
                                                     ("matched", pa.float64()), ("weight", pa.float64()))})

    # of several texts under one id each is matched by itself against the candidates of all
    whole = marks.where("term = 0").select("d", "terms", "places").join(cand, "d").select("d", "terms", "places", "c").repartition(cores, "d")
    best = F.max(F.struct("span", "matched", "weight")).alias("m")
    out = whole.mapInArrow(match, RESULT)
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.span", "m.matched", "m.weight")
