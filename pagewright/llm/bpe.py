"""Encoding of texts with a byte-level BPE vocabulary by a tokenization automaton.

The automaton over tokens is built merge by merge. It starts with one state on which every byte loops.
The merge of (u, v) puts a gadget where u leads to a state t that lets v through: all u arcs now lead to a
copy of t without v, and the new token uv may be read wherever u may, leading where v led. Every arc of a token
so leads to one state, and a copy differs from its origin by one blocked token; both are kept as chains
instead of whole transition tables, and the rows of the table that the encoder meets are filled on demand.
A token path is accepted exactly if it is the BPE tokenization of its bytes, and each prefix of a word has one
accepted path; so the encoder walks the byte trie from every reached position, crosses the arcs the state
allows, and emits the arc labels along the path.
"""
from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_DIR = "/opt/tokenizers"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _class(kind: str, below: int = sys.maxunicode + 1) -> str:
    """Regex class body of the code points whose general category starts with kind."""
    points = [i for i in range(below) if unicodedata.category(chr(i))[0] == kind]
    out = []
    for _, run in groupby(enumerate(points), lambda p: p[1] - p[0]):
        run = [p for _, p in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file: visible Latin-1 bytes stand for themselves, the
    rest are numbered on from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges. Tokens are numbered in the order they arise; ids are the vocabulary's."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids: list[int] = []
        self.left: list[int] = []  # the token that its first part is, -1 of a byte
        self.target: list[int] = []  # state after the token
        self.parent, self.blocked, self.since = [-1], [-1], [-1]  # chains of states
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.row: dict[tuple[int, int], bool] = {}
        index: dict[bytes, int] = {}
        for b in range(256):
            index[bytes([b])] = self._token(bytes([b]), vocab.get(bytes([b]), -1), -1, 0)
        for u, v in merges:
            a, b = index[u], index[v]
            t = self.target[a]
            if u + v in index or self._blocks(t, b):
                continue  # such a merge never fires
            after = self.target[b]
            new = self._token(u + v, vocab[u + v], a, after)
            index[u + v] = new
            self.parent.append(t)
            self.blocked.append(b)
            self.since.append(new)
            self.target[a] = len(self.parent) - 1

    def _token(self, text: bytes, ident: int, left: int, target: int) -> int:
        self.ids.append(ident)
        self.left.append(left)
        self.target.append(target)
        node = 0
        for b in text:
            nxt = self.trie[node].get(b)
            if nxt is None:
                nxt = len(self.trie)
                self.trie[node][b] = nxt
                self.trie.append({})
                self.ends.append(-1)
            node = nxt
        self.ends[node] = len(self.ids) - 1
        return len(self.ids) - 1

    def _blocks(self, state: int, token: int) -> bool:
        """A token is blocked by a state if the state, or one it is copied from, blocked it or a first part of it
        from which it had not yet been merged at that time."""
        while state > 0:
            c, since, nxt = token, self.since[state], self.blocked[state]
            while c > nxt:
                if c < since:
                    break
                c = self.left[c]
            if c == nxt:
                return True
            state = self.parent[state]
        return False

    def word(self, data: bytes) -> list[int]:
        n = len(data)
        if n == 1:
            return [self.ids[self.trie_byte(data[0])]]
        state = [-1] * (n + 1)
        state[0] = 0
        came = [(-1, -1)] * (n + 1)
        trie, ends, target, row = self.trie, self.ends, self.target, self.row
        for p in range(n):
            s = state[p]
            if s < 0:
                continue
            node, e = 0, p
            while e < n:
                node = trie[node].get(data[e], -1)
                if node < 0:
                    break
                e += 1
                t = ends[node]
                if t < 0 or state[e] >= 0:
                    continue
                ok = row.get((s, t))
                if ok is None:
                    ok = row[(s, t)] = not self._blocks(s, t)
                if ok:
                    state[e] = target[t]
                    came[e] = (p, t)
        out, e = [], n
        while e > 0:
            p, t = came[e]
            out.append(self.ids[t])
            e = p
        return out[::-1]

    def trie_byte(self, b: int) -> int:
        return self.ends[self.trie[0][b]]


class _Pieces(dict):
    """Text piece to the bytes of its int32 ids, filled on demand; emptied when it has grown to the bound, which
    costs time but changes no result."""

    def __init__(self, automaton: Automaton, bound: int = 200_000, longest: int = 2_000):
        self.automaton, self.bound, self.longest = automaton, bound, longest
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.plain, self.full = self._patterns(0x10000), self._patterns(sys.maxunicode + 1)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _patterns(below: int):
        """Splitters into words and pieces; classes of the basic plane alone compile into bitmaps."""
        letters, numbers = _class("L", below), _class("N", below)
        words = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+"
            rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        return words, re.compile(rf"([{SPACES}]?[{numbers}]+)").split

    def _word(self, w: str) -> bytes:
        got = np.array(self.automaton.word(w.encode("utf-8", "surrogatepass")), dtype="<i4").tobytes()
        if len(w) <= 64:
            if len(self.known) >= self.bound:
                self.known.clear()
                self.automaton.row.clear()
            self.known[w] = got
        return got

    def __missing__(self, piece: str) -> bytes:
        words = (self.full if self.beyond(piece) else self.plain)[0]
        known, word = self.known.get, self._word
        got = b"".join([known(w) or word(w) for w in words(piece)])
        if len(piece) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """A run of digits, with one space before it, is a piece: no word crosses its borders, and a break in
        white space before it falls where the word pattern breaks it anyhow."""
        split = (self.full if self.beyond(text) else self.plain)[1]
        return b"".join(map(self.__getitem__, split(text)))


def load(path: str) -> Automaton:
    """From a vocabulary file of the kind byte-level BPE (JSON with model.vocab and model.merges)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = _byte_chars()
    raw = lambda s: bytes(back[c] for c in s)
    vocab = {raw(k): v for k, v in model["vocab"].items() if all(c in back for c in k)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs])


@lru_cache(maxsize=2)
def encoder(path: str) -> _Pieces:
    return _Pieces(load(path))


def decode(path: str) -> dict[int, bytes]:
    """Id to bytes of the vocabulary, for the way back."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = _byte_chars()
    return {v: bytes(back[c] for c in k) for k, v in model["vocab"].items() if all(c in back for c in k)}


def encode(df: DataFrame, id_col: str, text_col: str, path: str, out_id: str = "doc_id") -> DataFrame:
    """(out_id BIGINT, ids ARRAY<INT>), one row for each row of df, repeated and null ids included.

    Null and empty text give the empty list; strings of special tokens in a text are ordinary text; a text of any
    length is encoded whole. Other columns of df are not read.
    """

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [enc.encode(t) if t else b"" for t in texts]
            offsets = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[out_id, "ids"])

    src = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS a", f"CAST(`{text_col}` AS STRING) AS b")
    return src.mapInArrow(run, f"{out_id} BIGINT, ids ARRAY<INT>")
