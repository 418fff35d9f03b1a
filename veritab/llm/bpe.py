"""Byte-level BPE encoding and decoding (operator 5).

A text is cut by the pattern of the rank file, and each match is merged by itself: a segment tree over its byte
positions holds at every node the leftmost smallest pair rank below it, so the root names the next merge and a merge
is three point updates of log(n) nodes (the merged pair, its left neighbour, the position that vanishes).
Short pieces are merged side by side, one tree per row of a matrix; long ones one at a time.

Null and empty texts have no tokens. Special tokens are ordinary text. Extra columns are passed through by the caller.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = 1 << 30
CACHE = 300_000  # remembered pieces of text per task; a memory bound, results do not depend on it
SLICE = 1 << 20  # characters handled at once
LONG = 64  # bytes; longer pieces get a tree of their own
SCHEMA = "n_tokens bigint, ids binary, decoded binary"

# The characters that the pattern's \s takes (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Ranks of byte strings, and the rank of joining two ids."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.width = np.int64(len(self.bytes))
        self.packed = [np.uint32(i).tobytes() for i in range(len(self.bytes))]
        pairs = {
            self.ranks[t[:k]] * int(self.width) + self.ranks[t[k:]]: r
            for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks
        }
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        # open addressing: a slot by multiplication, the next free one after it
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        self.one = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where the pair is no token."""
        key = left * self.width + right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        open_ = np.nonzero((self.keys[at] != key) & (self.keys[at] != -1))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there, want = self.keys[at[open_]], key[open_]
            out[open_[there == want]] = self.values[at[open_[there == want]]]
            open_ = open_[(there != want) & (there != -1)]
        return out


def merge_one(piece: bytes, v: Vocabulary) -> list[int]:
    """Ids of one piece by a segment tree over its bytes."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ranks, none = v.ranks, 1 << 62
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)  # rank * size + position

    def key(i: int) -> int:
        j = after[i]
        r = ranks.get(parts[i] + parts[j]) if j < n else None
        return none if r is None else r * size + i

    def put(i: int, value: int) -> None:
        at = size + i
        tree[at] = value
        while at > 1:
            at >>= 1
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low

    for i in range(n):
        tree[size + i] = key(i)
    for at in range(size - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] != none:
        i = tree[1] % size
        j = after[i]
        parts[i] += parts[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


def merge_many(pieces: list[bytes], size: int, v: Vocabulary) -> list[bytes]:
    """Ids (as encode() gives them) of pieces of at most `size` bytes, a power of two; one segment tree per matrix row."""
    m, wide = len(pieces), 2 * size
    length = np.fromiter(map(len, pieces), np.int64, m)
    ids = v.one[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8)].reshape(m, size)
    live = np.arange(size)[None, :] < length[:, None]
    ids[~live] = -1
    after = np.tile(np.arange(1, size + 1, dtype=np.int32), m)
    before = np.tile(np.arange(-1, size - 1, dtype=np.int32), m)
    tree = np.full((m, wide), NONE, np.int32)  # rank * size + position
    r, c = np.nonzero(live[:, 1:])  # a pair starts where a next byte exists
    rank = v.joined(ids[r, c], ids[r, c + 1])
    ok = rank != NONE
    tree[r[ok], size + c[ok]] = rank[ok] * size + c[ok]
    level = size
    while level > 1:
        level >>= 1
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
    tree, ids = tree.ravel(), ids.ravel()

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        root, at = rows * wide, at + size
        tree[root + at] = value
        for _ in range(size.bit_length() - 1):
            at = at >> 1
            child = root + 2 * at
            tree[root + at] = np.minimum(tree[child], tree[child + 1])

    def refresh(rows: np.ndarray, i: np.ndarray) -> None:
        row = rows * size
        j = after[row + i]
        rank = v.joined(ids[row + i], ids[row + np.minimum(j, size - 1)])
        put(rows, i, np.where((j < length[rows]) & (rank != NONE), rank * size + i, NONE))

    rows = np.nonzero(tree[1::wide] != NONE)[0]
    while len(rows):
        best = tree[rows * wide + 1].astype(np.int64)
        row, i = rows * size, best % size
        j = after[row + i]
        ids[row + i] = best // size
        ids[row + j] = -1
        k = after[row + j]
        after[row + i] = k
        inside = k < size
        before[(row + k)[inside]] = i[inside]
        put(rows, j, NONE)
        refresh(rows, i)
        h = before[row + i]
        left = h >= 0
        if left.any():
            refresh(rows[left], h[left].astype(np.int64))
        rows = rows[tree[rows * wide + 1] != NONE]
    kept = ids >= 0
    ends = (4 * np.cumsum(kept.reshape(m, size).sum(1))).tolist()
    flat = ids[kept].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts by a vocabulary, with a bounded memory of pieces seen before."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        # no match of the pattern goes on past a non-white character into white space, so these can be cut apart
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.known: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        """Encode new units: cut them by the pattern, then merge what is no token by itself."""
        v, findall = self.v, self.v.pattern.findall
        whole, cut = [], []
        for u in units:  # letters only, at most one space before them: one match
            (whole if (u[1:] if u[0] == " " else u).isalpha() else cut).append(u)
        parts = [[p.encode() for p in findall(u)] for u in cut]
        need = {u.encode() for u in whole}
        for p in parts:
            need.update(p)
        got = {p: v.packed[r] for p in need if (r := v.ranks.get(p)) is not None}
        by_size: dict[int, list[bytes]] = {}
        for p in need.difference(got):
            by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()) if len(p) <= LONG else 0, []).append(p)
        for size, pieces in by_size.items():
            step = max(1, (1 << 17) // size) if size else 1
            for k in range(0, len(pieces), step):
                some = pieces[k : k + step]
                got.update(zip(some, merge_many(some, size, v) if size else [np.array(merge_one(some[0], v), "<u4").tobytes()]))
        self.known.update(zip(whole, [got[u.encode()] for u in whole]))
        self.known.update(zip(cut, [b"".join([got[x] for x in p]) for p in parts]))

    def pieces(self, text: str) -> Iterator[str]:
        """The text in slices that end before white space which follows another character."""
        start = 0
        edge = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
        while len(text) - start > SLICE:
            m = edge.search(text, start + SLICE)
            if m is None:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
            return [b"".join([self.encode_all([p])[0] for p in self.pieces(texts[0])])]
        cut = [self.units.findall(t) for t in texts]
        new: set[str] = set()
        for units in cut:
            new.update(units)
        self.learn(new.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def token_ids(text: Column, path: str | None = None, pattern: str | None = None, digests: bool = False) -> Column:
    """Struct (n_tokens, ids, decoded) of a text column; with `digests` the hex SHA-256 of ids and decoded bytes instead.

    `path` is the rank file and `pattern` what cuts a text; both default to the public multi-language vocabulary.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as known

        enc = Encoder(Vocabulary(path or known.path(RANKS), pattern or known.PATTERN))
        for texts in batches:
            values = [t if isinstance(t, str) else "" for t in texts]
            rows = []
            for part in slices(values, SLICE):
                for ids in enc.encode_all([values[i] for i in part]):
                    back = enc.decode(ids)
                    if digests:
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
                    else:
                        rows.append((len(ids) // 4, ids, back))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    kind = "n_tokens bigint, ids string, decoded string" if digests else SCHEMA
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)(text.cast("string"))


def encoded_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs."""
    bounded_batches(docs.sparkSession)
    out = docs.select("doc_id", token_ids(F.col("text"), path, digests=True).alias("t"))
    return out.select("doc_id", "t.n_tokens", F.col("t.ids").alias("ids_sha256"), F.col("t.decoded").alias("decoded_sha256"))
