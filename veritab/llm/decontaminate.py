"""Benchmark decontamination (operator 2).

Every window of ten consecutive words of a benchmark item (the whole item, if it is shorter) is a pattern of one
Aho-Corasick automaton. Words are the automaton's letters: each distinct benchmark word has a code point, any other word
of a text is one code point that no pattern holds, so a text is scanned once, word by word, and a match's place is a word
index, which maps back to offsets in the original text.

The automaton is built in each task from a broadcast list of item texts whose size is checked: benchmarks beyond
`part_words` words are dealt into parts, each scanned in a pass of its own, so nothing larger is ever held or sent.

Null texts have no words and no windows. A null item_id counts as one item written as an empty string. Rows that share an
item_id are one item. Repeated documents are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.workspace import stored
from veritab.llm.common import bounded_batches, fresh, named, sha

WINDOW = 10
PART_WORDS = 200_000
# A-Z lower-cased; what is no digit, letter or non-ASCII byte separates words
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
OTHER = chr(1)
SCHEMA = "n_words bigint, n_hit bigint, items array<string>, hit array<int>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Windows:
    """An automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.codes: dict[bytes, str] = {}
        found: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            letters = "".join([self._code(w) for w in words_of(text)])
            k = min(size, len(letters))
            for i in range(len(letters) - k + 1 if k else 0):
                found.setdefault(letters[i : i + k], (k, set()))[1].add(item)
        self.tree = ahocorasick.Automaton()
        for letters, hit in found.items():
            self.tree.add_word(letters, hit)
        self.any = bool(found)
        if self.any:
            self.tree.make_automaton()

    def _code(self, word: bytes) -> str:
        c = self.codes.get(word)
        if c is None:
            n = len(self.codes) + 2
            c = self.codes[word] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are no letters
        return c

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive) of the matches, and the items they belong to."""
        places, items = [], set()
        if self.any:
            get = self.codes.get
            for last, (k, owners) in self.tree.iter("".join([get(w, OTHER) for w in words])):
                places.append((last + 1 - k, last + 1))
                items |= owners
        return places, items


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(items: list[tuple[str, str]], size: int):
    sent = items

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        windows = Windows(sent.value, size)
        for texts, hits, before in batches:
            rows = []
            for text, hit, had in zip(texts, hits, before, strict=True):
                words = words_of(text)
                places, found = windows.scan(words)
                if hit is not None and len(hit):
                    places += [(int(a), int(b)) for a, b in np.asarray(hit).reshape(-1, 2)]
                places = merged(places)
                found.update(() if had is None else had)
                spans = []
                if places:
                    at = [m.span() for m in WORD.finditer(text)]
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in places]
                rows.append((len(words), sum(b - a for a, b in places), sorted(found), [x for p in places for x in p], spans))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "hit", "spans"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, SCHEMA)


def with_hits(docs: DataFrame, text: str, benchmark: DataFrame, name: str, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs plus a struct column `name`: n_words, n_hit, items (sorted ids), hit (word ranges), spans (offsets in the text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    # words are at most half the characters and one more
    bound = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    parts = max(1, int(-(-bound // part_words)))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    hit: Column = F.lit(None).cast("array<int>")
    had: Column = F.lit(None).cast("array<string>")
    for k in range(parts):
        some = [(r.item, r.text) for r in dealt.where(F.col("part") == k).select("item", "text").toLocalIterator()]
        udf = _scanner(spark.sparkContext.broadcast(some), window)
        if k:
            docs = stored(docs, "hits")
            hit, had = docs[name]["hit"], docs[name]["items"]
        docs = docs.withColumn(name, udf(named(docs, text).cast("string"), hit, had))
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (start:end in code points): one row per row of docs."""
    r = with_hits(docs.select("doc_id", "text"), "text", benchmark, "r", window)
    spans = F.array_join(F.transform("r.spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return r.select(
        "doc_id", "r.n_words", "r.n_hit", F.size("r.items").cast("bigint").alias("n_items"),
        sha(F.array_join("r.items", ",")).alias("items_sha256"), (F.col("r.n_hit") > 0).alias("contaminated"), spans.alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    name = fresh(docs, "hits")
    return with_hits(docs, "text", benchmark, name, window).where(F.col(name)["n_hit"] == 0).drop(name)
