"""Ranked lexical search with hybrid term-at-a-time and document-at-a-time evaluation (operator 12).

Documents are dealt into segments as they are read. A segment is an inverted index of its own: documents in the order of their ids, per
term the sorted postings with their counts. Segments are stored; collection statistics are sums over them. Then every segment is
searched for every item of a block of items. A term's list is short in a segment if it holds at most a `SHORT`th of its documents.
Short lists are added up term at a time into accumulators, which from then on are one more sorted list with a known bound. This list and
the long ones are merged document at a time, in ranges of `RANGE` documents: lists are ordered by their bounds, those whose bounds
together stay below the score of the tenth document so far propose no documents, they are skipped to the documents that the others
propose, and a document is given up when the bounds of the lists still to come cannot lift it. A task goes on with the best ten of the
segments before, so its bar rises; the bests of all tasks are ranked at the end, ten rows an item and task.

A segment holds `DOCS` documents or `TOKENS` terms at most (a longer text has a segment of its own and is tokenised in pieces), so memory
does not grow with the table, and a term that fills a third of it is spread over all segments. Items are sent to the tasks in blocks of
`BLOCK` terms (checked), each block with an index of its own vocabulary.

Null and empty texts have no terms and are not counted; an item without terms has no rows. A null doc_id ranks behind others of the
same score. Repeated rows are documents of their own; rows that share an item_id are items of their own. Further columns of either
table, whatever their names, take no part. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.workspace import stored
from veritab.llm.common import bounded_batches, named

TOP = 10
DOCS = 8192
TOKENS = 4_000_000
BLOCK = 200_000
SHORT = 16
RANGE = 2048
PIECE = 1 << 20
# digits, ASCII letters (lower-cased) and all bytes beyond ASCII make words
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
SEGMENTS = "n_docs bigint, n_terms bigint, ids binary, nulls binary, sizes binary, terms binary, starts binary, at binary, tf binary"
FOUND = "q int, doc_id bigint, score bigint"


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    data = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Builder:
    """Collects documents of one segment; only terms of the vocabulary have postings."""

    def __init__(self, codes: dict[bytes, int]) -> None:
        self.codes = codes
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.sizes: list[int] = []
        self.known: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc: object, text: str | None) -> None:
        get, size, known = self.codes.get, 0, []
        for words in pieces(text):
            codes = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
            known.append(codes[codes >= 0])
            size += len(words)
        if size:
            missing = doc is None or pd.isna(doc)
            self.ids.append(0 if missing else int(doc))
            self.nulls.append(missing)
            self.sizes.append(size)
            self.known.append(np.concatenate(known))
            self.tokens += len(self.known[-1])

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.tokens >= TOKENS

    def segment(self) -> pd.DataFrame:
        ids, nulls, sizes = np.array(self.ids, np.int64), np.array(self.nulls, bool), np.array(self.sizes, np.int64)
        order = np.lexsort((ids, nulls))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = [len(k) for k in self.known]
        docs = np.repeat(place, lengths)
        keys, tf = np.unique(np.concatenate(self.known).astype(np.int64) * len(ids) + docs, return_counts=True)
        terms, starts = np.unique(keys // len(ids), return_index=True)
        row = (len(ids), int(sizes.sum()), ids[order], nulls[order], sizes[order], terms.astype(np.int32), np.append(starts, len(keys)).astype(np.int64),
               (keys % len(ids)).astype(np.int32), tf.astype(np.int32))
        self.clear()
        return pd.DataFrame([[x.tobytes() if isinstance(x, np.ndarray) else x for x in row]], columns=[c.split()[0] for c in SEGMENTS.split(", ")])


def _indexer(codes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = Builder(codes.value)
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                b.add(doc, text)
                if b.full():
                    yield b.segment()
        if b.ids:
            yield b.segment()

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for terms, starts in zip(batch["terms"], batch["starts"], strict=True):
            yield pd.DataFrame({"term": np.frombuffer(terms, np.int32), "df": np.diff(np.frombuffer(starts, np.int64))})


class Segment:
    """One stored segment with the value of each posting, and the largest value per term."""

    def __init__(self, row, docs: int, tokens: int) -> None:
        self.ids, self.nulls = np.frombuffer(row.ids, np.int64), np.frombuffer(row.nulls, bool)
        self.terms, self.starts = np.frombuffer(row.terms, np.int32), np.frombuffer(row.starts, np.int64)
        self.at, tf = np.frombuffer(row.at, np.int32), np.frombuffer(row.tf, np.int32).astype(np.int64)
        m = 100 - 75 + (75 * np.frombuffer(row.sizes, np.int64) * docs) // tokens
        self.value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at])
        self.most = np.maximum.reduceat(self.value, self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bound, documents, scores) of the terms that occur here: the accumulators of all short lists, then each long one."""
        i = np.searchsorted(self.terms, terms)
        here = (i < len(self.terms)) & (self.terms[np.minimum(i, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        out, at, score = [], [], []
        for k, w in zip(i[here].tolist(), weights[here].tolist(), strict=True):
            a, b = int(self.starts[k]), int(self.starts[k + 1])
            if (b - a) * SHORT <= len(self.ids):
                at.append(self.at[a:b])
                score.append(self.value[a:b] * w)
            else:
                out.append((int(self.most[k]) * w, self.at[a:b], self.value[a:b] * w))
        if at:
            docs, scores = np.concatenate(at), np.concatenate(score)
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            sums = np.add.reduceat(scores[order], first)
            out.append((int(sums.max()), docs[first], sums))
        return sorted(out, key=lambda x: x[0])


class Best:
    """The best documents of one item so far."""

    def __init__(self) -> None:
        self.score, self.nulls, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def bar(self) -> int:
        """The least score that can still matter: a document at the bar may win by its id."""
        return int(self.score[-1]) if len(self.score) == TOP else 1

    def add(self, score: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        score, nulls, ids = np.append(self.score, score), np.append(self.nulls, nulls), np.append(self.ids, ids)
        keep = np.lexsort((ids, nulls, -score))[:TOP]
        self.score, self.nulls, self.ids = score[keep], nulls[keep], ids[keep]


def merge(s: Segment, lists: list[tuple[int, np.ndarray, np.ndarray]], best: Best) -> None:
    """Document-at-a-time evaluation of lists that are sorted by their bounds."""
    below = np.cumsum([0, *(b for b, _, _ in lists)]).tolist()  # below[i]: what the lists before i can give together
    if below[-1] < best.bar():
        return
    for a in range(0, len(s.ids), RANGE):
        z = min(a + RANGE, len(s.ids))
        bar = best.bar()
        first = next((i for i in range(len(lists)) if below[i + 1] >= bar), None)
        if first is None:
            return
        total = np.zeros(z - a, np.int64)
        for _, docs, scores in lists[first:]:
            lo, hi = np.searchsorted(docs, (a, z))
            total[docs[lo:hi] - a] += scores[lo:hi]
        cand = np.flatnonzero((total > 0) & (total + below[first] >= bar))
        score = total[cand]
        for i in range(first - 1, -1, -1):
            if not len(cand):
                break
            _, docs, scores = lists[i]
            at = np.minimum(np.searchsorted(docs, cand + a), len(docs) - 1)
            score = score + np.where(docs[at] == cand + a, scores[at], 0)
            stays = score + below[i] >= bar
            cand, score = cand[stays], score[stays]
        if len(cand):
            best.add(score, s.nulls[cand + a], s.ids[cand + a])


def _searcher(sent, docs: int, tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = sent.value
        best = [Best() for _ in items]
        for batch in batches:
            for row in batch.itertuples(index=False):
                s = Segment(row, docs, tokens)
                for (terms, weights), b in zip(items, best, strict=True):
                    merge(s, s.lists(terms, weights), b)
        for q, b in enumerate(best):
            if len(b.ids):
                yield pd.DataFrame({"q": np.full(len(b.ids), q, np.int32), "doc_id": pd.arrays.IntegerArray(b.ids, b.nulls), "score": b.score})

    return run


def _block(docs: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
    """q, doc_id, score of the best documents of some items (q: place in the list), TOP rows at most per item and task."""
    spark = docs.sparkSession
    counted = [Counter(w for words in pieces(text) for w in words) for _, text in items]
    codes = {w: i for i, w in enumerate(sorted(set().union(*counted)))}
    texts = docs.select(named(docs, "doc_id").cast("bigint").alias("doc"), named(docs, "text").cast("string").alias("text"))
    index = stored(texts.mapInPandas(_indexer(spark.sparkContext.broadcast(codes)), SEGMENTS), "segments")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = dict(index.select("terms", "starts").mapInPandas(_frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df")).collect())  # one row per term of the block
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    sent = []
    for c in counted:
        terms = np.array(sorted(codes[w] for w in c if codes[w] in weight), np.int32)
        counts = {codes[w]: k for w, k in c.items()}
        sent.append((terms, np.array([weight[t] * counts[t] for t in terms.tolist()], np.int64)))
    return index.mapInPandas(_searcher(spark.sparkContext.broadcast(sent), n, max(total, 1)), FOUND)


def search(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = items.select(named(items, "item_id").alias("item_id"), F.coalesce(named(items, "text").cast("string"), F.lit("")).alias("text"))
    # terms are at most half the characters and one more
    bound = chosen.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    parts = max(1, math.ceil(bound / block))
    dealt = stored(chosen.withColumn("u", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("u"), F.lit(parts))), "items")
    kind = chosen.schema["item_id"].dataType.simpleString()
    out = []
    for k in range(parts):
        some = [(r.item_id, r.text) for r in dealt.where(F.col("part") == k).orderBy("u").toLocalIterator()]
        found = _block(docs, some)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(some)], f"q int, item_id {kind}")
        out.append(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
