"""Substring dedup by hashed sentences, lines, paragraphs and passages (operator 7).

A text is cut into paragraphs (at lines without words), lines and sentences. Hashed are sentences of at least `least` words, lines of
at least `line` words (LINE, any floor from 1 on) however short their sentences, and paragraphs of at least `least` words; a line that consists of hashed sentences,
and a paragraph of hashed lines or with a hashed sentence, is left to these. Units are normalised (case, spaces, punctuation), hashed to 128 bits and counted over
all documents; the earliest occurrence by (doc_id, offset) stays and the others go, each with its original offsets.

Passages are runs of at least PASSAGE words, wherever they start: each window of PASSAGE words that occurs earlier goes, and windows
that touch make one span. Windows that start beside each other are one row (`llm.repeats` forms the same runs of bytes): runs around
an equal gram of GRAM words are compared as a whole, those that differ are cut into stretches, and stretches that differ into single
windows; of equal ones the earliest goes on and stays, the others go. A window that overlaps its own earliest occurrence gives up the
words after that only, so one copy always stays.

Counting combines in each task, so that a unit with a third of all occurrences is one row per task. The units that repeat
are sent to every task only if they are few (checked), else joined with hot units split. Texts are not stored: a text is known by
doc_id and digest. Tables between the steps are deleted when the spans are written.

Null and empty texts have no units. A null doc_id ranks first; rows that share a doc_id are ranked by the digests of their texts. Of
rows that are equal in both one keeps its units, the others lose all of them. Further columns, whatever their names, take no part.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import BROADCAST_ROWS, lookup_join
from veritab.functions.workspace import discard, stored
from veritab.llm.common import bounded_batches, named
from veritab.llm.repeats import runs, stretches

LEAST = 8
LINE = 3
PASSAGE = 50
GRAM = 12
STEP = 7  # offsets of a stretch, about the square root of those of a run
END = re.compile(r"[.!?]+(?=[ \t\r])")  # of a sentence inside a line
KEEP = re.compile(r"[^\W_]+")
ROWS = "doc bigint, k binary, start int, stop int, high bigint, low bigint, units int"
RUNS = "doc bigint, k binary, gram bigint, high bigint, low bigint, at int, lo int, hi int, start int, stop int, first_stop int, n int"
CUTS = ("id bigint, doc bigint, k binary, at int, hi int, piece binary, offsets binary, "
        "parts array<struct<b:bigint,h:bigint,l:bigint,lo:int,hi:int,start:int,stop:int,first_stop:int>>")
WINDOWS = "w bigint, v bigint, doc bigint, k binary, at int, start int, stop int, first_stop int"
PLACE = ("doc", "k", "at", "first_stop")
NO_ID = -(2**63)  # stands for a null doc_id, which ranks first


def _digest(kind: bytes, words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(kind + b":" + " ".join(words).encode())


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    piece = text[start:stop]
    return start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())


def units(text: str, least: int, short_line: int = LINE) -> Iterator[tuple[int, int, bytes, bool]]:
    """Offsets and digest of each unit of a text that is long enough, and whether it is a sentence."""
    at = 0
    block: list[tuple[int, int, list[str]]] = []  # the lines of the paragraph so far
    rest = long = False  # whether a line of it is not hashed, and whether it holds a sentence that is
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line: list[str] = []
        short, here = False, at
        for stop in chain((m.end() for m in END.finditer(text, at, end)), (end,)):
            words = KEEP.findall(text[here:stop].lower())
            line += words
            if len(words) >= least:
                yield *_trimmed(text, here, stop), _digest(b"", words), True
                long = True
            elif words:
                short = True
            here = stop
        if line:
            if short and len(line) >= short_line:
                yield *_trimmed(text, at, end), _digest(b"line", line), False
            rest |= short and len(line) < short_line
            block.append((at, end, line))
        if block and (not line or end == len(text)):
            words = [w for _, _, x in block for w in x]
            if rest and not long and len(words) >= least:
                yield *_trimmed(text, block[0][0], block[-1][1]), _digest(b"block", words), False
            block, rest, long = [], False, False
        at = end + 1


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is part of a word (as for KEEP), and its lower-case form."""
    part, low = np.zeros(sys.maxunicode + 1, bool), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):  # one by one, as a list of all characters would stay in the worker's memory
        x = chr(i)
        if x.isalnum():
            part[i] = True
            low[i] = ord(x.lower()[0])
    return part, low


@cache
def _weights(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x94D049BB133111EB, np.uint64), dtype=np.uint64)


def _words(text: str) -> tuple[bytes, np.ndarray]:
    """64-bit hashes of the words of a text in a row, and the words' offsets (2 x words)."""
    part, low = _letters()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = part[code]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0)).astype(np.int32)
    at = edges.reshape(-1, 2).T
    if not len(edges):
        return b"", at
    length = at[1] - at[0]
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        letter = (low[code[inside]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        letter = (letter ^ (letter >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = np.add.reduceat(letter * _weights(1 << int(length.max()).bit_length())[place], first)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes.tobytes(), at


def _long(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _cut(least: int, line: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            many = np.zeros(len(batch), np.int64)
            for i, text in enumerate(batch["text"]):
                found.append((-1, -1, bytes(16), False))  # each row is there, with or without units
                found += units(text or "", least, line)
                many[i] = len(found)
            start, stop, digests, sentence = zip(*found, strict=True)
            many = np.diff(many, prepend=0)
            head = np.cumsum(many) - many
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            counts = np.zeros(len(found), np.int64)
            counts[head] = np.add.reduceat(np.array(sentence, np.int64), head)
            of = np.repeat(np.arange(len(batch)), many)
            yield pd.DataFrame({
                "doc": batch["doc"].to_numpy()[of], "k": batch["k"].to_numpy()[of], "start": np.array(start), "stop": np.array(stop),
                "high": both[:, 0], "low": both[:, 1], "units": counts})

    return run


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of windows of each text; one that occurs again in its text is a span (n = 0), behind its first occurrence."""
    for batch in batches:
        texts = [_words(t) if t else (b"", np.zeros((2, 0), np.int32)) for t in batch["text"]]
        for group in stretches([h for h, _ in texts], PASSAGE, 8):
            of, gram, at, first, last, high, low = runs(group, PASSAGE, GRAM, 8)
            row, base = np.array([i for i, _, _ in group])[of], np.array([b for _, b, _ in group])[of]
            offsets = [texts[i][1] for i, _, _ in group]
            a, z = first + base, last + base + PASSAGE - 1
            start, stop, first_stop = (np.array([offsets[g][side, w] for g, w in zip(of.tolist(), x.tolist(), strict=True)], np.int64) for side, x in ((0, a), (1, z), (1, a + PASSAGE - 1)))
            rows = np.stack([row, gram, high, low, at + base, at - last, at - first, start, stop, first_stop])
            rows = rows[:, np.lexsort(rows[[4, 6, 5, 3, 2, 0]])]
            head = np.append(True, (rows[[0, 2, 3, 5, 6], 1:] != rows[[0, 2, 3, 5, 6], :-1]).any(0))
            kept = np.maximum(rows[7], rows[9][np.flatnonzero(head)][np.cumsum(head) - 1])  # what overlaps the first copy stays
            rows[7] = np.where(head, rows[7], kept)
            rows = np.append(rows, np.where(head, 1, 0)[None], 0)[:, head | (rows[7] < rows[8])]
            out = pd.DataFrame(rows[1:].T, columns=["gram", "high", "low", "at", "lo", "hi", "start", "stop", "first_stop", "n"])
            out.insert(0, "k", batch["k"].to_numpy()[rows[0]])
            out.insert(0, "doc", batch["doc"].to_numpy()[rows[0]])
            yield out


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches of the asked runs of each text."""
    for batch in batches:
        out = []
        for doc, k, text, items in zip(batch["doc"], batch["k"], batch["text"], batch["items"], strict=True):
            words, offsets = _words(text)
            for i in items:
                at, lo, hi = int(i["at"]), int(i["lo"]), int(i["hi"])
                parts = []
                for p in range(lo // STEP * STEP, hi + 1, STEP):
                    a, z = max(lo, p), min(hi, p + STEP - 1)
                    core = words[8 * (at - p) : 8 * (at - p - STEP + 1 + PASSAGE)]
                    whole = xxhash.xxh3_128_digest(bytes([a - p, z - p]) + words[8 * (at - z) : 8 * (at - a + PASSAGE)])
                    ends = {"start": int(offsets[0, at - z]), "stop": int(offsets[1, at - a + PASSAGE - 1]), "first_stop": int(offsets[1, at - z + PASSAGE - 1])}
                    parts.append({"b": _long(xxhash.xxh3_64_digest(p.to_bytes(4, "little") + core)), "h": _long(whole[:8]), "l": _long(whole[8:]), "lo": a, "hi": z, **ends})
                piece = slice(at - hi, at - lo + PASSAGE)
                out.append((int(i["id"]), doc, k, at, hi, words[8 * piece.start : 8 * piece.stop], np.ascontiguousarray(offsets[:, piece]).tobytes(), parts))
        yield pd.DataFrame(out, columns=["id", "doc", "k", "at", "hi", "piece", "offsets", "parts"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The single windows of the asked stretches."""
    for batch in batches:
        out = []
        for doc, k, at, hi, piece, offsets, asked in batch[["doc", "k", "at", "hi", "piece", "offsets", "asked"]].itertuples(index=False, name=None):
            chars = np.frombuffer(offsets, np.int32).reshape(2, -1)
            for p in asked:
                for o in range(int(p["lo"]), int(p["hi"]) + 1):
                    a = hi - o
                    w = xxhash.xxh3_128_digest(piece[8 * a : 8 * (a + PASSAGE)])
                    stop = int(chars[1, a + PASSAGE - 1])
                    out.append((_long(w[:8]), _long(w[8:]), doc, k, at - o, int(chars[0, a]), stop, stop))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])


def _gone(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """doc, k, start, stop, source of the rows that are not the first of their group; groups: keys, first, count."""
    found = lookup_join(rows, groups.where("count > 1").select(*keys, "first", "count"), keys, how="inner", weight="count")
    own = (F.col("doc") == F.col("first.doc")) & (F.col("k") == F.col("first.k"))
    later = found.where(~(own & (F.col("at") == F.col("first.at"))))
    # what overlaps the kept copy stays
    start = F.when(own, F.greatest("start", F.col("first.first_stop"))).otherwise(F.col("start"))
    return later.select("doc", "k", start.alias("start"), "stop", F.col("first.doc").alias("source")).where("start < stop")


def _firsts(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*PLACE, *more)).alias("first"))


def passages(docs: DataFrame) -> DataFrame:
    """doc, k, start, stop, source: spans of the windows of PASSAGE words that occur earlier; docs: doc, k, text."""
    found = stored(docs.mapInPandas(_scan, RUNS), "runs")
    spans = [found.where("n = 0").select("doc", "k", "start", "stop", F.col("doc").alias("source"))]
    every = found.where("n > 0")
    grams = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "grams")
    rows = stored(lookup_join(every, grams, ["gram"], how="inner", weight="count"), "runs")
    whole = ["gram", "high", "low", "lo", "hi"]
    kinds = stored(_firsts(rows, whole), "kinds")
    spans.append(_gone(rows, kinds, whole))
    # the first run of each kind goes on where its gram has several kinds
    mixed = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    items = stored(lookup_join(kinds, mixed, ["gram"], how="inner", weight="n").select(F.monotonically_increasing_id().alias("id"), "first.doc", "first.k", "first.at", "lo", "hi"), "items")
    asked = items.groupBy("doc", "k").agg(F.collect_list(F.struct("id", "at", "lo", "hi")).alias("items"))  # a text's own runs
    texts = docs.join(asked, ["doc", "k"]).select("doc", "k", "text", "items")
    cut = stored(texts.mapInPandas(_parts, CUTS), "parts")
    part = cut.select("id", "doc", "k", "at", F.inline("parts"))
    same = stored(_firsts(part, ["b", "h", "l"], "id", "lo", "hi"), "same")
    spans.append(_gone(part, same, ["b", "h", "l"]))
    digits = stored(same.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digits")
    split = lookup_join(same, digits, ["b"], how="inner", weight="n").select("first.id", "first.lo", "first.hi")
    parts = split.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))  # a run's own stretches
    once = cut.select("id", "doc", "k", "at", "hi", "piece", "offsets").join(parts, "id")
    single = stored(once.mapInPandas(_windows, WINDOWS), "windows")
    spans.append(_gone(single, stored(_firsts(single, ["w", "v"]).where("count > 1"), "same"), ["w", "v"]))
    out = stored(reduce(DataFrame.unionByName, spans).distinct(), "passages")
    discard(found, rows, kinds, items, cut, same, single)
    return out


def _later(real: DataFrame) -> DataFrame:
    """doc, k, start, stop, source of the units that occur earlier too."""
    place = F.struct("doc", "k", "start")
    first = stored(real.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    few = first.count() <= BROADCAST_ROWS
    found = real.join(F.broadcast(first.drop("n")), ["high", "low"]) if few else lookup_join(real, first, ["high", "low"], how="inner", weight="n")
    # equal rows have equal places, all of them stay here
    return found.where(place != F.col("first")).select("doc", "k", "start", "stop", F.col("first.doc").alias("source"))


def _whole(least: int, line: int):
    """Every unit and passage of a text: what the second of two equal rows loses."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, k, text in batch[["doc", "k", "text"]].itertuples(index=False, name=None):
                spans = [(a, b) for a, b, _, _ in units(text or "", least, line)]
                at = [m.span() for m in KEEP.finditer(text or "")]
                if len(at) >= PASSAGE:
                    spans.append((at[0][0], at[-1][1]))
                out.append((doc, k, [{"start": a, "stop": b, "source": doc} for a, b in sorted(spans)]))
            yield pd.DataFrame(out, columns=["doc", "k", "spans"])

    return run


def _apart(spans: Column) -> Column:
    """Sorted spans, those that overlap joined."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for s in batch:
                ids, stop = [], -1
                for p in s:
                    if p["start"] >= stop:
                        ids.append([])
                    ids[-1].append(p)
                    stop = max(stop, p["stop"])
                out.append([{"start": g[0]["start"], "stop": max(p["stop"] for p in g), "sources": list(dict.fromkeys(None if p["source"] == NO_ID else int(p["source"]) for p in g))} for g in ids])
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<start:int,stop:int,sources:array<bigint>>>")(spans)


def repeats(docs: DataFrame, least: int = LEAST, line: int = LINE) -> DataFrame:
    """doc_id, n_units (sentences of at least `least` words), removed (array of start, stop, source doc_ids in order): one row per row of docs."""
    bounded_batches(docs.sparkSession)
    text = named(docs, "text").cast("string")
    rows = docs.select(F.coalesce(named(docs, "doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("k"), text.alias("text"))
    long = passages(rows)
    every = stored(rows.mapInPandas(_cut(least, line), ROWS), "units")
    gone = long.unionByName(_later(every.where(F.col("start") >= 0)))
    mark = every.where(F.col("start") < 0).select("doc", "k", "units", F.lit(None).cast("struct<start:int,stop:int,source:bigint>").alias("span"))
    both = mark.unionByName(gone.select("doc", "k", F.lit(None).cast("int").alias("units"), F.struct("start", "stop", "source").alias("span")))
    # a text's own spans; equal rows are counted
    found = stored(both.groupBy("doc", "k").agg(F.max("units").alias("units"), F.count("units").alias("rows"), F.sort_array(F.collect_set("span")).alias("spans")), "found")
    discard(every)
    again = found.where("rows > 1").select("doc", "k", "units", "rows")
    copies = rows.join(again.select("doc", "k"), ["doc", "k"])
    lost = copies.mapInPandas(_whole(least, line), "doc bigint, k binary, spans array<struct<start:int,stop:int,source:bigint>>")
    lost = lost.groupBy("doc", "k").agg(F.first("spans").alias("spans")).join(again, ["doc", "k"])
    others = lost.select("doc", "units", "spans", F.explode(F.sequence(F.lit(2), F.col("rows").cast("int")))).drop("col")
    every_row = found.select("doc", "units", "spans").unionByName(others)
    return every_row.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("units").cast("bigint").alias("n_units"), _apart(F.col("spans")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without spans (start, stop, ..) that are sorted and apart."""
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for t, s in zip(texts, spans, strict=True):
                edges = [0, *(x for p in (s if s is not None else ()) for x in (p["start"], p["stop"])), None]
                out.append(None if t is None else "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text, F.transform(removed, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))


def report(docs: DataFrame, least: int = LEAST, line: int = LINE) -> DataFrame:
    """doc_id, n_units, n_removed, chars_removed, removed (start:end), source_ids (documents that keep what was removed)."""
    r = repeats(docs, least, line)
    return r.select(
        "doc_id", "n_units", F.size("removed").cast("bigint").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"]).alias("chars_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("removed"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("removed", lambda s: s["sources"])))).alias("source_ids"),
    )
