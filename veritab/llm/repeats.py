"""Exact substring dedup by a depth-limited radix sort (operator 11).

A window is a string of `LENGTH` bytes of a text. Suffixes are ordered only through `LENGTH` bytes, by most-significant-digit passes in
which a suffix that is alone in its group drops out: what is equal at the end are exactly the repeated windows. The digits are taken
from the middle of a window outwards, so that windows that start beside each other share a row as long as they can:

1. The first digit is the window's gram of `GRAM` bytes that hashes lowest (the leftmost of equal ones). Equal windows have it at equal
   offsets, and neighbouring windows mostly have it at the same place, so a row is a run of windows around one place, about one row
   per 100 bytes. Grams that occur once drop out.
2. Runs of the same gram whose bytes are equal altogether repeat altogether, and go on as one run.
3. A run that equals no other is cut into stretches of about the square root of its offsets. The bytes that all windows of a stretch have
   in common are the next digit, and a stretch that equals another one as a whole is repeated.
4. Stretches that share the digit but differ are cut into single windows, whose bytes are the last digit.

Digits are compared by 128-bit digests. Passes count with map-side combining, so a digit with a third of all rows is a few rows per task;
joins back to the runs split hot digits. A text is identified by its digest, copies of it give the same runs. Inside a text, runs that
occur again are resolved at once, so that a text of one repeated line stays small. Texts are read in stretches of `STARTS` window starts.

Null texts count as empty; texts below `LENGTH` bytes have no window and lose nothing. Repeated rows are copies like others: both lose
their windows. doc_id may be null or repeated. Further columns of the table, whatever their names, take no part; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import lookup_join
from veritab.functions.workspace import discard, stored
from veritab.llm.common import bounded_batches, named

LENGTH = 400
GRAM = 200
STARTS = 1 << 19
RUNS = "k binary, doc bigint, gram bigint, high bigint, low bigint, at int, lo int, hi int, n int"
ITEMS = "id bigint, k binary, at int, open boolean, lo int, hi int, piece binary, stretches array<struct<b:bigint,h:bigint,l:bigint,lo:int,hi:int>>"
WINDOWS = "w bigint, v bigint, id bigint, at int, open boolean"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 24) - 1)


def _long(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    back = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (MULTIPLIER, back))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each gram of bytes, or of 64-bit hashes of words, from prefix sums of a polynomial."""
    n = len(data)
    up, down = _powers(1 << (n - 1).bit_length())
    letter = np.arange(1, 257, dtype=np.uint64)
    with np.errstate(over="ignore"):
        letter = (letter * MULTIPLIER) ^ (letter << np.uint64(29))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((letter[data] if data.dtype == np.uint8 else data) * up[:n], out=sums[1:])
        keys = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        keys ^= keys >> np.uint64(31)
        keys *= MULTIPLIER
    return keys


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks of w."""
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def stretches(texts: list[bytes], length: int, unit: int = 1) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of stretches of at most STARTS window starts, in groups of about as many; a token has `unit` bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        tokens = len(text) // unit
        for base in range(0, tokens - length + 1, STARTS):
            piece = text[base * unit : (base + STARTS + length - 1) * unit] if tokens > STARTS else text
            group.append((i, base, piece))
            size += len(piece) // unit
            if size >= STARTS:
                yield group
                group, size = [], 0
    if group:
        yield group


def runs(group: list[tuple[int, int, bytes]], length: int, gram: int, unit: int = 1) -> tuple[np.ndarray, ...]:
    """Per run of windows of some stretches: stretch, hash and place of its lowest gram, first and last start, digests of its bytes.

    The stretches are read as one string; windows that would cross from one into the next do not count.
    """
    whole = b"".join(p for _, _, p in group)
    sizes = np.array([len(p) // unit for _, _, p in group])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    final = begin + sizes - length  # the last start of each stretch
    hashes = gram_hashes(np.frombuffer(whole, np.uint8 if unit == 1 else np.uint64), gram)
    # 40 bits of the hash, then the place: the least is the leftmost of the lowest hashes
    keys = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(keys, length - gram + 1) & LOW).astype(np.int64)
    edge = np.zeros(len(at) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, final + 1, -1)
    fresh = np.append(True, at[1:] != at[:-1])
    fresh[begin] = True
    first = np.flatnonzero(fresh & (np.cumsum(edge[:-1]) > 0))
    of = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(at)) - 1, final[of])
    view = memoryview(whole)
    digest = b"".join([xxhash.xxh3_128_digest(view[a:z]) for a, z in zip((first * unit).tolist(), ((last + length) * unit).tolist(), strict=True)])
    both = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return of, hashes[at[first]].view(np.int64), at[first] - begin[of], first - begin[of], last - begin[of], both[:, 0], both[:, 1]


def _found(texts: list[bytes], copies: np.ndarray, length: int, gram: int) -> Iterator[pd.DataFrame]:
    """text, gram, high, low, at, lo, hi, n of the distinct runs of some texts; with n = 0, a span at..hi that repeats inside its text."""
    for group in stretches(texts, length):
        of, hashes, at, first, last, high, low = runs(group, length, gram)
        text = np.array([i for i, _, _ in group])[of]
        base = np.array([b for _, b, _ in group])[of]
        rows = np.stack([text, hashes, high, low, at + base, at - last, at - first])
        order = np.lexsort(rows[[4, 6, 5, 3, 2, 0]])
        rows = rows[:, order]
        differs = (rows[[0, 2, 3, 5, 6], 1:] != rows[[0, 2, 3, 5, 6], :-1]).any(0)
        head = np.flatnonzero(np.append(True, differs))
        n = np.diff(np.append(head, rows.shape[1]))
        made = [rows[:, head], n * copies[rows[0, head]]]
        again = np.repeat(n > 1, n)
        if again.any():
            spans: dict[int, list[tuple[int, int]]] = {}
            for i, _, _, _, p, lo, hi in rows[:, again].T.tolist():
                spans.setdefault(i, []).append((p - hi, p - lo + length))
            flat = [(i, 0, 0, 0, a, 0, z) for i, s in spans.items() for a, z in joined(s)]
            made = [np.concatenate([made[0], np.array(flat, np.int64).T], 1), np.append(made[1], np.zeros(len(flat), np.int64))]
        yield pd.DataFrame(np.append(made[0], made[1][None], 0).T, columns=["text", "gram", "high", "low", "at", "lo", "hi", "n"])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch made one."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _scan(length: int, gram: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # copies of a text are read once and count as often as they are there
            count = batch.groupby("k", sort=False)["doc"].transform("size").to_numpy()
            once = ~batch["k"].duplicated().to_numpy() & np.array([len(t) >= length for t in batch["text"]], bool)
            keys, docs = batch["k"].to_numpy()[once], batch["doc"].to_numpy()[once]
            for found in _found(batch["text"][once].tolist(), count[once], length, gram):
                of = found.pop("text").to_numpy()
                found.insert(0, "doc", docs[of])
                found.insert(0, "k", keys[of])
                yield found

    return run


def _cut(length: int, gram: int) -> Callable:
    step = int(np.ceil(np.sqrt(length - gram + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text, items in zip(batch["k"], batch["text"], batch["items"], strict=True):
                for i in items:
                    at, lo, hi = int(i["at"]), int(i["lo"]), int(i["hi"])
                    stretches = []
                    for p in range(lo // step * step, hi + 1, step):
                        core = text[at - p : at - p - step + 1 + length]
                        a, z = max(lo, p), min(hi, p + step - 1)
                        whole = xxhash.xxh3_128_digest(bytes([a - p, z - p]) + text[at - z : at - a + length])
                        digit = xxhash.xxh3_64_digest(p.to_bytes(4, "little") + core)
                        stretches.append({"b": _long(digit), "h": _long(whole[:8]), "l": _long(whole[8:]), "lo": a, "hi": z})
                    out.append((int(i["id"]), k, at, bool(i["open"]), lo, hi, text[at - hi : at - lo + length], stretches))
            yield pd.DataFrame(out, columns=["id", "k", "at", "open", "lo", "hi", "piece", "stretches"])

    return run


def _windows(length: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, hi, piece, parts in zip(batch["id"], batch["hi"], batch["piece"], batch["parts"], strict=True):
                for p in parts:
                    for o in range(int(p["lo"]), int(p["hi"]) + 1):
                        w = xxhash.xxh3_128_digest(piece[hi - o : hi - o + length])
                        out.append((_long(w[:8]), _long(w[8:]), i, o, bool(p["open"])))
            yield pd.DataFrame(out, columns=["w", "v", "id", "at", "open"])

    return run


def _span(lo: Column, hi: Column, length: int) -> list[Column]:
    return [(F.col("at") - hi).alias("start"), (F.col("at") - lo + length).alias("stop")]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k (digest of a text), spans (array of start, stop in bytes, sorted): the texts with a window that occurs elsewhere too.

    docs: k, doc, text (binary).
    """
    found = stored(docs.mapInPandas(_scan(length, gram), RUNS), "runs")
    inside = found.where("n = 0").select("k", F.col("at").alias("start"), F.col("hi").alias("stop"))
    every = found.where("n > 0")
    # a gram that occurs once belongs to no repeated window
    grams = stored(every.groupBy("gram").agg(F.sum("n").alias("count")).where("count > 1"), "grams")
    rows = stored(lookup_join(every, grams, ["gram"], how="inner", weight="count"), "runs")
    whole = ["gram", "high", "low", "lo", "hi"]
    kinds = stored(rows.groupBy(*whole).agg(F.sum("n").alias("count"), F.min(F.struct("k", "doc", "at")).alias("place")), "kinds")
    equal = kinds.where("count > 1").select(*whole, "count")
    spans = [inside, lookup_join(rows, equal, whole, how="inner", weight="count").select("k", *_span(F.col("lo"), F.col("hi"), length))]
    # runs of a gram that has several kinds of runs, one of them not resolved
    mixed = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("count"), F.min("count").alias("least")).where("count > 1 AND least = 1").drop("least"), "grams")
    open_runs = lookup_join(kinds.withColumnRenamed("count", "members"), mixed, ["gram"], how="inner", weight="count")
    items = stored(open_runs.select(F.monotonically_increasing_id().alias("id"), "place.*", "lo", "hi", (F.col("members") == 1).alias("open")), "items")
    asked = items.groupBy("k", "doc").agg(F.collect_list(F.struct("id", "at", "lo", "hi", "open")).alias("items"))  # a text's own runs
    texts = docs.join(asked, ["k", "doc"]).select("k", "text", "items")
    cut = stored(texts.mapInPandas(_cut(length, gram), ITEMS), "stretches")
    # repeated rows give an item more than once, so places are compared, not counted
    stretch = cut.select("id", "k", "at", "open", F.inline("stretches"))
    same = stretch.groupBy("b", "h", "l").agg(
        F.min("id").alias("id"), F.max("id").alias("last"), F.max("open").alias("open"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("count"))
    same = stored(same, "same")
    twice = same.where("id <> last").select("b", "h", "l", "count")
    spans.append(lookup_join(stretch.where("open"), twice, ["b", "h", "l"], how="inner", weight="count").select("k", *_span(F.col("lo"), F.col("hi"), length)))
    alone = F.col("open") & (F.col("id") == F.col("last"))
    digits = same.groupBy("b").agg(F.count(F.lit(1)).alias("count"), F.max(alone).alias("left")).where("count > 1 AND left").drop("left")
    split = lookup_join(same.drop("count").withColumn("open", alone), stored(digits, "digits"), ["b"], how="inner", weight="count")
    parts = split.groupBy("id").agg(F.collect_list(F.struct("lo", "hi", "open")).alias("parts"))  # a run's own stretches
    once = cut.select("id", "hi", "piece").join(parts, "id").select("id", "hi", "piece", "parts")
    single = stored(once.mapInPandas(_windows(length), WINDOWS), "windows")
    more = single.groupBy("w", "v").agg(F.min("id").alias("_a"), F.max("id").alias("_z"), F.count(F.lit(1)).alias("count")).where("_a <> _z").select("w", "v", "count")
    hit = lookup_join(single.where("open"), stored(more, "same"), ["w", "v"], how="inner", weight="count").select("id", F.col("at").alias("o")).distinct()
    place = cut.select("id", "k", "at").distinct()
    spans.append(hit.join(place, "id").select("k", *_span(F.col("o"), F.col("o"), length)))
    all_spans = spans[0]
    for s in spans[1:]:
        all_spans = all_spans.unionByName(s)
    out = stored(all_spans.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    discard(found, rows, kinds, items, cut, same, single)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, and k, doc, text as `repeated` takes them."""
    text = F.coalesce(named(docs, "text").cast("string"), F.lit("")).cast("binary")
    doc = named(docs, "doc_id").cast("bigint")
    return docs.select(doc.alias("doc_id"), F.unhex(F.md5(text)).alias("k"), F.coalesce(doc, F.lit(0)).alias("doc"), text.alias("text"))


def _with_runs(docs: DataFrame, length: int, gram: int, kept: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = _rows(docs)
    found = lookup_join(rows.drop("doc"), repeated(rows.drop("doc_id"), length, gram), ["k"], how="left")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, s in zip(texts, spans, strict=True):
                gone = joined([(int(x["start"]), int(x["stop"])) for x in s]) if s is not None else []
                edges = [0, *(x for p in gone for x in p), len(text)]
                left = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if gone else text
                out.append((len(text), [{"start": a, "stop": z} for a, z in gone], hashlib.sha256(left).hexdigest(), left if kept else None))
            yield pd.DataFrame(out, columns=["n_bytes", "removed", "kept_sha256", "kept"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    result = F.pandas_udf(run, "n_bytes bigint, removed array<struct<start:int,stop:int>>, kept_sha256 string, kept binary")
    return found.select("doc_id", result("text", "spans").alias("r")).select("doc_id", "r.*")


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, stop in bytes), kept_sha256, kept (bytes): one row per row of docs."""
    return _with_runs(docs, length, gram, True)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    c = _with_runs(docs, LENGTH, GRAM, False)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return c.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")
