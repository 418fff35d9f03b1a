"""URL filters (operator 6).

All glob rules become one nondeterministic automaton packed into 64-bit words (Shift-And): a state per rule character, a
mask per character, a self-loop mask for `*`. One shift, two ands and an or per character advance every rule at once, and a
batch of URLs advances together. The canonical URL is `.host|path?query`: host lower-cased, fragment gone, control
characters and `|` percent-encoded, so that `|` only parts host and path.

Rules by host and path come from a list (longest fitting rule wins); URLs that none fits are blocked if one of the
method's globs matches, else allowed. Null URLs and those without `://` have an empty host and path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches

# The rules given, as (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Globs over the canonical URL that block what no rule fits.
GLOBS = ("*spam*|*", "*cheap-*|*", "*casino*|*", "*.xxx|*", "*|*/login*", "*|*.exe", "*|*?*sessionid=*")
URLS = 4096  # URLs that advance together


@dataclass(frozen=True)
class Packed:
    """Shift-And masks of anchored globs."""

    letters: dict[str, int]  # class of a character; 0: any that no glob names
    start: np.ndarray
    loop: np.ndarray
    take: np.ndarray  # class x words
    last: list[tuple[int, int]]  # word and bit of each glob's final state


def pack(globs: Sequence[str]) -> Packed:
    """Masks of globs with `*` (any run) and `?` written as `\\x00` for one character (a plain `?` is itself)."""
    parsed = []
    for g in globs:
        tokens, loops = [], set()
        for c in g:
            if c == "*":
                loops.add(len(tokens))
            else:
                tokens.append(c)
        parsed.append((tokens, loops))
    names = sorted({c for tokens, _ in parsed for c in tokens if c != "\0"})
    letters = {c: i + 1 for i, c in enumerate(names)}
    words = max(1, -(-sum(len(t) + 1 for t, _ in parsed) // 64))
    start, loop = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    take = np.zeros((len(names) + 1, words), np.uint64)
    last, at = [], 0

    def put(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    for tokens, loops in parsed:
        put(start, at)
        for k in loops:
            put(loop, at + k)
        for k, c in enumerate(tokens):
            for row in take if c == "\0" else [take[letters[c]]]:
                put(row, at + k + 1)
        last.append(((at + len(tokens)) // 64, (at + len(tokens)) % 64))
        at += len(tokens) + 1
    return Packed(letters, start, loop, take, last)


def matches(p: Packed, subjects: list[str]) -> np.ndarray:
    """Which glob (column) matches which subject (row)."""
    length = np.array([len(s) for s in subjects], np.int64)
    order = np.argsort(-length, kind="stable")
    joined = "".join(subjects[i] for i in order)
    points, where = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    kinds = np.array([p.letters.get(chr(c), 0) for c in points.tolist()], np.int64)[where] if len(points) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(length[order])[:-1]]).astype(np.int64)
    state = np.tile(p.start, (len(subjects), 1))
    ascending = length[order][::-1]
    for t in range(int(length.max(initial=0))):
        n = len(subjects) - int(np.searchsorted(ascending, t, side="right"))  # those longer than t come first
        now = state[:n]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:n] = (moved & p.take[kinds[first[:n] + t]]) | (now & p.loop)
    out = np.zeros((len(subjects), len(p.last)), bool)
    for k, (w, b) in enumerate(p.last):
        out[order, k] = (state[:, w] >> np.uint64(b)) & np.uint64(1) == 1
    return out


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and path with query of a URL column."""
    there = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    full = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    return tuple(F.when(there, c).otherwise("") for c in (host, path, full))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict, matched (the method's globs that match, joined by spaces): one row per row of pages."""
    bounded_batches(pages.sparkSession)
    listed = sorted(rules, key=lambda r: -len(r[1]))

    def glob_of(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"*.{host}|/{path}*"

    every = [glob_of(r) for _, r in listed] + list(globs)
    hide = re.compile(r"[\x00-\x1f\x7f|*]")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        packed = pack(every)
        for hosts, paths in batches:
            rows = []
            for k in range(0, len(hosts), URLS):
                some = ["|".join(hide.sub(lambda m: f"%{ord(m[0]):02X}", x) for x in (f".{h}", p)) for h, p in zip(hosts[k : k + URLS], paths[k : k + URLS], strict=True)]
                for hit in matches(packed, some):
                    rule = next((i for i in range(len(listed)) if hit[i]), None)
                    own = [g for g, h in zip(globs, hit[len(listed) :], strict=True) if h]
                    verdict = listed[rule][0] if rule is not None else "block" if own else "allow"
                    rows.append((None if rule is None else listed[rule][1], verdict, " ".join(own)))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "matched"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "rule string, verdict string, matched string")
    host, path, full = parts(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), full.alias("full"))
    out = cut.withColumn("r", udf(F.col("host"), F.col("full")))
    return out.select("page_id", "host", "path", "r.rule", "r.verdict", "r.matched")
