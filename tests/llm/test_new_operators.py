"""Repeated windows, ranked search and the manifest against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from veritab.llm import lexical, manifest, repeats

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- repeated windows ---------------------------------------------------------------------------


def plain_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("1" if g else "0" for g in gone))]
        out.append((d, len(t), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got_repeats(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in df.collect()), key=str)


@pytest.mark.parametrize(("letters", "longest", "n", "length", "gram"), [("ab", 40, 60, 12, 6), ("abcé", 90, 80, 10, 4), ("a", 60, 12, 14, 7), ("abcdefgh", 60, 300, 9, 6)])
def test_repeats_equal_brute_force(spark, letters, longest, n, length, gram):
    r = random.Random(len(letters) * 31 + n)
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    passages = [word(r.randint(8, 40)) for _ in range(6)]
    rows = [(r.choice([None, *range(n)]), r.choice([None, "", word(r.randint(0, longest)), word(5) + r.choice(passages) + word(4), r.choice(passages)[2:] + word(7) + r.choice(passages)])) for _ in range(n)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, k int, spans int").repartition(5)
    assert got_repeats(repeats.cleaned(docs, length, gram)) == plain_repeats(rows, length)


def test_repeats_at_full_length(spark):
    r = random.Random(7)
    text = lambda k: "".join(r.choice("etaoin shrdlu") for _ in range(k))
    shared = text(900)
    rows = [(1, shared), (2, text(300) + shared[100:700] + text(500)), (3, text(50) + shared[300:699]), (4, shared[0:400]), (5, text(2000)), (6, "x" * 3000), (7, None), (8, text(399))]
    rows += [(9, shared[:450] + "Ñ" + shared[451:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_repeats(rows, 400)
    assert got_repeats(repeats.cleaned(docs)) == want
    got = as_rows(repeats.report(docs))
    assert got == sorted(((d, n, sum(z - a for a, z in s), len(s), sha(k)) for d, n, s, k in want), key=str)


def test_repeats_stretches_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STARTS", 64)
    r = random.Random(3)
    texts = ["".join(r.choice("ab ") for _ in range(n)).encode() for n in (700, 11, 12, 80, 300)]
    # every start belongs to one run, also where a stretch or a text ends
    starts: dict = {}
    for group in repeats.stretches(texts, 12):
        of, _, at, first, last, _, _ = repeats.runs(group, 12, 6)
        for k, p, a, z in zip(of.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
            assert z <= p <= a + 6
            starts.setdefault(group[k][0], []).extend(group[k][1] + x for x in range(a, z + 1))
    assert starts == {i: list(range(len(t) - 11)) for i, t in enumerate(texts) if len(t) > 11}


def test_repeats_without_rows(spark):
    assert repeats.report(spark.createDataFrame([], DOCS)).collect() == []


# --- ranked search ------------------------------------------------------------------------------


def plain_search(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x for _, _, x in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in counts:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:10])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("short", "span", "segment", "block"), [(16, 2048, 8192, 200_000), (3, 7, 40, 60), (1, 5, 1000, 200_000), (10**9, 16, 90, 200_000)])
def test_search_equals_brute_force(spark, monkeypatch, short, span, segment, block):
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "RANGE", span)
    monkeypatch.setattr(lexical, "DOCS", segment)
    r = random.Random(short)
    vocabulary = [f"w{i}" for i in range(60)] + ["É1", "ß", "Über"]
    text = lambda k: r.choice(" ,.\n").join(r.choices(vocabulary, [1 / (i + 1) for i in range(63)], k=k)).title()
    docs = [(r.choice([None, *range(200)]), r.choice([None, "", "...", *(text(r.randint(1, 40)) for _ in range(6))])) for _ in range(300)]
    docs += docs[:10]
    items = [(i, r.choice([None, "", text(1), text(r.randint(2, 30))])) for i in range(25)] + [(3, "w0 w0 w1"), (None, "w5 nothing")]
    d = spark.createDataFrame([(*x, 5, 6) for x in docs], "doc_id bigint, text string, score int, q int").repartition(3)
    q = spark.createDataFrame([(*x, 5, 6) for x in items], "item_id bigint, text string, rank int, u int")
    assert as_rows(lexical.search(d, q, block)) == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = "doc_id bigint, text string", "item_id bigint, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    asked = spark.createDataFrame([(1, "a")], items)
    assert lexical.search(spark.createDataFrame([], docs), asked).collect() == []
    assert lexical.search(some, spark.createDataFrame([], items)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, "-")], docs), asked).collect() == []


def test_words_of_a_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "x" * 300
    whole = [w for p in lexical.pieces(text) for w in p]
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert [w for p in lexical.pieces(text) for w in p] == whole == text.encode().split()


# --- manifest -----------------------------------------------------------------------------------


def hashed(*parts):
    return sha("".join(parts).encode())


def plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups: dict = {}
    for d, t, lang, source, n in rows:
        changed = t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
        groups.setdefault(source, []).append((d, *(hashed(*map(field, (d, source, lang, n, x))) for x in (t, changed))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hashed(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            at = i // 3 * 3
            yield level[at:i], level[i + 1 : at + 3]
            i //= 3

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (d, leaf, claim) in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            fold = claim
            for left, right in steps:
                fold = hashed(*left, fold, *right)
            out.append((d, leaf, trees[s][-1][0], top[-1][0], hashed(*[x for a, b in steps for x in a + b]), fold, fold == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "sources"), [(0, 1), (1, 1), (2, 2), (28, 1), (100, 40), (300, 2)])
def test_manifest_equals_brute_force(spark, n, sources):
    r = random.Random(n)
    named = [None, *(f"s{i}é" for i in range(sources))] if sources > 1 else ["s"]
    rows = [(r.choice([None, *range(20)]), r.choice([None, "a\nb\n", "", "x", "é\n"]), r.choice([None, "en"]), r.choice(named), r.choice([None, 3])) for _ in range(n)]
    rows += rows[:3]
    docs = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], DOCS + ", key int, g int, leaf int").repartition(4)
    assert as_rows(manifest.report(docs)) == plain_manifest(rows)


def test_manifest_finds_a_changed_row(spark):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    good = manifest.leaf_digest([docs[c] for c in manifest.FIELDS])
    bad = manifest.F.when(docs["doc_id"] == 31, manifest.digest(manifest.F.lit("other"))).otherwise(good)
    proofs = manifest.Manifest.build(docs, "doc_id", "source", good, bad).climb().collect()
    assert [p.key for p in proofs if p.folded_root != p.root] == [31]


# --- repeated passages of words -----------------------------------------------------------------


def plain_passages(rows, size):
    """Words (doc, text, place) of windows that occur earlier, but those that their own first copy covers."""
    texts = sorted({(d is not None, d or 0, hashlib.md5((t or "").encode()).digest(), t or "") for d, t in rows})
    first: dict = {}
    gone = set()
    for _, d, k, t in texts:
        words = [m.group().lower() for m in re.finditer(r"[^\W_]+", t)]
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            at = first.setdefault(w, (d, k, i))
            if at != (d, k, i):
                start = max(i, at[2] + size) if at[:2] == (d, k) else i
                gone |= {(d, t, j) for j in range(start, i + size)}
    return gone


def test_passages_equal_brute_force(spark):
    from veritab.llm import units
    from veritab.llm.units import KEEP

    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [words(n) for n in (50, 55, 70, 120, 200)]
    rows = [(0, "la " * 130), (1, f"{shared[4]} {shared[4]}"), (2, None), (3, ""), (4, words(49)), (2**60 + 1, shared[0].upper() + " tail"), (2**60 + 2, "head, " + shared[0])]
    for i in range(10, 60):
        p = r.choice(shared).split()
        a = r.randint(0, 30)
        rows.append((i if i % 7 else None, f"{words(r.randint(0, 30))} {' '.join(p[a:])} {words(r.randint(0, 60))}"))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, k int").repartition(4)
    text = docs["text"].cast("string")
    prepared = docs.select(units.F.coalesce("doc_id", units.F.lit(units.NO_ID)).alias("doc"), units.F.unhex(units.F.md5(units.F.coalesce(text, units.F.lit("")).cast("binary"))).alias("k"), text.alias("text"))
    by_key = {(0 if d is None else d, hashlib.md5((t or "").encode()).digest()): t or "" for d, t in rows}
    got = set()
    for s in units.passages(prepared).collect():
        d = 0 if s.doc == units.NO_ID else s.doc
        t = by_key[d, bytes(s.k)]
        got |= {(d, t, j) for j, m in enumerate(KEEP.finditer(t)) if s.start <= m.start() and m.end() <= s.stop}
    assert got == plain_passages(rows, units.PASSAGE)


def test_words_of_passages_are_those_of_the_pattern():
    from veritab.llm import units

    r = random.Random(2)
    letters = "abAB09_ .\n\u00e9\u00c9\u0130\u4e2d\U0001f642\u0345\u00bd\u0660-"
    for text in ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", "x" * 5000]:
        hashes, at = units._words(text)
        assert at.T.tolist() == [list(m.span()) for m in units.KEEP.finditer(text)]
        assert len(hashes) == 8 * at.shape[1]
    same = [units._words(t)[0] for t in ("Word", "word", "  WORD!")]
    assert len(set(same)) == 1 and len({units._words(t)[0] for t in ("ab", "ba", "aab", "b", "abb", "aba")}) == 6


def test_units_of_equal_rows(spark):
    from veritab.llm import units

    sentence = "one two three four five six seven eight nine ten."
    docs = spark.createDataFrame([(5, sentence)] * 3 + [(None, sentence), (None, "x")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.n_units, r.n_removed) for r in units.report(docs).collect())
    # the null id ranks first and keeps it; of the equal rows all lose it
    assert got == [(0, 0, 0), (0, 1, 0), (5, 1, 1), (5, 1, 1), (5, 1, 1)]
    short = spark.createDataFrame([(1, "Buy now\nA real sentence of many words that occurs just once here"), (2, "Buy now")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in units.report(short).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.n_removed for r in units.report(short, line=1).collect()} == {1: 0, 2: 1}
