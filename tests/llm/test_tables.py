"""Operators over whole tables, against brute force, and the pipeline."""

from __future__ import annotations

import collections
import math
import zlib

import check
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from veritab.llm import nearset, pitmanyor, quotes, topk


@pytest.mark.parametrize("name", ["op3_topk", "op6_url_filter"])
def test_same_as_sql(spark, sf, name):
    ok, note, _ = check.compare(spark, check.duck(sf), sf, name)
    assert ok, note


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=4)]) for i in range(1, 120)]
    rows += [(0, [1.0, 1.0, 0.0, 0.0]), (150, None), (200, [nan, 0.0, 0.0, 0.0]), (250, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (300, [1.0, 2.0]), (301, [3.0, 4.0]), (302, [inf, 1.0])]
    rows += [(k, [9.0, 9.0, 9.0, 9.0]) for k in range(400, 430)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in topk.nearest(df).collect()} == want
    assert topk.nearest(df.limit(0)).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you?\nSecond line here."), (1, 1, "bot", "> Hello there, how are you?\nI am fine.\n"),
        (1, 2, "user", "On Monday bot wrote:\n> I am fine.\n>> Hello there, how are you?\nGood!\nBye"), (1, 3, "user", "Unrelated"),
        (1, 4, "bot", ">second line, HERE\nok"), (None, 0, "user", "> x"), (2, None, "user", "a\n> b"), (2, 0, None, None), (2, 0, "user", "b"), (2, 1, "user", "> b\n> nothing\nc"),
    ]
    rows += [(3, i, "user", "\n".join([f"> line {i - 1}"] * (i > 0) + [f"line {i}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.formatted(df).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [one[t].parent_turn for t in range(5)] == [None, 0, 1, None, 0] and [one[t].position for t in range(5)] == [1, 2, 4, 5, 3]
    assert one[2].text == "Good!\nBye" and one[2].max_level == 2 and one[2].depth == 2 and one[2].n_linked == 2
    chain = sorted((r.turn, r.parent_turn, r.root_turn, r.depth, r.position) for r in got if r.conv_id == 3 and r.turn)
    assert chain == [(i, i - 1, 0, i, i + 1) for i in range(1, 20)]
    assert quotes.formatted(df.limit(0)).count() == 0


def groups(rows: list[tuple], width: int, percent: int) -> dict:
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups(spark, sf, width, percent, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 60))) for i in range(40)]
    base = [f"b{x}" for x in rng.integers(0, 900, 90)]
    for i in range(40, 160):  # one large group that drifts
        base[int(rng.integers(0, 90))] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(200, None), (201, ""), (202, "  \t"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "One  two"), (207, rows[0][1]), (208, rows[0][1].upper())]
    monkeypatch.setattr(nearset, "LEAF", 16)  # nodes branch, and clusters are cut, on this little too
    monkeypatch.setattr(nearset, "PART", 32)
    df = spark.createDataFrame([*rows, (None, "one"), (203, "one")], "doc_id long, text string")
    want, got = groups(rows, width, percent), nearset.near_groups(df, width, percent).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id, r.kept) == (1, None, None)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r
    assert nearset.near_groups(df.limit(0)).count() == 0
    kept = nearset.one_of_each(df, width, percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}


def test_near_groups_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c = ([f"{n}{x}" for x in rng.integers(0, 900, 80)] for n in "abc")
    near = lambda w: " ".join([*w[:40], "changed", *w[41:]])
    rows = [(1, " ".join(a)), (2, near(a)), (1, " ".join(b)), (3, near(b)), (2, " ".join(c)), (4, "something else entirely"), (1, "")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, gone int, id int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in nearset.near_groups(df, 3, 85).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False)] * 2 + [(3, 1, False), (4, 4, True)]
    kept = nearset.one_of_each(df, 3, 85)
    assert kept.columns == df.columns
    # a near copy goes, the other text of its id stays
    assert {(r.doc_id, r.text) for r in kept.collect()} == {rows[0], rows[2], rows[4], rows[5], rows[6]}


def test_near_groups_find_every_link(spark):
    """All components and set sizes of the documents at 0.01 against an exact prefix filter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: set(nearset.shingles(t, 3).tolist()) for i, t in rows}
    seen = collections.Counter(x for s in sets.values() for x in s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index: dict = collections.defaultdict(list)
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        order = sorted(sets[i], key=lambda x: (seen[x], x))
        found = set()
        for x in order[: len(order) - math.ceil(0.85 * len(order)) + 1]:
            found.update(index[x])
            index[x].append(i)
        for j in found:
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearset.near_groups(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_language_model(spark):
    rng = np.random.default_rng(4)
    words = [f"syl{a}la{b}" for a in range(60) for b in range(60)]
    rows = [(i, " ".join(words[int(x) % 3600] for x in rng.zipf(1.3, 50))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "Syl0la0 \t unseen-word " + "z" * 3000), (None, "syl0la0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pitmanyor.scores(df).collect()}
    count, kept = collections.Counter(), {}
    for i, t in rows:
        kept[i] = [*(t or "").encode().lower().split(), b""]
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(kept[i])
    n, v = sum(count.values()), len(count)
    for i, w in kept.items():
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(base) and math.isfinite(got[i].score) and got[i].score < 0
    # the base counts all unseen words as one; as a probability of the text it has to spell them, here byte by byte alike
    spelt = {i: got[i].base_score - sum((len(x) + 1) * math.log10(257) for x in w if not count[x]) for i, w in kept.items()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 30 and sum(got[i].score for i in held) > sum(spelt[i] for i in held)
    assert pitmanyor.scores(df.limit(0)).count() == 0
    # the same rows dealt otherwise, and equal rows
    again = pitmanyor.scores(df.repartition(7, "text").unionByName(df.where("doc_id = 1002"))).collect()
    assert len(again) == len(rows) + 1 and sum(r.doc_id == 1002 for r in again) == 2
    mean = {r.doc_id: r.score for r in pitmanyor.scores(df.coalesce(1)).collect()}
    one = {r.doc_id: r.score for r in pitmanyor.scores(df.repartition(7)).collect()}
    assert all(one[i] == pytest.approx(mean[i], abs=1e-9) for i in mean)


def test_word_probabilities_sum_to_one(spark):
    counts = {f"w{i}": 1 + 400 // (i + 1) for i in range(200)} | {"": 90, "zq": 1}
    words = spark.createDataFrame(list(counts.items()), "word string, c bigint").repartition(3)
    m = pitmanyor.learn(words)
    w = [x.encode() for x in counts]
    p = m.probability(w, np.array(list(counts.values()), float))
    left = []
    for s in m.samples:
        base = np.exp(s.after.log_probability(w))
        assert 0 < base.sum() < 1
        left.append((pitmanyor.STRENGTH + s.discount * s.tables) / (pitmanyor.STRENGTH + m.total) * (1 - base.sum()))
    assert p.sum() + np.mean(left) == pytest.approx(1, abs=1e-9)
    # the spelling is a distribution over byte strings: one step after any context sums to 1
    s = m.samples[0].after
    nexts = [s.back[c] * s.one[(c % pitmanyor.SYMBOLS) * pitmanyor.SYMBOLS : (c % pitmanyor.SYMBOLS + 1) * pitmanyor.SYMBOLS].copy() for c in (pitmanyor.END * pitmanyor.SYMBOLS + pitmanyor.END, 119 * pitmanyor.SYMBOLS + 49)]
    for c, row in zip((pitmanyor.END * pitmanyor.SYMBOLS + pitmanyor.END, 119 * pitmanyor.SYMBOLS + 49), nexts, strict=True):
        seen = s.keys // pitmanyor.SYMBOLS == c
        row[s.keys[seen] % pitmanyor.SYMBOLS] = s.values[seen]
        assert row.sum() == pytest.approx(1, abs=1e-6)
    unseen = m.probability([b"nowhere"], np.zeros(1))
    assert 0 < unseen[0] < p.min()


def test_seating_is_within_bounds():
    own = np.random.default_rng(0).integers(0, 2**63, 6).astype(np.uint64)
    c = np.array([0, 1, 2, 10, 1000, 10**6], float)
    t = pitmanyor.seated(c, np.full(6, 0.01), 0.6, 100.0, own, 0)
    assert (t <= c).all() and t[1] == 1 and t[0] == 0 and (t[2:] >= 1).all() and t[5] > t[3]
    # a dish draws the same in other company
    back = pitmanyor.seated(c[::-1].copy(), np.full(6, 0.01), 0.6, 100.0, own[::-1].copy(), 0)
    assert (back[::-1] == t).all()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, size = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        now = docs.count()
        assert 0.7 * size < now <= size
        size = now
        if name != "bpe":
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]


def test_prices_take_the_tables_drawn_in_the_sweeps(spark, monkeypatch):
    counts = {f"w{i}": 1 + 900 // (i + 1) for i in range(300)} | {"": 90, "é" * 40: 1}
    words = spark.createDataFrame(list(counts.items()), "word string, c bigint").repartition(3)
    m, seats = pitmanyor.learned(words)
    rows = seats.collect()
    assert {r.word: r.c for r in rows} == counts and seats.columns == ["word", "c", "t0", "t1"]
    w, c = [r.word.encode() for r in rows], np.array([r.c for r in rows], float)
    tables = [np.array([r[f"t{k}"] for r in rows], float) for k in range(2)]
    for s, t in zip(m.samples, tables, strict=True):
        assert s.tables == t.sum() and (t == s.draw(w, c)).all() and (t > 1).any()
    assert len(pitmanyor.learned(words.limit(0))[0].samples) == 2
    again = m.probability(w, c)
    monkeypatch.setattr(pitmanyor, "seated", None)
    assert (m.probability(w, c, tables) == again).all()
