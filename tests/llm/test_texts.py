"""Operators that judge one text at a time, against plain versions."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
import reference as plain
from pyspark.sql import functions as F

from veritab.llm import bpe, decontaminate, pii, severity, units, urlfilter

HARD = [
    "", None, "a@b.c-d@e.f a@b a.b@c.d.", "x" * 30000 + "@a.b", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111",
    "1 " * 20000, "9" * 50000, "+1 (988) 555-2485 +49 30-12+4930 1234567", "+" + "1 " * 4000, "é🙂 a@b.co 🙂 1.1.1.1", "card 4111111111111111",
    " ".join(f"u{i}@x.org" for i in range(3000)), "a@1.2.3.4 4111111111111111+12345678901", "a@b.c@d.e", "1.2.3.4@5.6.7.8", "4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(None, "again a@b.co", None, None), (2, HARD[2], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, N_CHARS long")


def test_base_spans(hard):
    got = pii.personal_data(hard.where("doc_id is not null")).collect()
    assert len(got) == len(HARD) + 1
    for r in got:
        want = plain.base_spans(HARD[r.doc_id])
        assert r.base_sha256 == plain.sha(",".join(f"{k}:{a}:{e}" for k, a, e in want)), HARD[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == q for q, _, _ in want) for k in plain.BASE]


def test_checksums_and_context(spark):
    text = "my iban DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; ssn 123-45-6789 or 123-45-6780 and far away " + "x" * 50 + " 123-45-6781"
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # the second number lies within the window of the same word, the third does not
    assert r.spans == "iban:8:35,ssn:74:85,ssn:89:100"


def test_context_reaches_over_other_matches(spark):
    texts = ["SSN: 123-45-6789 (John), 123-45-6780", "social security number 123-45-6789; spouse 123-45-6780", "call 555-123-4567 / home 555-123-4568 or 555-123-4569",
             "ssn 123-45-6789" + " x" * 30 + " 123-45-6780", "123-45-6780 " + "y " * 10 + "ssn"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: len([s for s in r.spans.split(",") if s]) for r in pii.personal_data(docs).collect()}
    # the last number of the third text starts 41 characters after the word
    assert got == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1}
    assert pii.personal_data(docs.limit(0)).count() == 0

def test_lists_and_words_after(spark):
    texts = ["SSNs: 123-45-6789, 123-45-6780, 223-45-6781", "phones " + ", ".join(f"555-123-45{i}" for i in range(10, 30)) + " and 555-123-4567", "123-45-6789 (SSN)", "123-45-6789, 123-45-6780 and " + "x" * 50 + " ssn"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: len([s for s in r.spans.split(",") if s]) for r in pii.personal_data(docs).collect()}
    assert got == {0: 3, 1: 21, 2: 1, 3: 0}
    cut = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert cut[0] == "SSNs: <SSN>, <SSN>, <SSN>" and cut[1].count("<LOCALPHONE>") == 21 and cut[2] == "<SSN> (SSN)" and cut[3] == texts[3]


def test_redaction_keeps_columns_and_order(hard, spark):
    out = pii.redact(hard)
    assert out.columns == hard.columns
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert got[1].text is None and got[0].text == "" and got[11].text == "card <CARD>" and got[10].text == "é🙂 <EMAIL> 🙂 <IP>"
    assert got[10].N_CHARS == 1  # only a column called n_chars is counted anew
    again = pii.redact(spark.createDataFrame([("a@b.co x", 8)], "text string, n_chars long")).first()
    assert (again.text, again.n_chars) == ("<EMAIL> x", 9)


def test_decontamination(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:15])), (2, "Short ITEM"), (3, None), (4, "..."), (None, "no id here"), (1, "alpha beta")]
    texts = ["x " + " ".join(words[2:12]).upper() + " y", " ".join(words[2:11]), "a short-item b", None, "", "no id here", "ALPHA, beta; short item", "é " * 5 + " ".join(words[:15] + words[:15])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.PART_WORDS, 12):  # in one part and in many
        got = {r.doc_id: r for r in decontaminate.with_hits(docs, "text", bench, "r", part_words=size).select("doc_id", "text", "r.*").collect()}
        for i, t in enumerate(texts):
            n, hit, found = plain.contaminated(t, [("" if k is None else k, x) for k, x in items])
            assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (n, hit, found), t
    assert got[0].text[got[0].spans[0].start : got[0].spans[0].end].lower() == " ".join(words[2:12])
    assert {r.doc_id for r in decontaminate.clean(docs.withColumn("HITS", F.lit(1)), bench).collect()} == {1, 3, 4}
    assert decontaminate.contamination(docs.limit(0), bench.limit(0)).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_bpe_round_trip_and_ids():
    import public_tokenizers as known
    import tiktoken

    with open(known.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(bpe.Vocabulary(known.path(bpe.RANKS), known.PATTERN))
    rng = np.random.default_rng(5)
    letters = list("ab \n\t'sreé \x1c\x85\u2003\u3000日本1234!?🙂 ll")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(800)] + ["", "a" * 50000, " " * 3001 + "x", "é" * 777, "<|endoftext|>", ("word " * 700_000).strip()]
    for t, ids in zip(texts, [enc.encode(t) for t in texts], strict=True):
        assert ids == np.array(other.encode_ordinary(t), "<u4").tobytes(), t[:60]
        assert enc.decode(ids) == t.encode()


def test_bpe_rows(spark):
    docs = spark.createDataFrame([(1, "hi there"), (1, "hi there"), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.encoded_documents(docs).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == (0, 0, empty) and got[3] == (2, 0, empty) and got[1] == got[2] == (1, 2, hashlib.sha256(b"hi there").hexdigest())
    assert bpe.encoded_documents(docs.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.NET/x", "https://www.example.net/en/a?q#f", "http://example.com/de/x", "http://fr.org/fr/", "no scheme", None, "http://net", "http://x.com/a.net/b",
            "http://spam.com/x", "http://x.com/login?a", "http://x.com/a|b", "http://evil.com/%00" + "y" * 5000 + ".exe", "x://", "http://xnet/"]
    got = [(r.host, r.path[:8], r.rule, r.verdict) for r in urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert [g[2:] for g in got[2:9]] == [("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block")]
    assert got[4][:2] == got[5][:2] == ("", "") and [g[3] for g in got[9:]] == ["block", "allow", "block", "allow", "allow"]


def test_automaton_is_the_glob():
    import fnmatch

    rng = np.random.default_rng(1)
    globs = ["".join(rng.choice(list("ab*"), rng.integers(1, 9))) for _ in range(60)] + ["*", "a" * 70 + "*b"]
    texts = ["".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(300)] + ["a" * 75 + "b", "a" * 69 + "b"]
    hit = urlfilter.matches(urlfilter.pack(globs), texts)
    assert hit.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_repeated_passages(spark):
    passage = "this passage has many words that are shared by several texts. And it goes on with one more sentence of enough words."
    rows = [(1, f"first text.\n{passage}\nend"), (2, f"Some start here {passage} tail"), (3, "As. Et."), (4, "As. Et."), (None, None), (5, ""), (1, f"first text.\n{passage}\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = units.repeats(docs)
    got = sorted((x.doc_id or 0, x.n_units, len(x.removed)) for x in r.collect())
    assert got == [(0, 0, 0), (1, 2, 0), (1, 2, 2), (2, 2, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0)]
    cut = docs.where("doc_id = 2").join(r, "doc_id").select(units.without(F.col("text"), F.col("removed")).alias("t")).first().t
    assert cut == "Some start here this passage has many words that are shared by several texts.  tail"
    assert units.report(docs.limit(0)).count() == 0


def test_short_sentences_and_passages_repeat(spark):
    line = "The and attion. To thanedble the, anea. Eriner thanea."
    block = "one\ntwo\nthree four\nfive six\nseven eight"
    run = " ".join(f"Word{i} of it." for i in range(20))  # 60 words, no sentence above 3
    loop = "la " * 200
    rows = [(1, f"{line}\nx"), (2, f"y\n{line.upper()}\nz"), (3, f"{block}\n\nother"), (4, f"u\n\n{block}"), (5, f"a b {run} c d"), (6, f"Not here {run}\nafter"), (7, loop), (None, "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = units.repeats(docs)
    cut = {x.doc_id: x.t for x in docs.join(r, "doc_id").select("doc_id", units.without(F.col("text"), F.col("removed")).alias("t")).collect()}
    assert [cut[i] for i in (1, 3, 5)] == [rows[i - 1][1] for i in (1, 3, 5)]  # the earliest stay
    assert cut[2] == "y\n\nz" and cut[4] == "u\n\n" and cut[6] == "Not here .\nafter"
    assert cut[7].split() == ["la"] * units.PASSAGE
    assert {x.doc_id: x.source_ids for x in units.report(docs).collect() if x.source_ids} == {2: [1], 4: [3], 6: [5], 7: [7]}


def test_severity_is_learned_and_ordered(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        toxic = {1: 1, 2: 2}.get(i % 10, 0)
        words = [f"w{x}" for x in rng.integers(0, 400, 30)] + [["idiot", "scum"][x] for x in rng.integers(0, 2, 2 * toxic)]
        rows.append((i, " ".join(rng.permutation(words)), "c"))
        labels.append((i, 0 if toxic == 2 else 1, int(toxic > 0)))
    docs = spark.createDataFrame(rows + [(None, None, "c"), (2000, "", "c")], "doc_id long, text string, severity string")
    marks = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, 1, 1), (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in severity.toxicity(docs, marks).collect()}
    assert len(got) == 902
    held = [got[i] for i in range(600, 900)]
    assert np.mean([r.rejected == (i % 10 in (1, 2)) for i, r in enumerate(held)]) > 0.85
    mean = [np.mean([r.expected_severity for i, r in enumerate(held) if min(i % 10, 3) % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and not got[2000].rejected
    kept = severity.accepted(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got.values())
    assert severity.toxicity(docs, marks.limit(0)).where("rejected").count() == 0
