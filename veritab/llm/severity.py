"""Toxicity by cumulative-link ordinal regression (operator 8).

P(grade >= k) = sigmoid(score - cut_k): one weight vector for all thresholds, cuts in order. The score of a text is linear in
sparse features: each distinct word has its own hashed feature and those of its character 4-grams, so that words not
seen in training are judged by their parts. A text's features are divided by the root of its number of distinct words.

The fit takes at most SAMPLE labelled rows, those with the smallest digests of their id, in one task of bounded size: the
documented bound on training rows. Scoring covers every text; a task keeps the scores of words it has met.

Null and empty texts have no features: their score is 0. Labels whose document is missing or without grade are not used;
repeated labels count each. Without any labels all weights and scores are 0 and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import bounded_batches, fresh, named
from veritab.llm.decontaminate import FOLD

SAMPLE = 8000
BITS = 17
GRAMS = (4,)
ROUNDS = 110
RATE = 0.7
DECAY = 5e-6
REJECT = 0.3  # P(grade >= 1) from which a document is rejected
CACHE = 400_000


def features(word: bytes) -> np.ndarray:
    """Hashed features of a word: itself and the character n-grams of the word in brackets."""
    text = "<" + word.decode("utf-8", "replace") + ">"
    parts = {text, *(text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1))}
    return np.fromiter((xxhash.xxh3_64_intdigest(p) & ((1 << BITS) - 1) for p in parts), np.int64, len(parts))


def distinct_words(text: str | None) -> list[bytes]:
    return list(dict.fromkeys(text.encode().translate(FOLD).split())) if text else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str | None], grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by Adam on the penalised log-likelihood."""
    index: dict[bytes, int] = {}
    docs, words, size = [], [], np.zeros(len(texts))
    for i, t in enumerate(texts):
        own = distinct_words(t)
        size[i] = max(1, len(own))
        words += [index.setdefault(w, len(index)) for w in own]
        docs += [i] * len(own)
    docs, words = np.array(docs, np.int64), np.array(words, np.int64)
    scale = 1 / np.sqrt(size[docs]) if len(docs) else np.zeros(0)
    own = [features(w) for w in index]
    feature = np.concatenate(own) if own else np.zeros(0, np.int64)
    many = np.array([len(f) for f in own], np.int64)
    holder = np.repeat(np.arange(len(own)), many)
    part = np.repeat(1 / np.sqrt(np.maximum(1, many)), many)
    k = max(1, levels - 1)
    many_of = np.bincount(grades, minlength=levels)
    weight = np.sqrt(len(grades) / np.maximum(1, many_of[grades]) / max(1, np.count_nonzero(many_of)))  # rare grades count for more
    share = np.array([(np.sum(grades > j) + 0.5) / (len(grades) + 1) for j in range(k)])
    cuts = -np.log(share / (1 - share))
    state = np.concatenate([np.zeros(1 << BITS), cuts[:1], np.log(np.maximum(1e-2, np.diff(cuts)))])
    first, second = np.zeros_like(state), np.zeros_like(state)

    def cuts_of(s: np.ndarray) -> np.ndarray:
        return s[-k] + np.concatenate([[0], np.cumsum(np.exp(np.minimum(s[len(s) - k + 1 :], 20)))])

    for step in range(1, ROUNDS + 1):
        w, c = state[: 1 << BITS], cuts_of(state)
        word_score = np.bincount(holder, part * w[feature], len(own)) if len(own) else np.zeros(0)
        z = np.bincount(docs, scale * word_score[words], len(texts)) if len(docs) else np.zeros(len(texts))
        # edges of the grade's interval on the latent scale
        padded = np.concatenate([[-np.inf], c, [np.inf]])
        low, high = padded[grades] - z, padded[grades + 1] - z
        p_low, p_high = sigmoid(low), sigmoid(high)
        mass = np.maximum(p_high - p_low, 1e-12)
        d_low, d_high = p_low * (1 - p_low) / mass, p_high * (1 - p_high) / mass
        d_low, d_high = d_low * weight, d_high * weight
        d_z = d_low - d_high  # of the log-likelihood
        n = len(texts)
        g_word = np.bincount(words, scale * d_z[docs], len(own)) if len(docs) else np.zeros(len(own))
        g = np.zeros_like(state)
        g[: 1 << BITS] = np.bincount(feature, part * g_word[holder], 1 << BITS)[: 1 << BITS] / n - DECAY * w if len(own) else -DECAY * w
        g_cut = np.array([(np.sum(d_high[grades == j]) - np.sum(d_low[grades == j + 1])) / n for j in range(k)])
        g[-k] = g_cut.sum()
        for j in range(1, k):
            g[len(g) - k + j] = g_cut[j:].sum() * np.exp(np.minimum(state[len(g) - k + j], 20))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        state = state + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return state[: 1 << BITS].astype(np.float32), cuts_of(state)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, levels: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of `levels` grades 0.. from a bounded sample of labelled documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    graded = labels.select(F.col("doc_id").alias("id"), grade.cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, levels - 1))
    some = graded.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)  # the bound: at most `sample` rows of two numbers
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(some), "id").select("id", "text", "grade")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            all_ = pd.concat(rows).sort_values(["id", "grade"], kind="stable")
            w, c = train(all_["text"].tolist(), all_["grade"].to_numpy(np.int64), levels)
            yield pd.DataFrame([(w.tobytes(), c.tobytes())], columns=["w", "c"])

    got = texts.repartition(1).mapInPandas(run, "w binary, c binary").first()
    if got is None:
        return np.zeros(1 << BITS, np.float32), np.full(max(1, levels - 1), 40.0)
    return np.frombuffer(got.w, np.float32), np.frombuffer(got.c, np.float64)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str, text: str = "text") -> DataFrame:
    """docs plus a struct column `name`: expected_severity, p_toxic (P(grade >= 1)), grade (the likeliest)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats, whatever the corpus

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, cuts = sent.value
        known: dict[bytes, float] = {}
        for texts in batches:
            z = np.zeros(len(texts))
            for i, t in enumerate(texts):
                own = distinct_words(t)
                if not own:
                    continue
                if len(known) > CACHE:
                    known.clear()
                for x in own:
                    if x not in known:
                        f = features(x)
                        known[x] = float(w[f].sum()) / len(f) ** 0.5
                z[i] = sum(map(known.__getitem__, own)) / len(own) ** 0.5
            over = sigmoid(z[:, None] - cuts[None, :])
            each = np.concatenate([np.ones((len(z), 1)), over], 1) - np.concatenate([over, np.zeros((len(z), 1))], 1)
            yield pd.DataFrame({"expected_severity": over.sum(1), "p_toxic": over[:, 0], "grade": each.argmax(1)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(name, F.pandas_udf(run, "expected_severity double, p_toxic double, grade int")(named(docs, text).cast("string")))


def label_grade() -> Column:
    """0: not toxic, 1: toxic, 2: toxic and of low quality; null without a toxic label."""
    toxic = F.col("toxic").cast("int")
    return F.when(toxic > 0, F.when(F.col("quality").cast("int") == 0, 2).otherwise(1)).when(toxic == 0, 0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, rejected: one row per row of docs."""
    model = fit(docs, labels, label_grade(), 3)
    r = scored(docs.select("doc_id", "text"), model, "r")
    return r.select("doc_id", "r.expected_severity", "r.p_toxic", "r.grade", (F.col("r.p_toxic") >= REJECT).alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = fit(train_on if train_on is not None else docs, labels, label_grade(), 3)
    name = fresh(docs, "severity")
    return scored(docs, model, name).where(F.col(name)["p_toxic"] < REJECT).drop(name)
