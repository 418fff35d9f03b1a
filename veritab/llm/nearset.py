"""Near-duplicate groups by a chosen-path set similarity join (operator 9).

1. A pass over the texts hashes each document's set of word shingles to 64 bits and keeps COORDINATES minwise hashes of it.
   Documents with equal sets (compared by a 128-bit digest) become one representative.
2. TREES independent trees branch the representatives. A node picks one minwise coordinate, and now and then a second
   one (1 / threshold children on average), and its rows go to the child their token names. Nodes of one row end, nodes of at
   most LEAF rows are compared exhaustively on sketches, larger ones branch on. Rows that still share a large node after the
   last level agree on as many tokens and are tied to the node's smallest row without a comparison.
   A pair at the threshold is missed by all trees with a probability under 1e-4; above it, less.
3. The ties (a spanning forest per leaf, not its pairs) give coarse clusters, which hold every link found; a sketch margin
   of five standard deviations keeps true links in.
4. Links are confirmed on full sets, inside a cluster, likeliest first; pairs that are connected by then are skipped. Clusters
   beyond PART documents are cut into parts, and every two parts meet in a task of their own, so no task holds
   more than two parts; each hands on a spanning forest only.
5. Components of the confirmed links, carried back to all copies: component_id is the smallest doc_id reachable.

Sets are small for most documents; full sets are made again for clustered documents only. Null and empty texts have no
words: an empty set, linked with nothing. A null doc_id is kept as it is, linked with nothing. Rows that share
a doc_id are one document for linking if their sets are equal; otherwise both texts' links count for that id (in `one_of_each`, which
removes texts, each text goes by its own links). Further columns, whatever their names, take no part and stay as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.workspace import stored
from veritab.llm.common import bounded_batches, fresh

COORDINATES = 128
TREES = 16
LEVELS = 4  # and one more for each tenfold of representatives from a million on
LEAF = 1024
PART = 1024
BROADCAST_IDS = 1_000_000
DEVIATIONS = 5.0
_rng = np.random.default_rng(20)
FACTOR = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words, one of all; of none, none."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minwise(hashes: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(small), 256):
        mixed = small[k : k + 256, None] * FACTOR + ADD
        mixed ^= mixed >> np.uint32(15)
        np.minimum(low, mixed.min(0), out=low)
    return low


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def described(docs: DataFrame, width: int) -> DataFrame:
    """id, key, n, digest of the set, coordinates (128 ints) and sketch (their low bytes) of every row (id, key, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingles(text, width)
                m = minwise(s)
                out.append((len(s), digest_of(s) if len(s) else None, m.view(np.int32), m.astype(np.uint8).tobytes()))
            made = pd.DataFrame(out, columns=["n", "digest", "coordinates", "sketch"])
            made.insert(0, "key", batch["key"].to_numpy())
            made.insert(0, "id", batch["id"].to_numpy())
            yield made

    return docs.mapInPandas(run, "id string, key binary, n bigint, digest binary, coordinates array<int>, sketch binary")


def _child(node: Column, salt: int) -> Column:
    """Child of a node by the token of a coordinate that the node picks."""
    at = F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(node, at, F.get("coordinates", at))


def _branched(rows: DataFrame, node: Column, percent: float, extra: bool) -> DataFrame:
    """The rows in their children: one per node, and for some nodes a second one."""
    also = F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < int(percent * 1000), F.array(_child(node, 1), _child(node, 2))).otherwise(F.array(_child(node, 1)))
    return rows.select("doc", F.explode(also if extra else F.array(_child(node, 1))).alias("node"))


def _find(parent: list[int] | np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _leaf_ties(least: float):
    """Ties of similar sketches in each node, as a spanning forest. Rows come sorted by node."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def ties(rows: pd.DataFrame) -> pd.DataFrame:
            node, doc = rows["node"].to_numpy(), rows["doc"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), COORDINATES)
            parent, out = np.arange(len(rows)), []  # every row's root, kept flat
            for shift in range(1, len(rows)):
                a = np.nonzero(node[:-shift] == node[shift:])[0]
                if not len(a):
                    break
                a = a[parent[a] != parent[a + shift]]
                like = np.zeros(len(a), np.int64)
                for k in range(0, len(a), 4096):
                    x = a[k : k + 4096]
                    like[k : k + 4096] = np.count_nonzero(sketch[x] == sketch[x + shift], axis=1)
                for i in a[like >= least * COORDINATES].tolist():
                    x, y = _find(parent, i), _find(parent, i + shift)
                    if x != y:
                        parent[y] = x
                        out.append((doc[i], doc[i + shift]))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
            return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows["node"].iloc[-1] if len(rows) else None
            open_ = rows["node"] == last
            yield ties(rows[~open_])
            rest = rows[open_]
        if rest is not None:
            yield ties(rest)

    return run


def coarse_ties(sets: DataFrame, threshold: float) -> DataFrame:
    """Ties (a, b) between representatives that may be linked: the trees of the chosen-path join."""
    spark = sets.sparkSession
    margin = threshold - DEVIATIONS * (threshold * (1 - threshold) / COORDINATES) ** 0.5
    trees = F.array(*[F.lit(t).cast("bigint") for t in range(TREES)])
    tokens = sets.select("doc", "coordinates")
    rows = _branched(tokens.select("doc", "coordinates", F.explode(trees).alias("tree")), F.col("tree"), 0, False)
    ties, leaves = [], []
    levels = max(LEVELS, math.ceil(math.log10(max(1, sets.count()))) - 2)
    for depth in range(1, levels + 1):
        rows = stored(rows, "nodes")
        # stored, as adaptive execution splits a hot key only where both sides of a join come straight from a shuffle
        size = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("least")).where("size > 1"), "sizes")
        sized = stored(rows.join(size, "node"), "sized")
        leaves.append(sized.where(F.col("size") <= LEAF).select("node", "doc"))
        large = sized.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        if depth == levels:
            ties.append(large.where(F.col("doc") != F.col("least")).select(F.col("least").alias("a"), F.col("doc").alias("b")))
        else:
            rows = _branched(large.select("doc", "node").join(tokens, "doc"), F.col("node"), 1 / threshold - 1, True)
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionByName(x)
    sketched = every.join(sets.select("doc", "sketch"), "doc")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = sketched.repartition(partitions, "node").sortWithinPartitions("node").select("node", "doc", "sketch").mapInPandas(_leaf_ties(margin), "a bigint, b bigint")
    for x in ties:
        near = near.unionByName(x)
    return near.distinct()


def components(ties: DataFrame) -> DataFrame:
    """node, group: connected components by contraction.

    Every vertex moves to the least of its neighbours and itself in a hashed order, which shortens chains by a constant factor
    however ids are ordered; edges shrink with the vertices. The group is named by one of its vertices.
    """
    edges = stored(ties.where("a <> b").select("a", "b").distinct(), "edges")
    moved = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(5)).alias("h"), F.col(c).alias("v"))
        to = stored(both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("to")).select(F.col("a").alias("v"), F.col("to.v").alias("to")), "moves")
        edges = stored(
            edges.join(to.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges",
        )
        if moved is None:
            moved = to.select(F.col("v").alias("node"), F.col("to").alias("group"))
        else:
            moved = stored(
                moved.join(to.select(F.col("v").alias("group"), "to"), "group", "left").select("node", F.coalesce("to", "group").alias("group")), "moved",
            )
    return moved if moved is not None else ties.select(F.col("a").alias("node"), F.col("b").alias("group")).where("false")


def _linked(percent: int, only_across: bool = False):
    """Confirmed links of a group of documents as a spanning forest, likeliest pairs first."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc", kind="stable").drop_duplicates("doc", ignore_index=True)
        doc = rows["doc"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        size = np.array([len(s) for s in sets])
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), COORDINATES)
        least = percent / 100
        bound = COORDINATES * (least - DEVIATIONS * (least * (1 - least) / COORDINATES) ** 0.5)
        like, left, right = [], [], []
        for i in range(len(rows) - 1):
            same = np.count_nonzero(sketch[i + 1 :] == sketch[i], axis=1)
            a, b = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
            j = np.nonzero((same >= bound) & (100 * a >= percent * b))[0]
            like.append(same[j].astype(np.int16))
            left.append(np.full(len(j), i, np.int32))
            right.append((j + i + 1).astype(np.int32))
        out, parent = [], list(range(len(rows)))
        if like:
            order = np.argsort(-np.concatenate(like), kind="stable")
            for i, j in zip(np.concatenate(left)[order].tolist(), np.concatenate(right)[order].tolist(), strict=True):
                x, y = _find(parent, i), _find(parent, j)
                if x == y:
                    continue
                small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                at = np.minimum(large.searchsorted(small), len(large) - 1)
                common = int(np.count_nonzero(large[at] == small))
                if 100 * common >= percent * (len(small) + len(large) - common):
                    parent[y] = x
                    out.append((doc[i], doc[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) inside the clusters (doc, group), as spanning forests."""
    sizes = stored(clusters.groupBy("group").agg(F.count(F.lit(1)).alias("many")), "many")
    # documents of a large cluster are dealt into parts; a pair of parts is a task
    parts = F.ceil(F.col("many") / PART).cast("int")
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    placed = stored(clusters.join(sizes, "group").withColumn("parts", parts).select("doc", "group", "parts", own.alias("own")), "placed")
    wanted = stored(sets.join(placed, "doc").select("doc", "id", "digest", "sketch", "group", "parts", "own"), "wanted")
    ids = wanted.select("id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingles(t, width) for t in batch["text"]]
            yield pd.DataFrame({"digest": [digest_of(s) for s in made], "hashes": [s.tobytes() for s in made]})

    # the texts of a representative's id hold its set, and perhaps others
    texts = docs.join(ids, "id", "left_semi").select("text").mapInPandas(run, "digest binary, hashes binary")
    full = texts.join(wanted, "digest")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = full.select("doc", "hashes", "sketch", "group", "own", other).select(
        "doc", "hashes", "sketch", "group", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
    )
    return met.groupBy("group", "one", "two").applyInPandas(_linked(percent), "a bigint, b bigint")


def _sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (id, key, n, digest), the distinct sets (doc, digest, id) and their links (a, b).

    A set's node is a number of its own, not one of the ids that have it, so ids may repeat with other texts. Ids travel as text, as
    a null among numbers would turn a batch's numbers into floats.
    """
    bounded_batches(docs.sparkSession)
    text = docs["text"].cast("string")
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    rows = docs.select(docs["doc_id"].cast("bigint").cast("string").alias("id"), key.alias("key"), text.alias("text"))
    every = stored(described(rows, width), "sets")
    real = every.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    least = real.groupBy("digest").agg(F.min(F.col("id").cast("bigint")).cast("string").alias("id"))
    # the representative's coordinates come with it; equal rows of it are one
    kinds = real.join(least, ["digest", "id"]).dropDuplicates(["digest"]).select("id", "digest", "n", "coordinates", "sketch")
    sets = stored(kinds.withColumn("doc", F.monotonically_increasing_id()), "representatives")
    clusters = stored(components(coarse_ties(sets, percent / 100)).select(F.col("node").alias("doc"), "group"), "clusters")
    whole = stored(clusters.union(clusters.select(F.col("group").alias("doc"), "group")).distinct(), "clusters")
    found = stored(links(rows, sets, whole, width, percent), "links")
    return every.select("id", "key", "n", "digest"), sets.select("doc", "digest"), found


def _grouped(every: DataFrame, sets: DataFrame, ties: DataFrame) -> DataFrame:
    """id, key, n, component: per row the smallest id of the sets that its set is tied to."""
    known = every.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    ids = known.groupBy("digest").agg(F.min(F.col("id").cast("bigint")).alias("least"))
    nodes = stored(sets.join(ids, "digest").select("doc", "digest", "least"), "nodes")
    found = components(ties)
    named = stored(found.union(found.select("group", "group")).distinct(), "components")
    placed = stored(nodes.join(named.select(F.col("node").alias("doc"), "group"), "doc", "left").select("digest", "least", F.coalesce("group", "doc").alias("group")), "placed")
    smallest = stored(placed.groupBy("group").agg(F.min("least").alias("component")), "smallest")
    by_set = stored(placed.join(smallest, "group").select("digest", "component"), "by_set")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", F.col("id").cast("bigint")))
    return every.join(by_set, "digest", "left").select(F.col("id").cast("bigint").alias("id"), "key", "n", own.alias("component"))


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs. Links: 100 * common >= percent * union."""
    every, sets, ties = _sets(docs, width, percent)
    # sets that one id has are linked through it
    shared = every.where(F.col("id").isNotNull() & F.col("digest").isNotNull()).select("id", "digest").distinct().join(sets, "digest")
    first = shared.groupBy("id").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("many")).where("many > 1")
    through = shared.join(first, "id").where("doc <> a").select("a", F.col("doc").alias("b"))
    out = _grouped(every, sets, stored(ties.union(through), "ties"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of smallest id of each group of texts, with their own columns; rows without id or words stay.

    Groups are of texts here: a text whose id also has another text goes or stays by its own links.
    """
    grouped = _grouped(*_sets(docs, width, percent))
    gone_id, gone_key = fresh(docs, "gone"), fresh(docs, "gone_text")
    gone = stored(grouped.where(F.col("id") != F.col("component")).select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    key = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))
    return docs.join(gone, (docs["doc_id"].cast("bigint") == gone[gone_id]) & (key == gone[gone_key]), "left_anti")
