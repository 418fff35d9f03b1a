"""Merkle dataset manifest with a recursive-CTE climb (operator 13).

A row's leaf is the SHA-256 of its fields. The leaves of a group are ordered by key, and every `FAN` consecutive nodes become one node
until one is left, the group's root; the group roots, ordered by group, likewise give the table's root. Built levels are stored as
parent-linked node rows, `STRIDE` levels a row: a node's row names its ancestor and the siblings on the way there. A recursive
Spark query then ascends from every leaf at once. Each step joins the nodes reached to their rows, appends the siblings and folds the
claimed digest, so a proof is never longer in a step than the siblings of that step.

Leaves are ranked in ranges (`ranked`), so that a group with a third of all rows is spread over its ranges; runs have `FAN ** STRIDE`
rows at most, whatever the size of a group. Levels shrink by that factor each round, and only inner nodes are joined in the climb.

Null fields count as `-`. A null group is a group of its own and comes first, a null key ranks first and its row is never tampered with.
Rows of equal group and key are ranked by their leaves; rows that are equal altogether are leaves of their own. An empty table gives no
row. Further columns of the table, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.workspace import stored
from veritab.llm.common import named

FAN = 3
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# FAN ** 39 is the largest power that fits a bigint
POWERS = [FAN**i for i in range(40)]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, a colon and its text."""
    parts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df, stored, with the place 0.. of each row in the order as `name` and its range as `part`; the order must be strict."""
    sorted_ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = stored(sorted_ranges.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    spread = spread.withColumn("part", F.shiftright("_at", 33))
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per range
    before, total = [], 0
    for s in sizes:
        before.append((s.part, total))
        total += s.n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "part bigint, _before bigint"))
    return spread.join(offsets, "part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_before")


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree with n leaves."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < n))


def _upper(hashes: Column) -> Column:
    """One level up inside a run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(hashes, k * FAN + 1, F.lit(FAN)), "").cast("binary"), 256))


def _beside(hashes: Column, at: Column) -> Column:
    """The siblings of a node, those before and those after it."""
    first = F.floor(at / FAN).cast("int") * FAN
    left = F.slice(hashes, first + 1, at - first)
    right = F.slice(hashes, at + 2, first + FAN - 1 - at)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def runs_of(nodes: DataFrame, level: int, sign: int) -> DataFrame:
    """Groups of up to FAN ** STRIDE neighbours of one level with their common ancestor.

    nodes: tree (place of its first leaf), depth, pos, hash (hex), id, row (whatever travels along). Gives tree, depth, up (levels
    climbed), pos, hash and id of the ancestor, and the members (id, row, path).
    """
    width = FAN**STRIDE
    member = F.struct((F.col("pos") % width).cast("int").alias("at"), "hash", "id", "row")
    g = nodes.groupBy("tree", "depth", F.floor(F.col("pos") / width).alias("pos")).agg(F.array_sort(F.collect_list(member)).alias("m"))
    g = g.withColumn("up", F.least(F.lit(STRIDE), F.col("depth") - level)).withColumn("h0", F.col("m.hash"))
    for j in range(1, STRIDE + 1):
        g = g.withColumn(f"h{j}", F.when(F.col("up") >= j, _upper(F.col(f"h{j - 1}"))).otherwise(F.col(f"h{j - 1}")))
    steps = lambda x: F.array(*[_beside(F.col(f"h{j}"), F.floor(x["at"] / FAN**j).cast("int")) for j in range(STRIDE)])
    members = F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["row"].alias("row"), F.slice(steps(x), 1, F.col("up")).alias("path")))
    # a node whose tree ends here is its own ancestor
    g = g.withColumn("pos", F.when(F.col("up") == STRIDE, F.col("pos")).otherwise(F.lit(0)))
    height = F.lit(level) + F.col("up")
    place = F.col("tree") + F.col("pos") * F.element_at(F.array(*[F.lit(p) for p in POWERS]), height + 1)
    node = place * 64 + height
    return g.select(
        "tree", "depth", "up", "pos", F.element_at(f"h{STRIDE}", 1).alias("hash"),
        F.when(F.col("up") == 0, F.col("m")[0]["id"]).otherwise(node if sign > 0 else -node - 1).alias("id"), members.alias("m"))


def _levels(nodes: DataFrame, deepest: int, sign: int) -> list[DataFrame]:
    """The stored runs of all strides of a forest, lowest first."""
    out = []
    for level in range(0, max(deepest, 1), STRIDE):
        runs = stored(runs_of(nodes, level, sign), "levels")
        out.append(runs)
        up = runs.where(F.lit(level) + F.col("up") < F.col("depth"))
        nodes = up.select("tree", "depth", "pos", "hash", "id", F.lit(None).cast("string").alias("row"))
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """tree, id, hash of each tree's root."""
    tops = [r.where(F.lit(i * STRIDE) + F.col("up") == F.col("depth")).select("tree", "id", "hash") for i, r in enumerate(levels)]
    return reduce(DataFrame.unionByName, tops)


def _links(runs: DataFrame, root: Column) -> DataFrame:
    """id, parent, path, sibs (packed digests in order), root of the group that the node is, if it is one."""
    m = runs.select(F.col("id").alias("parent"), F.explode("m").alias("m"))
    return m.select(F.col("m.id").alias("id"), "parent", F.col("m.path").alias("path"), packed(F.col("m.path")).alias("sibs"), root.alias("group_root"))


def packed(path: Column) -> Column:
    return F.unhex(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def folded(path: Column, claim: Column) -> Column:
    return F.aggregate(path, claim, lambda h, p: digest(F.concat(p["left"], hex_text(h), p["right"])))


@dataclass
class Manifest:
    """A stored tree: the lowest runs, whose members carry (key, leaf, claim), the link rows of all inner nodes, and the root."""

    spark: SparkSession
    lowest: DataFrame
    links: DataFrame
    root: str | None

    @staticmethod
    def build(rows: DataFrame, key: str, group: str, leaf: Column, claim: Column) -> Manifest:
        """The manifest of `rows`; `claim` is the digest that each row's proof is later folded with."""
        one = rows.select(
            named(rows, group).cast("string").alias("grp"), named(rows, key).alias("key"), leaf.alias("leaf"), claim.alias("claim"),
            F.monotonically_increasing_id().alias("u"))
        one = stored(one, "leaves")  # texts are read once
        placed = ranked(one, ["grp", "key", "leaf", "u"], "g")
        pieces = placed.groupBy("part", "grp").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))  # ranges + groups rows at most
        pieces = stored(pieces, "pieces")
        trees = stored(pieces.groupBy("grp").agg(F.min("first").alias("tree"), F.sum("n").alias("n")).withColumn("depth", depth_of(F.col("n"))), "trees")
        same = pieces.alias("p").join(trees.alias("t"), F.expr("p.grp <=> t.grp")).select("p.part", "p.grp", "t.tree", "t.depth")
        found = placed.alias("l").join(same.alias("s"), F.expr("l.part = s.part AND l.grp <=> s.grp"))
        row = F.struct("l.g", "l.key", "l.leaf", "l.claim")
        nodes = found.select("s.tree", "s.depth", (F.col("l.g") - F.col("s.tree")).alias("pos"), hex_text(F.col("l.leaf")).alias("hash"), (F.col("l.g") * 64).alias("id"), row.alias("row"))
        deepest, groups = trees.agg(F.max("depth"), F.count(F.lit(1))).first()
        lower = _levels(nodes, deepest or 0, 1)
        tops = ranked(_tops(lower), ["tree"], "pos")
        count = F.lit(groups).cast("bigint")
        upper_nodes = tops.select(F.lit(0).cast("bigint").alias("tree"), depth_of(count).alias("depth"), "pos", "hash", "id", F.col("hash").alias("row"))
        height = sum(p < groups for p in POWERS)
        upper = _levels(upper_nodes, height, -1)
        root = _tops(upper).first()
        none = F.lit(None).cast("string")
        links = [_links(r, none) for r in lower[1:]]
        if height:
            links += [_links(r, F.col("m.row") if i == 0 else none) for i, r in enumerate(upper)]
        else:  # one group: nothing above it
            links.append(_links(upper[0], none).where(F.lit(False)))
        return Manifest(rows.sparkSession, lower[0], stored(reduce(DataFrame.unionByName, links), "links"), root.hash if root else None)

    def climb(self) -> DataFrame:
        """key, leaf, group_root, root, proof_sha256, folded_root: one row per leaf, digests as lowercase hex."""
        # one row per leaf and step comes out; the default limits the rows of a recursion
        self.spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        m = self.lowest.select(F.col("id").alias("node"), F.explode("m").alias("m"))
        anchor = m.select(
            F.col("m.row.g").alias("g"), "node", folded(F.col("m.path"), F.coalesce("m.row.claim", "m.row.leaf")).alias("folded"),
            packed(F.col("m.path")).alias("sibs"), F.col("m.row.key").alias("key"), F.col("m.row.leaf").alias("leaf"))
        kind = anchor.schema["key"].dataType.simpleString()
        climbed = self.spark.sql(f"""
            WITH RECURSIVE climb AS (
              SELECT g, 0 AS step, node, folded, sibs, key, leaf, CAST(NULL AS STRING) AS group_root FROM {{anchor}}
              UNION ALL
              SELECT c.g, c.step + 1, l.parent,
                     aggregate(l.path, c.folded, (h, p) -> unhex(sha2(CAST(concat(p.left, lower(hex(h)), p.right) AS BINARY), 256))),
                     l.sibs, CAST(NULL AS {kind}), CAST(NULL AS BINARY), l.group_root
              FROM climb c JOIN {{links}} l ON c.node = l.id)
            SELECT * FROM climb""", anchor=anchor, links=self.links)
        root = F.lit(self.root).cast("string")
        steps = F.transform(F.array_sort(F.collect_list(F.struct("step", "sibs"))), lambda s: hex_text(s["sibs"]))
        return climbed.groupBy("g").agg(
            F.max("key").alias("key"), hex_text(F.max("leaf")).alias("leaf"), F.coalesce(F.max("group_root"), root).alias("group_root"),
            root.alias("root"), F.sha2(F.array_join(steps, "").cast("binary"), 256).alias("proof_sha256"),
            hex_text(F.max_by("folded", "step")).alias("folded_root")).drop("g")


def tampered(docs: DataFrame) -> Column:
    """The text, without its newlines where the checksum of the id is even."""
    text = docs["text"].cast("string")
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of docs."""
    fields = {c: named(docs, c) for c in FIELDS}
    leaf = leaf_digest(list(fields.values()))
    claim = leaf_digest([tampered(docs) if c == "text" else x for c, x in fields.items()])
    changed = F.when(docs["text"].contains("\n"), claim)
    proofs = Manifest.build(docs, "doc_id", "source", leaf, changed).climb()
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", F.col("group_root").alias("subroot"), "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
