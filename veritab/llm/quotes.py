"""Chat formatting by quotation linking (operator 4), in DataFrame expressions only.

A line's quote level is the number of `>` that lead it. Quoted lines are normalised (case, punctuation, spaces), hashed, and
joined to the earliest message of the conversation that wrote the line itself. A message replies to the earlier message
that most of its first-level quoted lines come from (of equals the latest); messages without such a link open a thread of
their own. Conversations are ordered thread by thread, and in a thread every reply comes after its parent:
by (root turn, depth, turn). Quotes and the attribution line before them are cut from the text.

Counting originals is a minimum per line and conversation, joins to it split hot keys, roots are found by doubling, and
positions by range-partitioned sums: a conversation with a third of all messages is never in one task.

Null texts have no lines and stay null. Null ids of conversations are one conversation; null turns come last and neither
quote nor are quoted. Rows of equal conversation and turn are one message for linking and keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import lookup_join, running_totals
from veritab.functions.workspace import stored

QUOTED = r"^(?:[ \t]*>)+"
# What introduces a quotation in the four languages of the tables.
ATTRIBUTION = r"(?i)^\s*(?:on|le|am|el)\b.*\b(?:wrote|écrit|schrieb|escribió)\s*:\s*$"


def lines(text: Column) -> Column:
    """Array of (level, content) of the lines of a text."""
    def cut(line: Column) -> Column:
        lead = F.regexp_extract(line, QUOTED, 0)
        return F.struct((F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(line, QUOTED + "[ ]?", "").alias("content"))

    return F.transform(F.split(text, "\r?\n", -1), cut)


def normal(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", " "))


def own_text(parsed: Column) -> Column:
    """The lines of level 0 without attributions of a quotation, and without blank lines at either end."""
    def keep(line: Column, i: Column) -> Column:
        introduces = line["content"].rlike(ATTRIBUTION) & (F.coalesce(F.get(parsed, i + 1)["level"], F.lit(0)) > 0)
        return (line["level"] == 0) & ~introduces

    kept = F.transform(F.filter(parsed, keep), lambda line: line["content"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s*\n|\s+$", "")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, parent_turn, root_turn, depth, n_quoted, n_linked, max_level, text: one row per message."""
    raw = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    some = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    messages = stored(raw.withColumn("conv", key).withColumn("quotes", some), "messages")  # row numbers hold from here on

    def exploded(rows: DataFrame) -> DataFrame:
        each = rows.where(F.col("turn").isNotNull()).select("conv", "turn", F.explode(lines(F.col("text"))).alias("line"))
        return each.select("conv", "turn", F.col("line.level").alias("level"), normal(F.col("line.content")).alias("content")).where("content <> ''").select(
            "conv", "turn", "level", F.unhex(F.md5("content")).alias("passage"),
        )

    quoting = messages.where("quotes")
    asked = stored(exploded(quoting).where("level > 0").groupBy("conv", "turn", "level", "passage").agg(F.count(F.lit(1)).alias("times")), "quoted")
    parents = None
    if not asked.isEmpty():
        threads = asked.select("conv").distinct()
        written = exploded(messages.join(threads, "conv", "left_semi")).where("level = 0")
        first = written.groupBy("conv", "passage").agg(F.min("turn").alias("origin"))
        met = lookup_join(asked, first, ["conv", "passage"], how="left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
        votes = met.groupBy("conv", "turn", "origin").agg(
            F.sum("times").alias("lines"), F.sum(F.when(F.col("level") == 1, F.col("times")).otherwise(0)).alias("first_level"), F.max("level").alias("level"),
        )
        voted = F.when(F.col("origin").isNotNull() & (F.col("first_level") > 0), F.struct("first_level", F.col("origin").alias("turn")))
        parents = stored(votes.groupBy("conv", "turn").agg(
            F.max(voted).alias("best"), F.sum("lines").alias("n_quoted"), F.max("level").alias("max_level"),
            F.sum(F.when(F.col("origin").isNotNull(), F.col("lines")).otherwise(0)).alias("n_linked"),
        ).select("conv", "turn", F.col("best.turn").alias("parent"), "n_quoted", "n_linked", "max_level"), "parents")
        messages = lookup_join(messages, parents.join(rooted(parents), ["conv", "turn"], "left"), ["conv", "turn"])
    else:
        none = F.lit(None).cast("bigint")
        messages = messages.select("*", *[none.alias(c) for c in ("parent", "n_quoted", "n_linked", "max_level", "root", "depth")])
    parsed = F.when(F.col("quotes"), own_text(lines(F.col("text")))).otherwise(F.col("text"))
    last = F.lit(2**63 - 1)
    ready = stored(messages.select(
        "conv", "conv_id", "turn", "role", "row", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.coalesce("max_level", F.lit(0)).cast("int").alias("max_level"), parsed.alias("text"),
    ), "linked")
    order = ready.select("conv", F.coalesce("root_turn", last).alias("o_root"), F.col("depth").alias("o_depth"), F.coalesce("turn", last).alias("o_turn"), "row", F.lit(1).alias("one"))
    placed = running_totals(order, ["conv"], ["o_root", "o_depth", "o_turn", "row"], ["one"]).select("row", F.col("one_run").cast("bigint").alias("position"))
    return ready.join(placed, "row").select("conv_id", "turn", "role", "position", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "max_level", "text")


def rooted(parents: DataFrame) -> DataFrame:
    """conv, turn, root, depth of the messages with a parent, by doubling: each round looks twice as far up."""
    up = parents.where(F.col("parent").isNotNull()).select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        up = stored(up, "roots")
        above = up.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        met = lookup_join(up, above, ["conv", "root"])
        if met.where(F.col("next").isNotNull()).isEmpty():
            return up
        up = met.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
