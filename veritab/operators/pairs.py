"""Pairwise-column fidelity in long form: (column_1, column_2, value, n).

All pairs of a kind are handled in one plan. Rows are reduced to counted cells per pair before
anything is joined, so repeated values cost nothing further down.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import HOT_ROWS, checkpointed, lookup_join, running_totals
from veritab.functions.expressions import equal_width
from veritab.operators.longform import CATEGORY_LIKE, NUMERIC_LIKE, as_number, as_text, number_bounds, two_sided
from veritab.operators.marginal import column_shapes
from veritab.sources.roles import DATETIME, NUMERICAL, Roles

PAIR = ["column_1", "column_2"]
EMPTY = "column_1 string, column_2 string, value double, n bigint"


def _exploded(
    df: DataFrame, pairs: Sequence[tuple[str, str]], first: Callable[[str], Column], second: Callable[[str], Column], drop_nulls: bool
) -> DataFrame:
    """(pair, v1, v2) for every row and pair, by its place; pairwise deletion when asked. A number is cheaper to group by than two names."""
    names = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    wide = df.select(*[first(a).alias(f"x_{a}") for a in names if any(a == p for p, _ in pairs)],
                     *[second(b).alias(f"y_{b}") for b in names if any(b == q for _, q in pairs)])
    # one SQL text instead of hundreds of column calls
    cells = ", ".join(f"named_struct('pair', {i}, 'v1', `x_{a}`, 'v2', `y_{b}`)" for i, (a, b) in enumerate(pairs))
    out = wide.selectExpr(f"inline(array({cells}))")
    return out.where(F.col("v1").isNotNull() & F.col("v2").isNotNull()) if drop_nulls else out


def _named(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The names of a pair instead of its place."""
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1).alias(PAIR[k])
    return df.select(name(0), name(1), *[c for c in df.columns if c != "pair"])


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], EMPTY)


def cramers_v(df: DataFrame, roles: Roles, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cramer's V with the 2x2 continuity correction.

    Cells that never occur need no rows: together they add n - sum(expected of the others) to
    the statistic, and in a 2x2 table all deviations are equal.
    """
    cols = roles.of(*CATEGORY_LIKE, within=columns)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return _none(df)
    cells = _exploded(df, pairs, as_text, as_text, drop_nulls=True)
    cells = checkpointed(_named(cells.groupBy("pair", "v1", "v2").agg(F.count(F.lit(1)).cast("double").alias("o")), pairs))
    rows = cells.groupBy(*PAIR, "v1").agg(F.sum("o").alias("r"), F.count(F.lit(1)).alias("_k"))
    cols2 = cells.groupBy(*PAIR, "v2").agg(F.sum("o").alias("c"), F.count(F.lit(1)).alias("_k"))
    # one row per pair in both
    row_side = rows.groupBy(*PAIR).agg(F.sum("r").alias("total"), F.count(F.lit(1)).alias("nr"), F.sum(1 / F.col("r")).alias("ir"))
    col_side = cols2.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("c")).alias("ic"))
    sizes = row_side.join(F.broadcast(col_side), PAIR)
    # one value of a narrow column can meet most values of a wide one
    filled = lookup_join(cells, rows, [*PAIR, "v1"], "inner", hot_rows=hot_rows, weight="_k")
    filled = lookup_join(filled, cols2, [*PAIR, "v2"], "inner", hot_rows=hot_rows, weight="_k").join(F.broadcast(sizes), PAIR)
    e = F.col("r") * F.col("c") / F.col("total")
    d = F.abs(F.col("o") - e)
    stat = filled.groupBy(*PAIR).agg(
        F.sum(d * d / e).alias("seen"), F.sum(e).alias("expected"), F.max(d).alias("dev"),
        *[F.max(k).alias(k) for k in ("total", "nr", "nc", "ir", "ic")],
    )
    off = F.col("dev") - F.least(F.lit(0.5), F.col("dev"))
    two_by_two = (F.col("nr") == 2) & (F.col("nc") == 2)
    chi2 = F.when(two_by_two, off * off * F.col("total") * F.col("ir") * F.col("ic")).otherwise(F.col("seen") + F.col("total") - F.col("expected"))
    dim = F.least("nr", "nc") - 1
    v = F.when(F.col("total") < 2, F.lit(None)).when(dim == 0, F.lit(0.0)).otherwise(
        F.sqrt(F.greatest(chi2, F.lit(0.0)) / F.nullif(F.col("total") * dim, F.lit(0.0))))
    return stat.select(*PAIR, v.cast("double").alias("value"), F.col("total").cast("bigint").alias("n"))


def correlation_ratio(df: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation ratio of every category-like column with every numerical one."""
    cats, nums = roles.of(*CATEGORY_LIKE, within=columns), roles.of(NUMERICAL, within=columns)
    pairs = [(c, x) for c in cats for x in nums]
    if not pairs:
        return _none(df)
    cells = _exploded(df, pairs, as_text, lambda n: as_number(df, n, roles), drop_nulls=True)
    groups = _named(cells.groupBy("pair", "v1").agg(F.count(F.lit(1)).alias("k"), F.avg("v2").alias("m"), F.var_pop("v2").alias("var")), pairs)
    # one row per pair
    overall = groups.groupBy(*PAIR).agg((F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mu"))
    j = groups.join(F.broadcast(overall), PAIR)
    dev = F.col("m") - F.col("mu")
    sums = j.groupBy(*PAIR).agg(F.sum(F.col("k") * dev * dev).alias("between"), F.sum(F.col("k") * F.col("var")).alias("within"), F.sum("k").alias("n"))
    total = F.col("between") + F.col("within")
    eta = F.when(F.col("n") < 2, F.lit(None)).when(total == 0, F.lit(0.0)).otherwise(F.sqrt(F.col("between") / F.nullif(total, F.lit(0.0))))
    return sums.select(*PAIR, eta.cast("double").alias("value"), "n")


def rank_matrix(
    tables: dict[str, DataFrame], roles: Roles, columns: Sequence[str] | None = None, kinds: Sequence[str] = (NUMERICAL,), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(side, column_1, column_2, value, n): signed rank correlations with average ranks under pairwise deletion, all tables in one plan.

    A column is ranked once per pattern of nulls that it meets, not once per partner: partners without nulls, or with nulls in the same
    rows, share its ranks. Ranks come from prefix sums over counted values and go back to the rows; one aggregation per table then holds
    the cross products of all pairs.
    """
    cols = roles.of(*kinds, within=columns)
    some = next(iter(tables.values()))
    pairs = list(combinations(cols, 2))
    if not pairs:
        return some.sparkSession.createDataFrame([], "side string, " + EMPTY)
    x = {c: f"x{i}" for i, c in enumerate(cols)}
    wide = reduce(DataFrame.unionByName, [df.select(F.lit(side).alias("side"), *[as_number(df, c, roles).alias(x[c]) for c in cols]) for side, df in tables.items()])
    wide = checkpointed(wide).withColumn("_row", F.monotonically_increasing_id())
    pattern = _null_patterns(wide, cols, x)
    # (column, pattern it is ranked under): None is its own non-null rows
    under = {(a, b): None if pattern[b] in (None, pattern[a]) else pattern[b] for p, q in pairs for a, b in ((p, q), (q, p))}
    tasks = {t: i for i, t in enumerate(sorted({(a, under[a, b]) for a, b in under}, key=str))}
    at = {(a, b): f"r{tasks[a, under[a, b]]}" for a, b in under}
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("task"), (F.col(x[a]) if m is None else F.when(F.col(x[m]).isNotNull(), F.col(x[a]))).alias("v")) for (a, m), i in tasks.items()]))
    long = wide.select("side", "_row", cells).where(F.col("v").isNotNull())
    run = running_totals(long.groupBy("side", "task", "v").agg(F.count(F.lit(1)).alias("k")), ["side", "task"], ["v"], ["k"])
    # deviation of the average rank from the mean rank
    dev = (F.col("k_run") - F.col("k")) + (F.col("k") + 1) / 2 - (F.col("k_all") + 1) / 2
    ranks = run.select("side", "task", "v", dev.cast("double").alias("d"), F.col("k").alias("_k"))
    found = lookup_join(long, ranks, ["side", "task", "v"], "inner", hot_rows=hot_rows, weight="_k")
    rows = found.groupBy("side", "_row").agg(*[F.max(F.when(F.col("task") == i, F.col("d"))).alias(f"r{i}") for i in tasks.values()])
    product = {(a, b): (F.col(at[a, b]), F.col(at[b, a])) for a, b in pairs}
    sums = rows.groupBy("side").agg(
        *[F.sum(f * g).alias(f"xy{i}") for i, (f, g) in enumerate(product.values())], *[F.count(f * g).alias(f"n{i}") for i, (f, g) in enumerate(product.values())],
        *[F.sum(F.col(f"r{t}") * F.col(f"r{t}")).alias(f"s{t}") for t in tasks.values()])
    rho = lambda i, a, b: F.when(F.col(f"n{i}") >= 2, F.try_divide(F.col(f"xy{i}"), F.sqrt(F.col(at[a, b].replace("r", "s"))) * F.sqrt(F.col(at[b, a].replace("r", "s")))))
    out = F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), rho(i, a, b).alias("value"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]))
    # a pair without shared rows has no row
    return sums.select("side", out).where(F.col("n") > 0)


def _null_patterns(wide: DataFrame, cols: Sequence[str], x: dict[str, str]) -> dict[str, str | None]:
    """Per column None if it has no nulls, else the first column with nulls in the same rows; one aggregation without a shuffle of rows."""
    empty = {c: F.col(x[c]).isNull() for c in cols}
    counts = wide.agg(
        *[F.count_if(empty[c]).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.count_if(empty[a] != empty[b]).alias(f"d{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]).first()
    out: dict[str, str | None] = {}
    for j, c in enumerate(cols):
        same = [a for i, a in enumerate(cols[:j]) if out[a] is not None and counts[f"d{i}_{j}"] == 0]
        out[c] = None if not counts[f"n{j}"] else (out[same[0]] if same else c)
    return out


def spearman(
    df: DataFrame, roles: Roles, columns: Sequence[str] | None = None, kinds: Sequence[str] = (NUMERICAL,), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Signed rank correlation with average ranks under pairwise deletion."""
    return rank_matrix({"": df}, roles, columns, kinds, hot_rows).drop("side")


def association(df: DataFrame, roles: Roles, columns: Sequence[str] | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """Association of every unordered pair: rank correlation, Cramer's V or correlation ratio.

    Pairs with a datetime column have no value and n = 0; fewer than two shared rows, no value. `ranks` are rank correlations that are
    known already.
    """
    spark = df.sparkSession
    cols = [c for c in roles.features if columns is None or c in columns]
    pairs = list(combinations(cols, 2))
    frame = spark.createDataFrame(pairs, "column_1 string, column_2 string")
    parts = [
        (spearman(df, roles, cols) if ranks is None else ranks).withColumn("value", F.abs("value")),
        cramers_v(df, roles, cols),
        _declared_order(correlation_ratio(df, roles, cols), pairs),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    dated = set(roles.of(DATETIME))
    undated = [p for p in pairs if not dated & set(p)]
    out = frame.join(found, PAIR, "left")  # one row per pair
    return out.select(*PAIR, "value", F.coalesce("n", F.lit(0)).alias("n")) if undated or pairs else _none(df)


def _declared_order(found: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Swap (category, number) pairs that are declared the other way round."""
    known = F.concat_ws("\u0001", "column_1", "column_2").isin(*["\u0001".join(p) for p in pairs])
    return found.select(
        F.when(known, F.col("column_1")).otherwise(F.col("column_2")).alias("column_1"),
        F.when(known, F.col("column_2")).otherwise(F.col("column_1")).alias("column_2"), "value", "n",
    )


def mirrored(pairs: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both directions of every pair plus the diagonal (value 1, n = rows)."""
    swapped = pairs.select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), "value", "n")
    diag = df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_1"), "n")
    diag = diag.select("column_1", F.col("column_1").alias("column_2"), F.lit(1.0).alias("value"), "n")
    return pairs.unionByName(swapped).unionByName(diag)


def association_matrix(df: DataFrame, roles: Roles) -> DataFrame:
    return mirrored(association(df, roles), df, roles.features)


def _both_ranks(real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    return rank_matrix({"r": real, "s": syn}, roles, columns, NUMERIC_LIKE)


def correlation_similarity(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None, ranks: DataFrame | None = None
) -> DataFrame:
    """1 - half the gap between the two signed rank correlations."""
    both = _both_ranks(real, syn, roles, columns) if ranks is None else ranks
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    # one row per pair that both tables have
    j = both.groupBy(*PAIR).agg(side("r").alias("real_value"), side("s").alias("synthetic_value"), F.count(F.lit(1)).alias("_n")).where("_n = 2")
    return j.select(*PAIR, "real_value", "synthetic_value", (1 - F.abs(F.col("real_value") - F.col("synthetic_value")) / 2).alias("score"))


def contingency_similarity(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None, bins: int = 10
) -> DataFrame:
    """1 - half the summed difference of joint shares, for pairs with a category-like column.

    A numeric-like partner is cut into `bins` bins of the real range, with one bucket below and
    one above; null is a category.
    """
    cols = [c for c in roles.features if columns is None or c in columns]
    nums = roles.of(*NUMERIC_LIKE, within=cols)
    pairs = [(a, b) for a, b in combinations(cols, 2) if not (a in nums and b in nums)]
    if not pairs:
        return real.sparkSession.createDataFrame([], "column_1 string, column_2 string, score double")
    if nums:
        limits = number_bounds(real, nums, roles)
        packed = limits.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("lo", "hi")))).alias("_lim"))

    def cells(df: DataFrame) -> DataFrame:
        source = df.crossJoin(F.broadcast(packed)) if nums else df  # exactly one row

        def label(n: str) -> Column:
            if n not in nums:
                return as_text(n)
            lim = F.element_at("_lim", F.lit(n))
            return equal_width(as_number(df, n, roles), lim["lo"], lim["hi"], bins).cast("string")

        return _exploded(source, pairs, label, label, drop_nulls=False)

    freq = _named(two_sided(cells(real), cells(syn), ["pair", "v1", "v2"]), pairs)
    # one row per pair
    totals = freq.groupBy(*PAIR).agg(F.sum("r").alias("r_all"), F.sum("s").alias("s_all"))
    gap = F.abs(F.try_divide("r", "r_all") - F.try_divide("s", "s_all"))
    return freq.join(F.broadcast(totals), PAIR).groupBy(*PAIR).agg((1 - F.sum(gap) / 2).alias("score"))


def pair_trends(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None, ranks: DataFrame | None = None
) -> DataFrame:
    """(column_1, column_2, metric, score) for every pair."""
    corr = correlation_similarity(real, syn, roles, columns, ranks).select(*PAIR, F.lit("correlation_similarity").alias("metric"), "score")
    cont = contingency_similarity(real, syn, roles, columns).select(*PAIR, F.lit("contingency_similarity").alias("metric"), "score")
    return corr.unionByName(cont)


def quality_score(shapes: DataFrame, trends: DataFrame) -> DataFrame:
    """(property, score): column shapes, pair trends and their mean."""
    a = shapes.agg(F.avg("score").alias("score")).select(F.lit("column_shapes").alias("property"), "score")
    b = trends.agg(F.avg("score").alias("score")).select(F.lit("column_pair_trends").alias("property"), "score")
    both = checkpointed(a.unionByName(b))  # two rows
    return both.unionByName(both.agg(F.lit("overall").alias("property"), F.avg("score").alias("score")))


def quality(real: DataFrame, syn: DataFrame, roles: Roles) -> DataFrame:
    return quality_score(column_shapes(real, syn, roles), pair_trends(real, syn, roles))


def pair_diagnostics(real: DataFrame, syn: DataFrame, roles: Roles) -> DataFrame:
    """Pairs for which both associations and the trend score exist."""
    ranks = checkpointed(_both_ranks(real, syn, roles))  # one row per table and pair
    plain = set(roles.of(NUMERICAL))
    own = lambda side: ranks.where((F.col("side") == side) & F.col("column_1").isin(plain) & F.col("column_2").isin(plain)).drop("side")
    r = association(real, roles, ranks=own("r")).select(*PAIR, F.col("value").alias("real_value"), F.col("n").alias("real_n"))
    s = association(syn, roles, ranks=own("s")).select(*PAIR, F.col("value").alias("synthetic_value"))
    q = pair_trends(real, syn, roles, ranks=ranks).select(*PAIR, "score")
    out = r.join(s, PAIR).join(q, PAIR)  # one row per pair in each
    return out.where(F.col("real_value").isNotNull() & F.col("synthetic_value").isNotNull() & F.col("score").isNotNull())


def pair_score_matrix(real: DataFrame, syn: DataFrame, roles: Roles) -> DataFrame:
    """Trend score of every pair in both directions, and 1 for a column with itself."""
    found = pair_trends(real, syn, roles).select(*PAIR, "score")
    own = real.sparkSession.createDataFrame([(c, c, 1.0) for c in roles.features], "column_1 string, column_2 string, score double")
    swapped = found.select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), "score")
    return found.unionByName(swapped).unionByName(own)


def worst_pairs(diagnostics: DataFrame, k: int = 5) -> DataFrame:
    """The k diagnosed pairs with the lowest score; scores that agree to nine digits are tied and go by name."""
    return diagnostics.where(F.col("score").isNotNull()).orderBy(F.round("score", 9), *PAIR).limit(k)
