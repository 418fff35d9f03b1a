"""Scalar column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as a missing category, and the accepted boolean spellings.
NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "None", "null", "NULL", "<NA>", "n/a")
TRUE_TOKENS = ("True", "true", "TRUE", "1")
FALSE_TOKENS = ("False", "false", "FALSE", "0")

MISSING = "Missing"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(row_id: Column | str, *salt: object) -> Column:
    """Reproducible uniform draw in [0, 1) from a row id and a salt.

    A digest rather than rand(): a retried or repartitioned task draws the same number.
    """
    text = F.concat_ws(":", as_col(row_id).cast("string"), *[F.lit(str(s)) for s in salt])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def digest(row_id: Column | str, *salt: object) -> Column:
    """Hex digest that orders rows at random, the same way on every run."""
    return F.md5(F.concat_ws(":", as_col(row_id).cast("string"), *[F.lit(str(s)) for s in salt]))


def to_boolean(c: Column | str) -> Column:
    """Accepted spellings of true and false; anything else is null."""
    text = as_col(c).cast("string")
    return F.when(text.isin(*TRUE_TOKENS), F.lit(True)).when(text.isin(*FALSE_TOKENS), F.lit(False))


def to_category(c: Column | str) -> Column:
    """Category as text, with the missing-value tokens folded to null."""
    text = as_col(c).cast("string")
    return F.when(text.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(text)


def to_binary(c: Column | str, dtype: str) -> Column:
    """0/1 label from a boolean, true/false text or number; other text raises."""
    c = as_col(c)
    if dtype == "boolean":
        return c.cast("int")
    if dtype == "string":
        low = F.lower(F.trim(c))
        return F.when(low == "true", F.lit(1)).when(low == "false", F.lit(0)).otherwise(c.cast("double").cast("int"))
    return c.cast("int")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, independent of the session zone."""
    span = as_col(c).cast("timestamp_ntz") - F.expr(EPOCH)
    return (span.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")


def canonical_text(c: Column | str, dtype: str) -> Column:
    """One spelling per value, and one value per spelling: null -> Missing, True/False, whole doubles without a fraction."""
    c = as_col(c)
    if dtype == "boolean":
        text = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif dtype in ("double", "float"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(9.0e15))
        exact = d.cast("string").try_cast("decimal(38,18)")
        plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), "0+$", ""), "\\.$", "")
        # the plain spelling where it reads back as the same number, else the shortest one with an exponent
        text = F.when(whole, d.try_cast("bigint").cast("string")).when(plain.try_cast("double") == d, plain).otherwise(d.cast("string"))
        return F.when(c.isNull() | F.isnan(d), F.lit(MISSING)).otherwise(text)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit(MISSING)).otherwise(text)


def bin_label(c: Column | str, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 1..bins as text, clamped; null -> Missing; a constant column is one bin."""
    v = as_col(c).cast("double")
    pos = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(float(bins))) + 1
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(MISSING))
        .when(lo == hi, F.lit("1"))
        .otherwise(F.greatest(F.lit(1), F.least(pos, F.lit(bins))).cast("string"))
    )


def equal_width(v: Column, lo: Column, hi: Column, bins: Column | int) -> Column:
    """Bucket 1..bins of a value inside [lo, hi]; 0 below, bins + 1 above; null stays null."""
    b = bins if isinstance(bins, Column) else F.lit(bins)
    inside = F.least(
        F.coalesce(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * b.cast("double")), F.lit(0)) + 1, b.cast("bigint")
    )
    return F.when(v < lo, F.lit(0)).when(v > hi, b + 1).when(v.isNotNull(), inside).cast("int")


def js_part(p: Column, q: Column) -> Column:
    """One bucket's share of the Jensen-Shannon divergence (natural log)."""
    m = (p + q) / 2
    left = F.when(p > 0, p * F.log(p / m)).otherwise(0.0)
    right = F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    return (left + right) / 2


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
