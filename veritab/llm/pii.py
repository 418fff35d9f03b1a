r"""Personal data (operator 1), in DataFrame expressions only.

Patterns propose spans, checksums confirm them (Luhn for cards, mod 97 for bank accounts), and words up to
CONTEXT characters before or after a span raise its score, whatever spans lie between. A word before the first of a list of spans (apart
by separators or "and") counts for all of them. The base kinds email, ip, card and phone are kept whatever their score; the others (iban, ssn, localphone)
need a score of THRESHOLD. Offsets are code points, end exclusive.

A text is split at the matches of a pattern: the pieces give the offsets, and the pieces around a match hold its context.
Patterns are written so that they cannot backtrack: `\G` or a look-behind lets a run of characters be tried at its
start only, which finds the same leftmost matches, and possessive groups take no stack.

Null and empty texts have no spans. Rows are judged one by one, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import fresh, named, sha

THRESHOLD = 0.6
CONTEXT = 40  # characters before and after a span that are searched for context words
LISTED = r"(?i)^(?:[\s,;/|&]|(?<![a-z])and(?![a-z]))*$"  # what parts the spans of a list
BLOCK = 64  # matches whose offsets are summed at once


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose weighted sum is a multiple of ten."""
    d = F.reverse(digits(m))
    n = F.length(d)

    def weighed(i: Column) -> Column:
        v = d.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(19)), F.lit(1))), F.lit(0), lambda s, i: s + weighed(i))
    return n.between(13, 19) & (total % 10 == 0)


def mod97(m: Column) -> Column:
    """15 to 34 letters and digits that are 1 mod 97 with the first four moved to the end and letters read as 10 to 35."""
    s = F.regexp_replace(m, " ", "")
    n = F.length(s)
    moved = F.concat(s.substr(F.lit(5), n), s.substr(F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(moved.substr(i, F.lit(1)))
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return n.between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(34)), F.lit(1))), F.lit(0), step) == 1)


def octets(m: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float  # without context
    words: str  # context words, as alternatives
    base: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9,
         "mail|contact|write|reply", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.6, "ip|address|host|server|login", True),
    Kind("card", r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+", luhn, 0.7, "card|visa|credit|debit|amex|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), 0.7, "phone|tel|call|mobile|fax|whatsapp", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.9, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.4,
         "ssn|social|security|insurance"),
    Kind("localphone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.3, "phone|tel|call|mobile|fax|whatsapp"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _cut(text: Column, kind: Kind) -> Column:
    """Struct of the pieces around the matches of a pattern, the matches, and whether a context word is near each."""
    pattern = F.lit(kind.pattern)
    gaps = F.split(text, kind.pattern, -1)
    parts = F.transform(F.array(gaps), lambda g: F.struct(
        g.alias("gaps"), F.when(F.size(g) > 1, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")).alias("hits"),
    ))
    return F.transform(parts, lambda c: c.withField("near", _contexts(c, kind)))[0]


def _word(window: Column, kind: Kind) -> Column:
    """Whether a window holds a context word; marks of redacted spans are none."""
    return F.regexp_replace(window, "<[A-Z]+>", "").rlike(rf"(?i)(?<![a-z])(?:{kind.words})")


def _contexts(cut: Column, kind: Kind) -> Column:
    """Per match, whether a context word is near: in the characters before it or before its list, or after it.

    The windows are of the text as it was, other matches included: a few pieces and matches are longer than a window together, unless
    the text begins or ends.
    """
    gaps, hits = cut["gaps"], cut["hits"]

    def before(i: Column) -> Column:
        earlier = [F.coalesce(x, F.lit("")) for k in range(5, 0, -1) for x in (F.get(gaps, i - k), F.get(hits, i - k))]
        return F.right(F.concat(*earlier, F.get(gaps, i)), F.lit(CONTEXT))

    def after(i: Column) -> Column:
        return F.left(F.concat(*[F.coalesce(x, F.lit("")) for k in range(1, 6) for x in (F.get(gaps, i + k), F.get(hits, i + k))]), F.lit(CONTEXT))

    def step(marks: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        return F.concat(marks, F.when(_word(before(i), kind), "1").when(gap.rlike(LISTED), F.right(marks, F.lit(1))).otherwise("0"))

    at = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
    marks = F.split(F.aggregate(at, F.lit("0"), step), "")
    return F.transform(F.array(marks), lambda m: F.transform(at, lambda i: (F.get(m, i + 1) == "1") | _word(after(i), kind)))[0]


def _spans(cut: Column, kind: Kind) -> Column:
    """All spans of a kind with their scores; checks have been made, the threshold has been applied."""
    gaps, hits = cut["gaps"], cut["hits"]
    n = F.size(hits)
    at = F.sequence(F.lit(0), n - 1)

    def placed(lens: Column) -> Column:
        # start of a match: lengths of all before it, in blocks, so that many matches do not cost their square
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda s, x: s + x))
        firsts = F.aggregate(
            sums, F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("all")),
            lambda s, x: F.struct((s["run"] + x).alias("run"), F.concat(s["all"], F.array(s["run"])).alias("all")),
        )["all"]
        return F.transform(F.array(firsts), lambda f: F.transform(at, lambda i: _span(lens, f, i)))[0]

    def _span(lens: Column, firsts: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get(firsts, block) + F.aggregate(F.slice(lens, block * BLOCK + 1, i % BLOCK), F.lit(0), lambda s, x: s + x) + F.length(F.get(gaps, i))
        m = F.get(hits, i)
        near = F.get(cut["near"], i)
        score = F.lit(kind.score) + F.when(near, F.lit((1 - kind.score) * 0.6)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"), kind.valid(m).alias("ok"))

    lens = F.transform(at, lambda i: F.length(F.get(gaps, i)) + F.length(F.get(hits, i)))
    found = F.transform(F.array(lens), placed)[0]
    kept = F.filter(found, lambda s: s["ok"] if kind.base else s["ok"] & (s["score"] >= THRESHOLD))
    bare = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return F.when(n > 0, bare).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def with_spans(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs plus an array column `name` of (kind, start, end, score), by kind as listed, then start."""
    value = F.coalesce(named(docs, text).cast("string"), F.lit(""))
    cuts = fresh(docs, "cuts")
    cut = docs.withColumn(cuts, F.struct(*[_cut(value, k).alias(k.name) for k in KINDS]))
    return cut.withColumn(name, F.concat(*[_spans(F.col(cuts)[k.name], k) for k in KINDS])).drop(cuts)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, best_score: one row per row of docs."""
    r = with_spans(docs.select("doc_id", "text"), "text", "spans").drop("text")
    count = [_count(k).alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return r.select(
        "doc_id", *count, sha(spelled(base)).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("best_score"),
    )


def _marked(cut: Column, kind: Kind) -> Column:
    hits, gaps = cut["hits"], cut["gaps"]

    def mark(m: Column, i: Column) -> Column:
        ok = kind.valid(m)
        if not kind.base and kind.score < THRESHOLD:
            ok = ok & F.get(cut["near"], i)
        return F.concat(F.get(gaps, i), F.when(ok, F.lit(f"<{kind.name.upper()}>")).otherwise(m))

    return F.concat(F.array_join(F.transform(hits, mark), ""), F.element_at(gaps, -1))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in `text` replaced by <KIND>, and n_chars (if there) counted anew.

    Kinds follow each other, phones before cards as those may lie inside; what a replaced span leaves of a span that only
    partly overlaps it is matched anew. Null texts stay null.
    """
    columns = docs.columns
    first = ("email", "iban", "phone", "card", "ip")
    order = sorted(KINDS, key=lambda k: first.index(k.name) if k.name in first else len(first))
    value, cut, spans = fresh(docs, "value"), fresh(docs, "cut"), fresh(docs, "spans")
    out = docs.withColumn(value, named(docs, "text"))
    for kind in order:
        v = F.col(value)
        out = out.withColumn(cut, _cut(v, kind))
        out = out.withColumn(value, F.when(F.size(F.col(cut)["hits"]) > 0, _marked(F.col(cut), kind)).otherwise(v)).drop(cut)
    changed = {"text": F.col(value), "n_chars": F.length(value).cast("bigint")}
    return out.select(*[(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`")) for c in columns])
