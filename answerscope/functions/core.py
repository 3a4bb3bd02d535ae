"""Small expression helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope import fixed

# Whitespace and word characters as the metrics define them (Unicode spaces count, words are ASCII).
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NON_WS = "[^" + WS[1:]
WS_CHARS = "\t\n\x0b\x0c\r " + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Expressions inside lambdas are not shared by common-subexpression elimination, so a
    costly intermediate is bound to a lambda variable instead of being repeated.
    """
    return F.transform(F.array(value), body)[0]


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states of a fold after each item; ``kind`` is the state's type.

    States are gathered in short lists that are joined at the end, so that appending does not
    copy everything gathered so far.
    """
    def merge(acc: Column, x: Column) -> Column:
        full = F.size(acc["cur"]) >= 256
        return bind(step(acc["s"], x), lambda s: F.struct(
            s.alias("s"), F.when(full, F.array(s)).otherwise(F.concat(acc["cur"], F.array(s))).alias("cur"),
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done")))

    zero = F.struct(start.cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("cur"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(items, zero, merge, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))


def char_class(code_points: list[int]) -> str:
    """Regex class of the given code points, neighbours merged into ranges."""
    runs: list[list[int]] = []
    for cp in sorted(code_points):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def literals(terms: list[str]) -> Column:
    """Literal array of strings, built in one expression."""
    return F.expr("array(" + ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms) + ")")


def any_contains(text: Column, terms: list[str]) -> Column:
    return F.exists(literals(terms), lambda t: F.contains(text, t))


def count_contains(text: Column, terms: list[str]) -> Column:
    return F.size(F.filter(literals(terms), lambda t: F.contains(text, t)))


def rx_quote(literal: Column) -> Column:
    """Regular expression that matches ``literal`` (B2)."""
    safe = F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), safe, F.lit("\\E"))


def rx_escape(literal: ColumnOrName) -> Column:
    """Backslash-escape every metacharacter, portable across regex engines (B2)."""
    return F.regexp_replace(as_col(literal), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def trim_ws(s: ColumnOrName) -> Column:
    return F.btrim(as_col(s), F.lit(WS_CHARS))


def squash_ws(s: ColumnOrName) -> Column:
    return F.regexp_replace(as_col(s), f"{WS}+", " ")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_half_up(x: Column, places: int = 3) -> Column:
    """Round half toward +infinity (B16); Spark's ``round`` goes half away from zero."""
    k = float(10**places)
    return F.floor(x.cast("double") * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def ratio(num: Column, den: Column) -> Column:
    """num/den as DOUBLE, 0 when there is nothing to divide by."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def grade_for(score: ColumnOrName) -> Column:
    """Letter grade of a 0..1 score, 'N/A' when unmeasured."""
    s = as_col(score)
    out = F.when(s.isNull(), "N/A")
    for letter, floor in fixed.GRADES:
        out = out.when(s >= floor, letter)
    return out.otherwise("F")


def status_for(score: ColumnOrName) -> Column:
    s = as_col(score)
    return F.when(s >= fixed.PASS_AT, "pass").when(s >= fixed.WARN_AT, "warn").otherwise("fail")


def band_for(score: ColumnOrName) -> Column:
    """Report colour band of a score."""
    s = as_col(score)
    return (
        F.when(s.isNull(), "none").when(s >= 0.7, "good")
        .when(s >= 0.45, "warning").otherwise("critical")
    )


def lookup(key: Column, table: dict[str, object], default: object) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def hash_id(s: ColumnOrName, n: int = 10) -> Column:
    """First n hex digits of SHA-256."""
    return F.substring(F.sha2(as_col(s), 256), 1, n)


def slug(s: ColumnOrName, cap: int | None = 60, default: str | None = "brand") -> Column:
    """Lowercase key of letters, digits and dashes."""
    out = F.regexp_replace(F.lower(as_col(s)), "[^a-z0-9]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    if cap:
        out = F.substring(out, 1, cap)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default)) if default else out
