"""Small expression helpers shared by all operators."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_TYPE = "array<struct<rule:string,score:int,detail:string>>"


def pin(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Append columns behind a one-row Generate node.

    Filters and projections are otherwise substituted into the expressions they
    use, so a costly column that many later rules read would be copied into each
    of them and evaluated again and again. Rules do not look through a Generate;
    the column is computed once per row and the stage stays narrow and compiled.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def lit_array(words: Iterable) -> Column:
    return F.array(*[F.lit(w) for w in words])


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when any word is a substring (short-circuiting byte search, no regex)."""
    return any_of(col.contains(w) for w in words)


def count_hits(col: Column, words: Iterable[str]) -> Column:
    """How many distinct words occur in ``col``."""
    return reduce(lambda a, b: a + b, (col.contains(w).cast("int") for w in words))


def found_words(col: Column, words: Iterable[str]) -> Column:
    """The words that occur in ``col``, in list order."""
    return F.array_compact(F.array(*[F.when(col.contains(w), F.lit(w)) for w in words]))


def count_char(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(col, F.lit(" \t\n\r\f\x0b"))


def hit(cond: Column, rule: str, score: int | Column, detail: str | Column) -> Column:
    """One rule hit, null when the condition does not hold."""
    return F.when(
        cond,
        F.struct(
            F.lit(rule).alias("rule"),
            (score if isinstance(score, Column) else F.lit(score)).cast("int").alias("score"),
            (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"),
        ),
    )


def hits(*items: Column) -> Column:
    """Array of the hits that fired, in the given order."""
    return F.array_compact(F.array(*items))


def hit_rules(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda h: h["rule"])


def hit_total(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.aggregate(c, F.lit(0), lambda acc, h: acc + h["score"])


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def safe_div(num: Column, den: Column) -> Column:
    """Quotient as double, 0 on a zero or null denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def finite(col: Column, default: float = 0.0) -> Column:
    """Double value with null, NaN and infinities replaced."""
    d = col.cast("double")
    bad = d.isNull() | F.isnan(d) | (d == float("inf")) | (d == float("-inf"))
    return F.when(bad, F.lit(default)).otherwise(d)


def md5_bits(salt: str, *cols: Column | str) -> Column:
    """32 pseudo-random bits that depend only on the salt and the row's key."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    key = F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def md5_unit(salt: str, *cols: Column | str) -> Column:
    """Uniform in [0, 1), the same on every run and every cluster size."""
    return md5_bits(salt, *cols).cast("double") / F.lit(4294967296.0)
