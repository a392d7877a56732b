"""Column helpers for operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes name their characters one by one: Java looks those up in one bit set, while it tries ranges one after another.
#: What separates words in the contracts: space and the five ASCII controls from tab to carriage return.
SPACES = r"\x20\x09\x0A\x0B\x0C\x0D"
SPACE = f"[{SPACES}]"
#: Elements that one step of ``prefixes`` folds at once.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often ``body`` names it.

    A projected column does not give that: the optimizer may write its
    expression into every place that reads it, also into lambdas.
    """
    return F.transform(F.array(value), body).getItem(0)


def with_one(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds (or replaces) a column that is worked out once per row.

    The one-element explode is a step of its own: filters and projections above
    read its output, where after a plain projection they would repeat ``value``.
    """
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def whole_text(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def no_items(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def indexes(items: Column) -> Column:
    """0, 1, ... for the places of an array; empty for an empty one."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(no_items("int"))


def prefixes(values: Column, fold: Callable[[Column, Column], Column], zero: int) -> Column:
    """What ``fold`` makes of all values before each place, as an array of bigint.

    ``fold`` is associative. Folding goes by chunks, then over the chunks, so
    that a text with n hits costs about n * CHUNK copied numbers, not n squared.
    """

    def scan(items: Column, start: Column) -> Column:
        return F.aggregate(items, F.array(start), lambda done, x: F.concat(done, F.array(fold(F.element_at(done, -1), x))))

    def whole(items: Column) -> Column:
        return F.aggregate(items, F.lit(zero).cast("bigint"), fold)

    def by_chunk(chunks: Column) -> Column:
        return let(
            scan(F.transform(chunks, whole), F.lit(zero).cast("bigint")),
            lambda starts: F.flatten(
                F.transform(chunks, lambda chunk, k: F.slice(scan(chunk, F.get(starts, k)), 1, F.size(chunk)))
            ),
        )

    def of(items: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
        return let(F.transform(places, lambda c: F.slice(items, c * CHUNK + 1, CHUNK)), by_chunk)

    return F.when(F.size(values) > 0, let(values.cast("array<bigint>"), of)).otherwise(no_items("bigint"))


def find_all(text: Column, pattern: Column | str, length: Callable[[Column], Column]) -> Column:
    """All leftmost non-overlapping matches of ``pattern``, as array of (start, match).

    ``start`` is ``length`` of everything before the match: the text is cut at
    the matches, and lengths of cuts and matches are summed from the left.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(cuts: Column) -> Column:
        return let(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda found: let(
                prefixes(
                    F.transform(indexes(found), lambda k: length(F.get(cuts, k)) + length(F.get(found, k))),
                    lambda a, b: a + b,
                    0,
                ),
                lambda before: F.transform(
                    indexes(found),
                    lambda k: F.struct(
                        (F.get(before, k) + length(F.get(cuts, k))).alias("start"), F.get(found, k).alias("match")
                    ),
                ),
            ),
        )

    return let(F.split(text, pattern, -1), placed)
