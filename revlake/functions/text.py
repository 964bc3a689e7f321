"""Small string and array helpers over built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Everything that counts as white space when source text is stripped.
WHITE_SPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def reused[T](build: Callable[..., T]) -> Callable[..., T]:
    """Build an expression, or several, once per JVM and set of (hashable) arguments.

    Large expressions take thousands of calls to the JVM to put together. They
    name their input columns, so the same one serves every plan.
    """
    built: dict[tuple, T] = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A fold over nothing goes from its start to its end at once. Unlike the
    elements of a transformed array neither is copied, however large it is.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    A filter on a computed column is otherwise pushed below it with a copy of
    the expression, and costly text work would run twice.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    """The text, evaluated once, or null when it is empty."""
    return let(text, lambda t: F.when(t != "", t))


def occurrences(text: Column, piece: str) -> Column:
    """How often a piece that cannot overlap itself occurs in a text."""
    without = F.replace(text, F.lit(piece), F.lit(""))
    size = len(piece.encode("utf-8"))
    lost = F.octet_length(text) - F.octet_length(without)
    return lost if size == 1 else (lost / F.lit(size)).cast("int")


def newlines(text: Column) -> Column:
    return occurrences(text, "\n")


def rest_from(text: Column, start: Column) -> Column:
    """Text from a 1-based position to its end."""
    return F.substring(text, start, F.lit(2**31 - 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def half_up(value: Column, decimals: int = 0) -> Column:
    scale = 10**decimals
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5))
    return rounded if decimals == 0 else rounded / F.lit(scale)
