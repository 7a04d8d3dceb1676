"""Predicates that queries put together at run time, and reusable views of what may be seen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*tests: Column | None) -> Column:
    """The conjunction of the tests that are given; true without any."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def given(value, test) -> Column | None:
    """A test that counts only where there is a value to test for; None and empty texts are none."""
    return None if value is None or value == "" else test(value)


def active(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.filter(F.col(status) == "active")


def public(rows: DataFrame, visibility: str = "visibility") -> DataFrame:
    return rows.filter(F.col(visibility) == "public")


def current(rows: DataFrame, flag: str = "is_current") -> DataFrame:
    return rows.filter(F.col(flag))


def still_open(rows: DataFrame, until: str = "valid_until") -> DataFrame:
    return rows.filter(F.col(until).isNull())


def in_list(rows: DataFrame, column: str, values: Iterable, most: int = 1000) -> DataFrame:
    """Rows whose value is listed: a predicate that scans can use for up to ``most`` distinct values, a semi join beyond."""
    wanted = list(dict.fromkeys(v for v in values if v is not None))
    if len(wanted) <= most:
        return rows.filter(F.col(column).isin(*wanted) if wanted else F.lit(False))
    listed = rows.sparkSession.createDataFrame([(v,) for v in wanted], f"_listed {rows.schema[column].dataType.simpleString()}")
    return rows.join(listed, F.col(column) == F.col("_listed"), "left_semi")


def like_escaped(term: str) -> str:
    """A text as part of a LIKE pattern, its wildcards taken literally."""
    return "".join("\\" + c if c in "\\%_" else c for c in term)


def contains_term(c: Column, term: str) -> Column:
    """Whether a text holds a term, the case of A-Z aside."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).like(f"%{like_escaped(term.translate(str.maketrans(upper, lower)))}%")


def json_or(c: Column, schema: str, fallback: Column) -> Column:
    """A JSON text as a value of the schema; the fallback where it is null or can't be parsed. What follows a whole value is not looked at."""
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)).otherwise(fallback)


def canonical_json(c: Column) -> Column:
    """A JSON text with the keys of all its objects sorted and no spaces, so that equal values are equal texts; null where it can't be parsed.

    Binary variants keep their keys in order, so going through one is all there is to do.
    """
    return F.to_json(F.try_parse_json(c))


def search_words(c: Column, most: int = 6) -> Column:
    """The first distinct words of a search text, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")), 1, most)
