"""Label matchers as predicates.  A missing label fails ``=`` and ``=~`` and passes ``!=`` and ``!~``, whatever the value."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", "=~", "!~")


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    value: str

    def __post_init__(self):
        if self.label is None or self.op is None or self.value is None:
            raise TypeError("label, op and value are needed")
        if not self.label:
            raise ValueError("label is empty")
        if self.op not in OPERATORS:
            raise ValueError(f"op is one of {OPERATORS}")

    def column(self, labels: Column) -> Column:
        actual = F.try_element_at(labels, F.lit(self.label))
        if self.op == "=":
            return F.coalesce(actual == self.value, F.lit(False))
        if self.op == "!=":
            return F.coalesce(actual != self.value, F.lit(True))
        # rlike finds anywhere: the whole value has to match
        found = actual.rlike(rf"\A(?:{self.value})\z")
        return F.coalesce(found, F.lit(False)) if self.op == "=~" else F.coalesce(~found, F.lit(True))


def eq(label: str, value: str) -> Matcher:
    return Matcher(label, "=", value)


def neq(label: str, value: str) -> Matcher:
    return Matcher(label, "!=", value)


def regex(label: str, value: str) -> Matcher:
    return Matcher(label, "=~", value)


def not_regex(label: str, value: str) -> Matcher:
    return Matcher(label, "!~", value)


def validate(spark: SparkSession, matchers: Iterable[Matcher]) -> None:
    """Raise for a pattern that does not compile, also where no series has its label."""
    for m in matchers:
        if m.op in ("=~", "!~"):
            spark._jvm.java.util.regex.Pattern.compile(m.value)


def all_match(matchers: Iterable[Matcher], labels: Column) -> Column:
    """The conjunction; no matcher matches everything."""
    return functools.reduce(operator.and_, (m.column(labels) for m in matchers), F.lit(True))


def filter_series(df: DataFrame, matchers: Iterable[Matcher]) -> DataFrame:
    """Rows whose ``labels`` satisfy all matchers."""
    matchers = list(matchers)
    validate(df.sparkSession, matchers)
    return df.where(all_match(matchers, F.col("labels")))
