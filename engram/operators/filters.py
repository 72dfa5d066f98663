"""Metadata filters with the semantics of optional fields, and a parser of filter strings."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _falsy(c: Column, value: Any) -> Column:
    zero = F.lit("") if isinstance(value, str) else F.lit(0)
    return c.isNull() | (c == zero)


def _in(c: Column, v: list) -> Column:
    return F.coalesce(c.isin(v) & ~_falsy(c, v[0] if v else 0), F.lit(False))


#: A missing value equals null only, differs from every value, and passes no comparison.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: F.coalesce(c > v, F.lit(False)),
    "ge": lambda c, v: F.coalesce(c >= v, F.lit(False)),
    "lt": lambda c, v: F.coalesce(c < v, F.lit(False)),
    "le": lambda c, v: F.coalesce(c <= v, F.lit(False)),
    "in": _in,
    "not_in": lambda c, v: ~_in(c, v),
    "contains": lambda c, v: F.coalesce(c.contains(v), F.lit(False)),
    "between": lambda c, v: F.coalesce(c.between(v[0], v[1]), F.lit(False)) if len(v) == 2 else F.lit(False),
}


def condition(name: str, operator: str, value: Any) -> Column:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    return OPERATORS[operator](F.col(name), value)


@dataclass
class Filters:
    """A conjunction, built step by step."""

    conditions: list[Column] = field(default_factory=list)

    def add(self, name: str, operator: str, value: Any) -> Filters:
        self.conditions.append(condition(name, operator, value))
        return self

    def topic_eq(self, topic: str) -> Filters:
        return self.add("topic", "eq", topic)

    def quality_ge(self, least: float) -> Filters:
        return self.add("quality", "ge", least)

    def created_after(self, start: Any) -> Filters:
        return self.add("ts", "gt", start)

    def created_before(self, end: Any) -> Filters:
        return self.add("ts", "lt", end)

    def topic_in(self, topics: list[str]) -> Filters:
        return self.add("topic", "in", topics)

    def confidence_ge(self, least: float) -> Filters:
        return self.add("confidence", "ge", least)

    def staleness_le(self, most: float) -> Filters:
        return self.add("staleness", "le", most)

    def verified_only(self) -> Filters:
        return self.add("verified", "eq", True)

    def created_between(self, start: Any, end: Any) -> Filters:
        return self.add("ts", "between", [start, end])

    def has_ttl(self) -> Filters:
        self.conditions.append(F.col("ttl_ts").isNotNull())
        return self

    def expired(self, as_of: Column) -> Filters:
        self.conditions.append(F.coalesce(F.col("ttl_ts") < as_of, F.lit(False)))
        return self

    def tags_any(self, tags: list[str]) -> Filters:
        self.conditions.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, self.conditions)) if self.conditions else df


_PART = re.compile(r"^\s*(\w+)\s*(>=|<=|!=|=|>|<|\s+not\s+in\s+|\s+in\s+|\s+contains\s+)\s*(.*?)\s*$", re.I)
_NAMES = {">=": "ge", "<=": "le", "!=": "ne", "=": "eq", ">": "gt", "<": "lt", "not in": "not_in", "in": "in", "contains": "contains"}


def _value(text: str) -> Any:
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?\d*\.\d+([eE][+-]?\d+)?", text):
        return float(text)
    return {"true": True, "false": False, "null": None, "none": None}.get(text.lower(), text.strip("'\""))


def parse(text: str) -> Filters:
    """``topic=python, confidence>0.5, label in (a;b)``: parts are joined by and."""
    filters = Filters()
    for part in filter(str.strip, text.split(",")):
        m = _PART.match(part)
        if not m:
            raise ValueError(f"can't read the filter {part!r}")
        operator = _NAMES[" ".join(m[2].lower().split())]
        value = [_value(x.strip()) for x in m[3].strip("()").split(";")] if operator in ("in", "not_in") else _value(m[3])
        filters.add(m[1], operator, value)
    return filters
