"""Grouped aggregates, taken directly or through a dimension key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """One aggregate: its output name, how it combines, the SQL value of a row, and which rows it takes."""

    name: str
    agg: str    # sum | avg | count | count_distinct
    value: str
    where: str | None = None
    otherwise: str = ""  # what a row that is not taken adds, nothing by default

    def taken(self) -> str:
        if self.where is None:
            return self.value
        return f"CASE WHEN {self.where} THEN {self.value} {f'ELSE {self.otherwise} ' if self.otherwise else ''}END"

    def sql(self) -> str:
        if self.agg == "avg":
            return f"avg(CAST({self.taken()} AS double))"
        if self.agg == "count_distinct":
            return f"count(DISTINCT {self.taken()})"
        return f"{self.agg}({self.taken()})"


def _named(expressions: Mapping[str, str]) -> list:
    return [F.expr(f"{sql} AS `{name}`") for name, sql in expressions.items()]


def aggregate(frame: DataFrame, by: Mapping[str, str], specs: Sequence[Spec], unique: Sequence[str] = ()) -> DataFrame:
    """Aggregates of one frame. ``unique`` are the columns that tell its rows apart.

    A distinct count of the column that tells rows apart is a plain count. Otherwise rows are first grouped by the counted column too,
    with a flag for each condition, so that several distinct counts never multiply the rows.
    """
    specs = [replace(s, agg="count") if s.agg == "count_distinct" and tuple(unique) == (s.value,) else s for s in specs]
    counted = {s.value for s in specs if s.agg == "count_distinct"}
    if len(counted) != 1:
        return frame.groupBy(*_named(by)).agg(*_named({s.name: s.sql() for s in specs}))
    first, then = {}, {}
    for i, s in enumerate(specs):
        if s.agg == "count_distinct":
            first[f"_f{i}"] = f"bool_or({s.where or 'true'})"
            then[s.name] = f"count_if(_f{i} AND _counted IS NOT NULL)"
        elif s.agg == "avg":
            first[f"_s{i}"] = f"sum(CAST({s.taken()} AS double))"
            first[f"_n{i}"] = f"count({s.taken()})"
            then[s.name] = f"try_divide(sum(_s{i}), sum(_n{i}))"
        else:
            first[f"_s{i}"] = s.sql()
            then[s.name] = f"coalesce(sum(_s{i}), 0L)" if s.agg == "count" else f"sum(_s{i})"
    keys = {f"_k{i}": sql for i, sql in enumerate(by.values())}
    reduced = frame.groupBy(*_named({**keys, "_counted": counted.pop()})).agg(*_named(first))
    return reduced.groupBy(*_named(dict(zip(by, keys)))).agg(*_named(then))


def stack_groups(frames: Sequence[DataFrame], by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Combine per-model results on their shared groups.

    Each frame has one row per group, so a union and one more group-by does the work of a chain of
    null-safe full outer joins in a single small shuffle.
    """
    if len(frames) == 1:
        return frames[0]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.groupBy(*by).agg(*_named({v: f"max(`{v}`)" for v in values}))
