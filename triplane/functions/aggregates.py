"""Aggregates of the query language as Spark aggregates.

None but ``distinct`` and those that users add holds a group's values: the least, greatest or sampled ``n`` are ranked by a
window whose limit is applied before rows are shuffled, and random draws keep the value of the greatest random number.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of one variable.
SIMPLE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "median": F.median, "variance": F.var_pop, "stddev": F.stddev_pop, "count": F.count, "count-distinct": F.countDistinct,
    "distinct": lambda c: F.sort_array(F.collect_set(c)), "min": F.min, "max": F.max,
}

#: Of a number and a variable. The values stand in rising order; rand picks with and sample without replacement.
COUNTED = {"min", "max", "sample", "rand"}

#: Aggregates that users add: name to a function of the collected values' column.
CUSTOM: dict[str, Callable[[Column], Column]] = {}


def _number(env: Any, a: Any) -> int | None:
    """The number that an element such as ``(max 3 ?x)`` begins with."""
    if len(a.args) < 2 or a.name == "aggregate":
        return None
    if a.name not in COUNTED:
        raise ValueError(f"{a.name} takes one argument")
    return int(env.constants.get(str(a.args[0]), a.args[0]))


def is_ranked(a: Any) -> bool:
    """Whether an element takes the first rows of a group in some order."""
    return len(a.args) == 2 and a.name in ("min", "max", "sample")


def drawn(env: Any, df: DataFrame, found: dict[Any, str]) -> DataFrame:
    """``df`` with a random number for each draw of the ``rand`` elements."""
    return df.withColumns({f"_d{n}_{i}": F.rand() for a, n in found.items() if a.name == "rand" for i in range(_number(env, a) or 1)})


def first_n(env: Any, df: DataFrame, a: Any, keys: list[str], name: str) -> DataFrame:
    """Rows of the groups' keys and ``name``: the n least, greatest or sampled values of each."""
    n, value = _number(env, a), F.col(f"`{a.args[-1]}`")
    rows = df.select(*(F.col(f"`{k}`") for k in keys), value.alias("_v")).where("_v is not null")
    order = F.rand() if a.name == "sample" else F.col("_v").desc() if a.name == "max" else F.col("_v")
    by = [F.col(f"`{k}`") for k in keys] or [F.lit(0)]
    ranked = rows.withColumn("_o", F.rand()).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o"))) if a.name == "sample" else rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    listed = F.collect_list("_v")
    return ranked.where(F.col("_n") <= n).groupBy(*(F.col(f"`{k}`") for k in keys)).agg((listed if a.name == "sample" else F.sort_array(listed)).alias(name))


def aggregate(env: Any, df: DataFrame, a: Any, name: str) -> Column:
    """The Spark aggregate for an element such as ``(sum ?x)`` or ``(aggregate ?f ?x)``."""
    *first, last = a.args
    value = F.col(f"`{last}`")
    if a.name == "aggregate":
        f = env.constants[str(first[0])]
        return f(value) if not isinstance(f, str) else CUSTOM[f](value)
    n = _number(env, a)
    if a.name == "rand":
        draws = [F.max_by(value, F.col(f"_d{name}_{i}")) for i in range(n or 1)]
        return F.array(*draws) if n is not None else draws[0]
    if a.name in SIMPLE:
        return SIMPLE[a.name](value)
    if a.name in CUSTOM:
        return CUSTOM[a.name](value)
    raise ValueError(f"unknown aggregate {a.name}")
