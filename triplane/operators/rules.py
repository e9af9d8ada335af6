"""Recursive rules: semi-naive evaluation, one Spark job per round.

A round's rows are stored in the shared folder, or, while they are few (SMALL), brought to the driver by the job that makes
them, so that a small recursion costs no more than its rounds and the next one broadcasts what it knows.

Rules that call each other grow together. In each round a branch is evaluated once for each of its recursive calls, with
that call reading only the rows new in the last round; rows already known are removed by an anti-join. The loop ends when a
round finds nothing new, so cycles in the data do no harm. If a call binds an argument that recursion passes on unchanged,
only rows with the bound values are ever made.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.edn import Symbol
from triplane.plans.lower import Env, Relations, c_, group_of, rename, solve
from triplane.plans.query import Not, Or, Rule, RuleCall, is_blank, is_var
from triplane.storage import durable

#: What is known is a union of the rounds' results; after so many it is stored as one.
MOST_PARTS = 12
#: Rows of a round up to which they are kept on the driver.
SMALL = 2_000


def stable(env: Env, group: set[str], name: str) -> list[int]:
    """Arguments that every recursive call of a rule that recurses by itself passes on unchanged."""
    if group != {name}:
        return []
    rules = env.rules[name]
    out = []
    for i in range(len(rules[0].args)):
        calls = [(r, c) for r in rules for c in r.body if isinstance(c, RuleCall) and c.name == name]
        nested = any(_inside(c, group) for r in rules for c in r.body if not isinstance(c, RuleCall))
        if not nested and all(str(c.args[i]) == r.args[i] for r, c in calls):
            out.append(i)
    return out


def _inside(x: Any, group: set[str]) -> bool:
    """Whether a clause of another kind holds a call of the group."""
    if isinstance(x, RuleCall):
        return x.name in group
    if isinstance(x, Or):
        return any(_inside(c, group) for b in x.branches for c in b)
    if isinstance(x, Not):
        return any(_inside(c, group) for c in x.clauses)
    if isinstance(x, tuple) and x and x[0] == "and":
        return any(_inside(c, group) for c in x[1])
    return False


def _negates(x: Any, group: set[str]) -> bool:
    if isinstance(x, Not):
        return _inside(x, group)
    if isinstance(x, Or):
        return any(_negates(c, group) for b in x.branches for c in b)
    return False


def _stored(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows of a round, computed once, and whether there are any."""
    found = df.limit(SMALL + 1).toArrow()
    if found.num_rows > SMALL:
        return durable(df), True
    return df.sparkSession.createDataFrame(found, df.schema), found.num_rows > 0


def fixpoint(env: Env, call: RuleCall, rels: Relations) -> DataFrame:
    """All rows of the rule that ``call`` names (or those that its bound arguments ask for): columns _0, _1, ..."""
    group = group_of(env.rules, call.name)
    if any(_negates(c, group) for n in group for r in env.rules[n] for c in r.body):
        raise ValueError(f"rule {call.name} recurses through a negation")
    seeds: dict[int, Any] = {}
    for i in stable(env, group, call.name):
        a = call.args[i]
        if is_var(a):
            if str(a) in env.constants:
                seeds[i] = env.constants[str(a)]
            elif str(a) in rels.vars:
                seeds[i] = next(p for p in rels.parts if str(a) in p.columns).select(c_(str(a)).alias("_v")).distinct()
        elif not is_blank(a):
            seeds[i] = a

    def evaluate(rule: Rule, delta: dict[str, DataFrame], total: dict[str, DataFrame], new_at: int | None) -> DataFrame:
        names: dict[str, Any] = {}
        inner = Relations()
        formal = [Symbol(f"?_{j}") for j in range(len(rule.args))]
        names.update(zip(rule.args, formal, strict=True))
        for i, seed in seeds.items():
            if isinstance(seed, DataFrame):
                inner.add(seed.select(F.col("_v").alias(str(formal[i]))))
        constants = {str(formal[i]): s for i, s in seeds.items() if not isinstance(s, DataFrame)}
        grown = dict(total)
        body, k = [], 0
        for c in rule.body:
            c = rename(c, names)
            if isinstance(c, RuleCall) and c.name in group:
                name = f"{c.name}#{k}"
                grown[name] = delta[c.name] if k == new_at else total[c.name]
                c = RuleCall(c.source, name, c.args)
                k += 1
            body.append(c)
        solve(Env(env.spark, env.sources, env.rules, env.constants | constants, env.grown | grown), body, inner)
        df = inner.all()
        for f in formal:
            if str(f) not in df.columns:  # a function that a rule takes is no value of its rows
                df = df.withColumn(str(f), F.lit(None).cast("string") if callable(constants[str(f)]) else F.lit(constants[str(f)]))
        return df.select(*(c_(str(f)).alias(f"_{j}") for j, f in enumerate(formal)))

    def recursive_calls(rule: Rule) -> int:
        return sum(isinstance(c, RuleCall) and c.name in group for c in rule.body)

    def nested(rule: Rule) -> bool:
        return any(_inside(c, group) for c in rule.body if not isinstance(c, RuleCall))

    delta: dict[str, DataFrame | None] = dict.fromkeys(group)
    for n in group:
        for r in env.rules[n]:
            if not recursive_calls(r) and not nested(r):
                rows = evaluate(r, {}, {}, None)
                delta[n] = rows if delta[n] is None else delta[n].union(rows)
    shape = next((d for d in delta.values() if d is not None), None)
    if shape is None:
        raise ValueError(f"rule {call.name} has no branch to start from")
    for n in group:
        width = len(env.rules[n][0].args)
        delta[n] = _stored(delta[n].distinct())[0] if delta[n] is not None else _nothing(env, shape, width)
    total, parts = dict(delta), {n: [d] for n, d in delta.items()}
    while True:
        found: dict[str, DataFrame] = {}
        for n in group:
            rows = None
            for r in env.rules[n]:
                turns = [None] if nested(r) else list(range(recursive_calls(r)))
                for k in turns:
                    part = evaluate(r, delta, total, k)
                    rows = part if rows is None else rows.union(part)
            found[n] = rows.distinct() if rows is not None else total[n].limit(0)
        fresh, some = {}, False
        for n, rows in found.items():
            right = total[n].select(*(c_(c).alias(f"{c}'") for c in total[n].columns))
            on = [rows[c].eqNullSafe(right[f"`{c}'`"]) for c in rows.columns]
            fresh[n], any_ = _stored(rows.join(right, on, "left_anti"))
            some = some or any_
        if not some:
            return total[call.name]
        for n in group:
            parts[n].append(fresh[n])
            if len(parts[n]) > MOST_PARTS:
                parts[n] = [_stored(reduce(DataFrame.union, parts[n]))[0]]
            total[n] = reduce(DataFrame.union, parts[n])
        delta = fresh


def _nothing(env: Env, shape: DataFrame, width: int) -> DataFrame:
    kind = shape.dtypes[0][1]
    return env.spark.range(0).select(*(F.lit(None).cast(kind).alias(f"_{j}") for j in range(width)))
