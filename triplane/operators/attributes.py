"""Functions of queries that read attributes: get-else, get-some, missing?, and nested queries."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.edn import Symbol
from triplane.functions.builtin import col
from triplane.plans.lower import RELATION_FUNCTIONS, SOURCE_FUNCTIONS, Env, Relations, c_, expression, run, unique_names
from triplane.plans.query import has_aggregate, is_source, is_var, parse


def source_of(args: tuple) -> tuple[str, list]:
    """The source that a call names (``$`` if none), and its other arguments."""
    rest = list(args)
    return (str(rest.pop(0)), rest) if rest and is_source(rest[0]) else ("$", rest)


def _joined(env: Env, df: DataFrame, source: str, entity: Any, attributes: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` left-joined with one value of each attribute of an entity; attributes of one table come by one join."""
    db = env.source(source)
    key = col(expression(env, df, entity))
    values: dict[str, Column] = {}
    tables: dict[str, list[str]] = {}
    for a in attributes:
        tables.setdefault(db.attribute(a).table, []).append(a)
    for t, names in tables.items():
        rows = db.tables[t].select(F.col("e").alias("_e"), *(F.col(f"`{db.attribute(a).column}`").alias(f"_v{attributes.index(a)}") for a in names))
        if db.attribute(names[0]).many:
            rows = rows.groupBy("_e").agg(F.min(f"_v{attributes.index(names[0])}").alias(f"_v{attributes.index(names[0])}"))
        df = df.join(rows, key == F.col("_e"), "left").drop("_e")
        values |= {a: F.col(f"_v{attributes.index(a)}") for a in names}
    return df, [values[a] for a in attributes]


def _drop(df: DataFrame, n: int) -> DataFrame:
    return df.drop(*(f"_v{i}" for i in range(n)))


def get_else(env: Env, df: DataFrame, args: tuple) -> DataFrame:
    source, (e, a, default) = source_of(args)
    if default is None:
        raise ValueError("get-else: the default can't be nil")
    df, (v,) = _joined(env, df, source, e, [str(a)])
    return _drop(df.withColumn("_r", F.coalesce(v, col(default))), 1)


def get_some(env: Env, df: DataFrame, args: tuple) -> DataFrame:
    source, (e, *attributes) = source_of(args)
    names = [str(a) for a in attributes]
    df, values = _joined(env, df, source, e, names)
    types = {t for c, t in df.dtypes if c.startswith("_v")}
    text = (lambda v: v) if len(types) == 1 else (lambda v: v.cast("string"))
    found = F.coalesce(*(F.when(v.isNotNull(), F.struct(F.lit(a).alias("a"), text(v).alias("v"))) for a, v in zip(names, values, strict=True)))
    return _drop(df.withColumn("_r", found), len(names))


def missing(env: Env, df: DataFrame, args: tuple) -> DataFrame:
    source, (e, a) = source_of(args)
    df, (v,) = _joined(env, df, source, e, [str(a)])
    return _drop(df.withColumn("_r", v.isNull()), 1)


def nested(env: Env, rels: Relations, args: tuple) -> DataFrame:
    """A query in a query: its rows are a relation, computed once.

    It takes sources, constants and variables of the outer query. For those it is answered once for all their values, which
    stay beside its rows as columns, groups of its aggregates are parted by them, and the outer query joins on them.
    """
    form, *values = args
    parsed = parse(form)
    spec = parsed.inputs or [Symbol("$")]
    inputs, kept, outer = [], [], []
    for s, v in zip(spec, values, strict=True):
        if is_var(v) and str(v) not in env.constants:
            if not is_var(s):
                raise ValueError("a variable of the outer query is for one variable of the nested one")
            outer.append((str(s), str(v)))
            continue
        kept.append(s)
        inputs.append(env.source(str(v)) if is_source(v) else env.constants[str(v)] if is_var(v) else v)
    if not outer:
        rows = run(parsed, *inputs)
        keys: list[str] = []
    else:
        if parsed.limit is not None or parsed.offset or parsed.shape in ("scalar", "tuple") and not any(map(has_aggregate, parsed.find)):
            raise ValueError("a nested query with variables of the outer one has all its rows")
        given = rels.over([v for _, v in outer]).select(*(c_(v).alias(f"{v}''") for _, v in outer)).distinct()
        inner = [Symbol(s) for s, _ in outer]
        names = [*(parsed.names or unique_names(parsed.find)), *(f"_k{i}" for i in range(len(outer)))]
        whole = replace(parsed, find=[*parsed.find, *map(str, inner)], names=names, shape="relation", inputs=[*kept, [inner]], order=[])
        rows = run(whole, *inputs, given).withColumnsRenamed({f"_k{i}": v for i, (_, v) in enumerate(outer)})
        keys = [v for _, v in outer]
    found = [c for c in rows.columns if c not in keys]
    item = c_(found[0]) if parsed.shape in ("scalar", "collection") else F.struct(*map(c_, found))
    return rows.select(item.alias("_r"), *map(c_, keys))


def udf(env: Env, df: DataFrame, args: tuple) -> DataFrame:
    """A registered function over columns."""
    from triplane.functions.registry import REGISTRY

    name, *values = args
    f = REGISTRY.resolve(env.constants.get(str(name), name) if isinstance(name, Symbol) else name)
    return df.withColumn("_r", f(*(col(expression(env, df, v)) for v in values)))


SOURCE_FUNCTIONS |= {"get-else": get_else, "get-some": get_some, "missing?": missing, "udf": udf}
RELATION_FUNCTIONS["q"] = nested
