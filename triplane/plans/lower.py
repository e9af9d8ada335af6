"""Queries to DataFrames.

A query becomes one DataFrame; Catalyst chooses join order and physical operators. What it can't know is done here: patterns
on one entity are read by one scan of its table, clauses wait until their variables are bound, negation becomes an anti-join,
alternatives a union, rules that don't recurse are written out in place, and results are sets over the found variables and
those of :with before anything is aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.catalog import Database, infer
from triplane.edn import Keyword, Symbol
from triplane.functions.aggregates import aggregate, drawn, first_n, is_ranked
from triplane.functions.builtin import FUNCTIONS, TYPED, col, truth
from triplane.functions.registry import REGISTRY
from triplane.plans.query import (Aggregate, Expression, Function, Not, Or, Pattern, Predicate, Pull, Query, QueryError, Rule, RuleCall, binding_vars, call_vars, clause_vars, find_vars,
                                  has_aggregate, is_blank, is_source, is_var, parse, parse_rules)

c_ = lambda name: F.col(f"`{name}`")

#: Functions that read a database: (env, relation or None, args) to a DataFrame that holds the relation's columns and ``_r``.
SOURCE_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}

#: Functions whose results are a relation of their own: (env, relations, args) to a DataFrame with a result a row in ``_r``,
#: and the outer variables that a result belongs to. It's joined with the other relations on the variables they share.
RELATION_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


# What is known of a relation: variables whose values no two of its rows share. Kept beside the DataFrame it is about.


def key_of(df: DataFrame) -> frozenset[str] | None:
    return df.__dict__.get("_triplane_key")


def keyed(df: DataFrame, key: Iterable[str] | None) -> DataFrame:
    df.__dict__["_triplane_key"] = None if key is None else frozenset(key)
    return df


@dataclass
class Env:
    """What clauses are read against."""

    spark: SparkSession
    sources: dict[str, Any]
    rules: dict[str, list[Rule]] = field(default_factory=dict)
    constants: dict[str, Any] = field(default_factory=dict)
    #: Results of rules that recurse, while they grow: name to a DataFrame of columns _0, _1, ...
    grown: dict[str, DataFrame] = field(default_factory=dict)
    depth: int = 0

    def source(self, name: str) -> Any:
        if name not in self.sources:
            raise QueryError(f"unknown source {name}")
        return self.sources[name]


class Relations:
    """Relations over variables; those that share a variable are joined as they are added."""

    def __init__(self, parts: Iterable[DataFrame] = ()):
        self.parts: list[DataFrame] = []
        for p in parts:
            self.add(p)

    @property
    def vars(self) -> set[str]:
        return {c for p in self.parts for c in p.columns}

    def add(self, df: DataFrame) -> None:
        rest = []
        for p in self.parts:
            shared = [c for c in p.columns if c in df.columns]
            if shared:
                df = _natural(p, df, shared)
            else:
                rest.append(p)
        self.parts = [*rest, df]

    def over(self, needed: Iterable[str]) -> DataFrame | None:
        """One relation that holds ``needed``, of those bound; relations that share nothing are multiplied."""
        needed = set(needed)
        mine = [p for p in self.parts if needed & set(p.columns)]
        if not mine:
            return None
        df = mine[0]
        for p in mine[1:]:
            df = _product(df, p)
        self.parts = [p for p in self.parts if all(p is not m for m in mine)] + [df]
        return df

    def replace(self, old: DataFrame, new: DataFrame) -> None:
        self.parts = [new if p is old else p for p in self.parts]

    def all(self) -> DataFrame | None:
        df = None
        for p in self.parts:
            df = p if df is None else _product(df, p)
        self.parts = [df] if df is not None else []
        return df


#: Pairs of rows that a task of a join makes, about, where a value meets many rows on both sides.
PAIRS = 4_000_000


def _parted(a: DataFrame, b: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of many rows with many, and the columns to join by: spread over tasks by the pairs they make.

    Pairs are counted first. A value of too many is a grid of cells: each row of one side has a line of it, of the other a column.
    """
    each = lambda df, n: df.groupBy(*map(c_, shared)).agg(F.count("*").cast("double").alias(n))
    met = each(a, "_a").join(each(b, "_b"), shared).withColumn("_pairs", F.col("_a") * F.col("_b"))
    total = met.agg(F.sum("_pairs")).first()[0] or 0.0
    if total <= PAIRS:
        return a, b, shared
    grid = met.where(F.col("_pairs") > PAIRS).select(*map(c_, shared), F.ceil(F.sqrt(F.col("_pairs") / PAIRS)).cast("int").alias("_side"))
    grid = a.sparkSession.createDataFrame(grid.collect(), grid.schema)  # at most total / PAIRS rows
    tasks, by = math.ceil(total / PAIRS), [*shared, "_line", "_column"]

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        side = F.coalesce("_side", F.lit(1))
        laid = df.join(F.broadcast(grid), shared, "left").select(*map(c_, df.columns), F.pmod(F.xxhash64(*map(c_, df.columns)), side).cast("int").alias(own), F.explode(F.sequence(F.lit(0), side - 1)).alias(other))
        return laid.repartition(tasks, *map(c_, by))

    return spread(a, "_line", "_column"), spread(b, "_column", "_line"), by


def _natural(a: DataFrame, b: DataFrame, shared: list[str]) -> DataFrame:
    ka, kb, by = key_of(a), key_of(b), shared
    if ka is not None and kb is not None and not (ka <= set(shared) or kb <= set(shared) or a.isStreaming or b.isStreaming):
        a, b, by = _parted(a, b, shared)
    right = b.select(*(c_(c).alias(f"{c}'") if c in by else c_(c) for c in b.columns))
    on = [a[f"`{c}`"] == right[f"`{c}'`"] for c in by]
    joined = a.join(right, on).drop(*(f"{c}'" for c in by), *(c for c in by if c not in shared))
    if ka is None or kb is None:
        return joined
    # A row meets one row at most of a side whose key is among the shared variables.
    return keyed(joined, ka if kb <= set(shared) else kb if ka <= set(shared) else ka | kb)


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    ka, kb = key_of(a), key_of(b)
    return keyed(a.crossJoin(b), None if ka is None or kb is None else ka | kb)


# --- patterns ---


def scan_entity(env: Env, source: str, entity: Any, patterns: list[Pattern]) -> DataFrame:
    """All patterns on one entity whose attributes are columns of one table: one scan of that table."""
    db: Database = env.source(source)
    attrs = [db.attribute(str(p.terms[1])) for p in patterns]
    df = db.tables[attrs[0].table]
    names = {a.column: f"_c{i}" for i, a in enumerate(dict.fromkeys(attrs))}
    keep = {"e": "_e"} | names
    df = df.select(*(c_(k).alias(v) for k, v in keep.items()))
    for a in dict.fromkeys(attrs):
        df = df.where(c_(names[a.column]).isNotNull())
    out: dict[str, Column] = {}
    df = _match(env, source, df, out, entity, c_("_e"), True)
    for p, a in zip(patterns, attrs, strict=True):
        if len(p.terms) > 2:
            df = _match(env, source, df, out, p.terms[2], c_(names[a.column]), a.ref)
    if not out:
        return df.select(F.lit(True).alias(f"_here{id(df)}")).limit(1)
    made = df.select(*(v.alias(k) for k, v in out.items()))
    one = attrs[0].table in db.keyed and is_var(entity) and str(entity) in out
    return keyed(made, {str(entity)} if one else set() if attrs[0].table in db.keyed and not is_var(entity) and not is_blank(entity) else None)


def _match(env: Env, source: str, df: DataFrame, out: dict[str, Column], term: Any, value: Column, ref: bool) -> DataFrame:
    """``df`` where ``value`` agrees with a term: a constant filters, a variable is bound, or tested if bound already."""
    if is_blank(term):
        return df
    if is_var(term):
        name = str(term)
        if name in env.constants:
            return df if callable(env.constants[name]) else _match(env, source, df, out, env.constants[name], value, ref)
        if name in out:
            return df.where(out[name] == value)
        out[name] = value
        return df
    if ref and isinstance(term, (list, tuple)) and len(term) == 2 and isinstance(term[0], str) and term[0].startswith(":"):
        ids = lookup(env.source(source), term)
        return df.join(ids, value == ids["_id"], "left_semi")
    if ref and isinstance(term, Keyword) and ":db/ident" in env.source(source).attributes:
        ids = lookup(env.source(source), (":db/ident", term))
        return df.join(ids, value == ids["_id"], "left_semi")
    if isinstance(term, dict) or term is None:
        raise QueryError(f"cannot match {term!r}")
    return df.where(value == col(term))


def lookup(db: Database, ref: Any) -> DataFrame:
    """The id, in column ``_id``, of the entity that has a unique attribute's value."""
    a = db.attribute(str(ref[0]))
    if not a.unique:
        raise QueryError(f"{a.name} is not unique")
    return db.scan(a.name).where(F.col("v") == col(ref[1])).select(F.col("e").alias("_id"))


def scan_any(env: Env, p: Pattern) -> DataFrame:
    """A pattern whose attribute is a variable or absent: over all facts, values as text."""
    db: Database = env.source(p.source)
    df, out = db.datoms(), {}
    for term, name in zip(p.terms, ("e", "a", "v"), strict=False):
        if name == "v" and not is_var(term) and not is_blank(term):
            term = str(term).lower() if isinstance(term, bool) else str(term)
        df = _match(env, p.source, df, out, term, F.col(name), False)
    return df.select(*(v.alias(k) for k, v in out.items())) if out else df.select(F.lit(True).alias(f"_here{id(df)}")).limit(1)


def scan_rows(env: Env, p: Pattern, rows: DataFrame) -> DataFrame:
    """A pattern over a relation given as input: terms match columns by place."""
    out: dict[str, Column] = {}
    df = rows
    for term, name in zip(p.terms, rows.columns, strict=False):
        df = _match(env, p.source, df, out, term, c_(name), False)
    return df.select(*(v.alias(k) for k, v in out.items())) if out else df.select(F.lit(True).alias(f"_here{id(df)}")).limit(1)


def patterns(env: Env, items: list[Pattern], rels: Relations) -> None:
    stars: dict[tuple, list[Pattern]] = {}
    for p in items:
        source = env.source(p.source)
        if isinstance(source, DataFrame):
            rels.add(scan_rows(env, p, source))
            continue
        terms = list(p.terms)
        if len(terms) > 1 and is_var(terms[1]) and str(terms[1]) in env.constants:
            terms[1] = env.constants[str(terms[1])]
            p = Pattern(p.source, tuple(terms))
        if len(terms) < 2 or is_var(terms[1]) or is_blank(terms[1]):
            rels.add(scan_any(env, p))
        else:
            a = source.attribute(str(terms[1]))
            e = terms[0]
            same = repr(e) if not is_blank(e) else f"_{id(p)}"
            stars.setdefault((p.source, same, a.table, a.name if a.many else ""), []).append(p)
    for (source, *_), group in stars.items():
        if group[0] and env.source(source).attribute(str(group[0].terms[1])).many:
            for p in group:
                rels.add(scan_entity(env, source, p.terms[0], [p]))
        else:
            rels.add(scan_entity(env, source, group[0].terms[0], group))


# --- expressions ---


def expression(env: Env, df: DataFrame, x: Any) -> Any:
    """An argument or call as an expression over ``df``; constants stay Python values."""
    if isinstance(x, tuple) and x and isinstance(x[0], (Symbol, str)) and not isinstance(x[0], Keyword):
        return call(env, df, x)
    if is_var(x):
        if str(x) in df.columns:
            return c_(str(x))
        if str(x) in env.constants:
            return env.constants[str(x)]
        raise QueryError(f"Insufficient bindings: {x}")
    if isinstance(x, list) and any(is_var(v) or isinstance(v, tuple) for v in x):
        return F.array(*(col(expression(env, df, v)) for v in x))
    return x


def call(env: Env, df: DataFrame, form: tuple) -> Any:
    name, *args = form
    if is_var(name) and str(name) in env.constants:
        name = env.constants[str(name)]
    if isinstance(name, tuple) and name and name[0] == "complement":
        return ~boolean(df, call(env, df, (name[1], *args)))
    values = [expression(env, df, a) for a in args]
    if callable(name):
        return name(*map(col, values))
    name = str(name).removeprefix("clojure.core/")
    if name in TYPED:
        kinds = [df.select(col(v).alias("x")).dtypes[0][1] if isinstance(v, Column) or not isinstance(v, Symbol) else "symbol" for v in values]
        return TYPED[name](kinds, *values)
    if name == "udf":
        return env.source("udf")(values[0])(*map(col, values[1:]))
    if name in FUNCTIONS:
        return FUNCTIONS[name](*values)
    try:
        found = REGISTRY.resolve(name)  # a user's function goes by its own name too
    except KeyError:
        raise QueryError(f"unknown function {name}") from None
    return found(*map(col, values))


def boolean(df: DataFrame, x: Any) -> Column:
    if not isinstance(x, Column):
        return F.lit(x is not None and x is not False)
    return truth(x, df.select(x.alias("x")).dtypes[0][1])


def bind(env: Env, df: DataFrame, value: Column, binding: Any) -> DataFrame:
    """``df`` with the variables of ``binding`` bound to ``value``; rows of a null value go, bound variables must agree."""
    if is_blank(binding):
        return df.where(value.isNotNull())
    if is_var(binding):
        name = str(binding)
        if name in df.columns:
            return df.where(c_(name) == value)
        if name in env.constants:
            return df.where(value == col(env.constants[name]))
        made = df.withColumn(name, value)
        return made.where(c_(name).isNotNull())
    if isinstance(binding, list) and len(binding) == 2 and binding[1] == "...":
        made = df.withColumn("_x", F.explode(value))
        return bind(env, made, F.col("_x"), binding[0]).drop("_x")
    if isinstance(binding, list) and len(binding) == 1 and isinstance(binding[0], list):
        made = df.withColumn("_x", F.explode(value))
        return bind(env, made, F.col("_x"), binding[0]).drop("_x")
    if isinstance(binding, list):
        made = df.withColumn("_t", value)
        kind = made.schema["_t"].dataType
        for i, b in enumerate(binding):
            item = F.col("_t").getField(kind.fieldNames()[i]) if isinstance(kind, T.StructType) else F.get("_t", i)
            if not is_blank(b):
                made = bind(env, made, item, b)
        return made.drop("_t")
    raise QueryError(f"cannot bind {binding!r}")


# --- clauses ---

ONE = "_one"


def solve(env: Env, items: list, rels: Relations) -> Relations:
    """All clauses, each as soon as what it needs is bound."""
    flat: list = []
    for x in items:
        flat += list(x[1]) if isinstance(x, tuple) and x and x[0] == "and" else [x]
    flat = [y for x in flat for y in (inline(env, x) if isinstance(x, RuleCall) else [x])]
    patterns(env, [x for x in flat if isinstance(x, Pattern)], rels)
    waiting = [x for x in flat if not isinstance(x, Pattern)]
    bindable = rels.vars | set(env.constants) | {v for x in waiting if not isinstance(x, (Not, Predicate)) for v in (binding_vars(x.binding) if isinstance(x, Function) else clause_vars(x))}
    while waiting:
        ready = [x for x in waiting if _ready(env, x, rels, bindable)]
        ready.sort(key=_rank)
        if not ready:
            raise QueryError(f"Insufficient bindings: {waiting[0]!r}")
        for x in ready[:1]:
            waiting.remove(x)
            one_clause(env, x, rels)
    return rels


def _rank(x: Any) -> int:
    return [Predicate, Function, Or, RuleCall, Not, tuple].index(type(x)) if type(x) in (Predicate, Function, Or, RuleCall, Not, tuple) else 9


def _ready(env: Env, x: Any, rels: Relations, bindable: set[str]) -> bool:
    known = rels.vars | set(env.constants)
    if isinstance(x, Predicate):
        return set(call_vars(x.call)) <= known
    if isinstance(x, Function):
        return set(call_vars(x.call)) <= known
    if isinstance(x, Not):
        outer = set(clause_vars(x)) & bindable
        return outer <= known
    if isinstance(x, Or):
        return set(x.required) <= known
    return True


def one_clause(env: Env, x: Any, rels: Relations) -> None:
    if isinstance(x, Predicate):
        _predicate(env, x, rels)
    elif isinstance(x, Function):
        _function(env, x, rels)
    elif isinstance(x, Or):
        _or(env, x, rels)
    elif isinstance(x, Not):
        _not(env, x, rels)
    elif isinstance(x, RuleCall):
        rels.add(_rule(env, x, rels))
    elif isinstance(x, tuple):
        solve(env, list(x[1]), rels)
    else:
        raise QueryError(f"cannot solve {x!r}")


def _over(env: Env, names: Iterable[str], rels: Relations) -> DataFrame:
    df = rels.over(names)
    if df is None:
        df = rels.over([ONE]) or env.spark.range(1).select(F.lit(1).alias(ONE))
        if ONE not in rels.vars:
            rels.parts.append(df)
    return df


def constant(env: Env, x: Any) -> Any:
    """An argument that must be known when the query is planned."""
    if is_var(x):
        if str(x) not in env.constants:
            raise QueryError(f"{x} must be an input")
        return env.constants[str(x)]
    return x


def _relation(env: Env, x: Function, rels: Relations) -> None:
    rows = RELATION_FUNCTIONS[str(x.call[0])](env, rels, x.call[1:])
    spread = isinstance(x.binding, list) and (len(x.binding) == 1 and isinstance(x.binding[0], list) or len(x.binding) == 2 and x.binding[1] == "...")
    made = bind(env, rows, F.col("_r"), x.binding[0] if spread else x.binding).drop("_r")
    rels.add(made if made.columns else made.select(F.lit(True).alias(f"_here{id(made)}")).limit(1))


def _predicate(env: Env, x: Predicate, rels: Relations) -> None:
    name = str(x.call[0])
    if name in RELATION_FUNCTIONS:
        _relation(env, Function(x.call, Symbol("_")), rels)
        return
    if name in SOURCE_FUNCTIONS:
        df = _over(env, call_vars(x.call), rels)
        rels.replace(df, keyed(SOURCE_FUNCTIONS[name](env, df, x.call[1:]).where(F.col("_r")).drop("_r"), key_of(df) if name == "missing?" else None))
        return
    df = _over(env, call_vars(x.call), rels)
    test = call(env, df, x.call)
    if not isinstance(test, Column) or df.select(test.alias("x")).dtypes[0][1] != "boolean":
        test = boolean(df, test)  # a filter drops nulls by itself, and in plain form it's pushed to the scan
    rels.replace(df, keyed(df.where(test), key_of(df)))


def _function(env: Env, x: Function, rels: Relations) -> None:
    name = str(x.call[0])
    if name in RELATION_FUNCTIONS:
        _relation(env, x, rels)
        return
    df = _over(env, [*call_vars(x.call), *binding_vars(x.binding)], rels)
    if name in SOURCE_FUNCTIONS:
        made = SOURCE_FUNCTIONS[name](env, df, x.call[1:])
        same = name in ("get-else", "get-some", "idoc-get", "udf") and not _spreads(x.binding)
        rels.replace(df, keyed(bind(env, made, F.col("_r"), x.binding).drop("_r"), key_of(df) if same else None))
        return
    value = call(env, df, x.call)
    if isinstance(value, (list, tuple)) and not isinstance(value, str) and any(isinstance(v, (list, tuple)) for v in value):
        rels.replace(df, df)
        rels.add(rows_of(env, value, x.binding))
        return
    if value is None:
        rels.replace(df, df.where(F.lit(False)))
        return
    rels.replace(df, keyed(bind(env, df, col(value), x.binding), None if _spreads(x.binding) else key_of(df)))


def _spreads(binding: Any) -> bool:
    """Whether a binding may give several rows for one."""
    return isinstance(binding, list) and ("..." in binding or any(map(_spreads, binding)) or (len(binding) == 1 and isinstance(binding[0], list)))


def _scoped(env: Env, source: str | None) -> Env:
    if source is None or source == "$":
        return env
    return Env(env.spark, env.sources | {"$": env.source(source)}, env.rules, env.constants, env.grown, env.depth)


def _or(env: Env, x: Or, rels: Relations) -> None:
    env = _scoped(env, x.source)
    free = list(x.free) if x.free is not None else None
    if free is None:
        sets = [{v for c in b for v in clause_vars(c)} for b in x.branches]
        if any(s != sets[0] for s in sets):
            raise QueryError("branches of or must use the same variables")
        free = [v for b in x.branches[:1] for c in b for v in clause_vars(c)]
        free = list(dict.fromkeys(free))
    free = [v for v in free if v not in env.constants]
    union = None
    for b in x.branches:
        inner = Relations()
        needs = _needed(env, list(b), free)
        seed = rels.over(needs) if needs else None
        if seed is not None:
            names = [c for c in seed.columns if c in needs]
            inner.add(seed.select(*map(c_, names)).distinct())
        solve(env, list(b), inner)
        df = inner.all()
        missing = [v for v in free if v not in df.columns]
        if missing:
            raise QueryError(f"Insufficient bindings: {missing}")
        df = df.select(*map(c_, free)) if free else df.select(F.lit(1).alias(ONE)).limit(1)
        union = df if union is None else union.union(df)
    rels.add(keyed(union.distinct(), union.columns))


def _needed(env: Env, items: list, free: list[str]) -> list[str]:
    """Variables of ``free`` that clauses use but can't bind by themselves."""
    made: set[str] = set()
    used: list[str] = []
    for x in items:
        if isinstance(x, tuple) and x and x[0] == "and":
            inner = list(x[1])
            used += [v for v in free if v in _needed(env, inner, free)]
            made |= {v for c in inner if not isinstance(c, (Predicate, Not)) for v in _makes(c)}
        elif isinstance(x, (Predicate, Not)):
            used += clause_vars(x)
        elif isinstance(x, Function):
            used += call_vars(x.call)
            made |= set(binding_vars(x.binding))
        else:
            if isinstance(x, Or):
                used += list(x.required) + [v for b in x.branches for v in _needed(env, list(b), free)]
                made |= set(clause_vars(x)) - {v for b in x.branches for v in _needed(env, list(b), free)}
                continue
            made |= set(clause_vars(x))
    return [v for v in free if v in used and v not in made]


def _makes(c: Any) -> list[str]:
    return binding_vars(c.binding) if isinstance(c, Function) else clause_vars(c)


def _not(env: Env, x: Not, rels: Relations) -> None:
    inside = list(x.only) if x.only is not None else clause_vars(x)
    outer = [v for v in inside if v in rels.vars]
    if not outer and not any(v in env.constants for v in inside):
        raise QueryError("Insufficient bindings: none of the variables of not is bound")
    inner_env = _scoped(env, x.source)
    needs = _needed(inner_env, list(x.clauses), outer)
    df = rels.over(outer) if outer else rels.all()
    inner = Relations()
    if needs:
        inner.add(df.select(*map(c_, needs)).distinct())
    # Variables that not-join doesn't name are its own.
    solve(inner_env, list(x.clauses), inner)
    found = inner.all()
    if not outer:
        rels.replace(df, keyed(df.join(found.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti"), key_of(df)))
        return
    right = found.select(*(c_(v).alias(f"{v}'") for v in outer)).distinct()
    on = [df[f"`{v}`"] == right[f"`{v}'`"] for v in outer]
    rels.replace(df, keyed(df.join(right, on, "left_anti"), key_of(df)))


# --- rules ---


def depends(rules: dict[str, list[Rule]], name: str) -> set[str]:
    """Names of rules that a rule calls, at any depth of clauses."""

    def calls(x: Any) -> set[str]:
        if isinstance(x, RuleCall):
            return {x.name}
        if isinstance(x, Or):
            return {n for b in x.branches for c in b for n in calls(c)}
        if isinstance(x, Not):
            return {n for c in x.clauses for n in calls(c)}
        if isinstance(x, tuple) and x and x[0] == "and":
            return {n for c in x[1] for n in calls(c)}
        return set()

    return {n for r in rules.get(name, []) for c in r.body for n in calls(c)}


def group_of(rules: dict[str, list[Rule]], name: str) -> set[str]:
    """The rules that recurse together with ``name``; empty if it doesn't recurse."""

    def reach(start: str) -> set[str]:
        seen, stack = set(), [start]
        while stack:
            for n in depends(rules, stack.pop()):
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return seen

    mine = reach(name)
    return {n for n in mine if name in reach(n)} if name in mine else set()


_fresh = [0]


def rename(x: Any, names: dict[str, Any]) -> Any:
    """A clause with its variables renamed, or replaced by constants; variables not named get a name of their own."""
    if is_var(x):
        return names.setdefault(str(x), Symbol(f"{x}__{_fresh[0]}"))
    if isinstance(x, Pattern):
        return Pattern(x.source, tuple(rename(t, names) for t in x.terms))
    if isinstance(x, Predicate):
        return Predicate(rename(x.call, names))
    if isinstance(x, Function):
        return Function(rename(x.call, names), rename(x.binding, names))
    if isinstance(x, RuleCall):
        return RuleCall(x.source, x.name, tuple(rename(a, names) for a in x.args))
    if isinstance(x, Or):
        named = lambda vs: tuple(str(rename(Symbol(v), names)) for v in vs)
        return Or(tuple(tuple(rename(c, names) for c in b) for b in x.branches), None if x.free is None else named(x.free), named(x.required), x.source)
    if isinstance(x, Not):
        return Not(tuple(rename(c, names) for c in x.clauses), None if x.only is None else tuple(str(rename(Symbol(v), names)) for v in x.only), x.source)
    if isinstance(x, tuple):
        return tuple(rename(y, names) for y in x)
    if isinstance(x, list):
        return [rename(y, names) for y in x]
    return x


def inline(env: Env, x: RuleCall) -> list:
    """A call of a rule of one branch that doesn't recurse, as that branch's clauses; other calls as they are."""
    rules = env.rules.get(x.name)
    if rules is None and x.name not in env.grown:
        raise QueryError(f"unknown rule {x.name}")
    if x.name in env.grown or len(rules) != 1 or group_of(env.rules, x.name) or len(rules[0].args) != len(x.args):
        return [x]
    body = _called(env, rules[0], x)
    return body if body is not None else [x]


def _called(env: Env, rule: Rule, x: RuleCall) -> list | None:
    _fresh[0] += 1
    names: dict[str, Any] = {}
    for formal, actual in zip(rule.args, x.args, strict=True):
        names[formal] = Symbol(f"?_{_fresh[0]}_{formal[1:]}") if is_blank(actual) else actual
    used = {str(v) for c in rule.body for v in clause_vars(c)}
    if any(f not in used for f in rule.args):
        return None
    body = [rename(c, names) for c in rule.body]
    body = [Pattern(x.source, c.terms) if isinstance(c, Pattern) and c.source == "$" and x.source != "$" else c for c in body]
    return [y for c in body for y in (inline(env, c) if isinstance(c, RuleCall) else [c])]


def _rule(env: Env, x: RuleCall, rels: Relations) -> DataFrame:
    from triplane.operators.rules import fixpoint

    rules = env.rules.get(x.name, [])
    if rules and len(rules[0].args) != len(x.args):
        raise QueryError(f"rule {x.name} takes {len(rules[0].args)} arguments")
    if x.name in env.grown:
        return _args(env, x, env.grown[x.name])
    if not group_of(env.rules, x.name):
        union = None
        for r in rules:
            union_part = _branch(env, r, x, rels)
            union = union_part if union is None else union.unionByName(union_part)
        return union.distinct()
    return _args(env, x, fixpoint(_scoped(env, x.source), x, rels))


def _branch(env: Env, rule: Rule, x: RuleCall, rels: Relations) -> DataFrame:
    body = _called(env, rule, x)
    seen = [str(a) for a in dict.fromkeys(x.args) if is_var(a) and str(a) not in env.constants]
    inner = Relations()
    needs = _needed(env, body, seen)
    if needs:
        seed = rels.over(needs)
        if seed is not None:
            inner.add(seed.select(*(c_(c) for c in seed.columns if c in needs)).distinct())
    solve(env, body, inner)
    df = inner.all()
    return df.select(*map(c_, seen)) if seen else df.select(F.lit(1).alias(ONE)).limit(1)


def _args(env: Env, x: RuleCall, rows: DataFrame) -> DataFrame:
    out: dict[str, Column] = {}
    for a, name in zip(x.args, rows.columns, strict=True):
        rows = _match(env, x.source, rows, out, a, c_(name), False)
    return rows.select(*(v.alias(k) for k, v in out.items())) if out else rows.select(F.lit(1).alias(ONE)).limit(1)


# --- inputs ---


def rows_of(env: Env, rows: Any, binding: Any) -> DataFrame:
    """A relation of Python rows that a binding takes apart."""
    names = binding[0] if isinstance(binding[0], list) else binding
    take = [(i, str(v)) for i, v in enumerate(names) if is_var(v)]
    data = [tuple(r[i] for i, _ in take) for r in rows]
    schema = T.StructType([T.StructField(v, infer([d[k] for d in data if d[k] is not None])) for k, (_, v) in enumerate(take)])
    return env.spark.createDataFrame(data, schema).distinct()


def inputs(env: Env, spec: list, values: list, rels: Relations) -> None:
    spec = spec or ([Symbol("$")] if values else [])
    if len(spec) != len(values):
        raise QueryError(f"the query takes {len(spec)} inputs, not {len(values)}")
    for s, v in zip(spec, values, strict=True):
        if is_source(s):
            if isinstance(v, (list, tuple, set, frozenset)):
                rows = [tuple(r) for r in v]
                width = max(map(len, rows), default=1)
                rows = [r + (None,) * (width - len(r)) for r in rows]
                schema = T.StructType([T.StructField(f"_{i}", infer([r[i] for r in rows if r[i] is not None])) for i in range(width)])
                v = env.spark.createDataFrame(rows, schema)
            env.sources[str(s)] = v
        elif s == "%":
            env.rules = v if isinstance(v, dict) else parse_rules(v)
        elif is_blank(s):
            continue
        elif isinstance(s, list):
            _input(env, s, v, rels)
        else:
            env.constants[str(s)] = v


def _input(env: Env, s: list, v: Any, rels: Relations) -> None:
    if isinstance(v, DataFrame):
        names = [str(x) for x in (s[0] if isinstance(s[0], list) else [s[0]])]
        rels.add(v.toDF(*names).distinct())
    elif len(s) == 2 and s[1] == "...":
        if is_var(s[0]):
            if len(v) and all(map(_is_lookup, v)):
                rels.add(_looked_up(env, list(v)).select(F.col("_id").alias(str(s[0]))))
                return
            kind = infer(list(v)) if len(v) else None
            if kind is None:
                rels.parts.append(env.spark.range(0).select(F.lit(None).cast("string").alias(str(s[0]))))
                return
            rels.add(env.spark.createDataFrame([(x,) for x in v], T.StructType([T.StructField(str(s[0]), kind)])).distinct())
        else:
            rels.add(rows_of(env, list(v), [s[0]]))
    elif isinstance(s[0], list):
        rels.add(rows_of(env, list(v), s))
    else:
        for a, b in zip(s, v, strict=False):
            if isinstance(a, list):
                _input(env, a, b, rels)
            elif not is_blank(a):
                env.constants[str(a)] = b


def _is_lookup(x: Any) -> bool:
    return isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[0], str) and x[0].startswith(":")


def _looked_up(env: Env, refs: list) -> DataFrame:
    """The ids, in column ``_id``, of the entities that lookup refs name: one scan per attribute."""
    out, by = None, {}
    for a, v in refs:
        by.setdefault(str(a), []).append(v)
    for name, values in by.items():
        a = env.source("$").attribute(name)
        if not a.unique:
            raise QueryError(f"{name} is not unique")
        rows = env.source("$").scan(name).where(F.col("v").isin(*values)).select(F.col("e").alias("_id"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


# --- results ---


def run(form: Any, *values: Any) -> DataFrame:
    """The result of a query as a DataFrame, one column per element of :find."""
    q = form if isinstance(form, Query) else parse(form)
    spark = next((v.spark for v in values if isinstance(v, Database)), None) or next((v.sparkSession for v in values if isinstance(v, DataFrame)), None) or SparkSession.active()
    env = Env(spark, {})
    rels = Relations()
    inputs(env, q.inputs, list(values), rels)
    return result(env, q, rels)


def result(env: Env, q: Query, rels: Relations) -> DataFrame:
    solve(env, q.where, rels)
    df = rels.all()
    if df is None:
        df = env.spark.range(1).select(F.lit(1).alias(ONE))
    needed = list(dict.fromkeys([*find_vars(q.find), *q.with_]))
    for v in needed:
        if v not in df.columns:
            if v not in env.constants:
                raise QueryError(f"{v} is not bound")
            df = df.withColumn(v, col(env.constants[v]))
    key = key_of(df)
    df = df.select(*map(c_, needed))
    df = df if key is not None and key <= set(needed) else df.distinct()
    names = q.names or unique_names(q.find)
    if any(map(has_aggregate, q.find)):
        df = aggregated(env, q, df, names)
    else:
        df = df.select(*map(c_, needed))
        pulls = [x for x in q.find if isinstance(x, Pull)]
        if pulls:
            from triplane.operators.pull import pull_column

            for x in pulls:
                df = pull_column(env, df, x)
        made = [(c_(x) if isinstance(x, str) else c_(pull_name(x)) if isinstance(x, Pull) else value(df, x)).alias(n) for x, n in zip(q.find, names, strict=True)]
        whole = {x for x in q.find if isinstance(x, str)} >= set(needed)
        df = df.select(*made)
        if not whole and not q.with_ and not pulls:
            df = df.distinct()
    if q.order:
        df = df.orderBy(*((c_(names[i]).desc() if down else c_(names[i]).asc()) for i, down in q.order))
    if q.offset:
        df = df.offset(q.offset)
    if q.shape in ("scalar", "tuple"):
        return df.limit(1)
    return df if q.limit is None else df.limit(q.limit)


def pull_name(x: Pull) -> str:
    return f"_pull_{x.var}"


def value(df: DataFrame, x: Any) -> Column:
    """A find expression without aggregates."""
    if isinstance(x, Expression):
        return FUNCTIONS[x.op](*(value(df, a) for a in x.args))
    return c_(x) if isinstance(x, str) and x.startswith("?") else col(x)


def aggregated(env: Env, q: Query, df: DataFrame, names: list[str]) -> DataFrame:
    """Groups by the plain variables of :find; without any and without rows there is no result."""
    keys = [x for x in q.find if isinstance(x, str)]
    found: dict[Aggregate, str] = {}

    def collect(x: Any) -> None:
        if isinstance(x, Aggregate):
            found.setdefault(x, f"_a{len(found)}")
        elif isinstance(x, Expression):
            for a in x.args:
                collect(a)

    for x in q.find:
        collect(x)
    df, ranked = drawn(env, df, found), {a: n for a, n in found.items() if is_ranked(a)}
    made = [aggregate(env, df, a, n).alias(n) for a, n in found.items() if a not in ranked]
    grouped = df.groupBy(*map(c_, keys)).agg(*made, F.count("*").alias("_rows")).where("_rows > 0")
    for a, n in ranked.items():  # a join on the groups in place of collecting them whole
        part = first_n(env, df, a, keys, n)
        part = part.select(*(c_(k).alias(f"{k}'") for k in keys), n)
        on = F.lit(True)
        for k in keys:
            on = on & grouped[f"`{k}`"].eqNullSafe(part[f"`{k}'`"])
        grouped = (grouped.join(part, on, "left") if keys else grouped.crossJoin(part)).drop(*(f"{k}'" for k in keys))

    def shown(x: Any) -> Column:
        if isinstance(x, Aggregate):
            return F.col(found[x])
        if isinstance(x, Expression):
            return FUNCTIONS[x.op](*map(shown, x.args))
        return c_(x) if isinstance(x, str) and x.startswith("?") else col(x)

    for h in q.having:
        def part(x: Any) -> Any:
            from triplane.plans.query import _element

            if isinstance(x, tuple):
                e = _element(x)
                missing = [a for a in _aggregates(e) if a not in found]
                return F.lit(None) if missing else shown(e)
            return shown(str(x)) if is_var(x) else x

        name, *args = h
        grouped = grouped.where(boolean(grouped, FUNCTIONS[str(name)](*map(part, args))))
    return grouped.select(*(shown(x).alias(n) for x, n in zip(q.find, names, strict=True)))


def _aggregates(x: Any) -> list[Aggregate]:
    if isinstance(x, Aggregate):
        return [x]
    return [a for y in x.args for a in _aggregates(y)] if isinstance(x, Expression) else []


def unique_names(find: list) -> list[str]:
    """A column name for each element: a variable's own, or what is computed of it."""

    def name(x: Any) -> str:
        if isinstance(x, Pull):
            return f"pull_{x.var[1:]}"
        if isinstance(x, Aggregate):
            return "_".join([x.name.replace("-", "_").rpartition("/")[2], *(str(a).lstrip("?") for a in x.args)])
        if isinstance(x, Expression):
            return "expr"
        return str(x).lstrip("?").replace("-", "_")

    out: list[str] = []
    for x in find:
        n, k = name(x), 2
        base = n
        while n in out:
            n, k = f"{base}_{k}", k + 1
        out.append(n)
    return out
