"""Pull: a tree-shaped value per entity.

In a query a pull adds a column, a struct or (for recursion) JSON text of the tree; level by level, one join a level, so all
entities of a result are pulled together. :func:`pull` and :func:`pull_many` give Python data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.catalog import Attribute, Database
from triplane.edn import Symbol, read
from triplane.functions.builtin import FUNCTIONS
from triplane.storage import durable

LIMIT = 1000


@dataclass
class Spec:
    """One attribute of a pattern."""

    name: str
    reverse: bool = False
    alias: str | None = None
    default: Any = None
    limit: int | None = LIMIT
    xform: Any = None
    nested: list | None = None
    recursion: int | None = None  # levels; 0: until nothing new is found

    @property
    def key(self) -> str:
        return self.alias or (self.name if not self.reverse else _reversed(self.name))


@dataclass
class Pattern:
    specs: list[Spec] = field(default_factory=list)
    wildcard: bool = False
    id: bool = False


def _reversed(name: str) -> str:
    space, slash, last = name.rpartition("/")
    return f"{space}/_{last}" if slash else f":_{name[1:]}"


def _forward(name: str) -> tuple[str, bool]:
    space, slash, last = name.rpartition("/")
    if slash and last.startswith("_"):
        return f"{space}/{last[1:]}", True
    if not slash and name.startswith(":_"):
        return ":" + name[2:], True
    return name, False


def parse(form: Any) -> Pattern:
    form = read(form) if isinstance(form, str) and form.startswith(("[", "(")) else form
    out = Pattern()
    for x in form:
        if isinstance(x, dict):
            for k, v in x.items():
                spec = _spec(k)
                if v == "..." or isinstance(v, int):
                    spec.recursion = 0 if v == "..." else v
                    spec.nested = list(form)
                else:
                    spec.nested = list(v)
                out.specs.append(spec)
        elif x in ("*", ":*") or (isinstance(x, Symbol) and x == "*"):
            out.wildcard = True
        elif x == ":db/id":
            out.id = True
        else:
            out.specs.append(_spec(x))
    return out


def _spec(x: Any) -> Spec:
    if isinstance(x, (list, tuple)):
        if x[0] == "limit":
            return replace(_spec(x[1]), limit=x[2])
        if x[0] == "default":
            return replace(_spec(x[1]), default=x[2])
        spec = _spec(x[0])
        for k, v in zip(x[1::2], x[2::2], strict=True):
            if k not in (":as", ":default", ":limit", ":xform"):
                raise ValueError(f"unknown option {k}")
            setattr(spec, {":as": "alias", ":default": "default", ":limit": "limit", ":xform": "xform"}[k], str(v) if k == ":as" else v)
        return spec
    name, reverse = _forward(str(x))
    return Spec(name, reverse)


Visitor = Callable[[str, Any, Any, Any], Any]


def pull_many(db: Database, pattern: Any, ids: list, visitor: Visitor | None = None) -> list[dict | None]:
    """Trees of the given entities, in their order; None for one without any of the facts asked for.

    The visitor hears of what is read: (":db.pull/attr", e, a, None), (":db.pull/wildcard", e, None, None) and
    (":db.pull/reverse", None, a, e).
    """
    pattern = parse(pattern)
    found = _level(db, pattern, {db_id(db, i) for i in ids}, {}, visitor)
    return [found.get(db_id(db, i)) for i in ids]


def pull(db: Database, pattern: Any, eid: Any, visitor: Visitor | None = None) -> dict | None:
    return pull_many(db, pattern, [eid], visitor)[0]


def db_id(db: Database, x: Any) -> int:
    """An entity id of an id or lookup ref."""
    if isinstance(x, (list, tuple)):
        from triplane.plans.lower import lookup

        row = lookup(db, x).first()
        return row[0] if row else None
    return x


def _level(db: Database, pattern: Pattern, ids: set, seen: dict, visitor: Visitor | None = None) -> dict[Any, dict]:
    """One level of the tree for all entities at once; the ids that a driver asks for are few, what they refer to is read by joins."""
    specs = list(pattern.specs)
    given = {s.name for s in specs if not s.reverse}
    if pattern.wildcard:
        specs += [Spec(a.name) for a in db.attributes.values() if a.name not in given]
    out: dict[Any, dict] = {}
    if not ids:
        return out
    want = db.spark.createDataFrame([(i,) for i in ids if i is not None], "e long")
    if visitor and pattern.wildcard:
        for e in ids:
            visitor(":db.pull/wildcard", e, None, None)
    for s in specs:
        a = db.attribute(s.name)
        if visitor and s in pattern.specs:
            for e in ids:
                visitor(*((":db.pull/reverse", None, s.name, e) if s.reverse else (":db.pull/attr", e, s.name, None)))
        facts = _facts(db, a, s, want).collect()
        values: dict[Any, list] = {}
        for e, v in facts:
            values.setdefault(e, []).append(v)
        if s.limit is not None:
            values = {e: sorted(v, key=lambda x: (str(type(x)), x))[: s.limit] for e, v in values.items()}
        if a.ref or s.reverse:
            inner = s.nested or (["*"] if a.component and not s.reverse else None)
            below = {v for vs in values.values() for v in vs}
            if inner and s.recursion is not None:
                trees = _recurse(db, s, below, seen | {e: True for e in values}, visitor)
            else:
                trees = _level(db, parse(inner), below, seen, visitor) if inner else {}
            values = {e: [trees.get(v, {":db/id": v}) if inner else {":db/id": v} for v in vs] for e, vs in values.items()}
            if s.nested and s.recursion is None:
                values = {e: [t for v, t in zip(vs, ts, strict=True) if t] for (e, ts), vs in zip(values.items(), values.values(), strict=True)}
        one = not a.many and not s.reverse or (s.reverse and a.component)
        for e, vs in values.items():
            shown = vs[0] if one else vs
            if s.xform is not None:
                shown = s.xform(shown) if callable(s.xform) else shown
            out.setdefault(e, {})[s.key] = shown
        if s.default is not None:
            for e in ids:
                if e not in values:
                    out.setdefault(e, {})[s.key] = s.default
    if pattern.id or pattern.wildcard:
        for e in ids:
            if e in out or (pattern.id and not specs):
                out.setdefault(e, {})[":db/id"] = e
    return out


def _facts(db: Database, a: Attribute, s: Spec, want: DataFrame) -> DataFrame:
    facts = db.scan(a.name)
    if s.reverse:
        facts = facts.select(F.col("v").alias("e"), F.col("e").alias("v"))
    return facts.join(F.broadcast(want), "e", "left_semi").select("e", "v")  # ``want``: ids named in a driver's call


def _recurse(db: Database, s: Spec, ids: set, seen: dict, visitor: Visitor | None = None) -> dict:
    """Levels below; an entity already on the way stands as its id alone."""
    fresh = {i for i in ids if i not in seen}
    rest = {i: {":db/id": i} for i in ids if i in seen}
    if s.recursion == 1 or not fresh:
        last = _level(db, parse([x for x in s.nested if not isinstance(x, dict)] or [":db/id"]), fresh, seen, visitor)
        return {i: last.get(i, {":db/id": i}) for i in fresh} | rest
    deeper = []
    for x in s.nested:
        if isinstance(x, dict):
            x = {k: (v - 1 if isinstance(v, int) else v) if _spec(k).name == s.name else v for k, v in x.items()}
        deeper.append(x)
    found = _level(db, parse(deeper), fresh, seen | dict.fromkeys(fresh, True), visitor)
    return {i: found.get(i, {":db/id": i}) for i in fresh} | rest


def pull_column(env: Any, df: DataFrame, x: Any) -> DataFrame:
    """``df`` with a struct column for a pull in :find: attributes, references one level deep for nested patterns."""
    from triplane.plans.lower import c_, pull_name

    form = x.pattern
    if isinstance(form, Symbol) and str(form) in env.constants:
        form = env.constants[str(form)]
    pattern = parse(form)
    deep = any(s.recursion is not None for s in pattern.specs)
    made = _deep_tree(env.source(x.source), pattern, df.select(c_(x.var).alias("_id")).distinct(), pull_name(x)) if deep else _tree(env.source(x.source), pattern, pull_name(x))
    return df.join(made, c_(x.var) == F.col("_id"), "left").drop("_id")


def _deep_tree(db: Database, pattern: Pattern, roots: DataFrame, name: str) -> DataFrame:
    """Rows ``_id`` and the tree as JSON text, of a pattern that recurses through one attribute; one per root with any fact of it.

    Paths grow level by level, all roots together, one join and one job a level, until the wanted depth or until nothing is
    new; an entity already on its path ends it. The texts are then put together from the deepest level up.
    """
    deep = [s for s in pattern.specs if s.recursion is not None]
    if len(deep) > 1:
        raise ValueError("a pattern in :find recurses through one attribute")
    (s,) = deep
    rest = [x for x in pattern.specs if x is not s]
    own = _tree(db, Pattern(rest, pattern.wildcard, True), "_own").select(F.col("_id").alias("_node"), "_own") if rest or pattern.wildcard else None
    facts = db.scan(s.name)
    facts = facts.select(F.col("v" if s.reverse else "e").alias("_from"), F.col("e" if s.reverse else "v").alias("_to"))
    levels = [durable(roots.select(F.array("_id").alias("_path"), F.col("_id").alias("_node"), F.lit(False).alias("_met")))]
    while not s.recursion or len(levels) <= s.recursion:
        last = levels[-1].where("not _met")
        met = F.array_contains("_path", F.col("_to"))
        found = durable(last.join(facts, F.col("_node") == F.col("_from")).select(F.array_append("_path", F.col("_to")).alias("_path"), F.col("_to").alias("_node"), met.alias("_met")))
        if found.isEmpty():
            break
        levels.append(found)
    one = not db.attribute(s.name).many and not s.reverse
    key, below = F.to_json(F.struct(F.lit(s.key).alias("k"))), None
    key = F.regexp_extract(key, r'^\{"k":(.*)\}$', 1)
    for rows in reversed(levels):
        named = rows.join(own, "_node", "left") if own is not None else rows.withColumn("_own", F.struct(F.col("_node").alias(":db/id")))
        bare = F.to_json(F.struct(F.col("_node").alias(":db/id")))
        text = F.when(F.col("_met") | F.col("_own").isNull(), bare).otherwise(F.to_json("_own"))
        if below is not None:
            listed = F.col("_below") if not one else F.get("_below", F.lit(0))
            inside = listed if one else F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))
            joined = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), key, F.lit(":"), inside, F.lit("}"))
            named = named.join(below, "_path", "left")
            text = F.when(F.col("_below").isNull(), text).otherwise(joined)
        done = named.select("_path", "_node", text.alias("_text"))
        parent = F.slice("_path", 1, F.size("_path") - 1)
        limit = (lambda a: a) if s.limit is None else (lambda a: F.slice(a, 1, s.limit))
        below = done.groupBy(parent.alias("_path")).agg(F.transform(limit(F.sort_array(F.collect_list(F.struct("_node", "_text")))), lambda x: x["_text"]).alias("_below")) if rows is not levels[0] else done
    return below.where((F.col("_text") != F.to_json(F.struct(F.col("_node").alias(":db/id")))) | F.lit(pattern.id)).select(F.col("_node").alias("_id"), F.col("_text").alias(name))


def _tree(db: Database, pattern: Pattern, name: str) -> DataFrame:
    """Rows ``_id`` and a struct: one per entity that has any of the attributes."""
    specs = list(pattern.specs)
    if pattern.wildcard:
        specs += [Spec(a.name) for a in db.attributes.values() if a.name not in {s.name for s in specs}]
    tables: dict[str, list[Spec]] = {}
    parts: list[tuple[DataFrame, list[str]]] = []
    for s in specs:
        a = db.attribute(s.name)
        if s.recursion is not None:
            raise ValueError("recursion must stand at the top of a pattern in :find")
        if not a.many and not s.reverse and not s.nested and not a.component:
            tables.setdefault(a.table, []).append(s)
            continue
        facts = db.scan(a.name)
        if s.reverse:
            facts = facts.select(F.col("v").alias("e"), F.col("e").alias("v"))
        value = F.struct(F.col("v").alias(":db/id")) if (a.ref or s.reverse) else F.col("v")
        inner = s.nested or (["*"] if a.component and not s.reverse else None)
        if inner and [str(x) for x in inner] != [":db/id"]:
            below = _tree(db, parse(inner), "_below")
            facts = facts.join(below, facts["v"] == below["_id"]).drop("_id")
            value = F.col("_below")
        if a.many or s.reverse:
            listed = F.sort_array(F.collect_list(F.struct(F.col("v").alias("k"), value.alias("x"))))
            listed = F.transform(listed if s.limit is None else F.slice(listed, 1, s.limit), lambda r: r["x"])
            facts = facts.groupBy(F.col("e").alias("_id")).agg(listed.alias(s.key))
        else:
            facts = facts.select(F.col("e").alias("_id"), value.alias(s.key))
        parts.append((facts, [s.key]))
    for t, own in tables.items():
        cols = []
        for s in own:
            v = F.col(f"`{db.attribute(s.name).column}`")
            v = v if s.default is None else F.coalesce(v, F.lit(s.default))
            if s.xform is not None:
                v = s.xform(v) if callable(s.xform) else FUNCTIONS[str(s.xform)](v)
            cols.append((F.struct(v.alias(":db/id")) if db.attribute(s.name).ref else v).alias(s.key))
        parts.insert(0, (db.tables[t].select(F.col("e").alias("_id"), *cols), [s.key for s in own]))
    df = None
    for part, _ in parts:
        df = part if df is None else df.join(part, "_id", "full")
    fields = [F.col("_id").alias(":db/id")] if pattern.id or pattern.wildcard else []
    return df.select("_id", F.struct(*fields, *(F.col(f"`{k}`") for _, keys in parts for k in keys)).alias(name))
