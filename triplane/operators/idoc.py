"""Indexed documents: JSON-like documents in a column, matched, read and patched by paths.

A document is JSON text; EDN and Markdown are normalised to it. Queries over maps of plain values are expressions over variants;
only wildcards, paths, and documents with arrays or broken numbers on the way are walked through in Python, in Arrow batches.
Before that, constants that every match must hold are looked for in the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.catalog import Database
from triplane.edn import Keyword, read
from triplane.operators.attributes import source_of
from triplane.plans.lower import RELATION_FUNCTIONS, SOURCE_FUNCTIONS, Env, Relations, constant, expression

ONE, ANY = ":?", ":*"
_COMPARE: dict[str, Callable[[Any, Any], bool]] = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def key(x: Any) -> str:
    return str(x).lstrip(":") if not isinstance(x, int) else str(x)


def normalize(doc: Any, kind: str = "json") -> str | None:
    """JSON text of a document in one of the formats; its root must be a map."""
    if doc is None:
        return None
    if kind == "markdown":
        value: Any = markdown(doc)
    elif kind == "edn":
        value = _plain(read(doc) if isinstance(doc, str) else doc)
    else:
        value = json.loads(doc) if isinstance(doc, str) else doc
    if not isinstance(value, dict):
        raise ValueError("a document's root must be a map")
    return json.dumps(value, ensure_ascii=False)


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {key(k): _plain(v) for k, v in x.items()}
    if isinstance(x, tuple):
        raise ValueError("documents hold vectors, not lists")
    return [_plain(v) for v in x] if isinstance(x, list) else x


def markdown(text: str) -> dict:
    """Headings become keys, nested by their level; what stands below a heading becomes its value."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(0, root)]
    body: list[str] = []

    def flush() -> None:
        content = "\n".join(body).strip()
        body.clear()
        if content:
            stack[-1][1]["content"] = content

    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            level, name = len(m[1]), re.sub(r"[^\w]+", "-", m[2].strip().lower()).strip("-")
            while stack[-1][0] >= level:
                stack.pop()
            stack[-1][1][name] = node = {}
            stack.append((level, node))
        else:
            body.append(line)
    flush()
    return _leaves(root)


def _leaves(x: dict) -> dict:
    return {k: (v["content"] if isinstance(v, dict) and set(v) == {"content"} else _leaves(v) if isinstance(v, dict) else v) for k, v in x.items()}


def _same(a: Any, b: Any) -> bool:
    """Equal, and of one type: 1 is not 1.0 nor true."""
    return type(a) is type(b) and a == b


def values(doc: Any, path: list) -> Iterator[Any]:
    """What a path leads to; arrays are walked through, ``:?`` stands for one step and ``:*`` for any number."""
    if not path:
        yield from doc if isinstance(doc, list) else [doc]
        if isinstance(doc, list):
            yield doc
        return
    step, *rest = path
    if step == ANY:
        yield from values(doc, rest)
        for v in doc.values() if isinstance(doc, dict) else doc if isinstance(doc, list) else ():
            yield from values(v, path if not isinstance(doc, list) else path)
        return
    if isinstance(doc, list):
        if isinstance(step, int):
            if -len(doc) <= step < len(doc):
                yield from values(doc[step], rest)
            return
        for v in doc:
            yield from values(v, path)
    elif isinstance(doc, dict):
        for v in doc.values() if step == ONE else [doc[key(step)]] if key(step) in doc else ():
            yield from values(v, rest)


def matches(doc: Any, query: Any) -> bool:
    """Whether a parsed document satisfies a query."""
    if isinstance(query, dict):
        if isinstance(doc, list):
            return any(matches(v, query) for v in doc)
        return all(any(_meets(v, q) for v in values(doc, [k])) for k, q in query.items())
    if isinstance(query, list) and query and query[0] in (":and", ":or", ":not"):
        parts = (matches(doc, q) for q in query[1:])
        return all(parts) if query[0] == ":and" else any(parts) if query[0] == ":or" else not any(parts)
    if isinstance(query, tuple):
        return _predicate(doc, query)
    return _meets(doc, query)


def _meets(value: Any, query: Any) -> bool:
    if isinstance(query, dict):
        return isinstance(value, (dict, list)) and matches(value, query)
    if isinstance(query, list) and query and query[0] in (":and", ":or", ":not"):
        return matches(value, query)
    if isinstance(query, tuple):
        return _predicate(value, query)
    return any(_same(v, query) for v in ([value, *value] if isinstance(value, list) else [value]))


def _is_path(x: Any) -> bool:
    return isinstance(x, Keyword) or (isinstance(x, list) and bool(x))


def _predicate(doc: Any, query: tuple) -> bool:
    op, *args = query
    op = str(op)
    path = next((a for a in args if _is_path(a)), None)
    steps = path if isinstance(path, list) else [path] if path is not None else []
    found = list(values(doc, steps))
    if op == "nil?":
        return any(v is None for v in found)
    for v in found:
        chain = [v if a is path and path is not None else a for a in args] if path is not None else [v, *args]
        if all(type(a) is type(b) and not isinstance(a, (dict, list)) and a is not None and _COMPARE[op](a, b) for a, b in zip(chain, chain[1:], strict=False)):
            return True
    return False


def needs(query: Any) -> list[str]:
    """JSON texts of constants that the text of every match holds."""
    if isinstance(query, dict):
        return [n for k, q in query.items() for n in ([json.dumps(key(k), ensure_ascii=False)] if k not in (ONE, ANY) else []) + needs(q)]
    if isinstance(query, list) and query and query[0] == ":and":
        return [n for q in query[1:] for n in needs(q)]
    if isinstance(query, str) and not isinstance(query, Keyword) and query.isascii() and query.isprintable() and '"' not in query and "\\" not in query:
        return [query]
    return [str(query)] if isinstance(query, int) and not isinstance(query, bool) else []


def _likely(doc: Column, query: Any) -> Column:
    """Whether a document's text has all constants of a query, or escapes under which they may hide."""
    found = F.lit(True)
    for n in needs(query):
        found = found & doc.contains(n)
    return found | doc.contains("\\")


def _decided(value: Column, query: Any) -> Column | None:
    """Whether a document, a variant, satisfies a query, as an expression: null where it must be walked through (arrays on the way,
    numbers that aren't plain integers). None for a query with wildcards or paths.
    """
    if isinstance(query, list) and query and query[0] in (":and", ":or", ":not"):
        parts = [_decided(value, q) for q in query[1:]]
        if not parts or any(p is None for p in parts):
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out & p if query[0] == ":and" else out | p
        return ~out if query[0] == ":not" else out
    kind = F.schema_of_variant(value)
    if isinstance(query, dict):
        out = F.lit(True)
        for k, q in query.items():
            if k in (ONE, ANY) or isinstance(k, int) or "'" in key(k) or "\\" in key(k):
                return None
            part = _decided(F.try_variant_get(value, f"$['{key(k)}']", "variant"), q)
            if part is None:
                return None
            out = out & part
        return F.when(value.isNull(), False).when(kind.startswith("OBJECT"), out).when(kind.startswith("ARRAY"), None).otherwise(False)
    if isinstance(query, tuple):
        op, *args = query
        if str(op) == "nil?" and not args:
            return F.when(value.isNull(), False).when(kind.startswith("ARRAY"), None).otherwise(F.is_variant_null(value))
        if str(op) not in _COMPARE or not args or not all(type(x) is int and abs(x) < 2**63 for x in args):
            return None
        chain = [F.try_variant_get(value, "$", "bigint"), *(F.lit(x).cast("long") for x in args)]
        test = F.lit(True)
        for x, y in zip(chain, chain[1:], strict=False):
            test = test & _COMPARE[str(op)](x, y)
        return F.when(value.isNull(), False).when(kind == "BIGINT", test).when(kind.isin("STRING", "BOOLEAN", "VOID") | kind.startswith("OBJECT"), False)
    if isinstance(query, bool):
        same, named = F.try_variant_get(value, "$", "boolean") == query, "BOOLEAN"
    elif type(query) is int and abs(query) < 2**63:
        same, named = F.try_variant_get(value, "$", "bigint") == F.lit(query).cast("long"), "BIGINT"
    elif isinstance(query, str) and not isinstance(query, Keyword):
        same, named = F.try_variant_get(value, "$", "string") == str(query), "STRING"
    else:
        return None
    return F.when(value.isNull(), False).when(kind == named, same).when(kind.isin("BIGINT", "STRING", "BOOLEAN", "VOID") | kind.startswith("OBJECT"), False)


def match(doc: Column, query: Any) -> Column:
    """Whether documents (JSON text) satisfy a query. Only those that no expression can decide are parsed in Python."""
    query = read(query) if isinstance(query, str) and query[:1] in "{[(" else query
    test = _likely(doc, query)

    @F.pandas_udf("boolean")
    def verified(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: d is not None and matches(json.loads(d), query)).astype(bool)

    if query == {}:
        return doc.isNotNull()
    parsed = F.try_parse_json(doc)
    known = _decided(parsed, query)
    if known is None:
        return F.when(test, verified(doc)).otherwise(False)
    known = F.when(doc.isNull() | ~test, False).when(parsed.isNotNull(), known)
    return F.coalesce(known, verified(F.when(known.isNull(), doc)))


def filtered(df: DataFrame, doc: Column, query: Any) -> DataFrame:
    """Rows whose document satisfies a query; those without its constants never reach Python."""
    query = read(query) if isinstance(query, str) and query[:1] in "{[(" else query
    return df.where(_likely(doc, query)).where(match(doc, query))


def get(doc: Column, *path: Any) -> Column:
    """The value at a path as JSON text; null if there is none. Steps are names or array places."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{key(p)}']" for p in path)
    return F.get_json_object(doc, "$" + steps)


def patch(doc: str, ops: list) -> str:
    """A document after ``[:set path v]``, ``[:unset path]`` and ``[:update path op args...]``, in turn."""
    value = json.loads(doc)
    for op, path, *args in ops:
        *way, last = [p if isinstance(p, int) else key(p) for p in (path if isinstance(path, list) else [path])]
        at = value
        for p in way:
            at = at.setdefault(p, {}) if isinstance(at, dict) else at[p]
        if op == ":set":
            at[last] = _plain(args[0])
        elif op == ":unset":
            if isinstance(at, dict):
                at.pop(last, None)
            elif -len(at) <= last < len(at):
                del at[last]
        elif op == ":update":
            at[last] = _updated(at.get(last) if isinstance(at, dict) else at[last], str(args[0]), [_plain(a) for a in args[1:]])
        else:
            raise ValueError(f"unknown change {op}")
    return json.dumps(value, ensure_ascii=False)


def _updated(old: Any, op: str, args: list) -> Any:
    if op == ":conj":
        return [*(old or []), *args]
    if op == ":merge":
        return (old or {}) | args[0]
    if op == ":assoc":
        return (old or {}) | {key(k): v for k, v in zip(args[::2], args[1::2], strict=True)}
    if op == ":dissoc":
        return {k: v for k, v in (old or {}).items() if k not in map(key, args)}
    if op in (":inc", ":dec"):
        return (old or 0) + (1 if op == ":inc" else -1)
    raise ValueError(f"unknown update {op}")


def patched(doc: Column, ops: list) -> Column:
    """Documents after changes."""

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else patch(d, ops))

    return run(doc)


def idoc_match(env: Env, rels: Relations, args: tuple) -> DataFrame:
    """``(idoc-match $ :attr query)``: rows ``[e a v]``."""
    source, rest = source_of(args)
    db: Database = env.source(source)
    names = [str(rest.pop(0))] if isinstance(rest[0], Keyword) else [a.name for a in db.attributes.values() if a.props.get(":db/valueType") == ":db.type/idoc"]
    query = constant(env, rest[0])
    out = None
    for name in names:
        rows = filtered(db.scan(name), F.col("v"), query).select(F.struct("e", F.lit(name).alias("a"), "v").alias("_r"))
        out = rows if out is None else out.unionByName(rows)
    return out


def idoc_get(env: Env, df: DataFrame, args: tuple) -> DataFrame:
    doc, *path = args
    return df.withColumn("_r", get(expression(env, df, doc), *path))


RELATION_FUNCTIONS["idoc-match"] = idoc_match
SOURCE_FUNCTIONS["idoc-get"] = idoc_get
