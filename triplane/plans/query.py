"""Queries as data: EDN text or Python data to a :class:`Query`."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from triplane.edn import Keyword, Symbol, read

ARITHMETIC = {"+", "-", "*", "/", "mod", "rem", "quot"}


class QueryError(ValueError):
    """A query that doesn't follow the grammar."""


def is_var(x: Any) -> bool:
    return isinstance(x, Symbol) and x.startswith("?")


def is_source(x: Any) -> bool:
    return isinstance(x, Symbol) and x.startswith("$")


def is_blank(x: Any) -> bool:
    return isinstance(x, Symbol) and x == "_"


@dataclass(frozen=True)
class Pattern:
    source: str
    terms: tuple


@dataclass(frozen=True)
class Predicate:
    call: tuple


@dataclass(frozen=True)
class Function:
    call: tuple
    binding: Any


@dataclass(frozen=True)
class RuleCall:
    source: str
    name: str
    args: tuple


@dataclass(frozen=True)
class Or:
    branches: tuple
    free: tuple | None = None
    required: tuple = ()
    source: str | None = None


@dataclass(frozen=True)
class Not:
    clauses: tuple
    only: tuple | None = None
    source: str | None = None


@dataclass(frozen=True)
class Aggregate:
    name: str
    args: tuple


@dataclass(frozen=True)
class Expression:
    op: str
    args: tuple


@dataclass(frozen=True)
class Pull:
    source: str
    var: str
    pattern: Any


@dataclass
class Query:
    find: list
    shape: str = "relation"  # relation, collection, tuple or scalar
    names: list[str] | None = None
    with_: list[str] = field(default_factory=list)
    inputs: list = field(default_factory=list)
    where: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list[tuple] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    timeout: int | None = None


_SECTIONS = {":find", ":with", ":in", ":where", ":having", ":order-by", ":limit", ":offset", ":timeout", ":keys", ":syms", ":strs"}


def parse(form: Any) -> Query:
    """A query in vector or map form, as EDN text or as data."""
    form = read(form) if isinstance(form, str) and not isinstance(form, Symbol) else form
    sections: dict[str, list] = {}
    if isinstance(form, dict):
        for k, v in form.items():
            sections[str(k)] = v if isinstance(v, list) and k not in (":limit", ":offset", ":timeout") else [v]
    else:
        name = None
        for x in form:
            if isinstance(x, Keyword) and x in _SECTIONS and not (name == ":order-by" and x in (":asc", ":desc")):
                name = str(x)
                sections[name] = []
            elif name is None:
                raise QueryError("a query starts with :find")
            else:
                sections[name].append(x)
    unknown = set(sections) - _SECTIONS
    if unknown or ":find" not in sections:
        raise QueryError(f"unknown sections {sorted(unknown)}" if unknown else ":find is missing")
    q = Query(*_find(sections[":find"]))
    for k in (":keys", ":syms", ":strs"):
        if k in sections:
            if q.shape not in ("relation", "tuple"):
                raise QueryError(f"{k} goes with a relation or tuple only")
            q.names = [str(x) for x in sections[k]]
            if len(q.names) != len(q.find):
                raise QueryError(f"{k} must name each element of :find")
    q.with_ = [str(x) for x in sections.get(":with", [])]
    q.inputs = sections.get(":in", [])
    where = sections.get(":where", [])
    q.where = clauses(where[0] if len(where) == 1 and isinstance(where[0], list) and where[0] and isinstance(where[0][0], (list, tuple)) and not _is_call(where[0]) and isinstance(form, dict) else where)
    having = sections.get(":having", [])
    q.having = [tuple(h[0]) if isinstance(h, list) else tuple(h) for h in having]
    q.order = _order(sections.get(":order-by", []), q)
    limit = sections.get(":limit", [None])[0]
    q.limit = None if limit in (None, -1) else int(limit)
    q.offset = int(sections.get(":offset", [0])[0])
    q.timeout = sections.get(":timeout", [None])[0]
    if (q.order or q.limit is not None or q.offset) and q.shape != "relation":
        raise QueryError(":order-by, :limit and :offset go with a relation only")
    shared = set(q.with_) & set(find_vars(q.find))
    if shared:
        raise QueryError(f":find and :with share {sorted(shared)}")
    return q


def _is_call(clause: list) -> bool:
    return isinstance(clause[0], tuple)


def _find(items: list) -> tuple[list, str]:
    if len(items) == 1 and isinstance(items[0], list):
        inner = items[0]
        if len(inner) == 2 and inner[1] == "...":
            return [_element(inner[0])], "collection"
        return [_element(x) for x in inner], "tuple"
    if len(items) > 1 and items[-1] == ".":
        return [_element(x) for x in items[:-1]], "scalar" if len(items) == 2 else "tuple"
    if not items:
        raise QueryError(":find is empty")
    return [_element(x) for x in items], "relation"


def _element(x: Any):
    if is_var(x):
        return str(x)
    if isinstance(x, tuple) and x:
        head, *args = x
        if head == "pull":
            source = str(args.pop(0)) if is_source(args[0]) else "$"
            return Pull(source, str(args[0]), args[1])
        if head in ARITHMETIC:
            return Expression(str(head), tuple(_element(a) if isinstance(a, tuple) or is_var(a) else a for a in args))
        return Aggregate(str(head), tuple(args))
    raise QueryError(f"cannot find {x!r}")


def find_vars(find: list) -> list[str]:
    """Variables that the elements need, in order."""
    out: list[str] = []

    def add(x: Any) -> None:
        if isinstance(x, Expression):
            for a in x.args:
                add(a)
        elif isinstance(x, Aggregate):
            out.extend(str(a) for a in x.args[-1:] if is_var(a))  # what goes before is a number or a function
        elif isinstance(x, Pull):
            out.append(x.var)
        elif isinstance(x, str) and x.startswith("?"):
            out.append(x)

    for x in find:
        add(x)
    return list(dict.fromkeys(out))


def has_aggregate(x: Any) -> bool:
    return isinstance(x, Aggregate) or (isinstance(x, Expression) and any(map(has_aggregate, x.args)))


def _order(items: list, q: Query) -> list[tuple]:
    if len(items) == 1 and isinstance(items[0], list):
        items = items[0]
    out: list[list] = []
    for x in items:
        if isinstance(x, Keyword):
            if x not in (":asc", ":desc") or not out:
                raise QueryError(f"cannot order by {x}")
            out[-1][1] = x == ":desc"
        elif isinstance(x, int):
            if not 0 <= x < len(q.find):
                raise QueryError(f"there is no column {x}")
            out.append([x, False])
        else:
            if str(x) not in q.find:
                raise QueryError(f"{x} is not in :find")
            out.append([q.find.index(str(x)), False])
    if len({x[0] for x in out}) != len(out):
        raise QueryError(":order-by repeats a column")
    return [tuple(x) for x in out]


def clauses(items: list, source: str = "$") -> list:
    return [clause(x, source) for x in items]


def clause(x: Any, source: str = "$"):
    if isinstance(x, tuple):
        head, *rest = x
        own = None
        if is_source(head):
            own, (head, *rest) = str(head), rest
            if not isinstance(head, str) or head.startswith("?"):
                return Pattern(own, (head, *rest))
            source = own
        if head == "and":
            return ("and", tuple(clauses(rest, source)))
        if head == "or":
            return Or(tuple(tuple(clauses([b], source)) for b in rest), source=own)
        if head == "or-join":
            spec, *branches = rest
            required = tuple(map(str, spec[0])) if spec and isinstance(spec[0], (list, tuple)) else ()
            free = tuple(str(v) for v in spec if not isinstance(v, (list, tuple)))
            if not free and not required:
                raise QueryError("or-join needs variables")
            return Or(tuple(tuple(clauses([b], source)) for b in branches), required + free, required, own)
        if head == "not":
            return Not(tuple(clauses(rest, source)), source=own)
        if head == "not-join":
            return Not(tuple(clauses(rest[1:], source)), tuple(map(str, rest[0])), own)
        return RuleCall(source, str(head), tuple(rest))
    if isinstance(x, list) and x:
        head, *rest = x
        if isinstance(head, tuple):
            if not rest:
                return Predicate(head)
            if len(rest) != 1:
                raise QueryError(f"a function has one binding: {x!r}")
            return Function(head, rest[0])
        if is_source(head):
            return Pattern(str(head), tuple(rest))
        return Pattern(source, tuple(x))
    raise QueryError(f"cannot read clause {x!r}")


def binding_vars(b: Any) -> list[str]:
    if is_var(b):
        return [str(b)]
    if isinstance(b, list):
        return [v for x in b for v in binding_vars(x)]
    return []


def clause_vars(c: Any) -> list[str]:
    """Variables of a clause that others can see."""
    if isinstance(c, Pattern):
        found = [str(t) for t in c.terms if is_var(t)]
    elif isinstance(c, Predicate):
        found = call_vars(c.call)
    elif isinstance(c, Function):
        found = call_vars(c.call) + binding_vars(c.binding)
    elif isinstance(c, RuleCall):
        found = [str(a) for a in c.args if is_var(a)]
    elif isinstance(c, Or):
        found = list(c.free) if c.free is not None else [v for b in c.branches for x in b for v in clause_vars(x)]
    elif isinstance(c, Not):
        found = list(c.only) if c.only is not None else [v for x in c.clauses for v in clause_vars(x)]
    else:
        found = [v for x in c[1] for v in clause_vars(x)]
    return list(dict.fromkeys(found))


def call_vars(call: Any) -> list[str]:
    out = []
    call = (call[0], *call[2:]) if call and call[0] == "q" else call  # variables of a nested query are its own
    for x in call:
        if is_var(x):
            out.append(str(x))
        elif isinstance(x, tuple):
            out += call_vars(x)
        elif isinstance(x, list):
            out += [str(v) for v in x if is_var(v)]
    return list(dict.fromkeys(out))


@dataclass
class Rule:
    name: str
    args: list[str]
    required: list[str]
    body: list


def parse_rules(form: Any) -> dict[str, list[Rule]]:
    """Rules by name; several with one name are alternatives and must have as many arguments."""
    form = read(form) if isinstance(form, str) else form
    out: dict[str, list[Rule]] = {}
    for rule in form or []:
        head, *body = rule
        name, *args = head
        required = [str(a) for a in args[0]] if args and isinstance(args[0], list) else []
        args = required + [str(a) for a in args[bool(required) :]]
        if not body:
            raise QueryError(f"rule {name} has no clauses")
        out.setdefault(str(name), []).append(Rule(str(name), args, required, clauses(body)))
    for name, rules in out.items():
        if len({len(r.args) for r in rules}) != 1:
            raise QueryError(f"rule {name} has branches of different arity")
    return out
