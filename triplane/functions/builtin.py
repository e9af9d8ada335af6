"""Functions and predicates of the query language as Spark expressions.

Each takes expressions or Python constants and gives an expression. A function whose result is null has no result: its row
goes. Truth: all but null and false, so a predicate
that gives another value holds wherever it isn't null.

Where the language of the original and Spark differ: integer division gives a double, not a ratio; ``_`` in LIKE stands
for one character; regular expressions are Java's. ``=`` holds between numbers of one kind only, whole or broken, ``==``
between any.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def named(*names: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        FUNCTIONS.update(dict.fromkeys(names, f))
        return f

    return add


#: Those whose form depends on the Spark types of their arguments, which they get first.
TYPED: dict[str, Callable[..., Column]] = {}


def typed(name: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        TYPED[name] = f
        return f

    return add


def col(x: Any) -> Column:
    """An expression of a constant; lists and sets become arrays, dicts maps."""
    if isinstance(x, Column):
        return x
    if isinstance(x, (list, tuple)):
        return F.array(*map(col, x)) if x else F.array()
    if isinstance(x, (set, frozenset)):
        return col(sorted(x, key=str))
    if isinstance(x, dict):
        return F.create_map(*(col(v) for kv in x.items() for v in kv))
    if isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63:
        return F.lit(x).cast("long")
    return F.lit(str(x) if isinstance(x, str) else x)


def _chain(test: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def f(*args: Any) -> Column:
        cols = list(map(col, args))
        return reduce(lambda a, b: a & b, [test(a, b) for a, b in zip(cols, cols[1:], strict=False)], F.lit(True))

    return f


def _same(a: Column, b: Column) -> Column:
    return a == b


FUNCTIONS |= {
    "=": _chain(_same), "==": _chain(lambda a, b: a.cast("double") == b.cast("double")),
    "<": _chain(lambda a, b: a < b), ">": _chain(lambda a, b: a > b), "<=": _chain(lambda a, b: a <= b), ">=": _chain(lambda a, b: a >= b),
    "+": lambda *a: reduce(lambda x, y: x + y, map(col, a or (0,))),
    "*": lambda *a: reduce(lambda x, y: x * y, map(col, a or (1,))),
    "-": lambda *a: -col(a[0]) if len(a) == 1 else reduce(lambda x, y: x - y, map(col, a)),
    "/": lambda *a: (1 / col(a[0])) if len(a) == 1 else reduce(lambda x, y: x / y, map(col, a)),
    "inc": lambda a: col(a) + 1, "dec": lambda a: col(a) - 1,
    "max": lambda *a: F.greatest(*map(col, a)) if len(a) > 1 else col(a[0]), "min": lambda *a: F.least(*map(col, a)) if len(a) > 1 else col(a[0]),
    "zero?": lambda a: col(a) == 0, "pos?": lambda a: col(a) > 0, "neg?": lambda a: col(a) < 0,
    "even?": lambda a: col(a) % 2 == 0, "odd?": lambda a: col(a) % 2 != 0,
    "true?": lambda a: col(a).eqNullSafe(F.lit(True)), "false?": lambda a: col(a).eqNullSafe(F.lit(False)), "nil?": lambda a: col(a).isNull(), "some?": lambda a: col(a).isNotNull(),
    "identical?": lambda a, b: col(a).eqNullSafe(col(b)), "identity": col, "ground": col, "untuple": col, "quote": col,
    "rand": lambda n=1: F.rand() * col(n), "rand-int": lambda n: F.floor(F.rand() * col(n)).cast("long"),
    "str": lambda *a: F.concat(*(F.coalesce(col(x).cast("string"), F.lit("")) for x in a)) if a else F.lit(""),
    "print-str": lambda *a: F.concat_ws(" ", *(F.coalesce(col(x).cast("string"), F.lit("nil")) for x in a)),
    "println-str": lambda *a: F.concat(FUNCTIONS["print-str"](*a), F.lit("\n")),
    "name": lambda a: F.regexp_extract(col(a), r"^:?(?:[^/]*/)?(.+)$", 1), "keyword": lambda *a: F.concat(F.lit(":"), F.concat_ws("/", *map(col, a))), "type": lambda a: F.typeof(col(a)), "meta": lambda a: F.lit(None).cast("string"),
    "re-pattern": lambda p: p, "re-find": lambda p, s: _found(p, s), "re-matches": lambda p, s: _found(f"^(?:{p})$", s), "re-seq": lambda p, s: _nonempty(F.regexp_extract_all(col(s), F.lit(str(p)), F.lit(0))),
    "vector": lambda *a: _together(a), "list": lambda *a: _together(a), "tuple": lambda *a: _together(a), "set": lambda a: F.array_distinct(col(a)),
    "hash-map": lambda *a: F.create_map(*map(col, a)), "array-map": lambda *a: F.create_map(*map(col, a)),
}


def truth(x: Column, kind: str) -> Column:
    """Whether a value of a Spark type counts as true: only null and false don't."""
    return F.coalesce(x, F.lit(False)) if kind == "boolean" else x.isNotNull()


@typed("pr-str")
def pr_str(kinds: list[str], *args: Any) -> Column:
    """Readable text: strings are quoted, null is nil."""
    quote = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\\\])', r"\\$1"), F.lit('"'))
    return F.concat_ws(" ", *(F.coalesce(quote(col(x)) if k == "string" else col(x).cast("string"), F.lit("nil")) for x, k in zip(args, kinds, strict=True)))


@typed("prn-str")
def prn_str(kinds: list[str], *args: Any) -> Column:
    return F.concat(pr_str(kinds, *args), F.lit("\n"))


def _together(items: tuple) -> Column:
    """A struct; its fields may be of different types."""
    return F.struct(*(col(x).alias(f"_{i}") for i, x in enumerate(items)))


def _found(pattern: Any, s: Any) -> Column:
    """The first match; with groups an array of it and what each group holds."""
    import re

    made = [F.regexp_extract(col(s), str(pattern), i) for i in range(re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", str(pattern))).groups + 1)]
    return F.when(col(s).rlike(str(pattern)), F.array(*made) if len(made) > 1 else made[0])


def _nonempty(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _kind(spark_type: str) -> str:
    """What of its Spark type counts when values are compared for equality."""
    return "whole" if spark_type in _WHOLE else "whole" if spark_type.endswith(",0)") and spark_type.startswith("decimal") else "broken" if spark_type in ("float", "double") else "exact" if spark_type.startswith("decimal") else ""


@typed("=")
def equal(kinds: list[str], *args: Any) -> Column:
    """Equal, and of one kind of number: 1 is not 1.0."""
    numbers = {_kind(k) for k in kinds if k != "symbol"} - {""}
    return F.lit(False) if len(numbers) > 1 else FUNCTIONS["="](*args)


@typed("==")
def same_number(kinds: list[str], *args: Any) -> Column:
    """Equal as numbers; whole ones exactly, others as doubles."""
    whole = all(_kind(k) in ("whole", "exact") for k in kinds)
    return FUNCTIONS["="](*args) if whole else FUNCTIONS["=="](*args)


@typed("not=")
def different_typed(kinds: list[str], *args: Any) -> Column:
    return ~equal(kinds, *args)


TYPED["!="] = different_typed


@named("not=", "!=")
def different(*args: Any) -> Column:
    return ~FUNCTIONS["="](*args)


@named("-differ?")
def differ(*args: Any) -> Column:
    half = len(args) // 2
    return reduce(lambda a, b: a | b, [col(x) != col(y) for x, y in zip(args[:half], args[half:], strict=True)], F.lit(False))


@named("compare")
def compare(a: Any, b: Any) -> Column:
    return F.when(col(a) < col(b), -1).when(col(a) > col(b), 1).otherwise(0).cast("long")


@typed("not")
def not_(kinds: list[str], a: Any) -> Column:
    return ~truth(col(a), kinds[0])


@typed("and")
def both(kinds: list[str], *args: Any) -> Column:
    """The last argument if all are true, else null."""
    if not args:
        return F.lit(True)
    return F.when(reduce(lambda a, b: a & b, [truth(col(x), k) for x, k in zip(args, kinds, strict=True)]), col(args[-1]))


@typed("or")
def either(kinds: list[str], *args: Any) -> Column:
    """The first true argument, else null."""
    return F.coalesce(*(F.when(truth(col(x), k), col(x)) for x, k in zip(args, kinds, strict=True))) if args else F.lit(None)


@typed("quot")
def quot(kinds: list[str], a: Any, b: Any) -> Column:
    """The quotient without its broken part: exact of whole numbers, a double of others."""
    if all(_kind(k) == "whole" for k in kinds):
        return F.call_function("div", col(a), col(b))
    x = col(a) / col(b)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


FUNCTIONS["quot"] = lambda a, b: quot(["bigint", "bigint"], a, b)


@named("rem")
def rem(a: Any, b: Any) -> Column:
    return col(a) % col(b)


@named("mod")
def mod(a: Any, b: Any) -> Column:
    rest = col(a) % col(b)
    return F.when((rest != 0) & ((rest < 0) != (col(b) < 0)), rest + col(b)).otherwise(rest)


@named("in")
def in_(x: Any, items: Any) -> Column:
    if isinstance(items, dict):
        raise TypeError("in takes no map")
    return F.array_contains(items, col(x)) if isinstance(items, Column) else col(x).isin(*items) if items else F.lit(False)


@named("not-in")
def not_in(x: Any, items: Any) -> Column:
    return ~in_(x, items)


@named("like")
def like(x: Any, pattern: str, opts: dict | None = None) -> Column:
    """SQL LIKE; ``!`` escapes unless ``{:escape c}`` names another character. Only ``%``, ``_`` and it may be escaped."""
    escape = str((opts or {}).get(":escape", "!"))
    i, out = 0, []
    while i < len(pattern):
        c = pattern[i]
        if c == escape:
            i += 1
            if i >= len(pattern) or pattern[i] not in ("%", "_", escape):
                raise ValueError(f"cannot escape in {pattern!r}")
            out.append("\\" + pattern[i])
        else:
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return col(x).like("".join(out))  # a prefix or plain pattern in this form reaches the scan as a pushed filter


@named("not-like")
def not_like(x: Any, pattern: str, opts: dict | None = None) -> Column:
    return ~like(x, pattern, opts)


@named("subs")
def subs(s: Any, start: Any, end: Any = None) -> Column:
    s, start = col(s), col(start).cast("int")
    end = F.length(s) if end is None else col(end).cast("int")
    good = (start >= 0) & (end >= start) & (end <= F.length(s))
    return F.when(good, F.substring(s, start + 1, end - start)).otherwise(F.raise_error("subs: index out of range").cast("string"))


@named("namespace")
def namespace(a: Any) -> Column:
    return F.when(col(a).contains("/"), F.regexp_extract(col(a), r"^:?([^/]*)/", 1))


def _size(kind: str, a: Any) -> Column:
    """Elements of an array or map, characters of a string."""
    return (F.size(col(a)) if kind.startswith(("array", "map")) else F.length(col(a))).cast("long")


@typed("count")
def count(kinds: list[str], a: Any) -> Column:
    return _size(kinds[0], a)


@typed("empty?")
def empty(kinds: list[str], a: Any) -> Column:
    return _size(kinds[0], a) == 0


@typed("not-empty")
def not_empty(kinds: list[str], a: Any) -> Column:
    return F.when(_size(kinds[0], a) > 0, col(a))


@typed("apply")
def apply(kinds: list[str], f: Any, *args: Any) -> Column:
    """A reducer over an array, after constants or columns that go before."""
    *first, items = args
    items = col(items)
    if f in ("+", "*"):
        kind = "double" if "double" in kinds[-1] or "float" in kinds[-1] else "long"
        step = (lambda a, x: a + x) if f == "+" else (lambda a, x: a * x)
        return FUNCTIONS[f](*first, F.aggregate(F.transform(items, lambda x: x.cast(kind)), F.lit(int(f == "*")).cast(kind), step))
    if f in ("max", "min"):
        return FUNCTIONS[f](*first, (F.array_max if f == "max" else F.array_min)(items))
    if f == "str":
        return F.concat(*(col(x).cast("string") for x in first), F.array_join(items, ""))
    if f in ("vector", "list", "set") and not first:
        return items if f != "set" else F.array_distinct(items)
    raise ValueError(f"cannot apply {f}")


@named("get")
def get(m: Any, k: Any, default: Any = None) -> Column:
    found = F.try_element_at(col(m), col(k)) if isinstance(m, (dict, Column)) and not isinstance(k, int) else F.get(col(m), col(k).cast("int"))
    return found if default is None else F.coalesce(found, col(default))


@named("contains?")
def contains(m: Any, k: Any) -> Column:
    if isinstance(m, (set, frozenset)):
        return F.array_contains(col(m), col(k))
    if isinstance(m, (list, tuple)) or (isinstance(m, Column) and isinstance(k, int)):
        return (col(k) >= 0) & (col(k) < F.size(col(m)))
    return F.map_contains_key(col(m), col(k))


@named("range")
def range_(*args: Any) -> Column:
    """Numbers from a start (0) to an end, exclusive, by a step (1); empty where there are none."""
    start, end, step = (0, args[0], 1) if len(args) == 1 else (*args, 1)[:3]
    start, end, step = (col(x).cast("long") for x in (start, end, step))
    last = end - F.signum(step).cast("long")
    some = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    return F.when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<bigint>"))


def _place(s: Column, part: Column, start: Any = 0) -> Column:
    """Where a text has another, from a place on, counted from 0; null if nowhere."""
    found = F.call_function("locate", part, s, col(start).cast("int") + 1)
    return F.when(found > 0, (found - 1).cast("long"))


def _last_place(s: Column, part: Column) -> Column:
    return F.when(s.contains(part), (F.length(s) - F.length(part) - F.call_function("locate", F.reverse(part), F.reverse(s)) + 1).cast("long"))


_TEXT = {"lower-case": F.lower, "upper-case": F.upper, "trim": F.trim, "triml": F.ltrim, "trimr": F.rtrim, "reverse": F.reverse, "capitalize": lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s)))), "blank?": lambda s: F.trim(s) == ""}
for _name, _f in _TEXT.items():
    FUNCTIONS[f"clojure.string/{_name}"] = lambda s, f=_f: f(col(s))
FUNCTIONS |= {
    "clojure.string/starts-with?": lambda s, p: col(s).startswith(col(p)), "clojure.string/ends-with?": lambda s, p: col(s).endswith(col(p)), "clojure.string/includes?": lambda s, p: col(s).contains(col(p)),
    "clojure.string/replace": lambda s, a, b: F.replace(col(s), col(a), col(b)), "clojure.string/split": lambda s, p: F.split(col(s), str(p)), "clojure.string/join": lambda sep, a: F.array_join(col(a), str(sep)),
    "clojure.string/index-of": lambda s, p, start=0: _place(col(s), col(p), start), "clojure.string/last-index-of": lambda s, p: _last_place(col(s), col(p)), "clojure.string/trim-newline": lambda s: F.regexp_replace(col(s), r"[\r\n]+$", ""),
    "clojure.string/replace-first": lambda s, a, b: F.when(col(s).contains(col(a)), F.concat(F.substring(col(s), F.lit(1), F.call_function("locate", col(a), col(s)) - 1), col(b), F.substring(col(s), F.call_function("locate", col(a), col(s)) + F.length(col(a)), F.length(col(s))))).otherwise(col(s)), "clojure.string/split-lines": lambda s: F.split(col(s), r"\r?\n"),
    ".indexOf": lambda s, p, start=0: F.coalesce(_place(col(s), col(p), start), F.lit(-1).cast("long")), ".lastIndexOf": lambda s, p: F.coalesce(_last_place(col(s), col(p)), F.lit(-1).cast("long")), ".isEmpty": lambda s: F.length(col(s)) == 0, ".isBlank": lambda s: F.trim(col(s)) == "", ".equals": lambda a, b: col(a) == col(b),
    ".equalsIgnoreCase": lambda a, b: F.lower(col(a)) == F.lower(col(b)), ".concat": lambda a, b: F.concat(col(a), col(b)), ".replace": lambda s, a, b: F.replace(col(s), col(a), col(b)), ".replaceAll": lambda s, p, b: F.regexp_replace(col(s), str(p), str(b)), ".matches": lambda s, p: col(s).rlike(f"^(?:{p})$"),
    ".charAt": lambda s, i: F.substring(col(s), col(i).cast("int") + 1, F.lit(1)), ".compareTo": lambda a, b: FUNCTIONS["compare"](a, b), ".repeat": lambda s, n: F.repeat(col(s), col(n).cast("int")), ".strip": lambda s: F.trim(col(s)), ".split": lambda s, p: F.split(col(s), str(p)), ".toString": lambda s: col(s).cast("string"),
    ".startsWith": lambda s, p: col(s).startswith(col(p)), ".endsWith": lambda s, p: col(s).endswith(col(p)), ".contains": lambda s, p: col(s).contains(col(p)), ".toUpperCase": lambda s: F.upper(col(s)), ".toLowerCase": lambda s: F.lower(col(s)), ".length": lambda s: F.length(col(s)).cast("long"), ".trim": lambda s: F.trim(col(s)), ".substring": lambda s, a, b=None: subs(s, a, b),
}
