"""Index access: facts in the order of an index, ranges, counts and metadata, as DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.catalog import Database


def _rows(db: Database, a: Any = None, e: Any = None, v: Any = None) -> DataFrame:
    """Facts ``e, a, v`` that agree with what is given; values as text unless an attribute is named."""
    if a is not None:
        df = db.scan(str(a)).select("e", F.lit(str(a)).alias("a"), "v")
    else:
        df = db.datoms()
    if e is not None:
        df = df.where(F.col("e") == e)
    if v is not None:
        df = df.where(F.col("v") == (v if a is not None else str(v)))
    return df


def _ordered(db: Database, df: DataFrame, index: str, down: bool = False) -> DataFrame:
    """By entity or by attribute; attributes stand in the order in which they were made."""
    place = {a: i for i, a in enumerate(db.attributes)}
    rank = F.lit(0)
    if len(place) > 1:
        rank = F.create_map(*(x for a, i in place.items() for x in (F.lit(a), F.lit(i))))[F.col("a")]
    keys = [F.col("e"), rank, F.col("v")] if index == ":eav" else [rank, F.col("v"), F.col("e")]
    return df.orderBy(*(k.desc() if down else k.asc() for k in keys))


def datoms(db: Database, index: str, c1: Any = None, c2: Any = None, c3: Any = None, n: int | None = None) -> DataFrame:
    """Facts whose first components agree, in the order of the index (``:eav`` or ``:ave``)."""
    e, a, v = (c1, c2, c3) if index == ":eav" else (c3, c1, c2)
    df = _ordered(db, _rows(db, a, e, v), index)
    return df if n is None else df.limit(n)


def search_datoms(db: Database, e: Any = None, a: Any = None, v: Any = None) -> DataFrame:
    return _rows(db, a, e, v)


def count_datoms(db: Database, e: Any = None, a: Any = None, v: Any = None) -> int:
    return _rows(db, a, e, v).count()


def seek_datoms(db: Database, index: str, c1: Any = None, c2: Any = None, c3: Any = None, n: int | None = None, back: bool = False) -> DataFrame:
    """``:ave a v``: facts of the attribute with a value from v on; ``:eav e a v``: of entities from e on, and if given of that
    attribute with a value from v on. ``back`` reads downwards."""
    past = (lambda x, y: x <= y) if back else (lambda x, y: x >= y)
    if index == ":ave":
        df = _rows(db, c1)
        df = df if c2 is None else df.where(past(F.col("v"), F.lit(c2)))
        df = df if c3 is None else df.where(past(F.col("e"), F.lit(c3)))
    else:
        df = _rows(db, c2)
        df = df if c1 is None else df.where(past(F.col("e"), F.lit(c1)))
        df = df if c3 is None else df.where(past(F.col("v"), F.lit(c3)))
    df = _ordered(db, df, index, back)
    return df if n is None else df.limit(n)


def rseek_datoms(db: Database, index: str, c1: Any = None, c2: Any = None, c3: Any = None, n: int | None = None) -> DataFrame:
    return seek_datoms(db, index, c1, c2, c3, n, back=True)


def index_range(db: Database, a: str, start: Any = None, end: Any = None) -> DataFrame:
    """Facts of an attribute with start <= v <= end, by value."""
    df = _rows(db, a)
    df = df if start is None else df.where(F.col("v") >= F.lit(start))
    df = df if end is None else df.where(F.col("v") <= F.lit(end))
    return _ordered(db, df, ":ave")


def cardinality(db: Database, a: str) -> int:
    """Distinct values of an attribute."""
    return db.scan(a).select("v").distinct().count()


def max_eid(db: Database) -> int:
    """The largest entity id."""
    tops = [db.tables[t].agg(F.max("e")).first()[0] for t in db.tables if dict(db.tables[t].dtypes)["e"] == "bigint"]
    return max((t for t in tops if t is not None), default=0)


def entid(db: Database, x: Any) -> Any:
    """The id of an id, lookup ref or ident; None if there is none."""
    from triplane.operators.pull import db_id

    if isinstance(x, str) and x.startswith(":"):
        return db_id(db, (":db/ident", x))
    return db_id(db, x)


def schema(db: Database) -> dict[str, dict]:
    return {a.name: dict(a.props) or ({":db/valueType": ":db.type/ref"} if a.ref else {}) for a in db.attributes.values()}


def opts(db: Database) -> dict:
    """What a database is made of: its tables and their keys, and the indexes that are kept with it."""
    return {":tables": list(db.tables), ":keyed": sorted(db.keyed & set(db.tables)), ":attributes": len(db.attributes), ":search-indexes": sorted(db.indexes), ":session-time-zone": db.spark.conf.get("spark.sql.session.timeZone")}


def analyze(db: Database, a: str | None = None) -> DataFrame:
    """Per attribute: facts, distinct values (estimated), least and greatest value as text."""
    out = None
    for name in [a] if a else list(db.attributes):
        row = db.scan(name).agg(F.lit(name).alias("a"), F.count("*").alias("facts"), F.approx_count_distinct(F.col("v").cast("string")).alias("values"), F.min(F.col("v").cast("string")).alias("least"), F.max(F.col("v").cast("string")).alias("greatest"))
        out = row if out is None else out.union(row)
    return out
