"""Transactions: a batch of changes gives a new version of a database.

What a batch names is read before it is applied, by one query per table for all its entities and one per unique attribute
for all its values, and resolved on the driver (temporary ids, upserts, compare-and-set). What it touches is then merged into
the tables by joins, so data that it doesn't name is never collected; references to entities that go are cut by the merge
alone. Tables are immutable, so a failed batch leaves nothing behind, and readers keep the version they have.
"""

from __future__ import annotations

import itertools
import queue
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.catalog import TYPES, Attribute, Database, infer
from triplane.operators.index import max_eid
from triplane.storage import durable

_temporary = itertools.count(1_000_000)


def tempid(part: Any = None, x: int | None = None) -> int:
    return x if x is not None else -next(_temporary)


def squuid() -> str:
    """A UUID whose first half rises with time."""
    import time

    return str(uuid.UUID(f"{int(time.time()):08x}{uuid.uuid4().hex[8:]}"))


def squuid_time_millis(x: str) -> int:
    return int(str(x)[:8], 16) * 1000


@dataclass
class Report:
    """What a transaction did: ``tx_data`` has (e, a, v, added).

    ``cut_references`` has the facts (e, a, v as text) that pointed to entities that went; ``dropped`` has those entities.
    """

    db_before: Database
    db_after: Database
    tx_data: list[tuple]
    tempids: dict
    tx_meta: Any = None
    cut_references: DataFrame | None = None
    dropped: tuple = ()


@dataclass
class Connection:
    """The current version of a database; listeners hear of each change. A store, if there is one, has each change first."""

    db: Database
    listeners: dict[Any, Callable[[Report], Any]] = field(default_factory=dict)
    log: list[Report] = field(default_factory=list)
    closed: bool = False
    store: Any = None
    _lock: Any = field(default_factory=threading.RLock, repr=False)
    _queue: Any = field(default=None, repr=False)

    def transact(self, tx_data: list, meta: Any = None) -> Report:
        with self._lock:
            self._open()
            return self._commit(with_(self.db, tx_data, meta))

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the connection is closed")

    def _commit(self, report: Report) -> Report:
        if self.store is not None:
            self.store.append(report)
        self.db = report.db_after
        self.log.append(report)
        for f in list(self.listeners.values()):
            f(report)
        return report

    def transact_async(self, tx_data: list, callback: Callable[[Report], Any] | None = None) -> Future:
        """A transaction by a worker of its own; those that wait are made one, whose report all of them get."""
        self._open()
        if self._queue is None:
            self._queue = _Worker(self)
        return self._queue.put(list(tx_data), callback)

    @contextmanager
    def transaction(self) -> Iterator[Connection]:
        """A connection whose changes become this one's at the end, unless it's aborted or fails. Others wait meanwhile."""
        with self._lock:
            self._open()
            inside = Connection(self.db)
            yield inside
            if not inside.closed:
                for report in inside.log:
                    self._commit(report)

    def abort(self) -> None:
        """Ends a transaction without its changes."""
        self.close()

    def query(self, form: Any, *inputs: Any) -> Any:
        """The answer of a query over the current version and further inputs."""
        from triplane.api import answer

        return answer(form, self.db, *inputs)

    def pull(self, pattern: Any, eid: Any) -> dict | None:
        from triplane.operators.pull import pull

        return pull(self.db, pattern, eid)

    def entity(self, eid: Any) -> Any:
        from triplane.operators.entity import entity

        return entity(self.db, eid)

    def listen(self, callback: Callable[[Report], Any], key: Any = None) -> Any:
        key = key if key is not None else uuid.uuid4().hex
        self.listeners[key] = callback
        return key

    def unlisten(self, key: Any) -> None:
        self.listeners.pop(key, None)

    def update_schema(self, update: dict | None = None, drop: list[str] = (), rename: dict[str, str] | None = None) -> None:
        with self._lock:
            self.reset(update_schema(self.db, update or {}, list(drop), rename or {}))

    def reset(self, db: Database) -> None:
        """Another database in place of the current one."""
        with self._lock:
            if self.store is not None:
                db = self.store.write(db)
            self.db = db

    def clear(self) -> None:
        self.reset(Database(self.db.spark, {n: d.limit(0) for n, d in self.db.tables.items()}, dict(self.db.attributes)))

    def compact(self) -> None:
        """Writes the current version as a whole, so that opening it needs no log."""
        self.reset(self.db)

    def close(self) -> None:
        if self._queue is not None:
            self._queue.stop()
        self.closed = True


class _Worker:
    """Applies waiting transactions of a connection together."""

    def __init__(self, conn: Connection):
        self.conn, self.waiting = conn, queue.Queue()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def put(self, tx_data: list, callback: Callable[[Report], Any] | None) -> Future:
        done: Future = Future()
        if callback:
            done.add_done_callback(lambda f: callback(f.result()) if not f.exception() else None)
        self.waiting.put((tx_data, done))
        return done

    def stop(self) -> None:
        self.waiting.put(None)
        self.thread.join()

    def _run(self) -> None:
        going = True
        while going:
            batch = [self.waiting.get()]
            while not self.waiting.empty():
                batch.append(self.waiting.get())
            going = None not in batch
            self._apply([x for x in batch if x is not None])

    def _apply(self, batch: list[tuple[list, Future]]) -> None:
        if not batch:
            return
        try:
            report = self.conn.transact([x for data, _ in batch for x in data])
        except Exception as e:
            if len(batch) == 1:
                batch[0][1].set_exception(e)
            else:  # one of them fails: each for itself
                for one in batch:
                    self._apply([one])
            return
        for _, done in batch:
            done.set_result(report)


def empty_db(spark: SparkSession, schema: dict | None = None) -> Database:
    db = Database(spark, {"entities": spark.createDataFrame([], "e long")}, {})
    return update_schema(db, schema or {})


def create_conn(spark: SparkSession, schema: dict | None = None) -> Connection:
    return Connection(empty_db(spark, schema))


def update_schema(db: Database, update: dict, drop: list[str] = (), rename: dict[str, str] | None = None) -> Database:
    """Attributes added or changed, dropped (only without facts) and renamed."""
    db = Database(db.spark, dict(db.tables), dict(db.attributes), db.keyed, dict(db.indexes))
    for name in drop:
        a = db.attribute(name)
        if db.scan(name).limit(1).count():
            raise ValueError(f"{name} has facts and can't be dropped")
        db.attributes.pop(name)
        db.indexes.pop(name, None)
        if a.many:
            db.tables.pop(a.table)
        else:
            db.tables[a.table] = db.tables[a.table].drop(a.column)
    for old, new in (rename or {}).items():
        a = db.attributes.pop(old)
        if old in db.indexes:
            db.indexes[new] = db.indexes.pop(old)
        db.attributes[new] = Attribute(new, a.table, a.column, a.many, a.ref, a.unique, a.component, a.props)
    for name, props in update.items():
        _declare(db, name, props, None)
    return db


def _declare(db: Database, name: str, props: dict, values: list | None) -> Attribute:
    if name in db.attributes and not props:
        return db.attributes[name]
    many = props.get(":db/cardinality") == ":db.cardinality/many"
    kind = TYPES.get(str(props.get(":db/valueType"))) or (T.ArrayType(T.StringType()) if ":db/tupleAttrs" in props else infer(values or []))
    old = db.attributes.get(name)
    if old and old.many != many:
        raise ValueError(f"the cardinality of {name} can't change")
    a = Attribute(name, name if many else "entities", "v" if many else name, many, props.get(":db/valueType") == ":db.type/ref", props.get(":db/unique"), bool(props.get(":db/isComponent")), dict(props))
    db.attributes[name] = a
    if many and name not in db.tables:
        db.tables[name] = db.spark.createDataFrame([], T.StructType([T.StructField("e", T.LongType()), T.StructField("v", kind)]))
    elif not many and name not in db.tables["entities"].columns:
        db.tables["entities"] = db.tables["entities"].withColumn(name, F.lit(None).cast(kind))
    return a


#: Ids or values named up to this number are looked for by a filter that reaches the scan, more of them by a join.
FEW = 500
#: Versions whose changes are read as joins over their base before a table is stored as one.
MOST_CHANGES = 4


def _among(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose ``column`` is one of some values that a batch names."""
    if len(values) <= FEW:
        return rows.where(F.col(column).isin(*values))
    asked = rows.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(column, rows.schema[column].dataType)]))
    return rows.join(asked, column, "left_semi")


def _plain(v: Any) -> Any:
    """A value as a key of a map."""
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


class _Batch:
    def __init__(self, db: Database):
        self.db = Database(db.spark, dict(db.tables), dict(db.attributes), db.keyed, dict(db.indexes))
        self.before = db
        self.tempids: dict[Any, int] = {}
        self.next = max_eid(db)
        self.facts: list[tuple] = []
        self.adds: dict[str, list[tuple]] = {}
        self.cuts: dict[str, list[tuple]] = {}
        self.current: dict[tuple, Any] = {}
        self.held: dict[tuple, list] = {}
        self.owners: dict[tuple, int | None] = {}
        self.dropped: list[int] = []
        self.taken: dict[tuple, int] = {}
        self.touched: set[tuple] = set()

    # --- what the batch names, read at once ---
    def prepare(self, tx_data: list) -> None:
        ids: set[int] = set()
        names: dict[str, set] = {}
        uniques: dict[str, list] = {}
        whole: list = []

        def unique(a: Any, v: Any) -> None:
            found = self.db.attributes.get(str(a))
            if found and found.unique and v is not None and not isinstance(v, (list, dict, set)):
                uniques.setdefault(found.name, []).append(v)

        def ref(x: Any) -> None:
            if isinstance(x, dict):
                form(x)
            elif isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[0], str) and x[0].startswith(":"):
                unique(*x)
            elif isinstance(x, str) and x.startswith(":"):
                unique(":db/ident", x)

        def named(e: Any, a: Any, v: Any = None) -> None:
            if isinstance(e, int) and not isinstance(e, bool) and e > 0:
                ids.add(e)
            ref(e)
            names.setdefault(str(a), set())
            unique(a, v)
            found = self.db.attributes.get(str(a))
            if found and found.ref:
                for x in v if isinstance(v, (list, set, frozenset)) and found.many else [v]:
                    ref(x)

        def form(m: dict) -> None:
            for k, v in m.items():
                if k != ":db/id":
                    named(m.get(":db/id"), k, v)
                    for x in v if isinstance(v, (list, set, frozenset)) else [v]:
                        if isinstance(x, dict):
                            form(x)

        for x in tx_data:
            if isinstance(x, dict):
                form(x)
            elif isinstance(x, (list, tuple)) and not callable(x[0]):
                op, *args = x
                if op in (":db/retractEntity", ":db.fn/retractEntity"):
                    ref(args[0])
                    whole.append(args[0])
                elif op in (":db.fn/call", ":db/udf"):
                    continue
                else:
                    named(*args[:3])
        for a, values in uniques.items():
            self.find_owners(a, values)
        ids |= {e for e in self.owners.values() if e is not None}
        attributes = [a for a in names if a in self.db.attributes]
        attributes += [str(p) for a in self.db.attributes.values() for p in a.props.get(":db/tupleAttrs", ())]
        self.load(sorted(ids), attributes)
        going = sorted({e for e in (x if isinstance(x, int) else self.owners.get((str(x[0]), x[1])) if isinstance(x, (list, tuple)) else None for x in whole) if e})
        while going:  # a level of components at a time
            self.load(going, list(self.db.attributes))
            below = {v for a in self.db.attributes.values() if a.component for e in going for v in self.values_of(e, a.name)}
            known = {e for e, _ in self.current} | {e for e, _ in self.held}
            going = sorted(v for v in below if v not in known)

    def find_owners(self, a: str, values: list) -> None:
        """The entities that have some values of a unique attribute."""
        missing = list(dict.fromkeys(v for v in values if (a, _plain(v)) not in self.owners))
        if missing:
            found = {_plain(r.v): r.e for r in _among(self.before.scan(a), "v", missing).collect()}
            if not self.db.attribute(a).many:
                for v, e in found.items():
                    self.current.setdefault((e, a), v)
            self.owners |= {(a, _plain(v)): found.get(_plain(v)) for v in missing}

    def owner(self, a: str, v: Any) -> int | None:
        """The entity that has a value of a unique attribute, as the batch has left it."""
        self.find_owners(a, [v])
        for e in (self.taken.get((a, _plain(v))), self.owners[a, _plain(v)]):
            if e is not None and (self.db.attribute(a).many or self.value_of(e, a) == v):
                return e
        return None

    def load(self, ids: list[int], attributes: list[str]) -> None:
        """The values that entities have of some attributes: one query per table."""
        tables: dict[str, list[Attribute]] = {}
        for n in dict.fromkeys(attributes):
            if n in self.before.attributes:
                a = self.before.attributes[n]
                tables.setdefault(a.table, []).append(a)
        for t, own in tables.items():
            rows = self.before.tables[t]
            if not ids or dict(rows.dtypes)["e"] != "bigint":
                continue
            found: dict[int, list] = {}
            for r in _among(rows, "e", ids).select("e", *dict.fromkeys(a.column for a in own)).collect():
                found.setdefault(r["e"], []).append(r)
            for e in ids:
                for a in own:
                    values = [r[a.column] for r in found.get(e, []) if r[a.column] is not None]
                    if a.many:
                        self.held.setdefault((e, a.name), values)
                    else:
                        self.current.setdefault((e, a.name), values[0] if values else None)

    def values_of(self, e: int, a: str) -> list:
        """The values of an attribute before the batch."""
        attribute = self.db.attribute(a)
        cache = self.held if attribute.many else self.current
        if (e, a) not in cache:
            self.load([e], [a])
        found = cache.setdefault((e, a), [] if attribute.many else None)
        return found if attribute.many else [found] if found is not None else []

    def new_id(self) -> int:
        self.next += 1
        for a in self.before.attributes.values():  # nothing has a new id yet
            (self.held if a.many else self.current).setdefault((self.next, a.name), [] if a.many else None)
        return self.next

    def resolve(self, e: Any) -> int:
        if isinstance(e, (list, tuple)):
            found = self.owner(str(e[0]), e[1])
            if found is None:
                raise ValueError(f"nothing has {e[0]} {e[1]!r}")
            return found
        if isinstance(e, str) and e.startswith(":"):
            return self.resolve((":db/ident", e))
        if e is None or isinstance(e, str) or (isinstance(e, int) and e < 0):
            if e is None:
                return self.new_id()
            if e not in self.tempids:
                self.tempids[e] = self.new_id()
            return self.tempids[e]
        self.next = max(self.next, e)
        return e

    def value_of(self, e: int, a: str) -> Any:
        """The value of an attribute of cardinality one, as the batch has left it."""
        if (e, a) not in self.current:
            self.values_of(e, a) if a in self.before.attributes else self.current.setdefault((e, a), None)
        return self.current[e, a]

    def add(self, e: int, name: str, v: Any) -> None:
        if v is None:
            raise ValueError(f"{name} can't be nil")
        a = self.db.attributes.get(name) or _declare(self.db, name, {}, [v])
        if a.ref or (isinstance(v, (tuple, list)) and len(v) == 2 and isinstance(v[0], str) and v[0].startswith(":") and a.ref):
            v = self.resolve(v)
        if a.unique:
            if (self.owner(name, v) if name in self.before.attributes else self.taken.get((name, _plain(v)))) not in (None, e):
                raise ValueError(f"{name} {v!r} is another entity's")
            self.taken[name, _plain(v)] = e
        if not a.many:
            old = self.value_of(e, name)
            if old == v and type(old) is type(v):
                return
            if old is not None:
                self.facts.append((e, name, old, False))
            self.current[e, name] = v
            if (e, name) in self.touched:
                self.adds[name] = [p for p in self.adds.get(name, []) if p[0] != e]
                self.cuts[name] = [p for p in self.cuts.get(name, []) if p[0] != e]
            self.touched.add((e, name))
            self.adds.setdefault(name, []).append((e, v))
            self.facts.append((e, name, v, True))
            return
        again = (e, name) in self.touched
        if again and (e, v) in self.adds.get(name, []) or v in self.values_of(e, name) and not (again and (e, v) in self.cuts.get(name, [])):
            return
        self.touched.add((e, name))
        self.adds.setdefault(name, []).append((e, v))
        if again:
            self.cuts[name] = [p for p in self.cuts.get(name, []) if p != (e, v)]
        self.facts.append((e, name, v, True))

    def cut(self, e: int, name: str, v: Any = None) -> None:
        a = self.db.attribute(name)
        if v is not None and a.ref:
            v = self.resolve(v)
        if a.many:
            again = (e, name) in self.touched
            held = [x for x in self.values_of(e, name) if not again or (e, x) not in self.cuts.get(name, [])] + ([y for x, y in self.adds.get(name, []) if x == e] if again else [])
        else:
            held = [x for x in [self.value_of(e, name)] if x is not None]
        for x in held:
            if v is None or x == v:
                self.cuts.setdefault(name, []).append((e, x))
                if (e, name) in self.touched:
                    self.adds[name] = [p for p in self.adds.get(name, []) if p != (e, x)]
                self.touched.add((e, name))
                self.facts.append((e, name, x, False))
                if not a.many:
                    self.current[e, name] = None

    def drop_entity(self, e: int) -> None:
        """All facts of an entity and all references to it; its components go with it."""
        if e in self.dropped:
            return
        self.dropped.append(e)
        for a in list(self.db.attributes.values()):
            below = [v for v in [*self.values_of(e, a.name), *(y for x, y in self.adds.get(a.name, []) if x == e)] if a.component]
            self.cut(e, a.name)
            for b in below:
                self.drop_entity(b)
            if a.ref:
                for x, y in [p for p in self.adds.get(a.name, []) if p[1] == e]:
                    self.cut(x, a.name, y)

    def map_form(self, m: dict) -> int:
        m = dict(m)
        e = m.pop(":db/id", None)
        for k, v in m.items():
            a = self.db.attributes.get(k)
            if a and a.unique == ":db.unique/identity" and not isinstance(v, (list, dict)):
                found = self.owner(k, v)
                if found is not None:
                    if isinstance(e, int) and e > 0 and e != found:
                        raise ValueError(f"{k} {v!r} is another entity's")
                    if e is not None and not (isinstance(e, int) and e > 0):
                        self.tempids[e] = found
                    e = found
                    break
        e = self.resolve(e)
        for k, v in m.items():
            space, _, last = k.rpartition("/")
            reverse = last.startswith("_") if space else k.startswith(":_")
            name = (f"{space}/{last[1:]}" if space else ":" + k[2:]) if reverse else k
            a = self.db.attributes.get(name)
            many = a is not None and a.many
            for x in v if (isinstance(v, (list, set, frozenset)) and (many or reverse)) else [v]:
                if isinstance(x, dict):
                    x = self.map_form(x)
                if reverse:
                    self.add(self.resolve(x), name, e)
                else:
                    self.add(e, name, x)
        self._composites(e)
        return e

    def _composites(self, e: int) -> None:
        for a in list(self.db.attributes.values()):
            if parts := a.props.get(":db/tupleAttrs"):
                made = [self.value_of(e, str(p)) for p in parts]
                if any(x is not None for x in made):
                    self.add(e, a.name, [None if x is None else str(x) for x in made])

    def apply(self, x: Any) -> None:
        if isinstance(x, dict):
            self.map_form(x)
            return
        if hasattr(x, "tx_data"):  # an entity with staged edits
            for y in x.tx_data():
                self.apply(y)
            return
        op, *args = x
        if callable(op):
            for y in op(self.db, *args):
                self.apply(y)
        elif op == ":db/add":
            e = self.resolve(args[0])
            self.add(e, args[1], args[2])
            self._composites(e)
        elif op == ":db/retract":
            self.cut(self.resolve(args[0]), *args[1:])
        elif op == ":db.fn/retractAttribute":
            self.cut(self.resolve(args[0]), args[1])
        elif op in (":db/retractEntity", ":db.fn/retractEntity"):
            self.drop_entity(self.resolve(args[0]))
        elif op in (":db/cas", ":db.fn/cas"):
            e = self.resolve(args[0])
            if self.value_of(e, args[1]) != args[2]:
                raise ValueError(f":db.fn/cas failed: {args[1]} is {self.value_of(e, args[1])!r}, not {args[2]!r}")
            self.add(e, args[1], args[3])
        elif op == ":db.fn/call":
            for y in args[0](self.db, *args[1:]):
                self.apply(y)
        elif op == ":db/udf":
            from triplane.functions.registry import REGISTRY

            for y in REGISTRY.resolve(args[0])(self.db, *args[1:]):
                self.apply(y)
        elif op == ":db.fn/patchIdoc":
            from triplane.operators.idoc import patch

            e = self.resolve(args[0])
            self.add(e, args[1], patch(self.value_of(e, args[1]), args[2]))
        else:
            raise ValueError(f"unknown operation {op}")

    def merged(self) -> Database:
        db, spark = self.db, self.db.spark
        changed = [n for n in dict.fromkeys([*self.adds, *self.cuts]) if not db.attributes[n].many and (self.adds.get(n) or self.cuts.get(n))]
        referring = [a for a in db.attributes.values() if a.ref] if self.dropped else []
        for table in dict.fromkeys([db.attributes[n].table for n in changed] + [a.table for a in referring if not a.many]):
            cut = [a.column for a in referring if a.table == table and not a.many]
            names = [n for n in changed if db.attributes[n].table == table]
            made = self._table(table, names, cut)
            db.tables[table] = _version(made, self.before.tables.get(table))
        for n in dict.fromkeys([*self.adds, *self.cuts, *(a.name for a in referring)]):
            a = db.attributes[n]
            if a.many and (self.adds.get(n) or self.cuts.get(n) or a in referring):
                df = db.tables[n]
                if cuts := self.cuts.get(n):
                    df = df.join(spark.createDataFrame(cuts, df.schema), ["e", "v"], "left_anti")
                if a in referring:
                    df = df.where(~F.col("v").isin(*self.dropped))
                if adds := self.adds.get(n):
                    df = df.unionByName(spark.createDataFrame(adds, df.schema)).distinct()
                db.tables[n] = _version(df, self.before.tables.get(n))
        for n, index in list(db.indexes.items()):  # of the kept search indexes only what changed is analysed anew
            touched = sorted({e for e, _ in [*self.adds.get(n, []), *self.cuts.get(n, [])]})
            if touched:
                ids = spark.createDataFrame([(e,) for e in touched], "doc long")
                rows = _among(db.scan(n), "e", touched).select(F.col("e").alias("doc"), F.col("v").alias("text"))
                db.indexes[n] = index.without(ids).add(rows)
        return db

    def references(self) -> DataFrame | None:
        """The facts ``e, a, v`` (as text) of other entities that point to those that went."""
        out = None
        for a in self.before.attributes.values():
            if self.dropped and a.ref:
                rows = _among(self.before.scan(a.name), "v", self.dropped).where(~F.col("e").isin(*self.dropped)).select("e", F.lit(a.name).alias("a"), F.col("v").cast("string").alias("v"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _table(self, table: str, names: list[str], cut: list[str]) -> DataFrame:
        """A table of entities with the batch's values of some attributes; entities without any fact are gone.

        ``cut``: columns whose references to dropped entities go. The batch's rows are joined to the table, as a broadcast if
        they are few; the table itself is neither collected nor shuffled for them.
        """
        wide = self.db.tables[table]
        column = {n: self.db.attributes[n].column for n in names}
        changes: dict[int, dict] = {}
        for n in names:
            for e, _ in self.cuts.get(n, []):
                changes.setdefault(e, {})[n] = None
            for e, v in self.adds.get(n, []):
                changes.setdefault(e, {})[n] = v
        kinds = {f.name: f.dataType for f in wide.schema.fields}
        facts = [c for c in wide.columns if c != "e"]
        gone = {c: F.when(F.col(f"`{c}`").isin(*self.dropped), F.lit(None)).otherwise(F.col(f"`{c}`")) for c in cut}
        base = wide.select("e", *(gone.get(c, F.col(f"`{c}`")).alias(c) for c in facts)) if cut else wide
        if changes:
            rows = [(e, *(x for n in names for x in (c.get(n), n in c))) for e, c in changes.items()]
            fields = [T.StructField("e", kinds["e"])] + [f for n in names for f in (T.StructField(f"{n}'", kinds[column[n]]), T.StructField(f"{n}?", T.BooleanType()))]
            patch = self.db.spark.createDataFrame(rows, T.StructType(fields))
            patch = F.broadcast(patch) if len(rows) <= 20 * FEW else patch
            own = {column[n]: F.when(F.coalesce(F.col(f"`{n}?`"), F.lit(False)), F.col(f"`{n}'`")).otherwise(F.col(f"`{column[n]}`")) for n in names}
            old = base.join(patch, "e", "left").select("e", *(own.get(c, F.col(f"`{c}`")).alias(c) for c in facts))
            made = patch.join(_among(base.select("e"), "e", list(changes)), "e", "left_anti").select("e", *((F.col(f"`{n}'`") if (n := next((x for x in names if column[x] == c), None)) else F.lit(None).cast(kinds[c])).alias(c) for c in facts))
            base = old.unionByName(made)
        return base.where(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in facts)).isNotNull()) if facts else base


def _version(df: DataFrame, before: DataFrame | None) -> DataFrame:
    """A table's next version, stored as one if its base lies too many changes behind."""
    n = (before.__dict__.get("_triplane_changes", 0) if before is not None else 0) + 1
    if n >= MOST_CHANGES:
        return durable(df)
    df.__dict__["_triplane_changes"] = n
    return df


def with_(db: Database, tx_data: list, meta: Any = None) -> Report:
    """The report of a transaction that nobody else sees."""
    batch = _Batch(db)
    batch.prepare(tx_data)
    for x in tx_data:
        batch.apply(x)
    return Report(db, batch.merged(), batch.facts, dict(batch.tempids), meta, batch.references(), tuple(batch.dropped))


def replay(db: Database, facts: list[tuple], dropped: list[int]) -> Database:
    """``db`` after the facts (e, a, v, added) of a logged transaction."""
    batch = _Batch(db)
    batch.dropped = list(dropped)
    for e, name, v, added in facts:
        a = batch.db.attributes.get(name) or _declare(batch.db, name, {}, [v])
        to, other = (batch.adds, batch.cuts) if added else (batch.cuts, batch.adds)
        same = (lambda p, e=e, v=v, a=a: p[0] == e and (not a.many or p[1] == v))
        other[name] = [p for p in other.get(name, []) if not same(p)]
        to[name] = [p for p in to.get(name, []) if not same(p)] + [(e, v)]
    return batch.merged()


def db_with(db: Database, tx_data: list) -> Database:
    return with_(db, tx_data).db_after


def tx_log(spark: SparkSession, reports: list[Report], first: int = 1) -> DataFrame:
    """A log of transactions as rows ``tx, e, a, v, added``; values as text."""
    rows = [(t, e, a, str(v), added) for t, r in enumerate(reports, first) for e, a, v, added in r.tx_data]
    out = spark.createDataFrame(rows, "tx long, e long, a string, v string, added boolean")
    for t, r in enumerate(reports, first):
        if r.cut_references is not None:
            out = out.unionByName(r.cut_references.select(F.lit(t).cast("long").alias("tx"), "e", "a", "v", F.lit(False).alias("added")))
    return out
