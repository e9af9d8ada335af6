"""Ordered key-value tables over DataFrames of columns ``k`` and ``v``, and list tables with many values a key.

Ranges are vectors such as ``[":closed", 1, 5]``; a name that ends in ``-back`` reads downwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Changes of a table in a folder after which it is written whole.
MOST_CHANGES = 16


def inside(c: Column, spec: Any) -> Column:
    """Whether a key is in a range."""
    kind, *ends = [spec] if isinstance(spec, str) else list(spec)
    kind = str(kind).lstrip(":").removesuffix("-back")
    if str(spec if isinstance(spec, str) else spec[0]).endswith("-back") and len(ends) == 2 and ends[0] > ends[1]:
        ends = ends[::-1]
    a, b = (ends + [None, None])[:2]
    tests = {
        "all": lambda: F.lit(True), "at-least": lambda: c >= a, "at-most": lambda: c <= a, "greater-than": lambda: c > a, "less-than": lambda: c < a,
        "closed": lambda: (c >= a) & (c <= b), "closed-open": lambda: (c >= a) & (c < b), "open": lambda: (c > a) & (c < b), "open-closed": lambda: (c > a) & (c <= b),
    }
    if kind not in tests:
        raise ValueError(f"unknown range {spec}")
    return tests[kind]()


def backward(spec: Any) -> bool:
    return str(spec if isinstance(spec, str) else spec[0]).endswith("-back")


class Dbi:
    """A table of unique keys."""

    def __init__(self, df: DataFrame):
        self.df = df

    def range(self, spec: Any = ":all") -> DataFrame:
        key = F.col("k").desc() if backward(spec) else F.col("k").asc()
        return self.df.where(inside(F.col("k"), spec)).orderBy(key, "v")

    get_range = range

    def get_value(self, k: Any) -> Any:
        row = self.df.where(F.col("k") == k).select("v").first()
        return row[0] if row else None

    def get_rank(self, k: Any) -> int | None:
        """How many keys are less; None if the key isn't there."""
        if self.get_value(k) is None:
            return None
        return self.df.where(F.col("k") < k).count()

    def ranked(self, buckets: int = 64) -> DataFrame:
        """Each key with its rank from 0: ranges of keys are counted, and ranks inside a range start from the ranges before."""
        from triplane.storage import durable

        parts = durable(self.df.repartitionByRange(buckets, "k").withColumn("_p", F.spark_partition_id()))
        starts = parts.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_s", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inner = F.row_number().over(Window.partitionBy("_p").orderBy("k")) - 1
        return parts.join(F.broadcast(starts.select("_p", "_s")), "_p").select("k", "v", (F.col("_s") + inner).alias("rank"))  # ``buckets`` rows

    def get_by_rank(self, rank: int) -> Row | None:
        return self.ranked().where(F.col("rank") == rank).select("k", "v").first()

    def sample(self, n: int) -> DataFrame:
        return self.df.orderBy(F.rand()).limit(n)

    def get_first(self, spec: Any = ":all") -> Row | None:
        return self.range(spec).first()

    def get_first_n(self, n: int, spec: Any = ":all") -> DataFrame:
        return self.range(spec).limit(n)

    def range_seq(self, spec: Any = ":all") -> Iterator[Row]:
        return self.range(spec).toLocalIterator()

    def key_range(self, spec: Any = ":all") -> DataFrame:
        return self.range(spec).select("k").distinct().orderBy(F.col("k").desc() if backward(spec) else F.col("k"))

    def key_range_count(self, spec: Any = ":all", cap: int | None = None) -> int:
        n = self.df.where(inside(F.col("k"), spec)).select("k").distinct()
        return (n if cap is None else n.limit(cap)).count()

    def range_count(self, spec: Any = ":all") -> int:
        return self.df.where(inside(F.col("k"), spec)).count()

    key_range_list_count = range_count

    def range_filter(self, test: Callable[[Column, Column], Column], spec: Any = ":all") -> DataFrame:
        return self.range(spec).where(test(F.col("k"), F.col("v")))

    def range_filter_count(self, test: Callable[[Column, Column], Column], spec: Any = ":all") -> int:
        return self.df.where(inside(F.col("k"), spec) & test(F.col("k"), F.col("v"))).count()

    def range_keep(self, f: Callable[[Column, Column], Column], spec: Any = ":all") -> DataFrame:
        return self.range(spec).select(f(F.col("k"), F.col("v")).alias("x")).where("x is not null")

    def range_some(self, f: Callable[[Column, Column], Column], spec: Any = ":all") -> Any:
        row = self.range_keep(f, spec).first()
        return row[0] if row else None

    def get_some(self, test: Callable[[Column, Column], Column], spec: Any = ":all") -> Row | None:
        return self.range_filter(test, spec).first()

    def visit(self, visitor: Callable[[Any, Any], Any], spec: Any = ":all") -> None:
        """Calls ``visitor`` on keys and values in order until it gives False."""
        for row in self.range_seq(spec):
            if visitor(row.k, row.v) is False:
                return

    def visit_key_range(self, visitor: Callable[[Any], Any], spec: Any = ":all") -> None:
        for row in self.key_range(spec).toLocalIterator():
            if visitor(row.k) is False:
                return

    def entries(self) -> int:
        return self.df.count()

    def stat(self) -> dict:
        return {"entries": self.entries(), "partitions": self.df.rdd.getNumPartitions()}

    def changes(self, txs: list[tuple]) -> DataFrame:
        """Rows ``k, v, put`` of ``(":put", k, v)`` and ``(":del", k)``, the last of a key."""
        last: dict[Any, tuple] = {t[1]: t for t in txs}
        rows = [(t[1], t[2] if str(t[0]) == ":put" else None, str(t[0]) == ":put") for t in last.values()]
        return self.df.sparkSession.createDataFrame(rows, _nullable(self.df).add("put", "boolean"))

    def changed(self, changes: DataFrame) -> Dbi:
        """The table after changes."""
        return type(self)(self.df.join(changes.select("k"), "k", "left_anti").select("k", "v").unionByName(changes.where("put").select("k", "v")))

    def transact(self, txs: list[tuple]) -> Dbi:
        """A new table after ``(":put", k, v)`` and ``(":del", k)``, the last of a key wins."""
        return self.changed(self.changes(txs))


def _nullable(df: DataFrame) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in df.select("k", "v").schema.fields])


class ListDbi(Dbi):
    """A table of keys with sets of values, kept in order."""

    def changes(self, txs: list[tuple]) -> DataFrame:
        """Rows ``k, v, put`` of ``:put-list``, ``:del-list``, ``:put`` (one value) and ``:del`` (all of a key: a null value)."""
        last: dict[tuple, bool] = {}
        for op, k, *rest in txs:
            if str(op) == ":del":
                last = {x: put for x, put in last.items() if x[0] != k} | {(k, None): False}
            else:
                for v in rest[0] if str(op) in (":put-list", ":del-list") else [rest[0]]:
                    last[k, v] = str(op) in (":put", ":put-list")
        return self.df.sparkSession.createDataFrame([(k, v, put) for (k, v), put in last.items()], _nullable(self.df).add("put", "boolean"))

    def changed(self, changes: DataFrame) -> ListDbi:
        left = self.df.join(changes.where("v is null").select("k"), "k", "left_anti").join(changes.where("v is not null").select("k", "v"), ["k", "v"], "left_anti")
        return ListDbi(left.select("k", "v").unionByName(changes.where("put").select("k", "v")))

    def put_list_items(self, k: Any, values: list) -> ListDbi:
        more = self.df.sparkSession.createDataFrame([(k, v) for v in values], self.df.schema)
        return ListDbi(self.df.unionByName(more).distinct())

    def del_list_items(self, k: Any, values: list | None = None) -> ListDbi:
        gone = F.col("k") == k
        return ListDbi(self.df.where(~(gone if values is None else gone & F.col("v").isin(*values))))

    def get_list(self, k: Any) -> DataFrame:
        return self.df.where(F.col("k") == k).select("v").orderBy("v")

    def list_count(self, k: Any) -> int:
        return self.df.where(F.col("k") == k).count()

    def in_list(self, k: Any, v: Any) -> bool:
        return bool(self.df.where((F.col("k") == k) & (F.col("v") == v)).limit(1).count())

    def near_list(self, k: Any, v: Any) -> Any:
        """The least value of a key that is not less than v."""
        return self.df.where((F.col("k") == k) & (F.col("v") >= v)).agg(F.min("v")).first()[0]

    def list_range(self, keys: Any = ":all", values: Any = ":all") -> DataFrame:
        order = [F.col("k").desc() if backward(keys) else F.col("k").asc(), F.col("v").desc() if backward(values) else F.col("v").asc()]
        return self.df.where(inside(F.col("k"), keys) & inside(F.col("v"), values)).orderBy(*order)

    def list_range_count(self, keys: Any = ":all", values: Any = ":all") -> int:
        return self.df.where(inside(F.col("k"), keys) & inside(F.col("v"), values)).count()

    def list_range_first(self, keys: Any = ":all", values: Any = ":all") -> Row | None:
        return self.list_range(keys, values).first()

    def list_range_first_n(self, n: int, keys: Any = ":all", values: Any = ":all") -> DataFrame:
        return self.list_range(keys, values).limit(n)

    def list_range_filter(self, test: Callable[[Column, Column], Column], keys: Any = ":all", values: Any = ":all") -> DataFrame:
        return self.list_range(keys, values).where(test(F.col("k"), F.col("v")))

    def list_range_filter_count(self, test: Callable[[Column, Column], Column], keys: Any = ":all", values: Any = ":all") -> int:
        return self.df.where(inside(F.col("k"), keys) & inside(F.col("v"), values) & test(F.col("k"), F.col("v"))).count()

    def list_range_keep(self, f: Callable[[Column, Column], Column], keys: Any = ":all", values: Any = ":all") -> DataFrame:
        return self.list_range(keys, values).select(f(F.col("k"), F.col("v")).alias("x")).where("x is not null")

    def list_range_some(self, f: Callable[[Column, Column], Column], keys: Any = ":all", values: Any = ":all") -> Any:
        row = self.list_range_keep(f, keys, values).first()
        return row[0] if row else None

    def visit_list(self, visitor: Callable[[Any], Any], k: Any) -> None:
        for row in self.get_list(k).toLocalIterator():
            if visitor(row.v) is False:
                return

    def visit_list_range(self, visitor: Callable[[Any, Any], Any], keys: Any = ":all", values: Any = ":all") -> None:
        for row in self.list_range(keys, values).toLocalIterator():
            if visitor(row.k, row.v) is False:
                return


class KV:
    """Named tables of one store; each change makes a new version of a table.

    With a folder, a change is written there before it's seen: as rows of changes, in a file set of its own number, and after
    MOST_CHANGES of those as a whole table. Opening the folder again gives the tables as they were.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.dbis, self.closed = spark, path and path.rstrip("/"), {}, False
        self.numbers: dict[str, int] = {}
        self._worker: ThreadPoolExecutor | None = None
        if self.path:
            self._files = spark._jvm.org.apache.hadoop.fs
            self._fs = self._files.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
            for folder in self._names(""):
                name, kind = folder.rsplit(".", 1)
                self.dbis[name] = self._read(name, kind)

    # --- the folder ---
    def _names(self, folder: str) -> list[str]:
        path = self._files.Path(f"{self.path}/{folder}" if folder else self.path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _folder(self, name: str, dbi: Dbi) -> str:
        return f"{self.path}/{name}.{'list' if isinstance(dbi, ListDbi) else 'one'}"

    def _read(self, name: str, kind: str) -> Dbi:
        folder = f"{self.path}/{name}.{kind}"
        done = [n for n in self._names(f"{name}.{kind}") if self._fs.exists(self._files.Path(f"{folder}/{n}/_SUCCESS"))]
        base = max((n for n in done if n.endswith("-whole")), default=None)
        made = ListDbi if kind == "list" else Dbi
        dbi = made(self.spark.read.parquet(f"{folder}/{base}"))
        for n in done:
            if n > base and n.endswith("-changes"):
                dbi = dbi.changed(self.spark.read.parquet(f"{folder}/{n}"))
        self.numbers[name] = int(done[-1].split("-")[0])
        return dbi

    def _write(self, name: str, dbi: Dbi, changes: DataFrame | None = None) -> Dbi:
        """The next version of a table, in the folder if there is one."""
        if not self.path:
            return dbi
        n = self.numbers[name] = self.numbers.get(name, -1) + 1
        whole = changes is None or n % MOST_CHANGES == 0
        target = f"{self._folder(name, dbi)}/{n:09}-{'whole' if whole else 'changes'}"
        (dbi.df if whole else changes).write.parquet(target)
        return type(dbi)(self.spark.read.parquet(target)) if whole else dbi

    # --- tables ---
    def _open(self, name: str, dbi: Dbi) -> Dbi:
        if name not in self.dbis:
            self.dbis[name] = self._write(name, dbi)
        return self.dbis[name]

    def open_dbi(self, name: str, key: str = "string", value: str = "string") -> Dbi:
        return self._open(name, Dbi(self.spark.createDataFrame([], f"k {key}, v {value}")))

    def open_list_dbi(self, name: str, key: str = "string", value: str = "string") -> ListDbi:
        return self._open(name, ListDbi(self.spark.createDataFrame([], f"k {key}, v {value}")))

    def transact_kv(self, name: str, txs: list[tuple]) -> None:
        """Changes of a table: ``:put k v``, ``:del k``, and of a list table ``:put-list k vs``, ``:del-list k vs``."""
        if self.closed:
            raise ValueError("the store is closed")
        dbi = self.dbis[name]
        changes = dbi.changes(txs)
        self.dbis[name] = self._write(name, dbi.changed(changes), changes)

    def transact_kv_async(self, name: str, txs: list[tuple]) -> Future:
        """The same by a worker of the store's own, one after the other."""
        if self._worker is None:
            self._worker = ThreadPoolExecutor(max_workers=1)
        return self._worker.submit(self.transact_kv, name, txs)

    @contextmanager
    def with_transaction_kv(self) -> Iterator[KV]:
        """A store whose changes become this one's at the end, unless it is aborted or fails."""
        inside = KV(self.spark)
        inside.dbis, inside.pending = dict(self.dbis), []
        inside.transact_kv = lambda name, txs: (KV.transact_kv(inside, name, txs), inside.pending.append((name, txs)))[0]
        yield inside
        if not inside.closed:
            for name, txs in inside.pending:
                self.transact_kv(name, txs)

    def abort_transact_kv(self) -> None:
        """Ends a transaction without its changes."""
        self.closed = True

    def list_dbis(self) -> list[str]:
        return sorted(self.dbis)

    def clear_dbi(self, name: str) -> None:
        self.dbis[name] = self._write(name, type(self.dbis[name])(self.dbis[name].df.limit(0)))

    def drop_dbi(self, name: str) -> None:
        dbi = self.dbis.pop(name, None)
        if dbi is not None and self.path:
            self._fs.delete(self._files.Path(self._folder(name, dbi)), True)
            self.numbers.pop(name, None)

    def stat(self, name: str) -> dict:
        return self.dbis[name].stat()

    def copy(self, path: str) -> KV:
        """A store in another folder with the same tables."""
        other = KV(self.spark, path)
        for name, dbi in self.dbis.items():
            other._open(name, dbi)
        return other

    def close_kv(self) -> None:
        if self._worker is not None:
            self._worker.shutdown()
        self.closed = True


def open_kv(spark: SparkSession, path: str | None = None) -> KV:
    return KV(spark, path)


def hexify(x: str) -> str:
    return x.encode().hex().upper()


def unhexify(x: str) -> str:
    return bytes.fromhex(x).decode()
