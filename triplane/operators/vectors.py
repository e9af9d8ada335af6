"""Vector search: exact nearest neighbours by a scan that keeps only the top rows of each task.

One query is an expression over the rows; many queries are a table that meets the rows block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.catalog import Database
from triplane.edn import Keyword
from triplane.operators.attributes import source_of
from triplane.plans.lower import RELATION_FUNCTIONS, Env, Relations, constant
from triplane.storage import durable

TOP = 10


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def _pearson(a: Column, b: Column) -> Column:
    n = F.size(a)
    sa, sb = _sum(a), _sum(b)
    cov = _zip(a, b, lambda x, y: x * y) * n - sa * sb
    va, vb = (_zip(c, c, lambda x, y: x * y) * n - s * s for c, s in ((a, sa), (b, sb)))
    return 1 - cov / F.sqrt(va * vb)


def _haversine(a: Column, b: Column) -> Column:
    (lat1, lon1), (lat2, lon2) = ((F.radians(F.get(c, 0).cast("double")), F.radians(F.get(c, 1).cast("double"))) for c in (a, b))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(h))


def _divergence(a: Column, b: Column) -> Column:
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return F.sqrt(_zip(a, b, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2))


def _bits(f: Callable[[Column, Column, Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A distance of sets that the non-zero places of vectors stand for."""

    def distance(a: Column, b: Column) -> Column:
        on = lambda x: (x != 0).cast("int")
        both = _zip(a, b, lambda x, y: on(x) * on(y))
        return f(both, _zip(a, b, lambda x, y: on(x)), _zip(a, b, lambda x, y: on(y)), _zip(a, b, lambda x, y: (on(x) != on(y)).cast("int")))

    return distance


#: Distances by metric; the Euclidean one is squared.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda a, b: _zip(a, b, lambda x, y: (x - y) * (x - y)),
    "cosine": lambda a, b: 1 - _zip(a, b, lambda x, y: x * y) / F.sqrt(_zip(a, a, lambda x, y: x * y) * _zip(b, b, lambda x, y: x * y)),
    "dot-product": lambda a, b: 1 - _zip(a, b, lambda x, y: x * y),
    "pearson": _pearson, "haversine": _haversine, "divergence": _divergence,
    "jaccard": _bits(lambda both, a, b, _: 1 - both / (a + b - both)), "tanimoto": _bits(lambda both, a, b, _: 1 - both / (a + b - both)),
    "sorensen": _bits(lambda both, a, b, _: 1 - 2 * both / (a + b)), "hamming": _bits(lambda both, a, b, differ: differ),
}


def quantize(v: Column, kind: str = "float") -> Column:
    """Vectors as another element type; int8 and byte scale -1..1 to -127..127."""
    if kind in ("int8", "byte"):
        return F.transform(v, lambda x: F.round(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 127).cast("tinyint"))
    return v.cast({"float": "array<float>", "double": "array<double>", "float16": "array<float>"}[kind])


def neighbors(rows: DataFrame, vector: str, query: Sequence[float], top: int = TOP, metric: str = "euclidean", before: Column | None = None, after: Column | None = None, key: str | None = None) -> DataFrame:
    """The ``top`` rows nearest to ``query``, with ``dist``; ties by ``key``.

    ``after`` filters what was found, so fewer may come; ``before`` filters what is searched. A vector of another length is an
    error.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    same = F.when(F.size(vector) == len(query), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {len(query)} numbers, not "), F.size(vector).cast("string"))).cast("boolean"))
    rows = rows.where(F.col(vector).isNotNull())
    rows = rows if before is None else rows.where(before)
    found = rows.withColumn("dist", F.when(same, METRICS[metric.lstrip(":")](F.col(vector), q)))
    found = found.orderBy("dist", *([key] if key else [])).limit(top)
    return found if after is None else found.where(after)


#: Distances between all rows of two matrices, in numpy; as METRICS has them for two columns.
def _between(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        dot = a @ b.T
        if metric == "euclidean":
            return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * dot, 0)
        if metric == "dot-product":
            return 1 - dot
        if metric == "cosine":
            return 1 - dot / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None])
        if metric == "pearson":
            return _between("cosine", a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True))
        if metric in ("jaccard", "tanimoto", "sorensen", "hamming"):
            x, y = (a != 0).astype(float), (b != 0).astype(float)
            both, na, nb = x @ y.T, x.sum(1)[:, None], y.sum(1)[None]
            return na + nb - 2 * both if metric == "hamming" else 1 - 2 * both / (na + nb) if metric == "sorensen" else 1 - both / (na + nb - both)
        rows = []
        for v in a:  # one query at a time, so that no array has three dimensions
            if metric == "haversine":
                p, q = np.radians(v[:2]), np.radians(b[:, :2])
                h = np.sin((q[:, 0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[:, 0]) * np.sin((q[:, 1] - p[1]) / 2) ** 2
                rows.append(2 * np.arcsin(np.sqrt(h)))
            else:
                m = (v + b) / 2
                part = lambda x, m=m: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0).sum(1)
                rows.append(np.sqrt(np.maximum((part(np.broadcast_to(v, b.shape)) + part(b)) / 2, 0)))
        return np.array(rows).reshape(len(a), len(b))


#: Vectors that a block holds: all pairs of two blocks' vectors are compared at once.
BLOCK = 1024


def _blocks(rows: DataFrame, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    """Rows of a block each: ids and vectors of up to BLOCK rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                ids, found = batch.column(0).slice(i, BLOCK), batch.column(1).slice(i, BLOCK)
                flat = np.asarray(found.flatten(), "<f8")
                yield pa.record_batch([pa.array([np.asarray(ids, "<i8").tobytes()]), pa.array([flat.tobytes()])], names=list(names))

    slim = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return slim.mapInArrow(run, f"{names[0]} binary, {names[1]} binary")


def nearest(rows: DataFrame, vector: str, queries: DataFrame, key: str, top: int = TOP, metric: str = "euclidean") -> DataFrame:
    """Rows ``query, id, dist``: for each row of ``queries`` the ``top`` rows nearest to it, ties by id; exact.

    Both tables have ids (long) in ``key`` and vectors of one length in ``vector``. Blocks of queries meet blocks of rows; of each
    meeting a query's nearest are kept, and of all meetings its nearest by a window whose limit is applied before the shuffle.
    Null vectors are no one's neighbours and ask for none.
    """
    metric = metric.lstrip(":")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, ri, rv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asks, ids = np.frombuffer(qi, "<i8"), np.frombuffer(ri, "<i8")
                a, b = np.frombuffer(qv, "<f8"), np.frombuffer(rv, "<f8")
                if len(a) * len(ids) != len(b) * len(asks):
                    raise ValueError("vectors must have one length")
                dist = _between(metric, a.reshape(len(asks), -1), b.reshape(len(ids), -1))
                n = min(top, len(ids))
                # All rows as near as the n-th, so that ties are told apart by id.
                least = np.partition(dist, n - 1, axis=1)[:, n - 1 : n]
                at, near = np.nonzero(dist <= least)
                yield pa.record_batch([pa.array(asks[at]), pa.array(ids[near]), pa.array(dist[at, near])], names=["query", "id", "dist"])

    met = _blocks(queries, key, vector, ("qi", "qv")).crossJoin(_blocks(rows, key, vector, ("ri", "rv"))).mapInArrow(meet, "query long, id long, dist double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))
    return met.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")


@dataclass
class VectorIndex:
    """Vectors by id (``id, vector``) in one metric; search is exact. Changes give a new index."""

    rows: DataFrame
    dimensions: int
    metric: str = "euclidean"
    kind: str = "float"

    @staticmethod
    def create(spark: SparkSession, dimensions: int, metric: str = "euclidean", kind: str = "float") -> VectorIndex:
        return VectorIndex(spark.createDataFrame([], "id long, vector array<double>"), dimensions, metric.lstrip(":"), kind)

    def add(self, rows: DataFrame) -> VectorIndex:
        """With more vectors (``id, vector``); those of ids that are there are replaced. Vectors of another length are an error."""
        same = F.when(F.size("vector") == self.dimensions, quantize(F.col("vector"), self.kind).cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector must have {self.dimensions} numbers")).cast("array<double>"))
        new = rows.where("vector is not null").select(F.col("id").cast("long").alias("id"), same.alias("vector"))
        return replace(self, rows=durable(self.rows.join(new.select("id"), "id", "left_anti").unionByName(new)))

    def remove(self, *ids: int) -> VectorIndex:
        return replace(self, rows=self.rows.where(~F.col("id").isin(*ids)))

    def clear(self) -> VectorIndex:
        return replace(self, rows=self.rows.limit(0))

    def info(self) -> dict:
        return {":size": self.rows.count(), ":dimensions": self.dimensions, ":metric-type": self.metric, ":quantization": self.kind}

    def indexed(self, id_: int) -> bool:
        return not self.rows.where(F.col("id") == id_).isEmpty()

    def search(self, query: Sequence[float], top: int = TOP) -> DataFrame:
        return neighbors(self.rows, "vector", query, top, self.metric, key="id").select("id", "dist")

    def search_all(self, queries: DataFrame, top: int = TOP) -> DataFrame:
        """For each row of ``queries`` (``id, vector``) its nearest: ``query, id, dist``."""
        return nearest(self.rows, "vector", queries, "id", top, self.metric)

    def save(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/vectors")
        spark = self.rows.sparkSession
        spark.createDataFrame([(self.metric, self.dimensions, self.kind)], "metric string, dimensions int, kind string").coalesce(1).write.parquet(f"{path}/index")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        meta = spark.read.parquet(f"{path}/index").first()
        return VectorIndex(spark.read.parquet(f"{path}/vectors"), meta.dimensions, meta.metric, meta.kind)


def vec_neighbors(env: Env, rels: Relations, args: tuple) -> DataFrame:
    """``(vec-neighbors $ :attr vector opts?)``: rows ``[e a v]``, and the distance with ``{:display :refs+dists}``."""
    source, rest = source_of(args)
    db: Database = env.source(source)
    a = str(rest.pop(0)) if isinstance(rest[0], Keyword) else None
    query = constant(env, rest[0])
    opts: dict[str, Any] = rest[1] if len(rest) > 1 else {}
    names = [a] if a else [x.name for x in db.attributes.values() if set(map(str, x.props.get(":db.vec/domains", []))) & set(map(str, opts[":domains"]))]
    out = None
    for name in names:
        facts = neighbors(db.scan(name), "v", query, int(opts.get(":top", TOP)), str(opts.get(":metric-type", "euclidean")), key="e")
        cols = [F.col("e"), F.lit(name).alias("a"), F.col("v")] + ([F.col("dist")] if "dists" in str(opts.get(":display", "")) else [])
        rows = facts.select(F.struct(*cols).alias("_r"))
        out = rows if out is None else out.unionByName(rows)
    return out


RELATION_FUNCTIONS["vec-neighbors"] = vec_neighbors
