"""Databases: attributes mapped to columns of entity tables.

An entity table has one row per entity: its id in column ``e`` and a column per attribute. All attributes of cardinality
one that belong to a table are read by one scan. An attribute of cardinality many has a table of its own, ``e, v``. A null
cell means that the entity lacks the attribute.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {
    ":db.type/string": T.StringType(), ":db.type/keyword": T.StringType(), ":db.type/symbol": T.StringType(), ":db.type/boolean": T.BooleanType(),
    ":db.type/long": T.LongType(), ":db.type/double": T.DoubleType(), ":db.type/float": T.FloatType(), ":db.type/ref": T.LongType(),
    ":db.type/bigint": T.DecimalType(38, 0), ":db.type/bigdec": T.DecimalType(38, 10), ":db.type/instant": T.TimestampType(), ":db.type/uuid": T.StringType(),
    ":db.type/bytes": T.BinaryType(), ":db.type/vec": T.ArrayType(T.FloatType()), ":db.type/idoc": T.StringType(),
}


@dataclass(frozen=True)
class Attribute:
    name: str
    table: str
    column: str
    many: bool = False
    ref: bool = False
    unique: str | None = None
    component: bool = False
    props: dict = field(default_factory=dict, hash=False, compare=False)


@dataclass
class Database:
    """An immutable set of tables with their attributes; changes give a new one."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    attributes: dict[str, Attribute]
    #: Tables in which no two rows have one id; results that hold such ids need no deduplication.
    keyed: frozenset[str] = frozenset({"entities"})
    #: Search indexes by attribute, built when first asked for or opened from where they were saved.
    indexes: dict = field(default_factory=dict, compare=False)
    #: Embedded values by attribute and provider.
    vectors: dict = field(default_factory=dict, compare=False)

    def attribute(self, name: str) -> Attribute:
        if name not in self.attributes:
            raise KeyError(f"unknown attribute {name}")
        return self.attributes[name]

    def scan(self, name: str) -> DataFrame:
        """Rows ``e, v`` of an attribute."""
        a = self.attribute(name)
        return self.tables[a.table].select("e", F.col(f"`{a.column}`").alias("v")).where("v is not null")

    def datoms(self) -> DataFrame:
        """All facts as ``e, a, v``; values of whatever type as text."""
        out = None
        for table in dict.fromkeys(a.table for a in self.attributes.values()):
            cells = [F.struct(F.lit(a.name).alias("a"), F.col(f"`{a.column}`").cast("string").alias("v")) for a in self.attributes.values() if a.table == table]
            rows = self.tables[table].select("e", F.explode(F.array(*cells)).alias("x")).select("e", "x.a", "x.v").where("v is not null")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "e long, a string, v string")

    def with_table(self, name: str, df: DataFrame, attributes: Iterable[Attribute] = ()) -> Database:
        kept = {a: i for a, i in self.indexes.items() if self.attributes[a].table != name}
        return replace(self, tables=self.tables | {name: df}, attributes=self.attributes | {a.name: a for a in attributes}, indexes=kept, vectors={})


def from_table(db: Database, name: str, df: DataFrame, key: str | None, prefix: str = "", refs: Iterable[str] = ()) -> Database:
    """``db`` with the columns of ``df`` as attributes ``:name/column``; ``prefix`` is cut from columns' names.

    ``key`` is the column with entity ids, unique in the table; without one, column ``e`` holds ids that are unique. Integer
    columns become long, so that references join.
    """
    wide = df.select(*(F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes))
    if key is not None:
        wide = wide.withColumn("e", F.col(f"`{key}`"))
    attrs = []
    for c in (c for c in df.columns if key is not None or c != "e"):
        short = c.removeprefix(prefix)
        attrs.append(Attribute(f":{name}/{short}", name, c, ref=short in refs, unique=":db.unique/identity" if c == key else None))
    made = db.with_table(name, wide, attrs)
    return replace(made, keyed=made.keyed | {name})


#: Of the driver's tables: key, prefix of columns, references.
STAR = {
    "region": ("r_regionkey", "r_", ()), "nation": ("n_nationkey", "n_", ("regionkey",)), "customer": ("c_custkey", "c_", ("nationkey",)), "supplier": ("s_suppkey", "s_", ("nationkey",)),
    "part": ("p_partkey", "p_", ()), "orders": ("o_orderkey", "o_", ("custkey",)), "lineitem": (None, "l_", ("orderkey", "partkey", "suppkey")), "events": ("event_id", "", ()),
    "documents": ("doc_id", "", ()), "labels": ("doc_id", "", ()), "embeddings": ("vec_id", "", ()), "pages": ("page_id", "", ()), "benchmark": ("item_id", "", ()),
}


def open_star(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """The driver's tables (all, or those named) as a database. A line item has no key: its place in its file is its id."""
    db = Database(spark, {}, {})
    for name in names or STAR:
        key, prefix, refs = STAR[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        db = from_table(db, name, df if key else with_place(df), key, prefix, refs)
    return db


def with_place(df: DataFrame) -> DataFrame:
    """Rows of Parquet files with ``e``, which no two share: the file and the row's number in it.

    Readers give both without reading a column, and filters and the choice of columns still reach the scan.
    """
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("e"))


def from_entities(spark: SparkSession, entities: Iterable[dict], schema: dict | None = None) -> Database:
    """A database of maps with ``:db/id`` and attributes; for what the schema doesn't say, types follow from the values."""
    schema, entities = dict(schema or {}), [dict(e) for e in entities]
    ids = {id(e): i for i, e in enumerate(entities, 1)}
    ones: dict[str, dict] = {}
    db = Database(spark, {}, {})
    names = list(dict.fromkeys([*(a for a, p in schema.items()), *(a for e in entities for a in e if a != ":db/id")]))
    for a in names:
        p = schema.get(a, {})
        kind = p.get(":db/valueType")
        many = p.get(":db/cardinality") == ":db.cardinality/many"
        pairs = []
        for e in entities:
            value = e.get(a)
            values = value if many and isinstance(value, (list, set, frozenset)) else [value]
            pairs += [(e.get(":db/id", ids[id(e)]), v) for v in values if v is not None]
        spark_type = TYPES.get(str(kind)) or infer([v for _, v in pairs])
        if many:
            df = spark.createDataFrame(pairs, T.StructType([T.StructField("e", T.LongType()), T.StructField("v", spark_type)]))
            db = db.with_table(a, df.distinct())
        else:
            ones[a] = {"type": spark_type, "values": dict(pairs)}
        db.attributes[a] = Attribute(a, a if many else "entities", "v" if many else a, many, kind == ":db.type/ref", p.get(":db/unique"), bool(p.get(":db/isComponent")), p)
    every = sorted({e.get(":db/id", ids[id(e)]) for e in entities})
    rows = [(e, *(o["values"].get(e) for o in ones.values())) for e in every]
    wide = spark.createDataFrame(rows, T.StructType([T.StructField("e", T.LongType()), *(T.StructField(a, o["type"]) for a, o in ones.items())]))
    return db.with_table("entities", wide)


def infer(values: list) -> T.DataType:
    """The type of a column of Python values; strings where they differ."""
    kinds = {type(v) for v in values}
    if kinds <= {bool} and kinds:
        return T.BooleanType()
    if kinds <= {int} and kinds:
        return T.LongType()
    if kinds <= {int, float} and kinds:
        return T.DoubleType()
    if kinds and all(issubclass(k, (list, tuple)) for k in kinds):
        return T.ArrayType(infer([x for v in values for x in v]))
    from datetime import datetime

    if kinds <= {datetime} and kinds:
        return T.TimestampType()
    return T.StringType()
