"""Reading and writing: CSV, facts in bulk, and dumps of whole databases as tables or as text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.catalog import TYPES, Attribute, Database
from triplane.edn import read, write


def read_csv(spark: SparkSession, path: str, separator: str = ",", quote: str = '"', header: bool = False, schema: str | None = None) -> DataFrame:
    """Rows of a CSV file; fields may hold separators, doubled quotes and line breaks between quotes. Text unless a schema is given."""
    reader = spark.read.options(sep=separator, quote=quote, escape=quote, multiLine=True, header=header)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", quote: str = '"', header: bool = False, quote_all: bool = False) -> None:
    df.write.options(sep=separator, quote=quote, escape=quote, header=header, quoteAll=quote_all).csv(path)


def dump(db: Database, path: str, form: str = "parquet") -> None:
    """All tables and the schema; files are written by the executors, the schema by Spark as text of one line."""
    for i, (_, df) in enumerate(db.tables.items()):
        df.write.format(form).save(f"{path}/table-{i}")
    meta = {"form": form, "tables": list(db.tables), "schemas": [df.schema.jsonValue() for df in db.tables.values()], "attributes": [vars(a) for a in db.attributes.values()], "keyed": sorted(db.keyed)}
    db.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/schema")


def load(spark: SparkSession, path: str) -> Database:
    from pyspark.sql.types import StructType

    meta = json.loads(spark.read.text(f"{path}/schema").first()[0])
    tables = {n: spark.read.format(meta["form"]).schema(StructType.fromJson(s)).load(f"{path}/table-{i}") for i, (n, s) in enumerate(zip(meta["tables"], meta["schemas"], strict=True))}
    return Database(spark, tables, {a["name"]: Attribute(**a) for a in meta["attributes"]}, frozenset(meta.get("keyed", ["entities"])))


def init_db(facts: DataFrame, schema: dict) -> Database:
    """A database of facts ``e, a, v`` (values as text, as casts to the attributes' types read them); the schema names all attributes.

    One pass over the facts gives all attributes of cardinality one: they are grouped by entity, with a column for each.
    """
    return fill_db(Database(facts.sparkSession, {"entities": facts.sparkSession.createDataFrame([], "e long")}, {}), facts, schema)


def fill_db(db: Database, facts: DataFrame, schema: dict | None = None) -> Database:
    """``db`` with more facts ``e, a, v``. A new value of an attribute of cardinality one takes the place of the old.

    Facts aren't checked as transactions are: what comes in bulk must be resolved and consistent. Where it has several values
    for one, the greatest stays.
    """
    from triplane.transact import update_schema

    db = update_schema(db, schema or {})
    kinds = {n: dict(db.tables[a.table].select(F.col(f"`{a.column}`").alias("v")).dtypes)["v"] for n, a in db.attributes.items()}
    value = lambda n: F.from_json("v", kinds[n]) if kinds[n].startswith("array") else F.col("v").cast(kinds[n])
    for t in dict.fromkeys(a.table for a in db.attributes.values()):
        own = [a for a in db.attributes.values() if a.table == t]
        mine = facts.where(F.col("a").isin(*(a.name for a in own)))
        if own[0].many:
            new = mine.select(F.col("e").cast("long").alias("e"), value(own[0].name).alias("v"))
            db = db.with_table(t, db.tables[t].unionByName(new).distinct())
            continue
        new = mine.groupBy(F.col("e").cast("long").alias("e")).agg(*(F.max(F.when(F.col("a") == a.name, value(a.name))).alias(f"{a.column}'") for a in own))
        both = db.tables[t].join(new, "e", "full")
        db = db.with_table(t, both.select("e", *(F.coalesce(F.col(f"`{a.column}'`"), F.col(f"`{a.column}`")).alias(a.column) for a in own)))
    return db


def dump_text(db: Database, path: str) -> None:
    """All facts as lines ``[e :a "v"]`` of text, and the schema; both are in the notation of queries."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("v", r'(["\\\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    out = None
    for a in db.attributes.values():
        kind = dict(db.scan(a.name).dtypes)["v"]
        v = F.to_json("v") if kind.startswith("array") else F.col("v").cast("string")
        rows = db.scan(a.name).select("e", F.lit(a.name).alias("a"), v.alias("v"))
        out = rows if out is None else out.unionByName(rows)
    if out is not None:
        out.select(F.concat(F.lit("["), F.col("e").cast("string"), F.lit(" "), "a", F.lit(" "), quoted, F.lit("]")).alias("value")).write.text(f"{path}/facts")
    props = {n: dict(a.props) or _props(db, n) for n, a in db.attributes.items()}
    db.spark.createDataFrame([(write(props),)], "value string").coalesce(1).write.text(f"{path}/schema")


def _props(db: Database, name: str) -> dict:
    a = db.attributes[name]
    kind = db.tables[a.table].select(F.col(f"`{a.column}`").alias("v")).schema["v"].dataType
    named = next((k for k, t in TYPES.items() if t == kind), ":db.type/string")
    props = {":db/valueType": ":db.type/ref" if a.ref else named}
    return props | ({":db/cardinality": ":db.cardinality/many"} if a.many else {}) | ({":db/unique": a.unique} if a.unique else {})


def load_text(spark: SparkSession, path: str) -> Database:
    """A database of what :func:`dump_text` wrote."""
    schema = read(spark.read.option("wholetext", True).text(f"{path}/schema").first()[0])
    line = r'^\[(-?[0-9]+) (\S+) "(.*)"\]$'
    raw = spark.read.text(f"{path}/facts")
    part = lambda i: F.regexp_extract("value", line, i)
    # An escaped backslash is set apart first, so that what follows it isn't read as its escape.
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(part(3), r"\\\\", "\0"), r"\\n", "\n"), r'\\"', '"'), "\0", r"\\")
    return init_db(raw.select(part(1).cast("long").alias("e"), part(2).alias("a"), v.alias("v")), {str(k): {str(a): b for a, b in p.items()} for k, p in schema.items()})


def copy(db: Database, path: str) -> Database:
    dump(db, path)
    return load(db.spark, path)


def exists(path: str) -> bool:
    return Path(path).exists()
