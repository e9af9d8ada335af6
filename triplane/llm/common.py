"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.storage import durable as durable

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes that don't follow from each other."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(7), text).alias("key_b")]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns added that are computed once a row, however often or wherever they are used.

    Catalyst copies expressions into filters above a projection and into lambdas; it copies nothing through a generator.
    """
    name = fresh(df, "_once")
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(name))
    return made.select("*", *(F.col(name)[k].alias(k) for k in columns)).drop(name)


#: Rows that go to a Python worker at a time: texts and vectors may be long, and a batch is held in both processes.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Has the session send Python workers at most BATCH_ROWS rows at a time, unless it sends fewer already.

    Every operator that has Python workers asks for it. The setting stays, since a result may be computed after its operator
    has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Returns memory that this Python worker no longer uses; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
