"""The public surface: open a database, ask queries, change it."""

from __future__ import annotations

import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame

from triplane.catalog import Database, from_entities, open_star
import triplane.operators.attributes
import triplane.operators.embedding
import triplane.operators.idoc
import triplane.operators.search
import triplane.operators.vectors  # noqa: F401  their functions join the query language
from triplane.plans.lower import run
from triplane.operators.entity import entity
from triplane.plans.query import parse
from triplane.sources.store import connect

__all__ = ["Database", "answer", "connect", "entity", "explain", "from_entities", "open_star", "q"]


def q(query: Any, *inputs: Any) -> DataFrame:
    """The result of a query (EDN text or data) over its inputs, as a DataFrame with a column per element of :find."""
    return run(query, *inputs)


def answer(query: Any, *inputs: Any) -> Any:
    """The result as Python data in the shape that :find asks for: a set of tuples, a list, a tuple or one value."""
    parsed = parse(query)
    rows = [tuple(r) for r in _collected(run(parsed, *inputs), parsed.timeout)]
    if parsed.shape == "scalar":
        return rows[0][0] if rows else None
    if parsed.shape == "tuple":
        return rows[0] if rows else None
    if parsed.shape == "collection":
        return [r[0] for r in rows]
    return rows


def _collected(df: DataFrame, timeout: int | None) -> list:
    """All rows; with a timeout in milliseconds, the query's jobs are stopped when it is over."""
    if timeout is None:
        return df.collect()
    spark, tag = df.sparkSession, f"triplane-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout / 1000, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if timer.is_alive():
            raise
        raise TimeoutError(f"the query took more than {timeout} ms") from e
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def explain(query: Any, *inputs: Any) -> str:
    """The parsed query and Spark's formatted plan."""
    df = run(query, *inputs)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return f"{parse(query)}\n{plan}"
