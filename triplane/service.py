"""Requests as JSON: one entry for programs that don't call Python.

A request is ``{"op": name, "args": {...}}``, an answer ``{"ok": true, "result": ...}`` or ``{"ok": false, "error": ...}``. Queries,
patterns and transactions are text in the notation of queries. What is open is named by handles that ``connect`` and
``open-kv`` give. Results of more than ``limit`` rows are cut, which ``truncated`` says.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from triplane.api import connect, q
from triplane.edn import read
from triplane.operators import index, pull, search
from triplane.operators.kv import open_kv
from triplane.plans.query import parse

LIMIT = 10_000


def plain(x: Any) -> Any:
    """A value as JSON has it."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [plain(v) for v in x]
    if isinstance(x, (bytes, bytearray)):
        return x.hex()
    return x if isinstance(x, (str, int, float, bool)) or x is None else x.isoformat() if isinstance(x, (date, datetime)) else str(x)


class Service:
    def __init__(self, spark: SparkSession, limit: int = LIMIT):
        self.spark, self.limit, self.open, self.made = spark, limit, {}, 0
        self.ops: dict[str, Callable[..., Any]] = {
            "connect": self._connect, "close": self._close, "open-kv": self._open_kv, "q": self._q, "pull": lambda conn, pattern, id: self.open[conn].pull(pattern, id),
            "pull-many": lambda conn, pattern, ids: pull.pull_many(self.open[conn].db, pattern, ids), "entity": lambda conn, id: self._entity(conn, id), "transact": self._transact, "schema": lambda conn: index.schema(self.open[conn].db),
            "update-schema": lambda conn, update=None, drop=(), rename=None: self.open[conn].update_schema(_data(update), list(drop), rename), "datoms": lambda conn, index_=":eav", components=(): self._rows(index.datoms(self.open[conn].db, index_, *components)),
            "count-datoms": lambda conn, e=None, a=None, v=None: index.count_datoms(self.open[conn].db, e, a, v), "max-eid": lambda conn: index.max_eid(self.open[conn].db), "fulltext-datoms": lambda conn, query, attributes=None, opts=None: self._rows(search.fulltext_datoms(self.open[conn].db, _data(query), attributes, opts)),
            "open-dbi": lambda kv, name, key="string", value="string": self.open[kv].open_dbi(name, key, value) and name, "open-list-dbi": lambda kv, name, key="string", value="string": self.open[kv].open_list_dbi(name, key, value) and name,
            "transact-kv": lambda kv, name, txs: self.open[kv].transact_kv(name, [tuple(t) for t in txs]), "get-value": lambda kv, name, key: self.open[kv].dbis[name].get_value(key), "get-range": lambda kv, name, range=":all": self._rows(self.open[kv].dbis[name].range(range)),
            "range-count": lambda kv, name, range=":all": self.open[kv].dbis[name].range_count(range), "list-dbis": lambda kv: self.open[kv].list_dbis(), "clear-dbi": lambda kv, name: self.open[kv].clear_dbi(name), "drop-dbi": lambda kv, name: self.open[kv].drop_dbi(name),
        }

    def handle(self, request: str | dict) -> dict:
        """The answer to a request; what goes wrong is told, not raised."""
        try:
            request = json.loads(request) if isinstance(request, str) else request
            if request.get("op") not in self.ops:
                raise ValueError(f"unknown op {request.get('op')!r}")
            found = self.ops[request["op"]](**{k.replace("index", "index_") if k == "index" else k: v for k, v in request.get("args", {}).items()})
            return {"ok": True, "result": plain(found)}
        except Exception as e:  # a caller in another language gets text
            return {"ok": False, "error": f"{type(e).__name__}: {e}"}

    def _named(self, kind: str, x: Any) -> str:
        self.made += 1
        self.open[f"{kind}-{self.made}"] = x
        return f"{kind}-{self.made}"

    def _connect(self, path: str, schema: Any = None) -> str:
        return self._named("conn", connect(self.spark, path, _data(schema)))

    def _open_kv(self, path: str | None = None) -> str:
        return self._named("kv", open_kv(self.spark, path))

    def _close(self, handle: str) -> None:
        x = self.open.pop(handle)
        (x.close if hasattr(x, "close") else x.close_kv)()

    def _rows(self, df: DataFrame) -> dict:
        rows = df.limit(self.limit + 1).collect()
        return {"columns": df.columns, "rows": [list(r) for r in rows[: self.limit]], "truncated": len(rows) > self.limit}

    def _q(self, conn: str, query: str, inputs: list = ()) -> Any:
        parsed = parse(query)
        found = self._rows(q(query, self.open[conn].db, *map(_data, inputs)))
        if parsed.shape in ("scalar", "tuple"):
            first = next(iter(found["rows"]), None)
            return first and (first[0] if parsed.shape == "scalar" else first)
        return found if parsed.shape == "relation" else [r[0] for r in found["rows"]]

    def _entity(self, conn: str, id: Any) -> Any:
        found = self.open[conn].entity(id)
        return None if found is None else {k: v.id if hasattr(v, "touch") else [x.id if hasattr(x, "touch") else x for x in v] if isinstance(v, list) else v for k, v in found.touch().items()}

    def _transact(self, conn: str, data: Any) -> dict:
        report = self.open[conn].transact(_data(data))
        return {"tx_data": report.tx_data, "tempids": report.tempids}


def _data(x: Any) -> Any:
    """Text in the notation of queries as data; other values as they are."""
    return read(x) if isinstance(x, str) and x[:1] in "[{(" else x
