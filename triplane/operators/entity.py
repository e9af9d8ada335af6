"""Entities as maps that read their facts when asked, and hold edits until they're transacted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from triplane.catalog import Database
from triplane.operators.pull import _forward, db_id


@dataclass
class Entity:
    """The facts of an entity in a version of a database: attributes to values, references to entities.

    Facts are read by one query per table, when the first is asked for; ``:ns/_attr`` reads references backwards. :meth:`add`,
    :meth:`assoc` and :meth:`retract` give an entity with staged edits, which reads as if they were made; a transaction takes it.
    """

    db: Database
    id: Any
    edits: tuple = ()
    _facts: dict | None = field(default=None, repr=False, compare=False)

    def _read(self) -> dict[str, Any]:
        if self._facts is None:
            found: dict[str, Any] = {}
            tables: dict[str, list] = {}
            for a in self.db.attributes.values():
                tables.setdefault(a.table, []).append(a)
            for t, own in tables.items():
                for row in self.db.tables[t].where(F.col("e") == F.lit(self.id)).collect():
                    for a in own:
                        v = row[a.column]
                        if v is not None:
                            found[a.name] = [*found.get(a.name, []), v] if a.many else v
            self._facts = found
        facts = {k: list(v) if isinstance(v, list) and self.db.attributes[k].many else v for k, v in self._facts.items()}
        for op, name, v in self.edits:
            a = self.db.attributes.get(name)
            many = a is not None and a.many
            if op == "add":
                facts[name] = [*(x for x in facts.get(name, []) if x != v), v] if many else v
            elif many and v is not None:
                facts[name] = [x for x in facts.get(name, []) if x != v]
            else:
                facts.pop(name, None)
        return facts

    def _shown(self, name: str, v: Any) -> Any:
        a = self.db.attributes.get(name)
        one = lambda x: Entity(self.db, x) if a is not None and a.ref and isinstance(x, int) else x
        return list(map(one, v)) if a is not None and a.many else one(v)

    def __getitem__(self, name: str) -> Any:
        if name == ":db/id":
            return self.id
        attribute, reverse = _forward(name)
        if reverse:
            rows = self.db.scan(attribute).where(F.col("v") == F.lit(self.id)).select("e").orderBy("e").collect()
            if not rows:
                raise KeyError(name)
            found = [Entity(self.db, r.e) for r in rows]
            return found[0] if self.db.attribute(attribute).component else found
        return self._shown(name, self._read()[name])

    def get(self, name: str, default: Any = None) -> Any:
        try:
            return self[name]
        except KeyError:
            return default

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def __iter__(self) -> Iterator[str]:
        return iter(self._read())

    def __len__(self) -> int:
        return len(self._read())

    def keys(self) -> list[str]:
        return list(self._read())

    def touch(self) -> dict[str, Any]:
        """All facts and the id; components are touched too, other references stand as entities."""
        out: dict[str, Any] = {":db/id": self.id}
        for name, v in self._read().items():
            a = self.db.attributes.get(name)
            shown = self._shown(name, v)
            if a is not None and a.component:
                shown = [x.touch() for x in shown] if a.many else shown.touch()
            out[name] = shown
        return out

    def add(self, name: str, v: Any) -> Entity:
        return Entity(self.db, self.id, (*self.edits, ("add", name, v)), self._facts)

    assoc = add

    def retract(self, name: str, v: Any = None) -> Entity:
        return Entity(self.db, self.id, (*self.edits, ("retract", name, v)), self._facts)

    def tx_data(self) -> list:
        """The staged edits as changes."""
        return [[":db/add", self.id, name, v] if op == "add" else [":db/retract", self.id, name, *([v] if v is not None else [])] for op, name, v in self.edits]


def entity(db: Database, eid: Any) -> Entity | None:
    """The entity of an id or lookup ref; None if a lookup ref finds none."""
    found = db_id(db, eid)
    return None if found is None else Entity(db, found)
