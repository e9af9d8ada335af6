"""User-defined functions: a registry of callables that queries name.

A function takes and gives Spark columns: a composition of expressions, a pandas UDF, or a plain function wrapped by
``python_function``. Descriptors are names, or maps with ``:udf/id`` and optionally ``:udf/version``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.functions: dict[tuple, Callable] = {}
        self.resolvers: list[Callable[[Any], Callable | None]] = []
        self.generation = 0

    @staticmethod
    def key(descriptor: Any) -> tuple:
        if isinstance(descriptor, dict):
            return str(descriptor[":udf/id"]), descriptor.get(":udf/version")
        return str(descriptor), None

    def register(self, descriptor: Any, f: Callable) -> None:
        self.functions[self.key(descriptor)] = f
        self.generation += 1

    def register_resolver(self, resolver: Callable[[Any], Callable | None]) -> None:
        self.resolvers.append(resolver)
        self.generation += 1

    def unregister(self, descriptor: Any) -> None:
        self.functions.pop(self.key(descriptor), None)
        self.generation += 1

    def registered(self, descriptor: Any) -> bool:
        return self.key(descriptor) in self.functions

    def resolve(self, descriptor: Any) -> Callable:
        if f := self.functions.get(self.key(descriptor)):
            return f
        for r in self.resolvers:
            if f := r(descriptor):
                return f
        raise KeyError(f"no function is registered for {descriptor}")


REGISTRY = Registry()


def python_function(f: Callable, returns: str) -> Callable:
    """A function of Python values as one of columns; arguments go to Python by Arrow batches."""
    return F.udf(f, returns, useArrow=True)
