"""Embeddings and language models behind small interfaces, and search by text over embeddings.

No model comes with the library. :class:`HashEmbedding` needs none: it adds up a fixed random vector for each token, so equal
texts have equal vectors and texts that share words lie near each other.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.catalog import Database
from triplane.edn import Keyword
from triplane.operators.attributes import source_of
from triplane.operators.vectors import TOP, neighbors
from triplane.plans.lower import RELATION_FUNCTIONS, Env, Relations, constant
from triplane.storage import durable


class EmbeddingProvider(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def tokens(self, text: str) -> list[str]: ...


class LanguageModel(Protocol):
    context_size: int

    def generate(self, prompt: str, limit: int) -> str: ...

    def tokens(self, text: str) -> list[str]: ...


class HashEmbedding:
    """Deterministic vectors of unit length; a text without words is the zero vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def tokens(self, text: str) -> list[str]:
        return re.findall(r"\w+", text.lower())

    def _vector(self, token: str) -> list[float]:
        raw = b"".join(hashlib.sha256(f"{token}:{i}".encode()).digest() for i in range(-(-self.dimensions // 32)))
        return [b / 127.5 - 1 for b in raw[: self.dimensions]]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            total = [0.0] * self.dimensions
            for t in self.tokens(text):
                total = [a + b for a, b in zip(total, self._vector(t), strict=True)]
            size = math.sqrt(sum(x * x for x in total)) or 1.0
            out.append([x / size for x in total])
        return out


PROVIDERS: dict[str, EmbeddingProvider] = {"default": HashEmbedding()}


def token_count(provider: EmbeddingProvider, text: str) -> int:
    return len(provider.tokens(text))


def truncate(provider: EmbeddingProvider, text: str, limit: int) -> str:
    """The first ``limit`` tokens, joined by blanks."""
    return " ".join(provider.tokens(text)[:limit])


def embed(text: Column, provider: EmbeddingProvider) -> Column:
    """Vectors of a column of texts, made in Arrow batches; null for null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna().unique().tolist()
        made = dict(zip(known, provider.embed(known), strict=True))
        return texts.map(lambda t: made.get(t))

    return run(text)


def summarize(model: LanguageModel, text: str, limit: int = 256) -> str:
    """A summary by a model; a text beyond its context is summarised in parts first."""
    room = model.context_size - limit
    parts = model.tokens(text)
    while len(parts) > room:
        shorter = [model.generate("Summarize:\n" + " ".join(parts[i : i + room]), limit) for i in range(0, len(parts), room)]
        merged = model.tokens(" ".join(shorter))
        if len(merged) >= len(parts):
            raise ValueError("the model's summaries are no shorter than what they summarise")
        parts = merged
    return model.generate("Summarize:\n" + " ".join(parts), limit)


def embedded(db: Database, name: str, provider: str) -> DataFrame:
    """Facts ``e, v`` of an attribute with their vectors ``_vec``, made once and kept with the database."""
    key = f"{name}#{provider}"
    if key not in db.vectors:
        db.vectors[key] = durable(db.scan(name).withColumn("_vec", embed(F.col("v"), PROVIDERS[provider])))
    return db.vectors[key]


def embedding_neighbors(env: Env, rels: Relations, args: tuple) -> DataFrame:
    """``(embedding-neighbors $ :attr text opts?)``: rows ``[e a v]`` whose text lies nearest, with distances on request."""
    source, rest = source_of(args)
    db: Database = env.source(source)
    names = [str(rest.pop(0))] if isinstance(rest[0], Keyword) else [a.name for a in db.attributes.values() if a.props.get(":db/embedding")]
    text = constant(env, rest[0])
    opts: dict[str, Any] = rest[1] if len(rest) > 1 else {}
    provider = PROVIDERS[str(opts.get(":provider", "default"))]
    (query,) = provider.embed([text])
    out = None
    for name in names:
        facts = embedded(db, name, str(opts.get(":provider", "default")))
        found = neighbors(facts, "_vec", query, int(opts.get(":top", TOP)), "cosine", key="e")
        cols = [F.col("e"), F.lit(name).alias("a"), F.col("v")] + ([F.col("dist")] if "dists" in str(opts.get(":display", "")) else [])
        rows = found.select(F.struct(*cols).alias("_r"))
        out = rows if out is None else out.unionByName(rows)
    return out


RELATION_FUNCTIONS["embedding-neighbors"] = embedding_neighbors
