"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, convolved by filters of several widths, pooled by maximum over a window of fixed length, and mapped to
languages by a softmax. A document is cut into such windows; its probabilities are the windows' means, by their bytes.

For speed, a filter's response is read from tables: what two neighbouring bytes contribute is summed up in advance for
every pair of bytes, so a filter of width 4 costs two look-ups. That is the same network, computed another way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.llm.common import give_back, held_out, small_batches, table

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
#: Bound of the sample that the network learns from: documents a language, windows a document, documents in all.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, MOST_DOCS = 600, 4, 150_000
CHUNK = 48  # windows that are convolved at a time


@dataclass
class ByteCNN:
    labels: list[str]
    embed: np.ndarray  # 256 x d; row 0, the padding, is zero
    filters: list[np.ndarray]  # for each width: width x d x filters
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For every pair of bytes: what it adds at a filter's start (all widths), and two bytes on (widths 3 and 4)."""
        w2, w3, w4 = (np.einsum("bd,wdf->wbf", self.embed, f) for f in self.filters)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(w[0], w[1]) for w in (w2, w3, w4)], axis=1)
        then = np.concatenate([pair(w3[2], np.zeros_like(w3[2])), pair(w4[2], w4[3])], axis=1)
        return first.astype(np.float32), then.astype(np.float32)

    def predict(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probabilities (n x labels) of n windows of ``WINDOW`` bytes."""
        first, then = tables
        f = self.filters[0].shape[2]
        pooled = np.empty((len(windows), first.shape[1]), np.float32)
        for a in range(0, len(windows), CHUNK):
            x = np.zeros((min(CHUNK, len(windows) - a), WINDOW + 3), np.intp)
            x[:, :WINDOW] = windows[a : a + CHUNK]
            pairs = x[:, :-1] * 256 + x[:, 1:]
            out = first.take(pairs[:, :WINDOW], axis=0)
            out[:, :, f:] += then.take(pairs[:, 2:], axis=0)
            n = WINDOW
            while n > 1:
                n //= 2
                out = np.maximum(out[:, :n], out[:, n:])
            pooled[a : a + CHUNK] = out[:, 0]
        return _softmax(np.maximum(pooled, 0) @ self.dense + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 1, epochs: int = 12, dim: int = 8, filters: int = 16, batch: int = 64, rate: float = 0.004) -> ByteCNN:
    """A network that tells ``labels`` from pieces of text; longer pieces are cut to a window.

    Half of the pieces are shown cut short at random, so that short texts are learned too. With no text it has no labels.
    """
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) < 3 else shape[0] * shape[1]), shape).astype(np.float32)
    p = [rng.normal(0, 0.5, (256, dim)).astype(np.float32), *(init(w, dim, filters) for w in WIDTHS), init(filters * len(WIDTHS), max(1, len(names))), np.zeros(max(1, len(names)), np.float32)]
    y_all = np.searchsorted(names, labels)
    x_all = np.zeros((len(texts), WINDOW + 3), np.uint8)
    for i, t in enumerate(texts):
        x_all[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs if len(names) > 1 else 0):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            x, y = x_all[order[a : a + batch]].copy(), y_all[order[a : a + batch]]
            for row in x[::2]:
                row[int(np.exp(rng.uniform(np.log(4), np.log(WINDOW)))) :] = 0
            p[0][0] = 0
            e = p[0][x]
            pooled, places, seen = [], [], []
            for w, filt in zip(WIDTHS, p[1:4], strict=True):
                parts = np.concatenate([e[:, j : j + WINDOW] for j in range(w)], axis=2)
                r = parts @ filt.reshape(w * dim, filters)
                at = r.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
                seen.append(parts)
            h = np.concatenate(pooled, axis=1)
            prob = _softmax(np.maximum(h, 0) @ p[4] + p[5])
            prob[np.arange(len(y)), y] -= 1
            prob /= len(y)
            g = [np.zeros_like(q) for q in p]
            g[4], g[5] = np.maximum(h, 0).T @ prob, prob.sum(axis=0)
            dh = (prob @ p[4].T) * (h > 0)
            rows = np.arange(len(y))[:, None]
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * filters : (k + 1) * filters]
                won = seen[k][rows, places[k]]  # batch x filters x (w * dim)
                g[1 + k] = np.einsum("bfi,bf->if", won, d).reshape(w, dim, filters)
                de = np.einsum("bf,wdf->bfwd", d, p[1 + k])
                for j in range(w):
                    np.add.at(g[0], x[rows, places[k] + j], de[:, :, j])
            step += 1
            for i, q in enumerate(p):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    p[0][0] = 0
    return ByteCNN(names, p[0], p[1:4], p[4], p[5])


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows: int = WINDOWS_PER_DOC) -> ByteCNN:
    """A network that learns from rows with a text and a ``lang`` that are not held out.

    The sample is bounded: of each language the documents whose ids hash lowest, and of each of those some windows, spread
    evenly over its whole text. With very many languages each has fewer documents, so that there are MOST_DOCS in all.
    """
    size = F.length("text")
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (size > 0)).select(
        "lang",
        F.xxhash64(F.col("doc_id").cast("long")).alias("order"),
        F.transform(
            F.sequence(F.lit(0), F.least(F.lit(windows), F.floor(size / WINDOW).cast("int") + 1) - 1),
            lambda i: F.substring("text", (i * F.floor(size / windows)).cast("int") + 1, F.lit(WINDOW)),
        ).alias("pieces"),
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "pieces"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= docs_per_language)
    rows = sorted(chosen.orderBy("rank", "lang").limit(MOST_DOCS).collect(), key=lambda r: (r.lang, r.rank))
    pieces = [(p.encode(), r.lang) for r in rows for p in r.pieces]
    return train([p for p, _ in pieces], [lang for _, lang in pieces])


def identify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; the model sees the texts alone.

    A null text, one without a letter, and any text if the model knows no language, is ``und`` with score 0. Texts are
    taken whole, window by window. Repeated rows stay, an empty table stays empty. Where ``docs`` has a column of those
    names already, it is replaced.
    """
    names, tables = np.array(model.labels), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal tables
        tables = model.tables() if tables is None else tables
        for batch in batches:
            texts = batch.column("text")
            real = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)) & bool(len(names))
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            held: list[tuple[int, int]] = []

            def flush(held: list[tuple[int, int]], best: np.ndarray = best, score: np.ndarray = score, offsets: np.ndarray = offsets, data: np.ndarray = data) -> None:
                if not held:
                    return
                flat = np.zeros((sum(n for _, n in held), WINDOW), np.uint8)
                at = 0
                for i, n in held:
                    raw = data[offsets[i] : offsets[i + 1]]
                    flat[at : at + n].reshape(-1)[: len(raw)] = raw
                    at += n
                p = model.predict(flat, tables)
                weight = (flat != 0).sum(axis=1, keepdims=True)
                starts = np.cumsum([0] + [n for _, n in held])[:-1]
                mean = np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)
                rows = [i for i, _ in held]
                best[rows], score[rows] = mean.argmax(axis=1), mean.max(axis=1)

            total = 0
            for i in np.flatnonzero(real):
                n = -(-int(offsets[i + 1] - offsets[i]) // WINDOW)
                if total + n > 20_000:
                    flush(held)
                    held, total = [], 0
                held.append((int(i), n))
                total += n
            flush(held)
            pred = np.where(real, names[best] if len(names) else UNKNOWN, UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(pred, pa.string()), pa.array(np.where(real, np.minimum(score, 1.0), 0.0))],
                schema=pa.schema([*(batch.schema.field(i) for i in kept), ("lang_pred", pa.string()), ("score", pa.float64())]),
            )
        tables = None
        give_back()

    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    kept = list(range(len(docs.columns)))
    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the language predicted, its probability, and whether the document was held out of learning."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
