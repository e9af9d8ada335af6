"""Toxicity by lexicon induction.

Words of labelled documents form a graph whose edges are positive pointwise mutual information: how much more often two
words stand near each other than chance has it. Two random walks with restart, one from seed terms of toxic documents and
one from those of clean documents, give each word two visiting rates; their log ratio is its polarity. Documents are scored
by the polarities of their words, through a logistic curve fitted to the labels.

The lexicon is learned from a bounded sample of labelled documents; every document is scored over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.common import give_back, held_out, small_batches, table
from triplane.llm.hashing import runs, word_hashes

#: Bound of the sample: documents that hash lowest, of each label, and the most characters that one may have to be drawn.
DOCS_PER_LABEL, MOST_CHARS = 1500, 20_000
NEAR = 8  # words on either side that count as near
LEAST_DOCS = 3  # documents that a word must be in to be in the graph
RESTART, STEPS = 0.5, 20
SEED = 3.5  # how far, in standard deviations, counts by label must differ from chance to make a seed
CUTS = (1.5, 2.5, 3.5, 4.5, 5.5)  # polarities from which words may belong to the lexicon; the best is taken
COPY_MARKS = 8  # of a text's three-word shingles those that hash lowest; texts that share one are near copies
AT_ONCE = 3_000_000
_WORD = re.compile(r"[a-z\u0080-\U0010ffff]+")


@dataclass
class Lexicon:
    """Words with a positive polarity, and the curve: score = 1 / (1 + exp(-(bias + slopes . features)))."""

    words: list[str]
    polarity: np.ndarray
    slopes: np.ndarray
    bias: float

    def hashes(self) -> np.ndarray:
        return word_hashes(pa.array(self.words, pa.string()), letters=True)[0] if self.words else np.empty(0, np.uint64)


def features(top: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The strongest polarity of a document's words, and how much there is in all, by itself and for its length."""
    return np.stack([top, np.log1p(total), np.log1p(100 * total / np.maximum(words, 20))], axis=1)


def _words(text: str) -> list[str]:
    return _WORD.findall(pc.utf8_lower(pa.scalar(text)).as_py())


def distinct(texts: list[str]) -> list[int]:
    """Places of texts of which none is a near copy of one before: copies would make any of their words look telling."""
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        ws = _words(text)
        marks = sorted({zlib.crc32(" ".join(ws[j : j + 3]).encode()) for j in range(max(1, len(ws) - 2))})[:COPY_MARKS]
        if not seen.intersection(marks):
            out.append(i)
        seen.update(marks)
    return out


def polarities(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Polarity of each word of the graph: the log ratio of the two walks' visiting rates. Empty without seeds of both kinds."""
    y = np.array(toxic)
    docs, bad = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        ws = set(_words(text))
        docs.update(ws)
        if label:
            bad.update(ws)
    names = sorted(w for w, n in docs.items() if n >= LEAST_DOCS)
    place = {w: i for i, w in enumerate(names)}
    found = [np.array([place[w] for w in _words(t) if w in place], np.int32) for t in texts]
    n, n_bad = np.array([docs[w] for w in names], float), np.array([bad[w] for w in names], float)
    del docs, bad, place
    p, q = (n_bad + 0.5) / (y.sum() + 1), (n - n_bad + 0.5) / (len(y) - y.sum() + 1)
    # Seeds: words whose counts by label differ by more than chance, by the signed root of the likelihood ratio.
    expected = n * y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(n_bad > 0, n_bad * np.log(n_bad / expected), 0) + np.where(n > n_bad, (n - n_bad) * np.log((n - n_bad) / (n - expected)), 0))
    strength = np.sign(p - q) * np.sqrt(np.maximum(g, 0))
    toxic_seeds = np.where((strength > SEED) & (p > 3 * q), strength, 0)
    clean_seeds = np.where(q >= p, np.sqrt(n - n_bad), 0)
    if not toxic_seeds.any() or not clean_seeds.any():
        return {}
    a, b, weight = ppmi(found, len(names))
    toxic_rate, clean_rate = (walk(a, b, weight, s / s.sum(), len(names)) for s in (toxic_seeds, clean_seeds))
    base = 0.02 / len(names)
    return dict(zip(names, np.log((toxic_rate + base) / (clean_rate + base)), strict=True))


def _features(texts: list[str], polarity: dict[str, float], cut: float) -> np.ndarray:
    known = {w: v for w, v in polarity.items() if v > cut}
    held = [[known.get(w, 0.0) for w in _words(t)] for t in texts]
    return features(np.array([max(h, default=0.0) for h in held]), np.array([sum(h) for h in held]), np.array([len(h) for h in held], float))


def induce(texts: list[str], toxic: list[int], share: float | None = None) -> Lexicon:
    """A lexicon from labelled texts; ``share`` is the share of toxic ones where it matters, that of the texts if not given.

    The curve, and the polarity from which a word belongs to the lexicon, are fitted on halves of the texts with polarities
    from the other half, so that words which tell by chance don't count. Without documents of both labels the lexicon is
    empty and all texts score alike.
    """
    share = (sum(toxic) / max(1, len(toxic))) if share is None else share
    blank = Lexicon([], np.empty(0), np.zeros(3), float(np.log(max(share, 0.01) / max(1 - share, 0.01))))
    keep = distinct(texts)
    texts, y = [texts[i] for i in keep], np.array([toxic[i] for i in keep])
    if not 0 < y.sum() < len(y):
        return blank
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    half = np.array([zlib.crc32(t.encode()) & 1 for t in texts])
    other = []
    for side in (0, 1):
        learn = np.flatnonzero(half != side)
        other.append(polarities([texts[i] for i in learn], [int(y[i]) for i in learn]))
    whole = polarities(texts, y.tolist())
    if not whole:
        return blank
    best = None
    for cut in CUTS:
        x = np.zeros((len(y), 3))
        for side in (0, 1):
            rows = np.flatnonzero(half == side)
            x[rows] = _features([texts[i] for i in rows], other[side], cut)
        slopes, bias = logistic(x, y, weight)
        p = 1 / (1 + np.exp(-np.clip(x @ slopes + bias, -30, 30)))
        loss = -(weight * np.log(np.where(y == 1, p, 1 - p))).mean()
        if best is None or loss < best[0]:
            best = (loss, cut, slopes, bias)
    _, cut, slopes, bias = best
    words = sorted(w for w, v in whole.items() if v > cut)
    return Lexicon(words, np.array([whole[w] for w in words]), slopes, bias)


def ppmi(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the word graph: pairs a < b that stand within NEAR words, weighted by positive mutual information."""
    code, times = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(docs), 250):  # few documents at a time: their pairs are many more than their words
        pairs = [code]
        for w in docs[start : start + 250]:
            w = w.astype(np.int64)
            pairs += [np.minimum(w[:-d], w[d:]) * size + np.maximum(w[:-d], w[d:]) for d in range(1, NEAR + 1)]
        known = len(code)
        merged, at = np.unique(np.concatenate(pairs), return_inverse=True)
        times = np.bincount(at[:known], times, len(merged)) + np.bincount(at[known:], minlength=len(merged))
        code = merged
    a, b = code // size, code % size
    apart = a != b
    a, b, times = a[apart], b[apart], times[apart]
    degree = np.bincount(a, times, size) + np.bincount(b, times, size)
    info = np.log(times * degree.sum() / np.maximum(degree[a] * degree[b], 1e-300)) if len(a) else np.empty(0)
    good = info > 0
    return a[good], b[good], info[good]


def walk(a: np.ndarray, b: np.ndarray, weight: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Visiting rates of a random walk that restarts at ``start``; where no edge leads on it restarts too."""
    out = np.bincount(a, weight, size) + np.bincount(b, weight, size)
    rate = start.copy()
    for _ in range(STEPS):
        share = np.divide(rate, out, out=np.zeros(size), where=out > 0)
        moved = np.bincount(b, share[a] * weight, size) + np.bincount(a, share[b] * weight, size)
        rate = (1 - RESTART) * moved
        rate += start * (1 - rate.sum())
    return rate


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and bias by Newton's method; the slopes are kept from growing without end on separable labels."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Lexicon:
    """A lexicon from documents with a ``toxic`` label of 0 or 1 that are not held out.

    The sample is bounded: of each label those ``docs_per_label`` documents of at most MOST_CHARS characters whose ids hash
    lowest. Labels of an id that differ from each other are not used.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    good = ~held_out(F.col("doc_id")) & (F.length("text") <= MOST_CHARS)
    slim = docs.where(good).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(marks, "doc_id")
    chosen = None
    for label in (1, 0):
        part = slim.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_label)
        chosen = part if chosen is None else chosen.union(part)
    # Ids first: texts are read again for the few that were chosen, and none is shuffled but theirs.
    texts = docs.where(good).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    n, bad = slim.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    return induce([r.text for r in rows], [int(r.toxic) for r in rows], bad / n if n else None)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` added: 0 to 1, from its words alone. A null or empty text scores as one without any word.

    All rows stay, repeated ones too; texts are scored whole, however long; an empty table stays empty. A column of that
    name is replaced.
    """
    from pyspark.sql.types import DoubleType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = lexicon.hashes()
        order = np.argsort(hashes)
        hashes, polarity = hashes[order], lexicon.polarity[order]
        maybe = np.zeros(1 << 16, bool)
        maybe[(hashes >> np.uint64(48)).astype(np.intp)] = True
        for batch in batches:
            texts, out = pc.fill_null(batch.column("text"), ""), []
            for a, b in runs(texts, AT_ONCE):
                found, starts = word_hashes(pc.utf8_lower(texts.slice(a, b - a)), letters=True)
                near = np.flatnonzero(maybe[(found >> np.uint64(48)).astype(np.intp)])
                at = np.minimum(np.searchsorted(hashes, found[near]), max(0, len(hashes) - 1))
                real = hashes[at] == found[near] if len(hashes) else np.zeros(0, bool)
                doc = np.searchsorted(starts, near[real], "right") - 1
                value = polarity[at[real]] if len(hashes) else np.empty(0)
                top = np.zeros(b - a)
                np.maximum.at(top, doc, value)
                x = features(top, np.bincount(doc, value, b - a), np.diff(starts).astype(float))
                out.append(1 / (1 + np.exp(-np.clip(x @ lexicon.slopes + lexicon.bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0))], schema=batch.schema.append(pa.field("score", pa.float64())))
        give_back()

    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("score", DoubleType()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its toxicity, the verdict at 0.3, and whether it was held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
