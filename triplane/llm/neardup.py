"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: times in the text by inverse document frequency. Frequencies are
counted over all documents, in a count-min sketch that adds up from any number of parts. Each document draws samples
such that two documents draw alike with the probability of their weighted Jaccard similarity; bands of samples propose
pairs; pairs are verified by that similarity, computed from the shingles; classes are the components of what is verified.

Equal texts count as one from the start. In a band's bucket each member is paired with the bucket's first, which joins
groups of any size by as many pairs as members. Of what buckets, however crowded, still hold in different classes every
pair that is similar enough is found, by an exact join: shingles are put in one order, the rarest first, and a pair can only
be similar if the two share one that comes before the last 80 % of either's weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.llm.common import durable, fresh, give_back, small_batches, table, text_key
from triplane.llm.components import components
from triplane.llm.hashing import mix, runs, word_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: The frequency sketch: rows of slots, and the parts in which it is added up. What other shingles add to a slot is in the
#: mean the same share of all documents at any size of corpus, and is taken off.
SLOT_BITS, SKETCH, PARTS = 18, 3, 16
#: Shingles in less than about this share of the documents weigh alike: the scale at which boilerplate begins.
RARE = 0.001
#: Weights are rounded to powers of 2 ** (1 / GRID); of LEVELS no text is long enough to need more. Draws of the first TABLED
#: levels are kept in tables, those of shingles that a text has some thousand times are computed.
GRID, LEVELS, TABLED = 4, 256, 64
POOL = 1 << 16
#: Bytes of texts that are hashed at once: some 70 times as much memory is held meanwhile.
AT_ONCE = 250_000
BROADCAST_ROWS = 1_000_000
#: Documents that share a shingle are met in blocks of about so many, all blocks with all others.
CROWD = 256
#: Pairs of one document that are verified in one part.
HUB = 256
#: Texts that a worker remembers, so that copies of one are not sampled again.
REMEMBERED = 100_000
#: Sums of weights that are added up in another order differ by less than this share.
SLACK = 1e-9

_rng = np.random.default_rng(77)
_ORDER = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DRAW = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct shingles' hashes, rising, and how often it has each.

    A text of one to four words has one shingle, all its words; a text without words none.
    """
    words, starts = word_hashes(texts)
    with np.errstate(over="ignore"):
        all_ = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            all_ += words[j : j + len(all_)] * _ORDER[j]
        all_ = mix(all_)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(all_[a : b - SHINGLE + 1], return_counts=True)
            elif b > a:
                yield mix((words[a:b] * _ORDER[: b - a]).sum(keepdims=True) + np.uint64(b - a)), np.ones(1, np.int64)
            else:
                yield np.empty(0, np.uint64), np.empty(0, np.int64)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Of each row of the sketch the slots of some shingles."""
    return [((hashes >> np.uint64(SLOT_BITS * r)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.intp) for r in range(SKETCH)]


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: of each row and slot how many have a shingle in it, counted with its others, and all documents."""
    width = (SKETCH << SLOT_BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, n = np.zeros((SKETCH, 1 << SLOT_BITS), np.int64), 0
        for batch in batches:
            texts = batch.column(0)
            n += len(texts)
            for a, b in runs(texts, AT_ONCE):
                found = np.concatenate([s for s, _ in shingles(texts.slice(a, b - a))])
                for row, at in zip(slots, _slots(found), strict=True):
                    row += np.bincount(at, minlength=1 << SLOT_BITS)
        give_back()
        if n:
            pack = pa.Codec("zstd")
            parts = [pack.compress(p.tobytes(), asbytes=True) for p in slots.astype("<i8").reshape(PARTS, -1)]
            yield pa.record_batch([pa.array([*range(PARTS)], pa.int32()), pa.array(parts, pa.binary()), pa.array([n] + [0] * (PARTS - 1), pa.int64())], names=["part", "counts", "docs"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        pack = pa.Codec("zstd")
        for batch in batches:
            for part, raw, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                more = np.frombuffer(pack.decompress(raw, decompressed_size=8 * width, asbytes=True), "<i8")
                sums[part] = sums[part] + more if part in sums else more
                docs[part] = docs.get(part, 0) + n
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array(list(docs.values()), pa.int64())], names=["part", "counts", "docs"])

    kind = "part int, counts binary, docs long"
    merged = docs.select("text").mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(add, kind)
    slots, n = np.zeros((PARTS, width), np.int64), 0
    for row in merged.collect():  # PARTS rows of fixed size
        slots[row.part] = np.frombuffer(row.counts, "<i8")
        n += row.docs
    return slots.reshape(SKETCH, -1), n


def levels_of(slots: np.ndarray, docs: int) -> np.ndarray:
    """The logarithm of each slot's inverse document frequency, 1 + ln((1 + RARE) / (share of documents + RARE)).

    From each slot's count is taken what shingles of other slots add to one in the mean.
    """
    own = np.maximum(slots - (slots.sum(axis=1, keepdims=True) - slots) / (slots.shape[1] - 1), 0)
    share = np.minimum(own / max(docs, 1), 1)
    return np.log2(1 + np.log((1 + RARE) / (share + RARE))).astype(np.float32)


def _rarity(hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The logarithm of each shingle's inverse document frequency. Of the sketch's rows the one of least count holds."""
    return np.maximum.reduce([row[at] for row, at in zip(idf, _slots(hashes), strict=True)])


def weigh(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights as levels: 2 ** (level / GRID) is the weight."""
    log = _rarity(hashes, idf)
    if times.size and times.max() > 1:
        log = log + np.log2(times)
    return np.clip(np.rint(log * GRID), 0, LEVELS - 1).astype(np.uint8)


class Remembered:
    """Whether a text was met before in this task, as far as the last REMEMBERED texts tell."""

    def __init__(self) -> None:
        self.now: set = set()
        self.before: set = set()

    def __call__(self, key: tuple) -> bool:
        met = key in self.now or key in self.before
        self.now.add(key)
        if len(self.now) >= REMEMBERED // 2:
            self.now, self.before = set(), self.now
        return met


class Sampler:
    """Draws of improved consistent weighted sampling.

    For shingle x of weight w and draw k, with r and c of Gamma(2, 1) and b uniform, all fixed by x and k:
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)). The draw is the x, t of least a. The variates come
    from a pool of POOL triples that x and k choose from, so ln a is a table by weight level and triple; a place is a level
    times POOL plus a triple.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(4242)
        r, c, b = rng.gamma(2, 1, POOL), rng.gamma(2, 1, POOL), rng.random(POOL)
        self.r, self.log_c, self.b = r, np.log(c), b
        self.a, self.t = np.empty(TABLED * POOL, np.float32), np.empty(TABLED * POOL, np.int32)
        for level in range(TABLED):
            own = slice(level * POOL, (level + 1) * POOL)
            self.a[own], self.t[own] = self._values(np.arange(own.start, own.stop))

    def _values(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t at some places, whether tables have them or not."""
        level, triple = place // POOL, place % POOL
        r, b = self.r[triple], self.b[triple]
        t = np.floor(level * (np.log(2) / GRID) / r + b)
        return (self.log_c[triple] - r * (t - b + 1)).astype(np.float32), t.astype(np.int32)

    def draw(self, hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The samples, each as a hash of its shingle and t. Equal a: the lesser hash."""
        best, at, base = None, None, level.astype(np.int64) << 16
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), 2048):
                place = ((hashes[i : i + 2048, None] * _DRAW) >> np.uint64(48)).astype(np.int64)
                place += base[i : i + 2048, None]
                a = self.a.take(place) if level[i : i + 2048].max() < TABLED else self._values(place)[0]
                row = a.argmin(axis=0)
                least, where = a[row, np.arange(SAMPLES)], place[row, np.arange(SAMPLES)]
                if best is None:
                    best, at, won = least, where, row
                else:
                    better = least < best
                    best, at, won = np.where(better, least, best), np.where(better, where, at), np.where(better, row + i, won)
            t = self.t[at] if at.max() < len(self.t) else self._values(at)[1]
            return mix(hashes[won] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows ``key_a, key_b, bands``: one or more per distinct text with a word."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, number, met = Sampler(), np.arange(BANDS, dtype=np.uint64), Remembered()
        for batch in batches:
            new = [i for i, key in enumerate(zip(batch.column("key_a").to_pylist(), batch.column("key_b").to_pylist(), strict=True)) if not met(key)]
            batch = batch.take(pa.array(new, pa.int64()))
            texts = batch.column("text")
            for a, b in runs(texts, AT_ONCE):
                rows, bands = [], []
                for i, (hashes, times) in enumerate(shingles(texts.slice(a, b - a)), a):
                    if not len(hashes):
                        continue
                    samples = sampler.draw(hashes, weigh(hashes, times, shared.value))
                    rows.append(i)
                    with np.errstate(over="ignore"):
                        band = mix((samples.reshape(BANDS, ROWS) * _ORDER[:ROWS]).sum(axis=1) + number)
                    bands.append(band.view(np.int64))
                chosen = batch.select(["key_a", "key_b"]).take(pa.array(rows, pa.int64()))
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32), np.concatenate(bands) if bands else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([*chosen.columns, lists], names=["key_a", "key_b", "bands"])
        del sampler
        give_back()

    slim = docs.where(F.col("text").isNotNull()).select("text", *text_key(F.col("text")))
    return slim.mapInArrow(run, "key_a long, key_b long, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], powers: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets with weight levels."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = powers[np.minimum(a[1][i], b[1][j])].sum()
    return float(both / max(powers[a[1]].sum() + powers[b[1]].sum() - both, 1e-300))


def _texts(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``node, text`` of all documents whose text is one of the nodes ``asked``."""
    asked = durable(asked.join(nodes.select("node", "key_a", "key_b"), "node"))
    few = asked.count() <= BROADCAST_ROWS
    texts = docs.where(F.col("text").isNotNull()).select("text", *text_key(F.col("text")))
    return texts.join(F.broadcast(asked) if few else asked, ["key_a", "key_b"]).select("node", "text")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, idf: np.ndarray, least: float = SIMILAR) -> DataFrame:
    """Those of ``pairs`` (``a, b``: nodes) whose similarity is ``least`` or more; ``nodes`` has each node's text key."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    powers = 2.0 ** (np.arange(LEVELS) / GRID)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Remembered()
        for batch in batches:
            batch = batch.take(pa.array([i for i, node in enumerate(batch.column("node").to_pylist()) if not met(node)], pa.int64()))
            texts = batch.column("text")
            for a, b in runs(texts, AT_ONCE):
                out = [hashes.tobytes() + weigh(hashes, times, shared.value).tobytes() for hashes, times in shingles(texts.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(out, pa.binary())], names=["node", "vector"])
        give_back()

    def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw) // 9
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, np.uint8, n, 8 * n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted: the vector of a, which has no b, before those of the b's that are compared with it.
        first, it = None, (None, None)
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            vector = batch.column("vector")
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if b is None:
                    first, it = a, unpack(vector[i].as_py())
                elif a == first and similarity(it, unpack(vector[i].as_py()), powers) >= least:
                    out[0].append(a)
                    out[1].append(b)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])
        give_back()

    made = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs).mapInArrow(vectors, "node long, vector binary")
    made = durable(made.groupBy("node").agg(F.first("vector").alias("vector")))  # copies of a text have one vector
    # A hub's pairs are spread over as many parts as they fill, each of which gets its vector once: it's no one task's, and its
    # vector isn't repeated on each of its rows.
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("parts"))
    left = parts.join(made.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(1), "parts")).alias("part"), F.lit(None).cast("long").alias("b"), "vector")
    spread = pairs.join(parts, "a").select("a", "b", (F.pmod(F.xxhash64("b"), F.col("parts")) + 1).alias("part"))
    right = spread.join(made.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "vector")
    rows = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(compare, "a long, b long")


def _remaining(label: DataFrame) -> DataFrame:
    """Rows ``key, node``: all members of the buckets that hold nodes of different components."""
    rows = label.select("node", "component", F.explode("bands").alias("key"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    return rows.join(mixed.select("key"), "key").select("key", "node")


def prefix(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a text in the order of all shingles, and for each the weight from it to the last.

    What two texts share weighs at least ``least`` of either's weight if they are that similar. So the first shingle they
    share has that much behind it in both, itself included; shingles with less are not among the first.
    """
    order = np.argsort(-_rarity(hashes, idf), kind="stable")  # equally rare ones stay in the order of their hashes
    weight = (2.0 ** (np.arange(LEVELS) / GRID))[weigh(hashes, times, idf)][order]
    rest = weight[::-1].cumsum()[::-1]
    n = int(np.count_nonzero(rest >= least * (1 - SLACK) * rest[0])) if len(rest) else 0
    return hashes[order[:n]], rest[:n]


def _likely_pairs(label: DataFrame, nodes: DataFrame, docs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Rows ``a, b``: nodes of different components, of buckets that hold such, that may be so similar; no other pairs of them are."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Remembered()
        for batch in batches:
            batch = batch.take(pa.array([i for i, node in enumerate(batch.column("node").to_pylist()) if not met(node)], pa.int64()))
            texts = batch.column("text")
            for a, b in runs(texts, AT_ONCE):
                found = [prefix(hashes, times, shared.value, least) for hashes, times in shingles(texts.slice(a, b - a))]
                ends = np.cumsum([0, *(len(h) for h, _ in found)], dtype=np.int32)
                first = pa.ListArray.from_arrays(ends, np.concatenate([h for h, _ in found]).view(np.int64))
                rest = pa.ListArray.from_arrays(ends, np.concatenate([r for _, r in found]))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), first, rest], names=["node", "first", "rest"])
        give_back()

    left = _remaining(label).select("node").distinct()
    made = _texts(left, nodes, docs).mapInArrow(run, "node long, first array<long>, rest array<double>")
    made = made.groupBy("node").agg(F.first(F.struct("first", "rest")).alias("x")).join(label.select("node", "component"), "node")  # copies of a text have one
    rows = made.select("node", "component", F.col("x.rest")[0].alias("weight"), F.explode(F.arrays_zip("x.first", "x.rest")).alias("at"))
    rows = durable(rows.select("node", "component", "weight", F.col("at.first").alias("shingle"), F.col("at.rest").alias("rest")))
    many = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")).where("low <> high")
    held = durable(rows.join(many.select("shingle", "blocks"), "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x, y = held.withColumn("other", other).alias("x"), held.withColumn("other", other).alias("y")
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    # What they share from here on weighs no more than either's rest; this holds of the first shingle they share.
    likely = F.least("x.rest", "y.rest") * (1 + least) >= least * (1 - SLACK) * (F.col("x.weight") + F.col("y.weight"))
    return x.join(y, same & (F.col("x.component") < F.col("y.component")) & likely).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _joined(docs: DataFrame, least: float) -> DataFrame:
    """Rows ``key_a, key_b, component``: the distinct texts that are near-duplicates of others."""
    small_batches(docs.sparkSession)
    slots, n = frequencies(docs)
    idf = levels_of(slots, n)
    found = signatures(docs, idf).groupBy("key_a", "key_b").agg(F.first("bands").alias("bands"))
    nodes = durable(found.withColumn("node", F.monotonically_increasing_id()))  # stored, so a node keeps its number
    banded = nodes.select("node", F.explode("bands").alias("band"))
    firsts = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("band", "a")
    pairs = durable(banded.join(firsts, "band").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    links = durable(verify(pairs, nodes, docs, idf, least))
    joined = components(links)
    label = nodes.join(joined, "node", "left").select("node", "bands", F.coalesce("component", "node").alias("component"))
    more = durable(_likely_pairs(label, nodes, docs, idf, least).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        joined = components(links.union(verify(more, nodes, docs, idf, least)))
    return durable(joined.join(nodes.select("node", "key_a", "key_b"), "node").select("key_a", "key_b", "component"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), F.col("text").isNull().alias("none"))


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Rows ``doc_id, class_id``: one per row of ``docs``, the class named by its least id.

    A row is of the class of its text. Equal texts are always of one class, empty ones too; a null text is of no other
    row's class, and its own is named by its id. Rows without an id take part; a class that has no id at all is null. Texts
    of one to four words are similar only if their words are equal. Texts are taken whole, however long. Extra columns are
    not read; an empty table gives no rows. The session's Arrow batches are made small.
    """
    joined = _joined(docs, least)
    rows = _rows(docs)
    texts = rows.where("not none").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("least")).join(joined, ["key_a", "key_b"], "left")
    names = texts.where("component is not null").groupBy("component").agg(F.min("least").alias("class_id"))
    named = texts.join(names, "component", "left").select("key_a", "key_b", F.coalesce("class_id", "least").alias("class_id"))
    own = rows.join(named, ["key_a", "key_b"], "left")
    return own.select("doc_id", F.when(F.col("none"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay where one document of each near-duplicate class does: that of the least id.

    A document without an id gives way to one with an id. Rows of one id but different texts are different documents;
    rows of one id and text are one, of which the first by its other columns stays. Rows without a text all stay. Texts are
    not shuffled unless more than BROADCAST_ROWS rows go.
    """
    ka, kb, tag, order = (fresh(docs, x) for x in ("_ka", "_kb", "_tag", "_order"))
    rows = _rows(docs).where("not none").groupBy("doc_id", "key_a", "key_b").agg(F.count("*").alias("n"))
    rows = rows.join(_joined(docs, least), ["key_a", "key_b"], "left")
    alone = F.col("component").isNull()
    group = [F.coalesce("component", "key_a").alias("group_a"), F.when(alone, F.col("key_b")).alias("group_b"), alone.alias("alone")]
    rows = rows.select("doc_id", "key_a", "key_b", "n", F.struct(*group).alias("group"))
    me = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key_a", "key_b")
    first = rows.groupBy("group").agg(F.min(me).alias("first"))
    judged = rows.join(first, "group").select("doc_id", "key_a", "key_b", (me == F.col("first")).alias("stays"), "n")
    odd = durable(judged.where("not stays or n > 1").select(F.col("doc_id").alias(tag), F.col("key_a").alias(ka), F.col("key_b").alias(kb), "stays"))
    few = odd.count() <= BROADCAST_ROWS

    def side(stays: bool, how: str) -> DataFrame:
        a, b = text_key(F.col("text"))
        part = odd.where("stays") if stays else odd
        part = part.drop("stays")
        on = (a == part[ka]) & (b == part[kb]) & docs["doc_id"].cast("long").eqNullSafe(part[tag])
        return docs.join(F.broadcast(part) if few else part, on, how)

    out = side(False, "left_anti")
    if not odd.where("stays").isEmpty():
        again = side(True, "left_semi")
        place = F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), *text_key(F.col("text"))).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
        out = out.unionByName(again.withColumn(order, place).where(F.col(order) == 1).drop(order))
    return out


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its id and that of its near-duplicate class."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
