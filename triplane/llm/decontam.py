"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of the token positions in a span and ignore the others; the chosen tokens of every place in every
document and benchmark item are hashed, and equal hashes are hits. A hit fixes how document and item would lie over each
other; along that alignment all tokens of the item are compared, so substituted tokens neither hide a passage nor end it.
Wherever a stretch may differ from a document that holds it, some place of some mask is intact. Masks leave few or no seeds to
items shorter than that; those have seeds of adjacent tokens too, so short that one is always intact.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.common import durable, fresh, once, table, text_key

#: Chosen positions of each mask. No pattern of the substitutions that SHARE allows in STRETCH tokens spoils every place of all.
MASKS = ((0, 1, 2, 4, 7), (0, 2, 3, 6, 8), (0, 1, 4, 5, 9), (0, 4, 5, 6, 7))
#: A document holds an item if in some stretch of STRETCH of the item's tokens (all of a shorter one's) this share is equal.
STRETCH, SHARE = 13, 0.75
#: Items of fewer tokens have seeds of adjacent tokens too; of others masks miss no pattern of substitutions.
LONG = STRETCH
TOKEN = r"[\p{L}\p{N}]+"
BROADCAST_ROWS = 400_000
#: Of more seeds than those, the hashes alone are broadcast up to this number (16 bytes each).
FILTER_ROWS = 4_000_000


def _tokens(text: Column) -> Column:
    """Hashes of the lower-case words of a text: runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def run_length(n: int) -> int:
    """Adjacent tokens that are equal somewhere in an item of ``n`` tokens wherever a document that holds it differs."""
    stretch = min(n, STRETCH)
    least = ceil(SHARE * stretch)
    return ceil(least / (stretch - least + 1))


#: The run lengths of items of 1, 2, ... tokens.
RUNS = tuple(run_length(n) for n in range(1, LONG))


def _seeds(tokens: str, runs: list[int], own: bool) -> Column:
    """Of all masks and runs, one after the other, the hash at each token; null where one reaches beyond the end.

    own: runs only of the length that an item of so many tokens needs.
    """

    def of(number: int, mask: tuple[int, ...]) -> Column:
        def at(_: Column, i: Column) -> Column:
            inside = i + mask[-1] < F.size(tokens)
            if own and number >= len(MASKS):
                inside = inside & (F.get(F.array(*map(F.lit, RUNS)), F.size(tokens) - 1) == len(mask))
            return F.when(inside, F.xxhash64(F.lit(number), *(F.get(tokens, i + p) for p in mask)))

        return F.transform(tokens, at)

    return F.concat(*(of(k, m) for k, m in enumerate(MASKS)), *(of(len(MASKS) + n, tuple(range(n))) for n in runs))


def _spread(df: DataFrame, runs: list[int], own: bool = False) -> DataFrame:
    """``df`` (with ``tokens``) as one row per seed: its other columns, ``hash`` and ``place``."""
    made = once(df, seeds=_seeds("tokens", runs, own), n_tokens=F.size("tokens")).drop("tokens")
    rows = made.select(*(c for c in made.columns if c != "seeds"), F.posexplode("seeds").alias("at", "hash"))
    return rows.where("hash is not null").withColumn("place", F.col("at") % F.col("n_tokens")).drop("at", "n_tokens")


def _compared(shifts: Column, item: Column, text: Column) -> Column:
    """The best alignment of an item's tokens with a text's: ``best, matched, hits``; null if none holds the item."""
    need = F.ceil(SHARE * F.least(F.size(item), F.lit(STRETCH)))
    width = F.least(F.size(item), F.lit(STRETCH))
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, e: s + e)

    def aligned(x: Column) -> Column:
        # A shift below 0 asks for tokens before the first; get() gives null for them, as beyond the last.
        equal = F.transform(item, lambda t, q: F.when(F.get(text, x["shift"].cast("int") + q) == t, 1).otherwise(0))
        return F.struct(equal.alias("equal"), total(equal).alias("matched"), x["hits"].alias("hits"))

    def summed(x: Column) -> Column:
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(item) - width + 1), lambda s: total(F.slice(x["equal"], s, width))))
        return F.struct(best.alias("best"), x["matched"].alias("matched"), x["hits"].alias("hits"))

    likely = F.filter(F.transform(shifts, aligned), lambda x: x["matched"] >= need)
    return F.array_max(F.filter(F.transform(likely, summed), lambda x: x["best"] >= need))


LEAKS = "array<struct<item_id:bigint,hits:bigint,matched:int,item_tokens:int,best:int>>"


def mark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with ``leaks`` added: an array of ``item_id, hits, matched, item_tokens, best``, by item.

    hits: seeds that the best alignment shares; matched: the item's tokens that are equal along it; best: the largest number
    equal in any stretch. Items or texts that are null or have no tokens can't be found; texts are taken whole, however
    long. Repeated items count under each id, an item with a null id isn't used; all rows of ``docs`` stay, repeated ones
    too, and an empty table stays empty. A column ``leaks`` is replaced.
    """
    docs = docs.drop("leaks")
    known = once(items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text"), tokens=_tokens(F.col("text"))).drop("text")
    known = durable(known)
    sizes = [r[0] for r in known.select(F.size("tokens")).where(F.size("tokens").between(1, LONG - 1)).distinct().collect()]  # under LONG rows
    runs = sorted({RUNS[n - 1] for n in sizes})
    seeds = _spread(known, runs, own=True).select("hash", "item_id", F.col("place").alias("item_place"))
    bulk = known.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    fit = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    n_seeds = seeds.count()
    texts = docs.where(F.col("text").isNotNull()).select("text", *text_key(F.col("text")))
    places = _spread(once(texts, tokens=_tokens(F.col("text"))).drop("text"), runs)
    if BROADCAST_ROWS < n_seeds <= FILTER_ROWS:  # hashes alone are small enough to keep most places out of the shuffle
        places = places.join(F.broadcast(seeds.select("hash").distinct()), "hash", "left_semi")
    hits = places.join(fit(seeds, n_seeds), "hash").groupBy("key_a", "key_b", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.count("*").alias("hits"))
    # A text and an item lie over each other in no more ways than they have tokens.
    tried = durable(hits.groupBy("key_a", "key_b", "item_id").agg(F.collect_list(F.struct("shift", "hits")).alias("shifts")))
    keys = durable(tried.select("key_a", "key_b").distinct())
    # The tokens of those texts, each once, however many rows have it.
    again = texts.join(fit(keys, keys.count()), ["key_a", "key_b"], "left_semi")
    again = once(again, words=_tokens(F.col("text"))).groupBy("key_a", "key_b").agg(F.first("words").alias("words"))
    told = tried.join(again, ["key_a", "key_b"]).join(fit(known, bulk), "item_id")
    told = once(told, found=_compared(F.col("shifts"), F.col("tokens"), F.col("words")), item_tokens=F.size("tokens")).where("found is not null")
    leak = F.struct("item_id", "found.hits", "found.matched", "item_tokens", "found.best")
    ka, kb, lk = (fresh(docs, x) for x in ("_ka", "_kb", "_leaks"))
    held = durable(told.groupBy("key_a", "key_b").agg(F.array_sort(F.collect_list(leak)).alias(lk)).toDF(ka, kb, lk))  # no more than there are items
    a, b = text_key(F.col("text"))
    out = docs.join(fit(held, held.count()), (a == F.col(ka)) & (b == F.col(kb)), "left")
    return out.withColumn("leaks", F.coalesce(F.col(lk), F.array()).cast(LEAKS)).drop(ka, kb, lk)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds; clean documents have none."""
    found = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
