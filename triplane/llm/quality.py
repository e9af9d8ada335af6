"""Quality rules whose thresholds adapt to each language and source.

Every document is measured (symbols, repeated lines, repeated three-word windows, word length). For each language and
source, each measure's distribution is kept as a quantile sketch: counts by logarithmic bucket, of bounded relative
error, which add up from any number of parts. Fences set from the sketches' quantiles replace fixed cutoffs; documents
are then joined with their group's fences. No fence has a least or greatest value: what a measure may be is what is usual
in the group, and a short document, whose measures vary more by chance, is allowed that much beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.llm.common import durable, fresh, once, table, words

SYMBOLS = r"[#*$%&|<>]"
#: Width of the sketches' buckets: quantiles have a relative error of at most 0.25 %.
GAMMA = 1.005
#: A group with fewer documents takes the fences of its language, or else of the corpus.
LEAST_DOCS = 30
#: The quantiles of each measure between which its usual spread is seen; fences stand REACH times that beyond the outer ones.
#: Shares are 0 in most documents, so theirs has but an upper fence, and starts higher.
SPREAD = {"symbols": (0.5, 0.9), "dup_lines": (0.5, 0.9), "repeats": (0.5, 0.9), "word_length": (0.25, 0.75)}
REACH = 3.0
LOWER = ("word_length",)
#: What is counted comes in units: a symbol, a line, a window found twice. A count may exceed what the fence gives for the
#: document's size by ALLOWED deviations of a sum of such units.
UNIT = {"symbols": 1, "dup_lines": 1, "repeats": 6}
ALLOWED = 3.0


def _windows(found: Column) -> Column:
    """A hash of each three-word window."""
    window = F.transform(found, lambda w, i: F.xxhash64(w, F.get(found, i + 1), F.get(found, i + 2)))
    return F.slice(window, 1, F.greatest(F.size(found) - 2, F.lit(0)))


COUNTS = ("word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) added; such columns are replaced.

    A null text has no words, lines or symbols: all are 0.
    """
    docs = docs.drop(*COUNTS)
    w, ln, wd, pr, pl = (fresh(docs, x) for x in ("_words", "_lines", "_windows", "_pairs", "_places"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = once(
        docs,
        **{w: words(F.col("text")), ln: lines},
        word_chars=(F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    )
    hashed = once(base, **{wd: _windows(F.col(w))}, n_words=F.size(w).cast("long"), n_dup_lines=(F.size(ln) - F.size(F.array_distinct(ln))).cast("long")).drop(w, ln)
    # Windows sorted with their places: those next to an equal one repeat. Most texts have none, which is cheap to see.
    some = F.size(F.array_distinct(wd)) < F.size(wd)
    pairs = once(hashed, **{pr: F.when(some, F.array_sort(F.transform(wd, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}).drop(wd)
    near = lambda i: F.get(F.col(pr), i)["h"]
    same = lambda x, i: near(i - 1).eqNullSafe(x["h"]) | near(i + 1).eqNullSafe(x["h"])
    places = once(pairs, **{pl: F.array_sort(F.transform(F.filter(pr, same), lambda x: x["i"]))}).drop(pr)
    steps = F.transform(pl, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col(pl), i + 1) - p, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
    return once(places, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long")).drop(pl)


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / n,
        "repeats": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }


def _allowance(name: str, fence: Column) -> Column:
    """How far beyond its fence a document's measure may be by chance: ALLOWED deviations, given its size.

    Word lengths are taken to deviate from their mean by half of it.
    """
    if name == "word_length":
        return ALLOWED * fence / 2 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    size = F.greatest(F.col("word_chars") if name == "symbols" else F.col("n_words"), F.lit(1))
    return ALLOWED * F.sqrt(UNIT[name] * (fence * size + UNIT[name])) / size


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (the groups' columns and the measures) as counts by group, level, measure and bucket.

    Levels: 2 has each group, 1 each value of the first column of ``by``, 0 all rows. Sketches merge by adding counts.
    """
    log = lambda x: F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(GAMMA)))).otherwise(F.lit(None)).cast("long")
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), log(F.col(m)).alias("bucket")) for m in SPREAD))).alias("x"))
    cells = long.groupBy(*by, "x.measure", "x.bucket").agg(F.count("*").alias("n"))
    levels = [cells.select(F.lit(k).alias("level"), *(F.col(c) if i < k else F.lit(None).cast("string").alias(c) for i, c in enumerate(by)), "measure", "bucket", "n") for k in (0, 1, 2)]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return merged.groupBy("level", *by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str], least: int = LEAST_DOCS) -> DataFrame:
    """One row per group with enough documents: ``level``, the group and a map of low and high fences by measure."""
    group = ["level", *by, "measure"]
    running = Window.partitionBy(*group).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = sketches.withColumns({"below": F.sum("n").over(running), "total": F.sum("n").over(Window.partitionBy(*group))})
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (GAMMA + 1), F.lit(0.0))
    share = lambda end: F.create_map(*(x for m, q in SPREAD.items() for x in (F.lit(m), F.lit(q[end]))))[F.col("measure")]
    at = lambda end: F.min(F.when(F.col("below") >= share(end) * F.col("total"), value))
    quantiles = summed.where(F.col("total") >= least).groupBy(*group).agg(at(0).alias("inner"), at(1).alias("outer"))
    reach = REACH * (F.col("outer") - F.col("inner"))
    ends = quantiles.select("level", *by, "measure", F.when(F.col("measure").isin(*LOWER), F.col("inner") - reach).alias("low"), (F.col("outer") + reach).alias("high"))
    return ends.groupBy("level", *by).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("fences"))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept`` added; all rows stay, repeated ones too.

    kept: not base_failed, and within the fences of every measure. Fences come from documents that the base rules pass,
    by ``lang`` and ``source`` (nulls form groups of their own); where such a group, or its language, is too small, the
    next larger one's hold, and where all are, every document is within. Null and empty texts fail the base rules; texts
    are measured whole, however long; an empty table stays empty. Columns of the names added are replaced.
    """
    return decide(measure(docs))


def decide(measured: DataFrame) -> DataFrame:
    """Verdicts for documents that :func:`measure` has measured. It reads them twice; stored ones are measured once."""
    by = ["lang", "source"]
    rows = measured.drop("base_failed", "kept").withColumn("base_failed", base_failed())
    passed = rows.where(~F.col("base_failed")).select(*by, *(c.alias(m) for m, c in measures().items()))
    limits = fences(sketch(passed, by), by)
    own = {c: fresh(rows, f"_{c}") for c in by}
    held = [fresh(rows, f"_fences{level}") for level in (0, 1, 2)]
    out = rows
    for level in (2, 1, 0):  # a few rows per group of the corpus; Spark broadcasts them if their measured size allows
        part = limits.where(F.col("level") == level).select(*(F.col(c).alias(own[c]) for c in by[:level]), F.col("fences").alias(held[level]))
        on = F.lit(True)
        for c in by[:level]:
            on = on & rows[c].eqNullSafe(F.col(own[c]))
        out = out.join(part if level else F.broadcast(part), on, "left").drop(*(own[c] for c in by[:level]))  # level 0 has one row
    found = F.coalesce(*(F.col(held[level]) for level in (2, 1, 0)))
    within = F.lit(True)
    for m, c in measures().items():
        high, low = found[m]["high"], found[m]["low"]
        within = within & F.coalesce(c <= high + _allowance(m, high), F.lit(True)) & F.coalesce(c >= low - _allowance(m, low), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & within).drop(*held)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts, and the verdicts of the base rules and of the fences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = durable(measure(docs).drop("text"))  # the counts alone, a few bytes a document
    return decide(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
