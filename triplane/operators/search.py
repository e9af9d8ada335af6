"""Full-text search over postings tables.

The index of a domain has a row per document and term with its frequency and positions and the document's number of
distinct terms. It is kept: texts are analysed once, when it's built. A search filters postings to the terms asked for,
groups them by document, and takes the top by the number of required terms found and then by score; of a saved index it
reads only the pages of its terms.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.catalog import Database
from triplane.edn import Keyword
from triplane.operators.attributes import source_of
from triplane.plans.lower import RELATION_FUNCTIONS, Env, Relations, constant
from triplane.storage import durable, shared_folder

STOP_WORDS = frozenset("there these their such with will then into this that they and the are for was not but be if of an in on no to or as is at it by a".split())
PUNCTUATION = r"""[\s:/.;,!=?"'()\[\]{}|<>&@#^*\\~`]+"""
LONGEST = 127
TOP = 10


def tokens(text: Column) -> Column:
    """The terms of a text with positions: lower case, without stop words, whose places still count."""
    words = F.split(F.lower(text), PUNCTUATION)
    placed = F.transform(F.filter(words, lambda w: w != ""), lambda w, i: F.struct(w.alias("term"), i.alias("position")))
    return F.filter(placed, lambda x: ~x["term"].isin(*sorted(STOP_WORDS)) & (F.length(x["term"]) <= LONGEST))


def terms_of(text: str) -> list[str]:
    """Terms of a query string, as documents are analysed."""
    return [w for w in re.split(PUNCTUATION, text.lower()) if w and w not in STOP_WORDS and len(w) <= LONGEST]


@dataclass
class Index:
    """postings: doc, term, tf, positions, norm (the document's distinct terms); size: documents ever added."""

    postings: DataFrame
    size: int

    @property
    def docs(self) -> DataFrame:
        """Rows ``doc, norm``."""
        return self.postings.groupBy("doc").agg(F.first("norm").alias("norm"))

    def doc_count(self) -> int:
        return self.docs.count()

    def indexed(self, doc: Any) -> bool:
        return not self.postings.where(F.col("doc") == doc).isEmpty()

    def add(self, rows: DataFrame) -> Index:
        """With more documents (``doc, text``); those of ids that are there are replaced."""
        new = build(rows)
        return Index(durable(self.without(rows.select("doc")).postings.unionByName(new.postings)), self.size + new.size)

    def without(self, docs: DataFrame) -> Index:
        """Without the documents of some ids (column ``doc``)."""
        return Index(self.postings.join(docs.select("doc").distinct(), "doc", "left_anti"), self.size)

    def remove(self, doc: Any) -> Index:
        return Index(self.postings.where(F.col("doc") != doc), self.size)

    def clear(self) -> Index:
        return Index(self.postings.limit(0), 0)

    def save(self, path: str) -> None:
        """Writes the index. Postings lie sorted by term, so a search reads only the files and row groups of its terms."""
        self.postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        _sized(self.postings.sparkSession, self.size, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size").first()[0])


def words(text: Column) -> Column:
    r"""Terms as ``\b`` of a regular expression bounds them: runs of ASCII letters, digits and ``_``, in lower case.

    Places are adjacent only if a single space is between, so a phrase is found as it's written.
    """
    parts = F.split(F.lower(F.regexp_replace(text, "[^0-9A-Za-z_ ]", "  ")), " ")
    return F.filter(F.transform(parts, lambda w, i: F.struct(w.alias("term"), i.alias("position"))), lambda x: x["term"] != "")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _grouped(placed: Column) -> Column:
    """A document's terms with ``tf``, positions and norm: its places sorted by term, cut where the term changes."""

    def cut(found: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (found[i]["term"] != F.get(found, i - 1)["term"]))
        return _let(begins, lambda at: F.transform(at, lambda i, k: run(found, i, F.coalesce(F.get(at, k + 1), F.size(found)) - i, F.size(at))))

    def run(found: Column, i: Column, n: Column, norm: Column) -> Column:
        places = F.transform(F.slice(found, i + 1, n), lambda x: x["position"])
        return F.struct(found[i]["term"].alias("term"), n.cast("long").alias("tf"), places.alias("positions"), norm.cast("long").alias("norm"))

    return _let(F.sort_array(placed), lambda found: F.when(F.size(found) > 0, cut(found)))


def postings(rows: DataFrame, analyzer: Callable[[Column], Column] = tokens) -> DataFrame:
    """Rows ``doc, term, tf, positions, norm`` of ``doc, text``, each document by itself: none is shuffled or kept.

    Only if an id comes more than once are its rows brought together.
    """
    rows = rows.where("doc is not null")
    listed = rows.where("text is not null").select("doc", F.explode(_grouped(analyzer(F.col("text")))).alias("t")).select("doc", "t.*")
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return listed
    merged = listed.groupBy("doc", "term").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return merged.withColumn("norm", F.count("*").over(Window.partitionBy("doc")))


def build(rows: DataFrame, analyzer: Callable[[Column], Column] = tokens) -> Index:
    """An index of ``doc, text``, stored in the shared folder; documents without a term are not indexed."""
    made = durable(postings(rows, analyzer))
    return Index(made, made.select("doc").distinct().count())


#: Bytes of a table's files whose documents a segment of its kept index has.
SEGMENT = 8_000_000


def kept(rows: DataFrame, name: str, analyzer: Callable[[Column], Column] = tokens) -> Index:
    """The saved index of a table's ``doc, text`` in the shared folder; built if there is none for the files as they are.

    ``name`` tells indexes of the same files apart, such as by other analysers. The index is made in segments: a task analyses
    some documents and writes their postings sorted by term, small enough to be sorted in memory. A search reads of each segment
    the pages of its terms.
    """
    spark = rows.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    stamp, size = [name], 0
    for f in sorted(rows.inputFiles()):
        path = files.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        stamp.append(f"{f} {status.getLen()} {status.getModificationTime()}")
        size += status.getLen()
    folder = f"{shared_folder(spark).rsplit('/', 1)[0]}/indexes/{hashlib.sha256(chr(10).join(stamp).encode()).hexdigest()[:32]}"
    done = files.Path(f"{folder}/size/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        parted = rows.repartition(-(-size // SEGMENT) or 1, "doc")
        postings(parted, analyzer).sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{folder}/postings")
        written = spark.read.parquet(f"{folder}/postings")
        _sized(spark, written.select("doc").distinct().count(), folder)
    return Index.load(spark, folder)


def _sized(spark: SparkSession, size: int, path: str) -> None:
    """Written last: a folder that has it is whole."""
    spark.range(1).select(F.lit(size).cast("long").alias("size")).coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def _required(query: Any) -> list[str]:
    """Terms that count for ranking: all but those under :not."""
    if isinstance(query, str):
        return list(dict.fromkeys(terms_of(query)))
    if isinstance(query, dict):
        return list(dict.fromkeys(terms_of(query.get(":phrase") or query.get(":term"))))
    head, *rest = query
    return [] if head == ":not" else list(dict.fromkeys(t for r in rest for t in _required(r)))


def _all_terms(query: Any) -> list[str]:
    if isinstance(query, (str, dict)):
        return _required(query)
    return list(dict.fromkeys(t for r in query[1:] for t in _all_terms(r)))


def _holds(query: Any, found: Column) -> Column:
    """Whether a document, by its map of terms to positions, satisfies a query."""
    has = lambda t: F.map_contains_key(found, F.lit(t))
    if isinstance(query, str) and not isinstance(query, Keyword):
        ts = terms_of(query)
        out = F.lit(False)
        for t in ts:
            out = out | has(t)
        return out
    if isinstance(query, dict):
        ts = terms_of(query.get(":phrase") or query.get(":term"))
        out = F.lit(bool(ts))
        for t in ts:
            out = out & has(t)
        if ":phrase" in query and len(ts) > 1:
            after = lambda p: [F.array_contains(found[t], p + i) for i, t in enumerate(ts) if i]

            def follows(p: Column) -> Column:
                ok = F.lit(True)
                for x in after(p):
                    ok = ok & x
                return ok

            out = out & F.exists(found[ts[0]], follows)
        return F.coalesce(out, F.lit(False))
    head, *rest = query
    parts = [_holds(r, found) for r in rest]
    if head == ":not":
        out = F.lit(True)
        for p in parts:
            out = out & ~p
        return out
    out = parts[0]
    for p in parts[1:]:
        out = out & p if head == ":and" else out | p
    return out


#: Proximity: hits farther apart than this begin a new span; so many times the wanted documents are scored anew.
FAR, EXPANSION = 45, 2


def spans(hits: list[tuple[int, str]], far: int = FAR) -> list[list[tuple[int, str]]]:
    """Hits of a document, by position, as runs in which no term comes twice and no gap is longer than ``far``.

    Where a term comes again, the run is cut there, or after its earlier place if the later hit lies nearer to the rest.
    """
    out: list[list[tuple[int, str]]] = []
    run: list[tuple[int, str]] = []
    for place, term in sorted(hits):
        if run:
            gap = place - run[-1][0]
            at = next((i for i, (_, t) in enumerate(run) if t == term), None)
            if gap > far or run[-1][1] == term:
                out.append(run)
                run = []
            elif at is not None:
                near = gap < run[at + 1][0] - run[at][0]
                out.append(run[: at + 1] if near else run)
                run = run[at + 1 :] if near else []
        run.append((place, term))
    return [r for r in [*out, run] if r]


def closeness(found: dict[str, list[int]], weights: dict[str, float], norm: int, far: int = FAR) -> float:
    """The score of a document by the spans of its hits: longer and denser ones count more."""
    runs = spans([(p, t) for t, places in found.items() for p in places], far)
    total = 0.0
    for r in runs:
        width = far if len(r) == 1 else r[-1][0] - r[0][0] + 1
        total += sum(weights.get(t, 0.0) for _, t in r) * (len(r) / width) ** 0.25 * len(r) ** 0.3
    return total / norm


def _first(rows: DataFrame, top: int | None) -> DataFrame:
    return rows if top is None else rows.limit(top)


def _rescored(good: DataFrame, required: list[str], counts: dict[str, int], index: Index, top: int | None) -> DataFrame:
    """Of each tier the best candidates, scored by closeness; few rows, by Arrow."""
    df = {r.term: r.df for r in index.postings.where(F.col("term").isin(*required)).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = {t: (1 + math.log10(counts[t])) * math.log10(index.size / n) for t, n in df.items()}
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.col("score").desc(), "doc"))
    best = good if top is None else good.withColumn("_rank", rank).where(F.col("_rank") <= EXPANSION * top)

    @F.pandas_udf("double")
    def score(found: pd.Series, norm: pd.Series) -> pd.Series:
        return pd.Series([closeness({t: list(p) for t, p in dict(f).items() if t in weights}, weights, int(n)) for f, n in zip(found, norm, strict=True)], dtype=float)

    return best.withColumn("score", score("found", "norm"))


def search(index: Index, query: Any, top: int | None = TOP, proximity: bool = False, doc_filter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows ``doc, score``, best first: more of the required terms, then the higher score, then the lesser id.

    Score: over terms, (1 + log10 qf) log10(N / df) (1 + log10 tf), by the document's number of distinct terms. A query that
    only negates gives documents of score 0.1 by id, or none if no term of it is indexed. With ``proximity`` the best of each
    tier are scored anew by how near to each other their hits stand. Documents that ``doc_filter`` (of the id's column)
    rejects don't count among the top. A ``top`` of None gives all matches.
    """
    required, every = _required(query), _all_terms(query)
    allowed = (lambda df: df) if doc_filter is None else (lambda df: df.where(doc_filter(F.col("doc"))))
    hits = index.postings.where(F.col("term").isin(*every)) if every else index.postings.limit(0)
    found = F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found")
    if not required:
        if hits.isEmpty():
            return index.docs.limit(0).select("doc", F.lit(0.1).alias("score"))
        rest = index.docs.join(hits.groupBy("doc").agg(found), "doc", "left").where(_holds(query, F.coalesce("found", F.create_map().cast("map<string,array<int>>"))))
        return _first(allowed(rest).select("doc", F.lit(0.1).alias("score")).orderBy("doc"), top)
    counts = {t: (terms_of(query).count(t) if isinstance(query, str) else 1) for t in required}
    weight = F.create_map(*(x for t, n in counts.items() for x in (F.lit(t), F.lit(1.0 + math.log10(n)))))
    df = hits.where(F.col("term").isin(*required)).groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    scored = hits.join(F.broadcast(df), "term", "left").withColumn("s", weight[F.col("term")] * F.log10(F.lit(float(index.size)) / F.col("df")) * (1 + F.log10("tf")))
    sums = scored.groupBy("doc").agg(F.sum("s").alias("s"), F.count("s").alias("n"), F.first("norm").alias("norm"), found).where("n > 0")
    good = allowed(sums.where(_holds(query, F.col("found")))).withColumn("score", F.col("s") / F.col("norm"))
    if proximity:
        good = _rescored(good, required, counts, index, top)
    return _first(good.select("doc", "n", "score").orderBy(F.col("n").desc(), F.col("score").desc(), "doc"), top).select("doc", "score")


def offsets(text: Column, term: str) -> Column:
    """Places (from 0) where a term's words begin in a text."""
    bound = "\\s:/.;,!=?\"'()\\[\\]{}|<>&@#^*~`"
    parts = F.split(F.lower(text), f"(?<![^{bound}]){re.escape(term)}(?![^{bound}])", -1)
    ends = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)) + i * len(term))
    return ends


def index_of(db: Database, attribute: str) -> Index:
    """The index of an attribute's values, kept with the database: built when it is first asked for."""
    if attribute not in db.indexes:
        db.indexes[attribute] = build(db.scan(attribute).select(F.col("e").alias("doc"), F.col("v").alias("text")))
    return db.indexes[attribute]


def re_index(db: Database, attribute: str, analyzer: Callable[[Column], Column] = tokens) -> Index:
    """The index built anew, as by another analyser."""
    db.indexes[attribute] = build(db.scan(attribute).select(F.col("e").alias("doc"), F.col("v").alias("text")), analyzer)
    return db.indexes[attribute]


def fulltext_datoms(db: Database, query: Any, attributes: list[str] | None = None, opts: dict | None = None) -> DataFrame:
    """Facts ``e, a, v, offsets, score`` that match, of the attributes named or of all that are full-text ones.

    Options: ``:top``, ``:proximity``, ``:doc-filter`` (a function of the id's column). offsets: an array of ``term, places``,
    of the required terms that the text has: where their words begin.
    """
    opts, out = opts or {}, None
    for a in attributes or [x.name for x in db.attributes.values() if x.props.get(":db/fulltext")]:
        top = opts.get(":top", TOP)
        found = search(index_of(db, a), query, None if top is None else int(top), bool(opts.get(":proximity")), opts.get(":doc-filter"))
        facts = db.scan(a)
        placed = [F.struct(F.lit(t).alias("term"), offsets(F.col("v"), t).alias("places")) for t in _required(query)]
        places = F.filter(F.array(*placed), lambda x: F.size(x["places"]) > 0) if placed else F.array().cast("array<struct<term:string,places:array<int>>>")
        rows = facts.join(found, facts["e"] == found["doc"]).select("e", F.lit(a).alias("a"), "v", places.alias("offsets"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def fulltext(env: Env, rels: Relations, args: tuple) -> DataFrame:
    """``(fulltext $ :attr? query opts?)``: rows ``[e a v]``; ``:display`` adds offsets or scores where its name has them."""
    source, rest = source_of(args)
    rest = [constant(env, r) for r in rest]
    attributes = [str(rest.pop(0))] if isinstance(rest[0], Keyword) else None
    query, opts = rest[0], rest[1] if len(rest) > 1 else {}
    shown = str(opts.get(":display", ""))
    cols = ["e", "a", "v", *(["offsets"] if "offsets" in shown else []), *(["score"] if "scores" in shown else [])]
    return fulltext_datoms(env.source(source), query, attributes, opts).select(F.struct(*cols).alias("_r"))


RELATION_FUNCTIONS["fulltext"] = fulltext
