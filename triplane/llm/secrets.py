"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: alternatives, each a set of trigrams that a
match must hold. The index has, for the trigrams that rules ask for, the texts that hold them; intersecting postings gives
each rule's candidates, and only those are verified with the expression. A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser  # the parser of regular expressions in the standard library

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.common import durable, fresh, once, table, text_key

#: Candidates are broadcast up to this many rows (of about 32 bytes); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, leftmost and without overlaps; a find counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of [0-9a-f]+ of 32 or more are what this finds at once.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: What ends a private key, and what follows the header of one whose end is missing: key headers and lines of base64.
_PEM_END = r"-----END [A-Z ]{0,24}PRIVATE KEY-----"
_PEM_OPEN = r"^(?:(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info):\x20?[^\s\\]++|[A-Za-z0-9+/=]{16,}+))++(?:(?:\r?\n|\\n)[A-Za-z0-9+/=]{1,64}(?=\s*$|\r?\n|\\[nr]))?)?"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams, in lower case; empty if the pattern has a match without any."""

    def letters(items) -> list[str] | None:
        out = []
        for op, value in items:
            if str(op) == "LITERAL":
                out.append(chr(value).lower())
            elif str(op) == "RANGE" and value[1] - value[0] < 8:
                out += [chr(c).lower() for c in range(value[0], value[1] + 1)]
            else:
                return None
        return out if len(out) <= 8 else None

    def broken(states):
        return {("", grams | {run[i : i + 3] for i in range(len(run) - 2)}) for run, grams in states}

    def walk(states, sequence):
        for op, value in sequence:
            name = str(op)
            if name == "LITERAL":
                states = {(run + chr(value).lower(), grams) for run, grams in states}
            elif name == "IN" and (chars := letters(value)):
                states = {(run + c, grams) for run, grams in states for c in chars}
            elif name == "SUBPATTERN":
                states = walk(states, value[3])
            elif name == "BRANCH":
                states = set().union(*(walk(states, branch) for branch in value[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, item = value
                if (low, high) == (0, 1):
                    states = states | walk(states, item)
                elif low == 0:
                    states = broken(states)
                else:
                    for _ in range(min(low, 3)):
                        states = walk(states, item)
                    states = states if low == high <= 3 else broken(states)
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                states = broken(states)
            if len(states) > MOST_ALTERNATIVES:
                states = {("", frozenset())}
        return states

    found = {grams for _, grams in broken(walk({("", frozenset())}, _parser.parse(pattern)))}
    if frozenset() in found:
        return []
    return sorted((g for g in found if not any(o < g for o in found)), key=sorted)


def _any_of(grams: list[str]) -> str:
    """An expression that finds each of ``grams`` at every place where it begins, in either case."""
    tree: dict = {}
    for g in grams:
        tree.setdefault(g[0], {}).setdefault(g[1], []).append(g[2])
    q = re.escape
    parts = [q(a) + "(?:" + "|".join(q(b) + "[" + "".join(q(c) for c in cs) + "]" for b, cs in sorted(bs.items())) + ")" for a, bs in sorted(tree.items())]
    return "(?i)(?=[" + "".join(q(a) for a in sorted(tree)) + "])(?=(" + "|".join(parts) + "))"


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index for ``grams``: rows ``trigram, key_a, key_b``, one per trigram and text that holds it."""
    held = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_any_of(grams)), F.lit(1)), F.lower))
    return docs.where(F.col("text").isNotNull()).select(*text_key(F.col("text")), F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """Rows ``key_a, key_b, rules``: texts whose postings meet an alternative of a query, as bits of the queries' numbers."""
    spark = postings.sparkSession
    wanted = [(g, number, alternative, 1 << i, (1 << len(grams)) - 1) for number, query in queries.items() for alternative, grams in enumerate(query) for i, g in enumerate(sorted(grams))]
    asked = F.broadcast(spark.createDataFrame(wanted, "trigram string, rule int, alternative int, bit long, all_bits long"))  # as many as the rules have
    met = postings.join(asked, "trigram").groupBy("key_a", "key_b", "rule", "alternative", "all_bits").agg(F.bit_or("bit").alias("bits")).where("bits = all_bits")
    return met.groupBy("key_a", "key_b").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def mandatory(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that rules ask for: those that an index for them has."""
    return sorted({g for r in rules for alternative in trigram_query(r.pattern) for g in alternative})


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, postings: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``spans`` added: an array of ``start, rank, end, kind``, by start and then as rules are listed.

    Places are code points, the end exclusive. A null or empty text has no spans; texts are scanned whole, however long; all
    rows stay, repeated ones too, and an empty table stays empty. A column of that name is replaced. ``postings`` is an index
    that was kept: of these documents, or of more, for the trigrams that :func:`mandatory` gives or for more of them.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    docs = docs.drop("spans")
    ka, kb, mask = fresh(docs, "_ka"), fresh(docs, "_kb"), fresh(docs, "_rules")
    if queries:
        postings = index(docs.select("text"), mandatory(rules)) if postings is None else postings
        found = durable(candidates(postings, queries))
        found = found.toDF(ka, kb, mask)
        rows = found.count()
        a, b = text_key(F.col("text"))
        docs = docs.join(F.broadcast(found) if rows <= BROADCAST_ROWS else found, (a == found[ka]) & (b == found[kb]), "left").drop(ka, kb)
    else:
        docs = docs.withColumn(mask, F.lit(0).cast("long"))
    hit_of, list_of = ([fresh(docs, f"_{x}{i}") for i in range(len(rules))] for x in "hl")
    hits, lists = {}, {}
    for i, r in enumerate(rules):
        hit = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        hits[hit_of[i]] = F.when(F.col(mask).bitwiseAND(1 << i) != 0, hit) if i in queries else hit
    made = once(docs, **hits)
    for i, r in enumerate(rules):
        part = lambda kind, i=i: F.when(F.size(hit_of[i]) > 0, kind)
        value = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col(hit_of[i])
        lists[list_of[i]] = part(F.arrays_zip(F.transform(F.split("text", r.pattern, -1), F.length).alias("gap"), F.transform(hit_of[i], F.length).alias("size"), F.transform(value, F.length).alias("value")))
    made = once(made, **lists)
    spans = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    for i, r in enumerate(rules):
        spans = F.concat(spans, F.coalesce(_placed(list_of[i], i, r), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    return once(made, spans=F.array_sort(spans)).drop(mask, *hits, *lists)


def _placed(column: str, rank: int, rule: Rule) -> Column:
    """Spans from the lengths of gaps and finds, in turn; the last gap has no find after it."""
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(column, none, step, lambda acc: acc["out"])


def _pem_body(rest: Column) -> Column:
    """How much of what follows a private key's header is the key: up to and with the END line, or else its lines alone."""
    key = F.substring_index(rest, "-----BEGIN ", 1)
    closing = F.regexp_extract(key, _PEM_END, 0)
    return F.when(closing != "", F.length(F.split(key, _PEM_END, 2)[0]) + F.length(closing)).otherwise(F.length(F.regexp_extract(key, _PEM_OPEN, 0)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, as :func:`scan` gives them, with each run of overlapping spans in the text replaced by ``mark``.

    The span of a private key is its header; what is replaced is the whole key.
    """
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda x: F.substring(F.col("text"), x["end"] + 1, F.length("text"))
    end = lambda x: x["end"] + F.when(x["kind"] == "pem", _pem_body(rest(x))).otherwise(0)

    def step(acc: Column, x: Column) -> Column:
        fresh_ = x["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], end(x)).alias("at"), F.when(fresh_, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", none, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return docs.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans as text."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(text_of(base), 256).alias("base_sha256"), text_of("spans").alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of :func:`op10_secrets`: every rule scans every text."""

    def listed(k: int, r: Rule) -> str:
        rx = "'" + r.pattern.replace("'", "''") + "'"
        lengths = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
        start = f"{lengths('gap[1:k]')} + {lengths('hit[1:k - 1]')}"
        return f"""SELECT id, list_transform(list_filter(range(1, len(hit) + 1), lambda k: length(val[k]) >= {r.least}),
            lambda k: {{'s': CAST({start} AS BIGINT), 'r': {k}, 'e': CAST({start} + length(hit[k]) AS BIGINT), 'k': '{r.kind}'}}) AS found
            FROM (SELECT id, regexp_extract_all(t, {rx}) AS hit, regexp_extract_all(t, {rx}, {r.group}) AS val, string_split_regex(t, {rx}) AS gap FROM docs)"""

    shown = lambda spans: f"array_to_string(list_transform({spans}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    base = f"list_filter(spans, lambda x: x.r < {len(BASE)})"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.k = '{r.kind}')) AS n_{r.kind}" for r in BASE)
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    parts AS ({" UNION ALL ".join(listed(k, r) for k, r in enumerate(rules))}),
    whole AS (SELECT id, list_sort(flatten(list(found))) AS spans FROM parts GROUP BY id)
    SELECT doc_id, {counts}, sha256({shown(base)}) AS base_sha256, {shown("spans")} AS spans FROM whole JOIN docs USING (id)"""
