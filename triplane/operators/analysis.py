"""Analyzers for search: a tokenizer and filters over arrays of ``term, position``, all as expressions.

``create_analyzer(tokenizer, filters)`` gives a function that :func:`triplane.operators.search.build` takes instead of the
default one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from triplane.operators.search import PUNCTUATION, STOP_WORDS

Filter = Callable[[Column], Column]
_ACCENTS = ("ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy")


def regexp_tokenizer(separator: str = PUNCTUATION) -> Callable[[Column], Column]:
    def run(text: Column) -> Column:
        return F.transform(F.filter(F.split(text, separator), lambda w: w != ""), lambda w, i: F.struct(w.alias("term"), i.alias("position")))

    return run


def _on_terms(f: Callable[[Column], Column]) -> Filter:
    return lambda tokens: F.transform(tokens, lambda x: F.struct(f(x["term"]).alias("term"), x["position"].alias("position")))


lower_case: Filter = _on_terms(F.lower)
unaccent: Filter = _on_terms(lambda t: F.translate(t, *_ACCENTS))


def stop_words(words: Iterable[str] = STOP_WORDS) -> Filter:
    listed = sorted(words)
    return lambda tokens: F.filter(tokens, lambda x: ~x["term"].isin(*listed))


def min_length(n: int) -> Filter:
    return lambda tokens: F.filter(tokens, lambda x: F.length(x["term"]) >= n)


def max_length(n: int) -> Filter:
    return lambda tokens: F.filter(tokens, lambda x: F.length(x["term"]) <= n)


def _spread(f: Callable[[Column], Column]) -> Filter:
    """Several terms in the place of each."""
    return lambda tokens: F.flatten(F.transform(tokens, lambda x: F.transform(f(x["term"]), lambda t: F.struct(t.alias("term"), x["position"].alias("position")))))


prefixes: Filter = _spread(lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substring(t, F.lit(1), n)))


def ngrams(least: int, most: int | None = None) -> Filter:
    """Runs of ``least`` to ``most`` characters; a shorter term has none."""
    most = most or least

    def of(t: Column) -> Column:
        starts = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*(starts(n) for n in range(least, most + 1))))

    return _spread(of)


def english_stem() -> Filter:
    """Terms by their stems, by the Snowball algorithm for English; done in Arrow batches when texts are analysed."""
    from triplane.operators.stemming import english

    @F.pandas_udf("array<struct<term:string,position:int>>")
    def stems(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: None if xs is None else [{"term": english(x["term"]), "position": x["position"]} for x in xs])

    return stems


def create_analyzer(tokenizer: Callable[[Column], Column] | None = None, filters: Iterable[Filter] = ()) -> Callable[[Column], Column]:
    def run(text: Column) -> Column:
        tokens = (tokenizer or regexp_tokenizer())(text)
        for f in filters:
            tokens = f(tokens)
        return tokens

    return run
