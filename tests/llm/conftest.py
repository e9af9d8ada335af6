import random

import pytest

SYLLABLES = {"en": "the er on an re he in ed nd ha th to or".split(), "de": "sch ein ung und heit der keit ver ü ö".split(), "fr": "eau que è é oi tre ment les aux".split()}


def prose(rng, n, lang="en"):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    lines, i = [], 0
    while i < n:
        k = rng.randint(5, 14)
        lines.append(" ".join(words[i : i + k]))
        i += k
    return ".\n".join(lines) + "."


@pytest.fixture(scope="session")
def corpus():
    """Rows ``doc_id, text, lang, source, n_chars`` with every awkward case; ids may repeat or be null."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, rng.randint(40, 200), lang), lang, f"src{i % 4}"))
    base = rows[0][1]
    rows += [(100, base, "en", "src0"), (101, base + " extra words here", "en", "src0"), (102, None, None, None), (103, "", "en", "src1"), (104, "", None, "src1"), (105, "one", "en", "src1"), (106, "$$$ ### 123", "en", "src2")]
    rows += [(None, base, "en", None), (None, "lonely text without id", None, "src3"), (107, prose(rng, 30_000), "en", "src3"), (1, rows[1][1], "de", "src1")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, KIND).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns of names that operators might use inside."""
    from pyspark.sql import functions as F

    names = ["_once", "_words", "tokens", "spans", "leaks", "entities", "licenses", "score", "lang_pred", "key_a", "key_b", "_ka", "_kb", "kept", "n_words", "node", "band", "class_id", "shard", "size", "hash", "at", "_map", "rank", "_h0", "_l0", "_lang", "_source", "_kept", "_fences0", "_fences2", "_pairs", "_lines", "_rules", "_leaks", "_found", "_tag", "_order", "row", "none", "seeds", "shifts", "text_", "doc_id_"]
    return docs.select("*", *(F.lit("x").alias(n) for n in names))
