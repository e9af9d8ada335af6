"""The pipeline's stages, each judged on its own input."""

import zlib

import corpus_pipeline
from triplane.llm import packing


def test_pipeline(spark, docs, corpus, tmp_path):
    from tests.llm.conftest import prose

    import random

    rng = random.Random(77)
    item = prose(rng, 30)
    leak, secret = prose(rng, 60) + " " + item, prose(rng, 60) + " password=e3b3ed3cc8548923d6 end"
    more = spark.createDataFrame([(900, leak, "en", "s", 1), (901, secret, "en", "s", 1)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, kept = str(tmp_path), [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], d).write.parquet(str(tmp_path / f"s{k}"))
        kept.append(spark.read.parquet(str(tmp_path / f"s{k}")))
    rows = [x.collect() for x in kept]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(x.columns == columns for x in kept[:5])
    assert {r.doc_id for r in rows[0]} - {r.doc_id for r in rows[1]} == {102, 103, 104, 106}
    ids = [r.doc_id for r in rows[2] if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 100 not in ids and {0, 900, 901} <= set(ids)
    assert {r.doc_id for r in rows[2]} - {r.doc_id for r in rows[3]} == {900}
    text = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[4]) == len(rows[3]) and "e3b3ed3" not in text[901] and text[901].endswith("[SECRET] end") and text[0] == corpus[0][1]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    first = next(r for r in rows[5] if r.doc_id == 901 and r.start == 0)
    ids = t.encode(text[901], add_special_tokens=False).ids + [1]
    assert first.doc_tokens == len(ids) and first.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[: first.length]))
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(repr, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(repr, kept[5].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_keeps_the_tokens(spark):
    """What is packed is written: 4 bytes a token, of which the checksum is made."""
    rows = spark.createDataFrame([(1, "some words to pack, twice", "en", "s", 25), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.pack_sequences(spark, rows, "").collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_stages_on_awkward_tables(spark, docs, none, clashing, corpus, tmp_path):
    """Empty tables stay empty, columns keep their names and values whatever they are, null and empty texts have their place."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, corpus[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, none, d)
        assert empty.count() == 0, name
        got = stage(spark, clashing, d)
        if number == 4:
            assert got.select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()
            continue
        assert empty.columns == none.columns and got.columns == clashing.columns, name
        rows = got.collect()
        assert rows and all(r[c] == "x" for r in rows for c in clashing.columns if c not in docs.columns), name
        kept = [(r.doc_id, r.text) for r in rows]
        if name == "benchmark":
            assert sorted(map(repr, kept)) == sorted(repr((i, t)) for i, t, *_ in corpus if i != 3)
        if name == "secrets":
            assert len(kept) == len(corpus) and (102, None) in kept and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "near_duplicates":
            assert (102, None) in kept and sum(t == "" for _, t in kept) == 1 and sum(t == corpus[0][1] for _, t in kept) == 1
        if name == "language":
            assert all(t for _, t in kept)


def test_rows_of_one_id(spark):
    """Two texts of one id are two documents; nothing is lost for a shared id."""
    from tests.llm.conftest import prose

    import random

    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b)])


def test_crowded_near_duplicates_go(spark, monkeypatch, tmp_path):
    """Of near-duplicates that share one bucket with many other texts, and no further one, one stays."""
    import random

    from pyspark.sql import functions as F

    from tests.llm.conftest import prose
    from triplane.llm import neardup

    rng = random.Random(29)
    rows = []
    for g in range(15):
        base = prose(rng, 80).split(" ")
        for k in range(3):
            copy = list(base)
            copy[7 * k] = "changed"
            rows.append((3 * g + k, " ".join(copy), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    real = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda docs, idf: real(docs, idf).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(neardup, "CROWD", 4)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, str(tmp_path)).collect()
    assert sorted(map(tuple, kept)) == [r for r in rows if r[0] % 3 == 0]


def test_long_repetition_is_no_near_duplicate(spark, tmp_path):
    """Texts that repeat words many thousand times, some of them four times as often as others, all stay."""
    phrase = "buy this thing now or never "
    rows = [(1, "spam " * 50_000, "en"), (2, "spam " * 200_000, "en"), (3, phrase * 50_000, "en"), (4, phrase * 200_000, "en"), (5, phrase * 201_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4]


def test_no_pattern_of_substitutions_hides_a_leak(spark, tmp_path):
    """Of items of 13 tokens and more, a stretch with any three tokens substituted goes; with four it stays."""
    from itertools import combinations

    items = {n: [f"w{n}x{i}" for i in range(n)] for n in (13, 14, 19, 20, 40)}
    rows, kept = [], []
    for n, tokens in items.items():
        at = (n - 13) // 2
        for spoiled in combinations(range(13), 3):
            rows.append((len(rows), "some words " + " ".join("other" if i in spoiled else t for i, t in enumerate(tokens[at : at + 13])) + " and more"))
        kept.append((len(rows), "some words " + " ".join("other" if i in (1, 4, 7, 10) else t for i, t in enumerate(tokens[at : at + 13])) + " and more"))
        rows.append(kept[-1])
    spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["benchmark"](spark, df, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == kept
