"""The corpus pipeline: language, near-duplicates, benchmark leaks, secrets, packing.

``STAGES`` lists the stages; each works on all rows that the one before kept. :func:`run` applies them to ``documents``. A
stage's columns are those it was given, whatever their names: all but id and text are carried in one structure, so that
none clashes with what an operator adds. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm import decontam, language, neardup, packing, secrets
from triplane.llm.common import durable, table


def _wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` as ``doc_id, text`` and ``row``, which has all other columns."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row") if rest else F.lit(None).cast("string").alias("row"))


def _unwrapped(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from wrapped rows, some of them ``new``."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("row")[c] for c in docs.columns}
    return rows.select(*(new.get(c, own[c]).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with ``lang`` set to it; those that are ``und`` go, null and empty texts too.

    The network learns from the labelled documents of ``documents`` that are not held out.
    """
    model = language.fit(table(spark, sf_dir, "documents"))
    told = language.identify(_wrapped(docs), model).where(F.col("lang_pred") != language.UNKNOWN)
    return _unwrapped(told, docs, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id; rows of one id and different texts are two.

    Rows without a text stay; of documents without an id one of a class stays, if it has none with an id.
    """
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none and stay, repeated rows too."""
    marked = decontam.mark(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return _unwrapped(marked.where(F.size("leaks") == 0), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and ``n_chars`` counted again; null texts stay null."""
    clean = secrets.redact(secrets.scan(_wrapped(docs)))
    return _unwrapped(clean, docs, n_chars=F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: token ids, and a checksum of them. A null or empty text has the end token alone."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Language, weighted sampling and tokenizing can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs)
    return docs
