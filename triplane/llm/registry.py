"""Queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triplane.llm.decontam import op3_decontam
from triplane.llm.language import op8_language
from triplane.llm.licenses import op7_licenses
from triplane.llm.neardup import op1_neardup
from triplane.llm.packing import op6_packing
from triplane.llm.pii import op5_pii
from triplane.llm.quality import op2_quality
from triplane.llm.secrets import op10_secrets
from triplane.llm.secrets import oracle_sql as secrets_sql
from triplane.llm.sharding import op4_sharding
from triplane.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_quality": op2_quality,
    "op3_decontam": op3_decontam,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_licenses": op7_licenses,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
}

#: The others learn, sketch, hash or tokenize; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op10_secrets": secrets_sql()}
