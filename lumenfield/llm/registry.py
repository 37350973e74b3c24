"""The registered queries of this package and, where SQL can say them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfield.llm import caps, chat, divergence, language, lm, mixing, phrases, pieces, quality, secrets, sharding, signatures, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.query,
    "op2_ngram_join": signatures.query,
    "op3_pieces": pieces.query,
    "op4_embedding_caps": caps.query,
    "op5_lm_score": lm.query,
    "op6_mixing": mixing.query,
    "op7_chat": chat.query,
    "op8_url_filter": urls.query,
    "op9_secrets": secrets.query,
    "op10_quality": quality.query,
    "op11_divergence": divergence.query,
    "op12_phrases": phrases.query,
    "op13_sharding": sharding.query,
}
ORACLES: dict[str, str] = {
    "op2_ngram_join": signatures.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
