"""The operators as queries over the given tables, with production parameters, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from soukline.llm import (
    conversations, embeddings, language, licenses, mixing, neighbours, packing, quality, secrets, simhash, toxicity, urls, variants,
)
from soukline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": _toxicity,
    "op2_simhash_near_dedup": _over("documents", simhash.op2),
    "op3_best_fit_packing": _over("documents", packing.op3),
    "op4_secret_scans": _over("documents", secrets.op4),
    "op5_embedding_near_dedup": _over("embeddings", embeddings.op5),
    "op6_license_scans": _over("documents", licenses.op6),
    "op7_language_id": _over("documents", language.op7),
    "op8_url_filter": _over("pages", urls.op8),
    "op9_source_mix": _over("documents", mixing.op9),
    "op10_quality_rules": _over("documents", quality.op10),
    "op11_nearest_neighbours": _over("embeddings", neighbours.op11),
    "op12_spelling_variants": _over("documents", variants.op12),
    "op13_conversation_repair": _over("conversations", conversations.op13),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_embedding_near_dedup": embeddings.ORACLE,
    "op8_url_filter": urls.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
