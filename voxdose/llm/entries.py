"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import alignment, byte_bpe, classifier, embeddings, html_text, licenses, minhash, oracle, packing, private, quality, repeats, secrets, trie


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": _over("pages", html_text.op1),
        "op2_suffix_array_dedup": _over("documents", repeats.op2),
        "op3_private_data": _over("documents", private.op3),
        "op4_embedding_near_dedup": _over("embeddings", embeddings.op4),
        "op5_byte_bpe": _over("documents", byte_bpe.op5),
        "op6_minhash_near_dedup": _over("documents", minhash.op6),
        "op7_secret_scan": _over("documents", secrets.op7),
        "op8_license_scan": _over("documents", licenses.op8),
        "op9_quality_rules": lambda spark, sf_dir: quality.op9(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))),
        "op10_best_fit_packing": _over("documents", packing.op10),
        "op11_conversation_trie": _over("conversations", trie.op11),
        "op12_quality_classifier": lambda spark, sf_dir: classifier.op12(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))),
        "op13_tokenizer_alignment": _over("documents", alignment.op13),
        "pipeline": corpus_pipeline.run,
    }


oracle_sql = oracle.oracle_sql
