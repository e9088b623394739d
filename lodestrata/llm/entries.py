"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestrata.llm import ann, bpe_codec, collocations, exact_dedup, fim, html_text, line_dedup, ngram_join, packing, pii, quality, sharding, simhash_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_html_text": html_text.op2_html_text,
        "op3_quality": quality.op3_quality,
        "op4_sharding": sharding.op4_sharding,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_bpe_codec": bpe_codec.op6_bpe_codec,
        "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
        "op8_ann": ann.op8_ann,
        "op9_pii": pii.op9_pii,
        "op10_packing": packing.op10_packing,
        "op11_fim": fim.op11_fim,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op4_sharding": sharding.SQL, "op5_line_dedup": line_dedup.SQL, "op11_fim": fim.SQL, "op13_collocations": collocations.SQL}
