"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, decontam, exact_dedup, langid, line_dedup, pii, prefix_trie, resample, secrets, simhash, token_counts, url_filter, warc
from codeloom.llm.common import table
from codeloom.llm.oracles import ORACLES


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, name) for name in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": _over(token_counts.op1, "documents"),
        "op2_pii": _over(pii.op2, "documents"),
        "op3_language_id": _over(langid.op3, "documents"),
        "op4_warc": _over(warc.op4, "pages"),
        "op5_simhash": _over(simhash.op5, "documents"),
        "op6_byte_bpe": _over(bpe.op6, "documents"),
        "op7_decontamination": _over(decontam.op7, "documents", "benchmark"),
        "op8_secrets": _over(secrets.op8, "documents"),
        "op9_exact_dedup": _over(exact_dedup.op9, "documents"),
        "op10_url_filter": _over(url_filter.op10, "pages", "labels"),
        "op11_line_dedup": _over(line_dedup.op11, "documents"),
        "op12_prefix_trie": _over(prefix_trie.op12, "conversations"),
        "op13_resample": _over(resample.op13, "documents", "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
