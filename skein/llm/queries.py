"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, chat, decontaminate, exact_dedup, language_id, secrets, simhash, token_store, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_warc": warc.op2_warc,
        "op3_token_store": token_store.op3_token_store,
        "op4_secrets": secrets.op4_secrets,
        "op5_bpe": bpe.op5_bpe,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_chat_format": chat.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.oracle(),
        "op6_decontaminate": decontaminate.oracle(),
        "op8_exact_dedup": exact_dedup.oracle(),
        "op10_chat_format": chat.oracle(),
    }
