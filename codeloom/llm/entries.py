"""Queries of the subpackage, as registered in __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, decontaminate, mixing, near, packing, pii, quality, repeats, secrets, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_near_dedup": near.op2_near_dedup,
        "op3_repeats": repeats.op3_repeats,
        "op4_pii": pii.op4_pii,
        "op5_mixing": mixing.op5_mixing,
        "op6_chat": chat.op6_chat,
        "op7_packing": packing.op7_packing,
        "op8_secrets": secrets.op8_secrets,
        "op9_urls": urls.op9_urls,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": near.OP2_SQL,
        "op3_repeats": repeats.OP3_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op6_chat": chat.OP6_SQL,
        "op8_secrets": secrets.OP8_SQL,
        "op9_urls": urls.OP9_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
    }
