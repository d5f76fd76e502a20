"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat, decontaminate, gif, langid, licenses, neardup, packing, toxicity, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_urls": urls.op2_urls,
        "op3_licenses": licenses.op3_licenses,
        "op4_warc": warc.op4_warc,
        "op5_langid": langid.op5_langid,
        "op6_neardup": neardup.op6_neardup,
        "op7_gif": gif.op7_gif,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_urls": urls.OP2_SQL, "op4_warc": warc.OP4_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
