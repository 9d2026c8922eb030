"""The training-data operators' queries and oracles."""

from __future__ import annotations

import corpus_pipeline
from postwright.llm import chat, langid, lm, neardup, packing, pieces, pii, quality, topk, toxicity


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_language_id": langid.op1,
        "op2_toxicity": toxicity.op2,
        "op3_minhash_near_dedup": neardup.op3,
        "op4_sentencepiece": pieces.op4,
        "op5_quality_rules": quality.op5,
        "op6_packing": packing.op6,
        "op7_pii": pii.op7,
        "op8_lm_scoring": lm.op8,
        "op9_topk_search": topk.op9,
        "op10_chat_formatting": chat.op10,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op5_quality_rules": quality.ORACLE,
        "op9_topk_search": topk.ORACLE,
        "op10_chat_formatting": chat.ORACLE,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
