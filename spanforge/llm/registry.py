"""The queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from spanforge.llm import chat, decontam, jaccard, langid, mixing, pagetext, quality, recount, sharding, spelling, topk, trie, warc

_MODULES = {
    "op1_warc": warc,
    "op2_quality": quality,
    "op3_topk": topk,
    "op4_recount": recount,
    "op5_chat": chat,
    "op6_jaccard": jaccard,
    "op7_mixing": mixing,
    "op8_sharding": sharding,
    "op9_langid": langid,
    "op10_decontam": decontam,
    "op11_trie": trie,
    "op12_spelling": spelling,
    "op13_pagetext": pagetext,
}


def queries():
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql():
    return {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
