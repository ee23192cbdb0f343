"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from helixframe.llm import decontaminate, langid, licenses, linedup, mixing, negatives, quality, secrets, simhash, spelling, tokencount, tokenfile, topk


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_mixing": mixing.op2_mixing,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_tokencount": tokencount.op4_tokencount,
        "op5_licenses": licenses.op5_licenses,
        "op5_licenses_base": licenses.op5_licenses_base,
        "op6_langid": langid.op6_langid,
        "op7_secrets": secrets.op7_secrets,
        "op8_topk": topk.op8_topk,
        "op9_simhash": simhash.op9_simhash,
        "op10_linededup": linedup.op10_linededup,
        "op10_linededup_runs": linedup.op10_linededup,
        "op10_linededup_maximal": linedup.op10_linededup_maximal,
        "op11_spelling": spelling.op11_spelling,
        "op12_tokenfile": tokenfile.op12_tokenfile,
        "op13_negatives": negatives.op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op5_licenses_base": licenses.OP5_BASE_SQL,
        "op7_secrets": secrets.OP7_SQL,
        "op8_topk": topk.OP8_SQL,
        "op10_linededup": linedup.OP10_SQL,
        "op10_linededup_runs": linedup.OP10_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op13_negatives": negatives.OP13_SQL,
    }
