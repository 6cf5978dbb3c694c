"""The corpus operators' registered queries and the SQL that DuckDB checks them with."""

from __future__ import annotations

from . import ann, langid, licenses, mixing, packing, passages, pii, quality, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_pii": pii.op2,
    "op3_packing": packing.op3,
    "op4_licenses": licenses.op4,
    "op5_mixing": mixing.op5,
    "op6_quality": quality.op6,
    "op7_langid": langid.op7,
    "op8_toxicity": toxicity.op8,
    "op9_passages": passages.op9,
    "op10_ann": ann.op10,
}
ORACLES = {
    "op5_mixing": mixing.OP5_SQL,
    "op4_licenses": licenses.OP4_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
