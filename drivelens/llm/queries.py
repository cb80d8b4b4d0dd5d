"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, dedup, html, langid, license, media, mixing, pii, toxicity


def queries() -> dict:
    return {
        "op1_html": html.op1,
        "op2_probminhash": dedup.op2,
        "op3_pii": pii.op3,
        "op4_language": langid.op4,
        "op5_media": media.op5,
        "op6_bpe": bpe.op6,
        "op7_license": license.op7,
        "op8_hilbert": ann.op8,
        "op9_toxicity": toxicity.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_license": license.oracle()}
