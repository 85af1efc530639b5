"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagemill.llm import additive, langid, licenses, mixing, packing, pii, pivots, resharding, simhash, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_pivots": pivots.query,
    "op3_warc": warc.query,
    "op4_packing": packing.query,
    "op5_licenses": licenses.query,
    "op6_resharding": resharding.query,
    "op7_pii": pii.query,
    "op8_langid": langid.query,
    "op9_simhash": simhash.query,
    "op10_additive": additive.query,
}

ORACLES: dict[str, str] = {
    "op2_pivots": pivots.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_licenses": licenses.oracle(),
    "op10_additive": additive.ORACLE,
}
