"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm import decontamination, fingerprints, jaccard_join, licenses, mixing, pii, sharding, suffix_tree, token_counts, toxicity

QUERIES = {
    "op3_sharding": sharding.op3_sharding,
    "op1_licenses": licenses.op1_licenses,
    "op2_suffix_tree": suffix_tree.op2_suffix_tree,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_pii": pii.op6_pii,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op9_token_counts": token_counts.op9_token_counts,
}
ORACLES = {
    "op3_sharding": sharding.ORACLE,
    "op8_mixing": mixing.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
