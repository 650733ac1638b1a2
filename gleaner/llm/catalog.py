"""The queries of the dealt operators and the SQL that checks them."""

from __future__ import annotations

from gleaner.llm import (exact_dedup, filter_audit, licenses, mixing, ngram_jaccard, packing, periodic_runs, pii, quality, secrets,
                         sharding, simhash, token_files)

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_files": token_files.op4_token_files,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_secrets": secrets.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op9_pii": pii.op9_pii,
    "op10_licenses": licenses.op10_licenses,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_simhash": simhash.op12_simhash,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
#: The others hold models, tokenisers or checksums that SQL lacks; tests hold them against brute force.
ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op7_secrets": secrets.OP7_SQL,
    "op10_licenses": licenses.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
