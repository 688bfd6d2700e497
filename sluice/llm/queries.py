"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import op1_shard, op2_simhash, op3_warc, op4_packing, op5_bpe, op6_digest, op7_substring, op8_toxicity, op9_imi, op10_quality, op11_negatives, op12_codes, op13_secrets

_QUERIES = [
    op1_shard.op1_histogram_shards, op2_simhash.op2_simhash_vptree, op3_warc.op3_warc_chunks, op4_packing.op4_best_fit_packing, op5_bpe.op5_bpe_transducer, op6_digest.op6_canonical_digest,
    op7_substring.op7_fixed_block_anchors, op8_toxicity.op8_levenshtein_lexicon, op9_imi.op9_inverted_multi_index, op10_quality.op10_factorisation_machine,
    op11_negatives.op11_bounded_lists, op12_codes.op12_va_file, op13_secrets.op13_blob_ledger,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the docstring of each other says why it has none."""
    return {"op11_bounded_lists": op11_negatives.SQL, "op12_va_file": op12_codes.SQL, "op13_blob_ledger": op13_secrets.SQL}
