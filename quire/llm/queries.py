"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from quire.llm import bagminhash, bpe, centroids, flac, hmm_lm, license_scan, merkle, oracles, packing, substring_dedup, suffix_dedup, topk, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_packing": packing.query,
    "op3_license_scan": license_scan.query,
    "op4_toxicity": toxicity.query,
    "op5_flac": flac.query,
    "op6_hmm_language_model": hmm_lm.query,
    "op7_byte_bpe": bpe.query,
    "op8_exact_top_k": topk.query,
    "op9_warc_zip": warc.query,
    "op10_bagminhash": bagminhash.query,
    "op11_centroids": centroids.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLES = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_exact_top_k": topk.SQL,
    "op9_warc_zip": oracles.WARC,
    "op10_bagminhash": oracles.NEAR_DUPLICATES,
    "op11_centroids": centroids.SQL,
    "op12_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op13_merkle_manifest": merkle.SQL,
}
