"""Queries of the corpus operators, one per operator, and SQL where it can express them."""

from __future__ import annotations

from timberline.llm import counting, exact, langid, manifest, merkle, minhash, mixing, packing, passages, runs, secrets, suffixes, topk

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_minhash_dedup": minhash.op3_minhash_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_pack": packing.op5_pack,
    "op6_fingerprint": merkle.op6_fingerprint,
    "op7_mix": mixing.op7_mix,
    "op8_passage_dedup": passages.op8_passage_dedup,
    "op9_token_count": counting.op9_token_count,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_topk": topk.op11_topk,
    "op12_manifest": manifest.op12_manifest,
    "op13_runs": runs.op13_runs,
}

ORACLES = {
    "op7_mix": mixing.SQL,
    "op10_exact_dedup": exact.SQL,
    "op11_topk": topk.SQL,
    "op12_manifest": manifest.SQL,
}
