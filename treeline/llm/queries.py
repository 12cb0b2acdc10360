"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from treeline.llm import alignment, bpe, exact_dedup, language, minhash, mixing, neighbours, periodic, substring_dedup, token_counts, topk, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_topk": topk.op4_topk,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_minhash": minhash.op6_minhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language": language.op8_language,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_alignment": alignment.op13_alignment,
}

SQL = exact_dedup.SQL | minhash.SQL | neighbours.SQL | substring_dedup.SQL | topk.SQL
