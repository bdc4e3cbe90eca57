"""The llm queries and their SQL, as the entry module registers them."""

from __future__ import annotations

from loomgraph.llm import bpe, exact_dedup, gif, jaccard_join, license_scan, packing, quality, tool_calls, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc": warc.op2_warc,
    "op3_gif": gif.op3_gif,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_tool_calls": tool_calls.op5_tool_calls,
    "op6_quality": quality.op6_quality,
    "op7_bpe": bpe.op7_bpe,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_warc": warc.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_tool_calls": tool_calls.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
}
