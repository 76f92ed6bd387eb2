"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pulsefield.llm import clusters, collocations, decontaminate, lines, mixing, quality, secrets, simhash, substring, tokens, topk, toxicity, warc

QUERIES = {
    "op1_scan_secrets": secrets.op1_scan_secrets,
    "op2_toxicity_grades": toxicity.op2_toxicity_grades,
    "op3_remove_repeated_lines": lines.op3_remove_repeated_lines,
    "op4_simhash_groups": simhash.op4_simhash_groups,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_remove_repeats": substring.op8_remove_repeats,
    "op9_token_shards": tokens.op9_token_shards,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_quality_rules": quality.op11_quality_rules,
    "op12_centroid_clusters": clusters.op12_centroid_clusters,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op3_remove_repeated_lines": lines.OP3_SQL,
    "op6_warc_round_trip": warc.OP6_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op8_remove_repeats": substring.OP8_SQL,
    "op10_exact_topk": topk.OP10_SQL,
    "op11_quality_rules": quality.OP11_SQL,
    "op12_centroid_clusters": clusters.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
