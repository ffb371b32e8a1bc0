"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from plumbline.llm import archives, chunks, contexts, mixing, nearcopies, pieces, planes, quality, ranking, suffixes, urls, vantage, whitening

QUERIES = {
    "op1_chunk_copies": chunks.query,
    "op2_token_planes": planes.query,
    "op3_quality_votes": quality.query,
    "op4_sparse_suffixes": suffixes.query,
    "op5_vantage_trees": vantage.query,
    "op6_order_minhash": nearcopies.query,
    "op7_arc_to_warc": archives.query,
    "op8_source_mix": mixing.query,
    "op9_sampled_pieces": pieces.query,
    "op10_url_templates": urls.query,
    "op11_path_tree_search": ranking.query,
    "op12_count_whitening": whitening.query,
    "op13_context_trees": contexts.query,
}
ORACLE = {"op3_quality_votes": quality.ORACLE_SQL, "op5_vantage_trees": vantage.ORACLE_SQL, "op7_arc_to_warc": archives.ORACLE_SQL, "op8_source_mix": mixing.ORACLE_SQL, "op11_path_tree_search": ranking.ORACLE_SQL}
