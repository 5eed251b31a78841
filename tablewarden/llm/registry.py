"""The corpus queries by name and, where DuckDB can express them, their SQL."""

from tablewarden.llm import ann, centroids, exact_dedup, line_dedup, lm_score, mixing, pieces, pii, quality, ranked, secrets, simhash, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_source_mixing": mixing.query,
    "op4_sentencepiece": pieces.query,
    "op5_lm_scoring": lm_score.query,
    "op6_quality_classifier": quality.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_warc_archives": warc.query,
    "op9_nearest_neighbours": ann.query,
    "op10_secret_scan": secrets.query,
    "op11_centroid_clustering": centroids.query,
    "op12_ranked_search": ranked.query,
    "op13_pii": pii.query,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_source_mixing": mixing.ORACLE_SQL,
    "op11_centroid_clustering": centroids.ORACLE_SQL,
    "op12_ranked_search": ranked.ORACLE_SQL,
}
