"""The corpus queries and their SQL."""

import corpus_pipeline
from tidemark.llm import exact_dedup, flac, language_id, license_scan, packing, pieces, quality, ranked_search, simhash, substring_dedup, token_counts, toxicity, vector_codes


def queries():
    found = (
        toxicity.op1_toxicity, simhash.op2_simhash, substring_dedup.op3_substring_dedup, license_scan.op4_license_scan, exact_dedup.op5_exact_dedup,
        packing.op6_packing, pieces.op7_pieces, token_counts.op8_token_counts, flac.op9_flac_media, language_id.op10_language_id,
        ranked_search.op11_ranked_search, vector_codes.op12_vector_codes, quality.op13_quality,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return substring_dedup.ORACLE | exact_dedup.ORACLE | license_scan.ORACLE | ranked_search.ORACLE | vector_codes.ORACLE | sql
