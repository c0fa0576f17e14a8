"""The queries of this subpackage, and the SQL of those that SQL can express."""

from gleaner.llm import bpe, centroids, chat, codebooks, langid, ledger, lm, packing, phrases, pieces, search, simhash, suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe_roundtrip,
        chat.op2_chat_role_repair,
        lm.op3_lm_scores,
        packing.op4_best_fit_packing,
        search.op5_bm25_top_k,
        phrases.op6_phrase_fingerprints,
        suffix_dedup.op7_suffix_array_dedup,
        langid.op8_language_id,
        ledger.op9_token_counts,
        simhash.op10_simhash_near_dedup,
        centroids.op11_centroid_clustering,
        codebooks.op12_vector_codes,
        pieces.op13_sentencepiece_roundtrip,
    )
}
ORACLE_SQL = {"op11_centroid_clustering": centroids.OP11_SQL, "op12_vector_codes": codebooks.OP12_SQL}
