"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from tidemill.llm import bpe, language, licenses, mixing, ngram_join, passages, quality, simple8b, spotsigs, vectors

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_fingerprints": spotsigs.op2_fingerprints,
    "op3_token_files": simple8b.op3_token_files,
    "op4_passages": passages.op4_passages,
    "op5_quality": quality.op5_quality,
    "op6_vector_graph": vectors.op6_vector_graph,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_language": language.op8_language,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL = {
    "op1_license_scan": licenses.ORACLE,
    "op2_fingerprints": spotsigs.ORACLE,
}
