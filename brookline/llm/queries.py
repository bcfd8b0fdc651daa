"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, katz, language, licenses, ngram_join, packing, quality_model, quality_rules, spotsigs, token_orc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_katz_scores": katz.op2_katz_scores,
    "op3_bpe_encode": bpe.op3_bpe_encode,
    "op4_token_orc": token_orc.op4_token_orc,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_language_id": language.op6_language_id,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_pack_documents": packing.op9_pack_documents,
    "op10_license_scan": licenses.op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.oracle_sql(),
    "op5_quality_rules": quality_rules.oracle_sql(),
    "op10_license_scan": licenses.oracle_sql(),
}
