"""The registered queries of this package, and the SQL that gives the same rows."""

from cortexloom.llm import curve_packing, language_id, line_dedup, maxent_lm, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, surrogates, token_alignment, topk, vector_codes

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_quality": quality_classifier.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_surrogates": surrogates.op4_surrogates,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language": language_id.op7_language,
    "op8_lm": maxent_lm.op8_lm,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_mixing": mixing.op10_mixing,
    "op11_curve_packing": curve_packing.op11_curve_packing,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op1_topk": topk.OP1_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
