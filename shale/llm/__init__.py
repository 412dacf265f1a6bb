"""Corpus operators for training data; nothing else in the library imports this subpackage."""

from shale.llm import op1_secrets, op2_sentencepiece, op3_simhash, op4_toxicity, op5_decontaminate, op6_pii, op7_token_files, op8_quality, op9_language, op10_quality_rules, op11_vector_codes, op12_repeats, op13_fill_in_middle

_MODULES = {
    "op1_secrets": op1_secrets,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_repeats": op12_repeats,
    "op13_fill_in_middle": op13_fill_in_middle,
}

QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLES = {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
