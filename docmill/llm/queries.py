"""The training-data queries and, where SQL can express them, their SQL."""

from docmill.llm import bpe, language, minhash, mixing, scoring, secrets, toxicity, url_rules, vectors, winnowing


def queries():
    return {
        "op1_winnowing": winnowing.op1_winnowing,
        "op2_language": language.op2_language,
        "op3_secrets": secrets.op3_secrets,
        "op4_bpe": bpe.op4_bpe,
        "op5_mixing": mixing.op5_mixing,
        "op6_scoring": scoring.op6_scoring,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_vectors": vectors.op8_vectors,
        "op9_url_rules": url_rules.op9_url_rules,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql():
    return {"op9_url_rules": url_rules.SQL}
