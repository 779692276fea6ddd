"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from docloom.llm import decontam, jaccard, lang_id, line_dedup, mixing, phrase_dedup, pii, quality_knn, rules, token_count
from docloom.llm.common import table
from docloom.llm.oracles import ORACLE_SQL


def op1_language_id(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return rules.digest(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return phrase_dedup.digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
