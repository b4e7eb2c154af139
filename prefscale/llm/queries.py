"""The registered query of each corpus operator, with production parameters over whole tables."""

import public_tokenizers

from . import decontaminate, embedding_dedup, html_text, language_id, maxent_lm, ngram_join, packing, pii, suffix_dedup, toxicity

ORACLE_SQL = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.classes(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.classes(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_html_text(spark, sf_dir):
    return html_text.digest(_table(spark, sf_dir, "pages"))


def op7_language_id(spark, sf_dir):
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii(spark, sf_dir):
    return pii.digest(_table(spark, sf_dir, "documents"))


def op9_maxent_lm(spark, sf_dir):
    return maxent_lm.digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_html_text": op6_html_text,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_pii": op10_pii,
}
ORACLE_SQL["op8_decontaminate"] = decontaminate.ORACLE
ORACLE_SQL["op10_pii"] = pii.ORACLE
ORACLE_SQL["op5_ngram_join"] = ngram_join.ORACLE
