"""Registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file

from ledgerloom.llm import token_store
from ledgerloom.llm.ball_tree import lexical_search
from ledgerloom.llm.common import table
from ledgerloom.llm.language_id import page_language
from ledgerloom.llm.latent import contaminated
from ledgerloom.llm.line_crf import line_quality
from ledgerloom.llm.line_templates import line_report
from ledgerloom.llm.lm_scoring import lm_scores
from ledgerloom.llm.oracles import JACCARD_JOIN, LEXICAL_SEARCH, QUALITY_RULES
from ledgerloom.llm.packing import pack
from ledgerloom.llm.partenum import similar_groups
from ledgerloom.llm.periodic_runs import periodic_runs, repeated_tail, run_digests
from ledgerloom.llm.quality_rules import quality_rules
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.toxicity import toxicity

TOKENIZER = tokenizer_file("word_bpe_49k.json")


def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=1)


def op3_token_store(spark, sf_dir):
    path = token_store.new_folder(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return token_store.read_documents(spark, path)


def op4_quality_classifier(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark, sf_dir):
    return page_language(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), most=4, width=4, seed=42)


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"), min_docs=3, similar=0.7)


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"), order=6, modulus=7, held=2)


def op11_lexical_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def op12_jaccard_join(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"), percent=90, width=3)


def op13_periodic_runs(spark, sf_dir):
    return run_digests(
        periodic_runs(table(spark, sf_dir, "documents"), min_length=6, min_exponent=4, rewrite=repeated_tail)
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_packing, op3_token_store, op4_quality_classifier,
        op5_language_id, op6_simhash_near_dedup, op7_toxicity, op8_line_dedup,
        op9_decontamination, op10_lm_scoring, op11_lexical_search, op12_jaccard_join,
        op13_periodic_runs,
    )
}

ORACLE = {
    "op1_quality_rules": QUALITY_RULES,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_jaccard_join": JACCARD_JOIN,
}
