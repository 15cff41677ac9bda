"""The queries of this package by name: ``opN_<name>``, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversation_trie, decontaminate, exact_dedup, language_id, language_model, lexical_search, minhash, mixing, pii, quality, simhash, substring_dedup, url_filter
from .common import read


def op1_language_id(spark, sf_dir):
    return language_id.identify_languages(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.digest_contamination(decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op3_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_language_model(spark, sf_dir):
    return language_model.score_corpus(read(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op6_pii(spark, sf_dir):
    return pii.digest_spans(pii.find_pii(read(spark, sf_dir, "documents")))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.substring_dedup(read(spark, sf_dir, "documents")))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark, sf_dir):
    return conversation_trie.conversation_trie(read(spark, sf_dir, "conversations")).drop("at", "until")


def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_decontaminate, op3_quality, op4_language_model, op5_url_filter, op6_pii, op7_substring_dedup, op8_simhash, op9_exact_dedup, op10_mix_sources, op11_conversation_trie, op12_minhash, op13_lexical_search)
}
ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE, "op5_url_filter": url_filter.oracle(), "op7_substring_dedup": substring_dedup.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op10_mix_sources": mixing.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE, "op12_minhash": minhash.ORACLE, "op13_lexical_search": lexical_search.ORACLE,
}
