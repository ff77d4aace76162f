"""Registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import (alignment, byte_bpe, lm_scoring, packing, prefix_trie, quality_rules, repeats, secret_scan,
                          simhash, token_files, toxicity, url_filter, vector_dedup)
from tidemark.llm.common import table


def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_vector_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(files)


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.spliced(turns))


def op12_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark, sf_dir):
    return repeats.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_secret_scan, op3_toxicity, op4_byte_bpe, op5_lm_scoring, op6_vector_dedup,
    op7_quality_rules, op8_token_files, op9_best_fit_packing, op10_url_filter, op11_prefix_trie, op12_token_alignment, op13_suffix_dedup)}
