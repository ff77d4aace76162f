"""A training corpus in five stages over ``documents``; the last returns packed pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  ``run``
writes each stage as Parquet below the shared scratch folder and reads it back for the next.

All but the last return the columns that they got, whatever their names and types; an empty table
gives an empty one.  A null text counts as empty; rows without a doc_id are documents of their own.
"""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import packing, quality_rules, secret_scan, simhash, toxicity
from tidemark.llm.common import saved, table


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go; null and empty texts have too few words and go too."""
    return quality_rules.apply_rules(docs)


def drop_toxic(spark, docs, sf_dir):
    """Documents that score as toxic go; labels are learned on the documents that are still there.

    Without labels of both kinds nothing is known to be toxic, and all stay; so do empty texts.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each SimHash group stays, the one with the smallest id (then fingerprint).

    Rows that repeat id and fingerprint are one document; rows without an id stay.
    """
    return simhash.one_of_each(docs)


def redact_secrets(spark, docs, sf_dir):
    """Every span that the secret scan finds is replaced; no document goes, and a null text stays null."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens with their sequences; an empty text is one piece with the end id only."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack),
]

# Toxicity, secret scans and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
