"""Stages that turn documents into training data.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run``
writes each stage's rows to the shared checkpoint folder as Parquet and rereads them for the
next, so a lost executor costs one stage at most.  All stages but the last return the
columns of documents; the last gives doc_id, n_tokens, token_ids and round_trip.

Cases.  Rows with null or empty text are rejected by the first stage.  Rows with a null
doc_id pass like others and are no one's duplicates.  Repeated rows stay or go together.
Extra columns pass through until the last stage.  Empty tables give an empty result.
"""

from scriven.llm import bpe, decontaminate, language_id, near_duplicates, quality
from scriven.llm.common import materialize, table


def language(spark, docs, sf_dir):
    """Documents in a known language (operator 5)."""
    return language_id.accept(docs, language_id.fit(docs))


def quality_classifier(spark, docs, sf_dir):
    """Documents that are neither of low quality nor toxic (operator 2), fitted on what is labelled."""
    return quality.accept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_groups(spark, docs, sf_dir):
    """One document of each group of n-gram Jaccard matches (operator 7), the least doc_id."""
    return near_duplicates.deduplicate(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark passage (operator 9)."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Token ids of what is left, decoded again to check them (operator 10)."""
    return bpe.encode(docs, bpe.load())


STAGES = [
    ("language", language),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
#: Trained models decide the first stages; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows: the stages applied one after another to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
