"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each one's result to the shared folder and reads it again for the next. All
stages but the last return the columns of documents, under their names.

A stage deletes what earlier stages had staged, but for what its docs read;
their results must have been written by then, as run() does.

Defined results: documents with a null or empty text are clean, copies of each
other (one of them stays), lose nothing, are never taken by the mix (they have
no words), and so do not reach the packing; a null id is an id like any other,
and of a group of near copies the smallest id stays; repeated rows are
documents of their own and near copies of each other; of equal documents
packed twice each is packed; an empty table gives an empty result; texts of
any length are processed whole.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, near_copies, packing, shared, suffix_dedup, toxicity
from factloom.llm.queries import tokenizer_path

#: Documents whose toxicity reaches this go.
TOXIC = 0.3
#: Shortest repeated passage that is cut out, in words: those of over 50.
PASSAGE_WORDS = 51

#: Rows that a Python worker is sent at once. What stages make of a batch of texts is many times its size.
BATCH_ROWS = 400

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class Left(threading.local):
    """Folders of the tables that a thread's stages have staged and that are still there."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_left = Left()


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gone = shared.unread(_left.paths, docs)
        shared.delete(gone)
        _left.paths = [p for p in _left.paths if p not in gone]
        shared.bound_batches(spark, BATCH_ROWS)
        with shared.noted(_left.paths):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels outside the held-out fold, like the query of the operator."""
    labels = shared.table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels), TOXIC)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, alike in 0.8 or more of their five-word shingles, stays."""
    return near_copies.keep_one(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere too are cut out of the texts."""
    return suffix_dedup.remove_repeated_words(docs, PASSAGE_WORDS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their shares of one and a half times all words; documents that are taken twice come twice."""
    return mixing.mixed_documents(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and their places in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity machine, connected components and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    # What other runs of this thread have left is not this one's to delete.
    others, _left.paths = _left.paths, []
    try:
        for name, of in STAGES:
            before, docs = docs, shared.staged(of(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            shared.delete(shared.staged_paths(before))
    finally:
        _left.paths += others
    return docs
