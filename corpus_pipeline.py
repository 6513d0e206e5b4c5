"""The corpus pipeline: toxicity, exact copies, near copies, benchmark passages, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it
returns is written as Parquet and reread as the next one's ``docs``.
"""

import os
import uuid

import public_tokenizers

from tablewright.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from tablewright.plans.lineage import steps_folder


def toxic_texts(spark, docs, sf_dir):
    """Texts that the model calls toxic go; it is trained on the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def exact_copies(spark, docs, sf_dir):
    """One row of each group of texts equal without white space stays."""
    return exact_dedup.without_copies(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group linked by Jaccard similarity 0.8 or more of five-word n-grams stays."""
    return ngram_join.without_near_copies(docs, width=5, percent=80)


def benchmark_passages(spark, docs, sf_dir):
    """Documents that hold a benchmark item's passage go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_passages(docs, items, width=5, percent=80)


def token_ids(spark, docs, sf_dir):
    """Every kept document's ids, their count and digest, and that of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids_col="ids")


STAGES = [
    ("toxic_texts", toxic_texts),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: SQL cannot express the toxicity model, the near copies and the token ids; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = os.path.join(steps_folder(spark), "pipeline-" + uuid.uuid4().hex)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
