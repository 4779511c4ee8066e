"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes each
result to the shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import minhash, packing, quality, suffix_dedup, toxicity
from maskframe.llm.common import materialize, spent, table
from maskframe.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the fertility bands reject; the bands are learnt from the labelled rows among docs."""
    model = tokenizer_path("piece_bpe_32k.model")
    return quality.keep(docs, model, bands=quality.learn(docs, table(spark, sf_dir, "labels"), model))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the lexicon is learnt from the labelled rows among docs."""
    return toxicity.keep(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every passage of 200 bytes or more that occurs elsewhere too."""
    return suffix_dedup.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), cache_parts=150_000)  # workers still hold memory of earlier stages


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", pack),
]

#: Tokenisers, learnt weights and similarity of sets are beyond SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
        spent(docs)  # what the stage before has written
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
