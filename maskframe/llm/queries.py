"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import html_extract

    return html_extract.main_text(table(spark, sf_dir, "pages"), html_extract.train())


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import chat

    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import simhash

    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import quality

    return quality.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizer_path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import pieces

    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm import warc

    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_html_extraction": op2_html_extraction,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_document_fingerprints": op5_document_fingerprints,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_sentencepiece_sampling": op9_sentencepiece_sampling,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    from maskframe.llm import chat, warc

    return {"op3_chat_formatting": chat.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL}
