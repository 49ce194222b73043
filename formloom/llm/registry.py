"""Queries of the training-data operators on the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann_forest import nearest
from .license_scan import license_scan
from .packing import pack
from .piece_codec import encode_pieces
from .prefix_trie import conversation_trie
from .quality_classifier import classify
from .quality_rules import quality_rules
from .secret_scan import secret_spans
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_files import token_files_round_trip
from .url_filter import url_verdicts
from .url_labels import labelled_urls
from .va_codes import vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: The rules that op11_url_filter applies.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_urls(), "url string, block int")
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, labelled)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("n_measured")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_license_scan": op5_license_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ann_forest": op9_ann_forest,
    "op10_quality_rules": op10_quality_rules,
    "op11_url_filter": op11_url_filter,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    name: (Path(__file__).parent / f"{sql}_oracle.sql").read_text()
    for name, sql in (("op10_quality_rules", "quality_rules"), ("op12_vector_codes", "vector_codes"), ("op13_prefix_trie", "prefix_trie"))
}
