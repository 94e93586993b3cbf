"""Registered queries of the operators, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .decontaminate import contamination
from .exactdedup import SQL as EXACT_SQL, duplicates
from .fillmiddle import SQL as MIDDLE_SQL, middle_digests
from .language import predict_language
from .merkle import SQL as MERKLE_SQL, verified_manifest
from .mixing import mix_documents
from .personal import find_personal
from .sharding import shard_documents
from .simhash import near_duplicates
from .tokenfile import token_digest
from .toxicity import score_toxicity
from .urlfilter import SQL as URL_SQL, filter_urls
from .vectors import SQL as VECTOR_SQL, search

Query = Callable[[SparkSession, str], DataFrame]


def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op4_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op5_range_coded_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op6_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bilstm_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))


def op9_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op11_displacement_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(table(spark, sf_dir, "documents"))


def op12_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


def op13_nested_rollup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_kneser_ney_toxicity,
    op2_balanced_label_propagation,
    op3_block_matrix_neighbours,
    op4_compression_language,
    op5_range_coded_token_ids,
    op6_link_graph_url_filter,
    op7_suffix_automaton_decontamination,
    op8_bilstm_crf_personal_data,
    op9_pigeonhole_simhash,
    op10_subset_sum_mixing,
    op11_displacement_fill_middle,
    op12_golomb_exact_dedup,
    op13_nested_rollup_manifest,
)}

SQL: dict[str, str] = {
    "op3_block_matrix_neighbours": VECTOR_SQL,
    "op6_link_graph_url_filter": URL_SQL,
    "op11_displacement_fill_middle": MIDDLE_SQL,
    "op12_golomb_exact_dedup": EXACT_SQL,
    "op13_nested_rollup_manifest": MERKLE_SQL,
}
