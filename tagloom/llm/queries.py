"""One query per operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import leak_report
from .exact_dedup import exact_dedup
from .hmm import score_texts
from .id_codec import id_round_trip
from .lang_id import identify
from .line_chunks import remove_repeats
from .merkle import manifest, tampered_third
from .minhash import near_components
from .packing import pack
from .page_content import extract_main_text
from .url_filter import url_verdicts
from .variants import spelling_variants
from .warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op1_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages, with the counts of chunks and of what was removed."""
    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), "n", over_words=50)
    return done.select("doc_id", F.col("n.chunks").alias("n_chunks"), F.col("n.removed").alias("n_removed"), "text")


def op4_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


def op6_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op9_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"), tampered_third())


def op13_partenum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), slip=199)


def op12_tree_model_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op12_tree_model_extract": op12_tree_model_extract,
    "op13_partenum_variants": op13_partenum_variants,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op4_hidden_markov_lm": op4_hidden_markov_lm,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op3_line_chunks": op3_line_chunks,
    "op1_nearest_centroid": op1_nearest_centroid,
    "op10_fm_decontamination": op10_fm_decontamination,
    "op2_simple8b_ids": op2_simple8b_ids,
    "op7_differencing_pack": op7_differencing_pack,
    "op6_url_lm_ratio": op6_url_lm_ratio,
    "op9_splittable_warc": op9_splittable_warc,
    "op8_tree_merge_dedup": op8_tree_merge_dedup,
}
