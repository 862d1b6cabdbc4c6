"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm import bitplanes, chaining, hash_forest, interval_expansion, license_scan, merge_queue, merkle, oracles, packing, periodic_runs, permutation_index, pitman_yor, robust_outliers, wrapper
from claimcheck.llm.common import shared_folder, ship_library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_diagonal_voting": oracles.LICENSES, "op13_merkle_climb": oracles.MERKLE}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    bitplanes.write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return bitplanes.read_ids(spark, folder, bitplanes.crc_of_ids, "ids_crc32 long")


@query
def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


@query
def op3_merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_queue.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judged(table(spark, sf_dir, "documents"))


@query
def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.join(table(spark, sf_dir, "documents"))


@query
def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


@query
def op8_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interval_expansion.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.digest(chaining.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op11_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


@query
def op13_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(table(spark, sf_dir, "documents"))
