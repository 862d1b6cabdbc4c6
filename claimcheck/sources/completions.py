"""Stored completions: one JSON file per prompt, named by the prompt key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STORE_SCHEMA = (
    "completion string, user string, "
    "meta struct<model:string,captured_at:string,note:string>"
)


def read_completions(spark: SparkSession, folder: str) -> DataFrame:
    """``(prompt_key, user_prompt, completion, model, captured_at, note)``.

    The key is the file's name, so a copied or renamed file is found out when
    its stored prompt is compared with the requested one.
    """
    files = spark.read.schema(STORE_SCHEMA).option("multiLine", True).json(f"{folder}/*.json")
    return files.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("prompt_key"),
        F.col("user").alias("user_prompt"),
        "completion",
        "meta.model",
        "meta.captured_at",
        "meta.note",
    )
