"""The metadata table as records: one row per file_name, speaker, split and numbers in their read form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.blanks import blank_to_null, point_number
from corpusloom.runtime import table


def read_columns(meta: DataFrame) -> dict:
    """The read forms by name, to be picked from in a select."""
    return {
        "file_name": meta["file_name"],
        "speaker": F.lower(blank_to_null(meta["speaker_id"])),
        "split": F.lower(F.coalesce(blank_to_null(meta["split"]), F.lit("train"))),
        "dnsmos": point_number(meta["dnsmos"]),
        "cer": point_number(meta["cer"]),
        "source_path": meta["source_path"],
        "text": meta["text_normalized"],
    }


def records(meta: DataFrame, *columns: str) -> DataFrame:
    """One row per ``file_name`` with the named read forms; of rows that differ, the last export counts.

    Only the columns asked for are shuffled. Rows without ``file_name`` are no records.
    """
    read = read_columns(meta)
    keep = meta.where(F.col("file_name").isNotNull()).select(
        "file_name", F.struct(F.col("exported_at"), *[read[c].alias(c) for c in columns]).alias("_r")
    )
    return keep.groupBy("file_name").agg(F.max("_r").alias("_r")).select("file_name", *[F.col(f"_r.{c}").alias(c) for c in columns])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)
