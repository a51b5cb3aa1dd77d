"""Harvested metadata records: XML files of a landing folder, read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metadata import zip_names

RECORD = "id string, setSpec array<string>, version array<struct<_version: string, date: string>>, keyname array<string>, forenames array<string>"


def read_records(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """Records with id, categories, versions and names; a malformed record gives nulls, never a failure."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(RECORD).load(path)


def parse_records(texts: DataFrame, col: str = "value") -> DataFrame:
    """The like for records that stand in a column, one each; what cannot be read gives nulls."""
    return texts.select(F.from_xml(F.col(col), RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def versions_of(records: DataFrame) -> DataFrame:
    """``(arxiv_id, number, version_time)``: one leading ``v`` is dropped, dates of the mail format are read."""
    v = records.select(F.col("id").alias("arxiv_id"), F.explode("version").alias("v"))
    date = F.regexp_replace(F.col("v.date"), "^[A-Za-z]{3}, *", "")
    return v.select(
        "arxiv_id",
        F.expr("try_cast(regexp_replace(v._version, '^v', '') as int)").alias("number"),
        F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss z")).alias("version_time"),
    )


def categories_of(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("arxiv_id"), F.explode("setSpec").alias("spec")).distinct()


def authors_of(records: DataFrame) -> DataFrame:
    """Names zipped to the shorter of the two lists."""
    a = records.select(F.col("id").alias("arxiv_id"), F.explode(zip_names(F.col("forenames"), F.col("keyname"))).alias("a"))
    return a.select("arxiv_id", F.col("a.0").alias("first_name"), F.col("a.1").alias("last_name")).distinct()
