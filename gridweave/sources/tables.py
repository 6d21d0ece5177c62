"""Fact tables from files, and level columns derived from others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sample: float | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema types are inferred, from a share of the rows if `sample` is given.

    Inference reads the data once more: give a schema for large files.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    reader = reader.option("inferSchema", True)
    return (reader if sample is None else reader.option("samplingRatio", sample)).csv(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir, which all executors see; only a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"


def lookup(key: str | Column, mapping: dict[str, str], default: str = "Other") -> Column:
    """A level column by lookup: unknown keys get the default, null stays null."""
    key = F.col(key) if isinstance(key, str) else key
    pairs = [F.lit(x) for kv in sorted(mapping.items()) for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    return F.when(key.isNotNull(), F.coalesce(found, F.lit(default)))


def with_lookup(df: DataFrame, column: str, key: str, mapping: dict[str, str], default: str = "Other") -> DataFrame:
    return df.withColumn(column, lookup(key, mapping, default))


def materialise(facts: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Facts written once as Parquet, with their joins and derived levels done, and read back.

    Partitioned by the levels that queries pin (a year, a scenario), their filters prune whole folders;
    rows are dealt by those levels first, so that each folder gets few files, split where it is large.
    """
    rows = facts.hint("rebalance", *partition_by) if partition_by else facts
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    # the schema is given, so that a partition's value keeps its type and isn't guessed from its text
    return facts.sparkSession.read.schema(facts.schema).parquet(path).select(*facts.columns)
