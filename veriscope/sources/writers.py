"""Results to files, and outputs that grow over several runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions.text import text_hash
from veriscope.plans.shared import exists


def parquet(df: DataFrame, path: str, *by: str) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def csv_sorted(df: DataFrame, path: str, *order: Column) -> None:
    """A small ranking as one sorted CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def full_json(df: DataFrame) -> DataFrame:
    """One column ``json`` with every column of each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def one_line(df: DataFrame) -> DataFrame:
    """``line``: a short text of each match."""
    return df.select(F.format_string("[%s] %s score=%.4f %s", F.col("claim_id").cast("string"), F.col("match_type"), F.col("score"), F.coalesce("where", F.lit("-"))).alias("line"))


def cached_vectors(spark: SparkSession, texts: DataFrame, text: str, model: str, embed: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """``key, vec`` of all texts; only texts whose key (hash of model and text) the cache lacks are embedded."""
    asked = texts.select(text_hash(F.concat(F.lit(model), text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    known = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "key string, vec array<float>")
    fresh = embed(asked.join(known.select("key"), "key", "left_anti"))
    fresh.select("key", "vec").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(asked.select("key"), "key", "left_semi")


def append_pending(spark: SparkSession, rows: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Runs ``work`` on the rows whose key the output lacks and appends the result; how many rows that were.

    A run that breaks off leaves what it committed, and the next one goes on from there.
    """
    before, todo = 0, rows
    if exists(spark, path):  # any other failure to read is one, and not "no output yet"
        done = spark.read.parquet(path)
        before, todo = done.count(), rows.join(done.select(key).distinct(), key, "left_anti")
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def shard(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Shard ``i`` of ``n`` by the hash of the key."""
    return df.filter(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(n)) == i)
