"""Features: one-hot sequences, and pooled or joined embeddings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions.columns import AMINO_ACIDS, one_hot
from evalgrid.sources.staging import exists, staged


def max_length(df: DataFrame, sequence: str = "sequence") -> int:
    return df.agg(F.max(F.length(sequence))).first()[0] or 0


def with_one_hot(df: DataFrame, sequence: str = "sequence", alphabet: str = AMINO_ACIDS, length: int | None = None, unknown: str = "error") -> DataFrame:
    """``features``: one-hot residues padded to the longest of all sequences, train and test alike."""
    return df.withColumn("features", one_hot(sequence, alphabet, length or max_length(df, sequence), unknown))


def mean_pool(tokens: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """(key, pooled): mean over the rows of a key, coordinate by coordinate."""
    flat = tokens.select(key, F.posexplode(embedding).alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("v"))
    pooled = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"])
    return flat.groupBy(key).agg(pooled.alias("pooled"))


def last_pool(tokens: DataFrame, key: str, position: str, embedding: str = "embedding", back: int = 2) -> DataFrame:
    """(key, pooled): the embedding ``back`` places from the end."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return tokens.withColumn("_place", place).where(F.col("_place") == back).select(key, F.col(embedding).alias("pooled"))


def joined(forward: Column | str, backward: Column | str) -> Column:
    return F.concat(forward, backward)


def gather(df: DataFrame, embeddings: DataFrame, key: str = "embedding_index") -> DataFrame:
    """Rows with their embedding from a written table."""
    return df.join(embeddings, key)


def row_numbered(df: DataFrame, order: str, name: str = "embedding_index") -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique column, without one task for all rows.

    Rows are range-partitioned and written, since a second run would draw other bounds; each
    partition is then numbered from the count of those before it.
    """
    spark = df.sparkSession
    ranged = staged(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # a row a partition
    done, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, done))
        done += sizes[part]
    before = spark.createDataFrame(starts, "_part int, _before long")
    ranged = ranged.withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_part", "_within", "_before")


def cached_embeddings(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The embeddings written at ``path``; made and written first where there are none."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Embedder:
    """Pooled embeddings of sequences from a table of (key, pos, embedding): fit learns nothing but the table."""

    pooling: str = "mean"
    key: str = "sequence"
    position: str = "pos"

    def fit(self, tokens: DataFrame) -> EmbedderModel:
        if self.pooling not in POOLING:
            raise ValueError(f"unknown pooling: {self.pooling}")
        pooled = mean_pool(tokens, self.key) if self.pooling == "mean" else last_pool(tokens, self.key, self.position)
        return EmbedderModel(pooled, self.key)


@dataclass(frozen=True)
class EmbedderModel:
    table: DataFrame
    key: str

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """``df`` with the pooled embedding of each row's key; keys without one are left out."""
        return df.join(self.table.withColumnRenamed("pooled", output), self.key)


POOLING = {"mean": mean_pool, "last": last_pool}
