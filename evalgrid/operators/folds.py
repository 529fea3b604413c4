"""Cross-validation folds: masks, membership, and train / test frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.columns import named, top_k_of


def membership_from_masks(slices: DataFrame) -> DataFrame:
    """(split, fold, assay_idx, record_idx) from rows of (split, fold, assay_idx, mask)."""
    return slices.select("split", "fold", "assay_idx", F.posexplode("mask").alias("record_idx", "_in")).where("_in").drop("_in")


def modulo_folds(record: Column, folds: int) -> Column:
    return F.pmod(record, F.lit(folds)).cast("int")


def contiguous_folds(df: DataFrame, order: str, folds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A column ``fold``: equal runs of rows in the order of a unique column."""
    return df.withColumn("fold", F.ntile(folds).over(Window.partitionBy(*by).orderBy(order)) - 1)


def fold_indices(membership: DataFrame) -> DataFrame:
    """(split, folds, total_folds), folds ascending."""
    folds = F.array_sort(F.collect_set("fold"))
    return membership.groupBy("split").agg(folds.alias("folds"), F.countDistinct("fold").alias("total_folds"))


def with_top_k(fold_meta: DataFrame) -> DataFrame:
    """(split, fold, top_k) from (split, fold, metadata map)."""
    return fold_meta.select("split", "fold", top_k_of("metadata").alias("top_k"))


def slice_records(records: DataFrame, membership: DataFrame) -> DataFrame:
    """Records of each fold; overlapping folds repeat them."""
    return records.join(membership.select("fold", "record_idx"), "record_idx")


def train_test(records: DataFrame, membership: DataFrame, target: str, test_fold: int, drop_nan: bool = True) -> DataFrame:
    """Records labelled train / test in ``split``, the target renamed ``target``; NaN targets go, nulls stay."""
    rows = slice_records(records, membership)
    rows = rows.select(*[named(c) for c in records.columns if c != target], named(target).alias("target"), F.when(F.col("fold") == test_fold, "test").otherwise("train").alias("split"))
    return rows.where(~F.isnan("target") | F.col("target").isNull()) if drop_nan else rows


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))
