"""Scores of test folds aggregated to mean and standard deviation, and made wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("game", "model", "dataset", "split", "target")
#: Keys of a score document's metadata that belong to a single fold.
SINGLE_FOLD = ("test_fold", "test_folds", "train_available_folds")


def mean(value: str = "value") -> Column:
    return F.avg(value)


def sample_std(value: str = "value") -> Column:
    """Sample standard deviation; 0 for one value. Nulls are skipped, NaN is not."""
    return F.when(F.count(value) == 1, F.when(F.isnan(F.max(value)), F.lit(float("nan"))).otherwise(F.lit(0.0))).otherwise(F.stddev_samp(value))


def aggregate(scores: DataFrame, by: Sequence[str] = ("mode", "metric"), value: str = "value") -> DataFrame:
    """Mean, std and number of values that are not null; groups without any are left out."""
    return scores.where(F.col(value).isNotNull()).groupBy(*by).agg(mean(value).alias("mean"), sample_std(value).alias("std"), F.count(value).alias("n_values"))


def flatten_wide(aggregates: DataFrame, by: Sequence[str] = KEYS, names: Sequence[str] | None = None) -> DataFrame:
    """Columns ``<mode>_<metric>`` and, for all modes but full_dataset, ``<mode>_<metric>_std``."""
    cells = F.array(
        F.struct(F.concat_ws("_", "mode", "metric").alias("name"), F.col("mean").alias("v")),
        F.struct(F.concat_ws("_", "mode", "metric", F.lit("std")).alias("name"), F.col("std").alias("v")),
    )
    long = aggregates.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").where("not (name like 'full_dataset%' and name like '%_std')")
    return long.groupBy(*by).pivot("name", list(names) if names else None).agg(F.first("v"))


def first_metadata(docs: DataFrame, by: Sequence[str], path: str = "path", metadata: str = "metadata") -> DataFrame:
    """Metadata of the first document by path, without the keys of a single fold."""
    kept = F.map_filter(F.col("_m"), lambda k, _: ~k.isin(*SINGLE_FOLD))
    return docs.where(F.col(metadata).isNotNull()).groupBy(*by).agg(F.min_by(metadata, path).alias("_m")).select(*by, kept.alias("metadata"))
