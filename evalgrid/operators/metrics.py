"""Metrics as Column aggregates over ranked rows, and their registry.

A metric is a function that returns a Column aggregate over the canonical columns of ``ranked``:
``y``, ``yhat``, their average ranks ``rank_y``, ``rank_yhat`` and ascending places ``place_y``,
``place_yhat`` within the group, the group's size ``n``, and ``top_k`` (null where undefined).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")
REGISTRY: dict[str, Callable[[], Column]] = {}


def metric(name: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Register a metric under a name (``metric_`` in front is dropped)."""

    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        REGISTRY[name.removeprefix("metric_")] = f
        return f

    return add


@metric("spearman")
def spearman() -> Column:
    """Pearson correlation of average ranks; NaN for any null or NaN value, constants and single rows."""
    bad = F.max(F.isnan("y") | F.isnan("yhat"))
    spread = F.stddev_pop("rank_y") * F.stddev_pop("rank_yhat")
    rho = F.try_divide(F.covar_pop("rank_y", "rank_yhat"), spread)
    return F.when(bad | (spread < 1e-12), F.lit(NAN)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(rho, F.lit(NAN)))))


@metric("recovery")
def recovery() -> Column:
    """Share of the top_k rows by truth that are among the top_k by prediction.

    Null without a positive top_k; an error if it exceeds the rows. NaN and null count as largest;
    of equal values the higher row id wins.
    """
    k, n = F.max("top_k"), F.max("n")
    both = F.count_if((F.col("place_y") > F.col("n") - F.col("top_k")) & (F.col("place_yhat") > F.col("n") - F.col("top_k")))
    message = F.format_string("top_k (%d) is larger than the number of samples (%d).", k, n)
    return F.when(k.isNull() | (k <= 0), F.lit(None).cast("double")).when(k > n, F.raise_error(message).cast("double")).otherwise(F.try_divide(both.cast("double"), k.cast("double")))


@metric("pearson")
def pearson() -> Column:
    """Pearson correlation of the values, NaN where it is undefined."""
    bad = F.max(F.isnan("y") | F.isnan("yhat"))
    spread = F.stddev_pop("y") * F.stddev_pop("yhat")
    return F.when(bad, F.lit(NAN)).otherwise(F.coalesce(F.try_divide(F.covar_pop("y", "yhat"), spread), F.lit(NAN)))


@metric("rmse")
def rmse() -> Column:
    """Root of the mean squared difference."""
    return F.sqrt(F.avg((F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))))


def ranked(df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat", row_id: str = "row_id", cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """``df`` with the canonical columns: all windows share one exchange on ``by``.

    The average of the row numbers of equal values is their average rank, and the row number is
    also the place, so a column costs two sorts. Nulls become NaN, which sorts last.

    ``cuts`` (``value_cuts``), for groups too large for one task: rows are dealt by group and range
    of values, numbered there, and moved up by the sizes of the group's lower ranges.
    """
    out = df.withColumns({c: F.coalesce(F.col(v).cast("double"), F.lit(NAN)) for c, v in (("y", y), ("yhat", yhat))})
    if "top_k" not in out.columns:
        out = out.withColumn("top_k", F.lit(None).cast("int"))
    if cuts is None:
        for c in ("y", "yhat"):
            out = out.withColumn(f"place_{c}", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c), F.col(row_id))))
            out = out.withColumn(f"rank_{c}", F.avg(f"place_{c}").over(Window.partitionBy(*by, c)))
        return out.withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    out = out.withColumns({f"_range_{c}": _range(F.col(c), cuts[c]) for c in ("y", "yhat")})
    ranges = [f"_range_{c}" for c in ("y", "yhat")]
    sizes = out.groupBy(*by, *ranges).agg(F.count("*").alias("_size"))  # a row for each group and two ranges
    for c, r in zip(("y", "yhat"), ranges, strict=True):
        lower = sizes.groupBy(*by, r).agg(F.sum("_size").alias("_size"))
        before = F.sum("_size").over(Window.partitionBy(*by).orderBy(r)) - F.col("_size")
        lower = lower.select(*by, r, before.alias(f"_below_{c}"), F.sum("_size").over(Window.partitionBy(*by)).alias("n"))
        lower = lower if c == "y" else lower.drop("n")
        within = F.row_number().over(Window.partitionBy(*by, r).orderBy(F.col(c), F.col(row_id)))
        mean = F.avg("_within").over(Window.partitionBy(*by, r, c))
        out = out.withColumn("_within", within).withColumn("_mean", mean).join(F.broadcast(lower), [*by, r])
        out = out.withColumns({f"place_{c}": F.col(f"_below_{c}") + F.col("_within"), f"rank_{c}": F.col(f"_below_{c}") + F.col("_mean")}).drop("_within", "_mean", f"_below_{c}")
    return out.drop(*ranges)


RANGES = 32


def value_cuts(**columns: tuple[DataFrame, str]) -> dict[str, list[float]]:
    """For each named (table, column) the bounds of about RANGES ranges that hold about as many rows each; one job."""
    rows = None
    for name, (df, column) in columns.items():
        part = df.select(F.lit(name).alias("name"), F.col(f"`{column}`").cast("double").alias("v")).where(~F.isnan("v"))
        rows = part if rows is None else rows.unionByName(part)
    shares = [i / RANGES for i in range(1, RANGES)]
    found = {r["name"]: r["cuts"] for r in rows.groupBy("name").agg(F.percentile_approx("v", shares, 50 * RANGES).alias("cuts")).collect()}
    return {name: sorted(set(found.get(name) or [])) for name in columns}


def _range(value: Column, cuts: list[float]) -> Column:
    """The number of cuts below a value; NaN is above all."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < value))


def known_metrics(names: Sequence[str] | None) -> list[str]:
    """The names that are registered, all of them for None; others are warned about and left out."""
    chosen = []
    for name in REGISTRY if names is None else names:
        if name in REGISTRY:
            chosen.append(name)
        else:
            warnings.warn(f"Unknown metric: {name}", stacklevel=2)
    return chosen


def score(df: DataFrame, metrics: Sequence[str] | None, by: Sequence[str], y: str = "y", yhat: str = "yhat", row_id: str = "row_id", cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """One row for each group with a column for each metric and ``n``; ``cuts`` as in ``ranked``."""
    names = known_metrics(metrics)
    return ranked(df, by, y, yhat, row_id, cuts).groupBy(*by).agg(F.count("*").alias("n"), *[REGISTRY[m]().alias(m) for m in names])


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank``: the mean place of equal values within the group.

    Windows on ``by``; for one huge group use ``global_average_rank``.
    """
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def global_average_rank(df: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``rank`` over all rows, without a task that sorts them all.

    Distinct values are counted, ranged into buckets by approximate quantiles, numbered within
    their bucket and moved up by the counts of the lower buckets; then joined back by value. Nulls
    rank first, NaN last, as in ``average_rank``.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    cuts = sorted(set(counts.where(F.col(value).isNotNull()).approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.001)))
    bucket = F.lit(0)
    for i, cut in enumerate(cuts):
        bucket = F.when(F.col(value) > cut, i + 1).otherwise(bucket)
    counts = counts.withColumn("_bucket", F.when(F.isnan(F.col(value).cast("double")), len(cuts) + 1).otherwise(bucket))
    lower = counts.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    lower = lower.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_below"))  # a row a bucket
    within = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(value))
    counts = counts.withColumn("_upto", within).join(F.broadcast(lower), "_bucket")
    ranks = counts.select(value, (F.col("_below") + F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias("rank"))
    ranks = ranks.withColumnRenamed(value, "_value")
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
