"""All score modes of a benchmark cell in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.columns import named

from .metrics import known_metrics, score, value_cuts
from .scoring import join_keys, scoring_frame

MODES = ("test", "train_available", "per_fold", "full_dataset")
_GROUP = ("_kind", "_fold")


def preconditions(truth: DataFrame, predicted: DataFrame, membership: DataFrame, keys: Sequence[str]) -> bool:
    """Whether keys are unique on both sides and no record is in two folds: the fast plan is right then.

    One job over the keys' hashes: an accidental collision only means the slower plan.
    """
    sides = [df.select(F.xxhash64(F.lit(i), *[named(k) for k in by]).alias("h")) for i, (df, by) in enumerate(((truth, keys), (predicted, keys), (membership, ["record_idx"])))]
    return not sides[0].union(sides[1]).union(sides[2]).groupBy("h").count().where("count > 1").head(1)


def _group(kind: str, fold: Column) -> Column:
    return F.struct(F.lit(kind).alias("_kind"), fold.cast("int").alias("_fold"))


def _groups(fold: Column, test_fold: int | None, modes: Sequence[str]) -> Column:
    """The groups of a record in a fold (null: in none): its fold, the pooled training folds, and all records; 'test' is a fold's group again."""
    parts = []
    if "per_fold" in modes:
        parts.append(F.when(fold.isNotNull(), _group("fold", fold)))
    elif "test" in modes:
        parts.append(F.when(fold == test_fold, _group("fold", fold)))
    if "train_available" in modes:
        parts.append(F.when(fold != test_fold, _group("train", F.lit(-1))))
    if "full_dataset" in modes:
        parts.append(_group("full", F.lit(-1)))
    return F.explode(F.filter(F.array(*parts), lambda g: g.isNotNull())).alias("_g")


def score_modes(
    truth: DataFrame,
    predicted: DataFrame,
    membership: DataFrame,
    target: str,
    test_fold: int | None = None,
    metrics: Sequence[str] | None = None,
    modes: Sequence[str] = ("test", "train_available", "per_fold"),
    fold_meta: DataFrame | None = None,
    variables: Sequence[str] = (),
    plan: str = "auto",
    coverage: bool = False,
) -> DataFrame:
    """(mode, fold, metric, value, n): every metric in every mode; unknown modes are ignored.

    ``truth`` and ``predicted`` have record_idx, the keys and the target; ``membership``
    (fold, record_idx); ``fold_meta`` (fold, top_k). Folds are pooled before ranking for
    train_available; recovery is defined for single folds only. ``plan``: 'fast' joins once and
    needs unique keys and disjoint folds, 'compat' lets overlapping folds and repeated keys
    multiply on both sides, 'auto' looks first. ``coverage`` adds ``expected``, the rows of truth in
    the group, and a row with n = 0 and null values for a group without any prediction.

    Groups that may hold most rows (the pooled folds, all records) are ranked by ranges of values,
    so that no task sorts a whole group.
    """
    modes = [m for m in MODES if m in modes]
    names = known_metrics(metrics)
    keys = join_keys(truth, predicted, variables)
    pred = f"{target}_pred"
    folded = [m for m in modes if m != "full_dataset"]
    if not modes or not names:
        spark = truth.sparkSession
        return spark.createDataFrame([], "mode string, fold int, metric string, value double, n long" + (", expected long" if coverage else ""))
    if plan == "auto":
        plan = "fast" if not folded or preconditions(truth, predicted, membership, keys) else "compat"
    picked = [named(target).alias("y"), named(pred).alias("yhat")]
    folds = membership.select("record_idx", F.col("fold").cast("int").alias("_in"))
    if plan == "fast":  # one join; a record is in one fold at most
        rows = scoring_frame(truth, predicted, target, keys, ["record_idx"])
        rows = rows.join(folds, "record_idx", "left" if "full_dataset" in modes else "inner") if folded else rows.withColumn("_in", F.lit(None).cast("int"))
        rows = rows.select("record_idx", *picked, _groups(F.col("_in"), test_fold, modes)).select("_g.*", "record_idx", "y", "yhat")
    else:
        grouped = folds.select("record_idx", _groups(F.col("_in"), test_fold, folded)).select("record_idx", "_g.*")
        rows = scoring_frame(truth.join(grouped, "record_idx"), predicted.join(grouped, "record_idx"), target, [*_GROUP, *keys], ["record_idx"])
        rows = rows.select(*_GROUP, "record_idx", *picked)
        if "full_dataset" in modes:
            whole = scoring_frame(truth, predicted, target, keys, ["record_idx"])
            rows = rows.unionByName(whole.select(F.lit("full").alias("_kind"), F.lit(-1).alias("_fold"), "record_idx", *picked))
    cuts = None
    if {"train_available", "full_dataset"} & set(modes):
        cuts = value_cuts(y=(truth, target), yhat=(predicted, target))
    if fold_meta is not None:
        limits = fold_meta.select(F.lit("fold").alias("_kind"), F.col("fold").cast("int").alias("_fold"), "top_k")
        rows = rows.join(F.broadcast(limits), list(_GROUP), "left")  # a row a fold
    scores = score(rows, names, _GROUP, row_id="record_idx", cuts=cuts)
    more = []
    if coverage:
        held = truth.join(folds, "record_idx", "left").select("record_idx", _groups(F.col("_in"), test_fold, folded) if folded else _groups(F.lit(None).cast("int"), None, modes))
        expected = held.select("_g.*").groupBy(*_GROUP).agg(F.count("*").alias("expected"))
        if folded and "full_dataset" in modes:
            expected = expected.unionByName(truth.agg(F.count("*").alias("expected")).select(F.lit("full").alias("_kind"), F.lit(-1).alias("_fold"), "expected"))
        scores = scores.join(expected, list(_GROUP), "right").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        more = ["expected"]
    long = scores.select(*_GROUP, "n", *more, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("s")).select(*_GROUP, "n", *more, "s.*")
    labels = []
    if "test" in modes:
        labels.append(F.when((F.col("_kind") == "fold") & (F.col("_fold") == test_fold), F.lit("test")))
    if "per_fold" in modes:
        labels.append(F.when(F.col("_kind") == "fold", F.lit("per_fold")))
    labels += [F.when(F.col("_kind") == k, F.lit(m)) for k, m in (("train", "train_available"), ("full", "full_dataset")) if m in modes]
    long = long.withColumn("mode", F.explode(F.filter(F.array(*labels), lambda m: m.isNotNull())))
    return long.select("mode", F.when(F.col("mode") == "per_fold", F.col("_fold")).alias("fold"), "metric", "value", "n", *more)


def nested(scores: DataFrame) -> DataFrame:
    """One row: a map of metrics for each plain mode and a map of folds for per_fold."""
    plain = scores.where("mode != 'per_fold'").groupBy("mode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("values"))
    folds = scores.where("mode = 'per_fold'").groupBy("fold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("values"))
    folds = folds.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("fold_"), "fold").alias("k"), "values"))).alias("per_fold"))
    return plain.groupBy().pivot("mode", ["test", "train_available", "full_dataset"]).agg(F.first("values")).crossJoin(folds)
