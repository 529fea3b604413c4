"""Truth joined to predictions, with keys that the data decide and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evalgrid.functions.columns import named

SEQUENCE = "sequence"


def filled_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Those of the columns that have a value that is not null; one aggregate."""
    present = [n for n in names if n in df.columns]
    if not present:
        return set()
    row = df.agg(*[F.max(named(n).isNotNull()).alias(str(i)) for i, n in enumerate(present)]).first()
    return {n for i, n in enumerate(present) if row[i]}


def join_keys(truth: DataFrame, predicted: DataFrame, variables: Sequence[str] = ()) -> list[str]:
    """The sequence and the declared variables that both sides have with some value."""
    shared = [v for v in variables if v in truth.columns and v in predicted.columns]
    filled = filled_columns(truth, shared) & filled_columns(predicted, shared)
    return [SEQUENCE, *[v for v in shared if v in filled]]


def check_variables(truth: Sequence[str], predicted: Sequence[str]) -> None:
    if list(truth) != list(predicted):
        raise ValueError(f"Variables differ: {list(truth)} and {list(predicted)}.")


def scoring_frame(truth: DataFrame, predicted: DataFrame, target: str, keys: Sequence[str] = (SEQUENCE,), extra: Sequence[str] = ()) -> DataFrame:
    """Truth inner-joined to predictions: keys, the target, ``<target>_pred`` and columns of truth in ``extra``.

    Nulls match nothing and repeated keys multiply.
    """
    left = truth.select(*[named(c) for c in dict.fromkeys([*keys, *extra, target])])
    right = predicted.select(*[named(k) for k in keys], named(target).alias(f"{target}_pred"))
    return left.join(right, list(keys), "inner")


def missing_count(truth: DataFrame, joined: DataFrame) -> int:
    """Rows of truth less rows of the join: repeated keys can hide a gap."""
    return max(truth.count() - joined.count(), 0)


def missing_keys(truth: DataFrame, predicted: DataFrame, keys: Sequence[str] = (SEQUENCE,)) -> DataFrame:
    """Rows of truth without any prediction."""
    return truth.join(predicted.select(*[named(k) for k in keys]), list(keys), "left_anti")


def check_target(truth: DataFrame, predicted: DataFrame, target: str) -> None:
    for side, df in (("Truth", truth), ("Predictions", predicted)):
        if not isinstance(df, DataFrame):
            raise TypeError(f"{side} must be a DataFrame, not {type(df).__name__}.")
        if target not in df.columns:
            raise ValueError(f"{side} lack the target {target}.")


def check_coverage(scores: Sequence[Row]) -> None:
    """ValueError for the first group of collected scores with fewer rows than its truth: repeated keys can hide a gap within a group."""
    for r in scores:
        if r["expected"] > r["n"]:
            raise ValueError(f"Missing {r['expected'] - r['n']} prediction(s).")


def checked_scoring_frame(truth: DataFrame, predicted: DataFrame, target: str, variables: Sequence[str] = (), strict: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """The scoring frame, or ValueError if predictions are missing (``strict``: for any single row)."""
    check_target(truth, predicted, target)
    keys = join_keys(truth, predicted, variables)
    joined = scoring_frame(truth, predicted, target, keys, extra)
    missing = missing_keys(truth, predicted, keys).count() if strict else missing_count(truth, joined)
    if missing:
        raise ValueError(f"Missing {missing} prediction(s).")
    return joined


def unmatched_predictions(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions whose sequence is no record's."""
    return predictions.join(records.select(SEQUENCE), SEQUENCE, "left_anti")


def predictions_delta(records: DataFrame, predictions: DataFrame, target: str, allow_extra: bool = False) -> DataFrame:
    """Records that have a prediction, with the predicted target in place of their own; other columns stay."""
    if not allow_extra:
        extra = unmatched_predictions(records, predictions).count()
        if extra:
            raise ValueError(f"{extra} prediction(s) match no record.")
    kept = [named(c) for c in records.columns if c != target]
    return records.select(*kept).join(predictions.select(SEQUENCE, named(target)), SEQUENCE, "inner")
