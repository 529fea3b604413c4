from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalgrid.operators.folds import fold_indices, membership_from_masks, train_test, with_top_k
from evalgrid.operators.metrics import REGISTRY, average_rank, global_average_rank, known_metrics, metric, score
from evalgrid.operators.modes import preconditions, score_modes
from evalgrid.operators.scoring import check_variables, checked_scoring_frame, join_keys, missing_keys, predictions_delta, scoring_frame

LETTERS = "GHIKLMNPQR"
SEQUENCES = [f"ACDEF{c}" for c in LETTERS]


def records(spark, values, name="DMS Score"):
    rows = [(i, s, v) for i, (s, v) in enumerate(zip(SEQUENCES, values, strict=False))]
    return spark.createDataFrame(rows, f"record_idx int, sequence string, `{name}` double")


def one(spark, y, yhat, metrics=("spearman",), top_k=None):
    rows = [(i, a, b, top_k) for i, (a, b) in enumerate(zip(y, yhat, strict=True))]
    df = spark.createDataFrame(rows, "row_id int, y double, yhat double, top_k int").withColumn("g", F.lit(1))
    return score(df, list(metrics), ["g"]).first()


def test_frame_has_prediction_column(spark):
    truth, pred = records(spark, range_(1.0)), records(spark, range_(1.1))
    joined = checked_scoring_frame(truth, pred, "DMS Score")
    assert set(joined.columns) == {"sequence", "DMS Score", "DMS Score_pred"}
    assert joined.count() == 10


def range_(start):
    return [start + i for i in range(10)]


def test_missing_predictions_are_counted(spark):
    truth, pred = records(spark, range_(1.0)), records(spark, [1.1])
    with pytest.raises(ValueError, match=r"Missing 9 prediction\(s\)\."):
        checked_scoring_frame(truth, pred, "DMS Score")


def test_bad_arguments(spark):
    truth = records(spark, range_(1.0))
    with pytest.raises(TypeError):
        checked_scoring_frame([1], truth, "DMS Score")
    with pytest.raises(ValueError, match="lack the target"):
        checked_scoring_frame(truth, truth, "other")
    with pytest.raises(ValueError, match="Variables differ"):
        check_variables(["a"], ["a", "b"])


def test_duplicates_can_hide_a_gap_unless_strict(spark):
    truth = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sequence string, t double")
    pred = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "sequence string, t double")
    assert checked_scoring_frame(truth, pred, "t").count() == 2
    with pytest.raises(ValueError, match="Missing 1"):
        checked_scoring_frame(truth, pred, "t", strict=True)
    assert [r["sequence"] for r in missing_keys(truth, pred).collect()] == ["b"]


def test_keys_drop_absent_and_all_null_variables(spark):
    truth = spark.createDataFrame([("a", 1.0, None, 1), ("b", None, None, 2)], "sequence string, temp double, gone double, t int")
    pred = truth.drop("missing")
    assert join_keys(truth, pred, ["temp", "gone", "absent"]) == ["sequence", "temp"]
    assert scoring_frame(truth, pred, "t", ["sequence", "temp"]).count() == 1  # null matches nothing


def test_predictions_delta(spark):
    truth = records(spark, range_(1.0))
    some = spark.createDataFrame([(SEQUENCES[0], 5.0), ("ZZZ", 1.0)], "sequence string, `DMS Score` double")
    with pytest.raises(ValueError, match="match no record"):
        predictions_delta(truth, some, "DMS Score")
    assert predictions_delta(truth, some, "DMS Score", allow_extra=True).collect()[0]["DMS Score"] == 5.0


@pytest.mark.parametrize(
    ("y", "yhat", "rho"),
    [
        ([1.0, 2.0, 3.0], [2.0, 4.0, 9.0], 1.0),
        ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0], -1.0),
        ([1.0, 1.0, 2.0, 3.0], [1.0, 2.0, 2.0, 4.0], 0.8333333333),
        ([1.0, 2.0, 3.0], [5.0, 5.0, 5.0], math.nan),
        ([1.0], [1.0], math.nan),
        ([1.0, 2.0, 3.0], [1.0, math.nan, 3.0], math.nan),
        ([1.0, 2.0, 3.0], [1.0, None, 3.0], math.nan),
    ],
)
def test_spearman(spark, y, yhat, rho):
    found = one(spark, y, yhat)["spearman"]
    assert math.isnan(found) if math.isnan(rho) else found == pytest.approx(rho)


FITNESS = [0.1 * (i + 1) for i in range(10)]


@pytest.mark.parametrize(
    ("yhat", "k", "expected"),
    [
        (FITNESS, 3, 1.0),
        (FITNESS[::-1], 3, 0.0),
        ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.95, 0.75, 0.9, 1.0], 3, 2 / 3),
        (FITNESS, None, None),
        (FITNESS, 0, None),
        (FITNESS, -2, None),
        ([math.nan] + FITNESS[1:], 1, 0.0),
    ],
)
def test_recovery(spark, yhat, k, expected):
    found = one(spark, FITNESS, yhat, ["recovery"], k)["recovery"]
    assert found is None if expected is None else found == pytest.approx(expected)


def test_recovery_wants_enough_rows(spark):
    with pytest.raises(PySparkException, match=r"top_k \(10\) is larger than the number of samples \(2\)\."):
        one(spark, [1.0, 2.0], [1.0, 2.0], ["recovery"], 10)


def test_ties_at_the_cut_go_to_the_higher_row(spark):
    assert one(spark, [1.0, 1.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0], ["recovery"], 2)["recovery"] == 1.0


def test_average_ranks_both_ways(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 2.0, 3.0, 3.0, 3.0])], "id int, v double")
    expected = [1.5, 1.5, 3.0, 5.0, 5.0, 5.0]
    assert [r["rank"] for r in average_rank(df, "v").orderBy("id").collect()] == expected
    assert [r["rank"] for r in global_average_rank(df, "v").orderBy("id").collect()] == expected


def test_registry():
    with pytest.warns(UserWarning, match="nothing"):
        assert known_metrics(["spearman", "nothing"]) == ["spearman"]
    metric("metric_rows")(lambda: F.count("*"))
    assert REGISTRY.pop("rows")


def overlapping(spark):
    truth = spark.createDataFrame([(i, f"SEQ{i:03}", v) for i, v in enumerate(FITNESS)], "record_idx int, sequence string, fitness double")
    masks = spark.createDataFrame([("cv", f, 0, [True] * 10) for f in range(3)], "split string, fold int, assay_idx int, mask array<boolean>")
    meta = spark.createDataFrame([("cv", 0, None), ("cv", 1, {"other": "x"}), ("cv", 2, {"top_k": "3.0"})], "split string, fold int, metadata map<string,string>")
    return truth, membership_from_masks(masks), with_top_k(meta)


def test_overlapping_folds_multiply(spark):
    truth, membership, top_k = overlapping(spark)
    assert not preconditions(truth, truth, membership, ["sequence"])
    rows = score_modes(truth, truth, membership, "fitness", 2, ["spearman", "recovery"], fold_meta=top_k).collect()
    found = {(r["mode"], r["fold"], r["metric"]): (r["value"], r["n"]) for r in rows}
    assert found["train_available", None, "spearman"] == (pytest.approx(1.0), 40)
    assert found["train_available", None, "recovery"][0] is None
    assert found["test", None, "recovery"][0] == 1.0
    assert [found["per_fold", f, "recovery"][0] for f in range(3)] == [None, None, 1.0]


def test_plans_agree_on_clean_folds(spark):
    truth = records(spark, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0], "t")
    pred = records(spark, [2.0, 7.0, 1.0, 8.0, 2.0, 8.0, 1.0, 8.0, 2.0, 8.0], "t")
    membership = spark.createDataFrame([(i % 2, i) for i in range(10)], "fold int, record_idx int")
    modes = ("test", "train_available", "per_fold", "full_dataset", "unheard-of")
    runs = [sorted((r["mode"], str(r["fold"]), r["metric"], round(r["value"], 9)) for r in score_modes(truth, pred, membership, "t", 0, ["spearman", "pearson"], modes, plan=p).collect()) for p in ("fast", "compat", "auto")]
    assert runs[0] == runs[1] == runs[2]
    assert len(runs[0]) == 2 * (1 + 1 + 2 + 1)


def test_single_fold_has_no_training_rows(spark):
    truth = records(spark, range_(1.0), "t")
    membership = spark.createDataFrame([(0, i) for i in range(10)], "fold int, record_idx int")
    modes = {r["mode"] for r in score_modes(truth, truth, membership, "t", 0, ["spearman"]).collect()}
    assert modes == {"test", "per_fold"}


def test_train_test_keeps_nulls_and_drops_nan(spark):
    truth = spark.createDataFrame([(0, "a", 1.0), (1, "b", math.nan), (2, "c", None)], "record_idx int, sequence string, t double")
    membership = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "fold int, record_idx int")
    rows = {(r["sequence"], r["split"]) for r in train_test(truth, membership, "t", 0).collect()}
    assert rows == {("a", "test"), ("c", "train")}


def test_fold_indices(spark):
    membership = spark.createDataFrame([("s", 1, 0), ("s", 0, 1), ("s", 0, 2)], "split string, fold int, record_idx int")
    row = fold_indices(membership).first()
    assert (row["folds"], row["total_folds"]) == ([0, 1], 2)
