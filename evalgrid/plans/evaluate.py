"""Whole runs: score a cell, aggregate its folds, and list them on the leaderboard."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions.columns import int_of, map_get
from evalgrid.models.features import with_one_hot
from evalgrid.models.linear import MODELS
from evalgrid.operators.aggregate import KEYS, aggregate, first_metadata, flatten_wide
from evalgrid.operators.folds import train_test, with_top_k
from evalgrid.operators.leaderboard import UNKNOWN
from evalgrid.operators.metrics import REGISTRY
from evalgrid.operators.modes import score_modes
from evalgrid.operators.scoring import check_coverage, check_target, check_variables
from evalgrid.sources.readers import catalog_rows, declared_variables, is_split, read_aggregates, read_cards, read_csv, read_dataset, read_score_docs
from evalgrid.sources.sinks import failure_document, upsert_csv, write_catalogs, write_document
from evalgrid.sources.staging import exists


def score_document(scores: list, metadata: dict, modes: Sequence[str]) -> dict:
    """Collected score rows as the nested document; every fold and metric once."""
    doc: dict = {"metadata": metadata}
    for mode in modes:
        mine = [r for r in scores if r["mode"] == mode]
        if mode == "per_fold":
            doc[mode] = {}
            for r in sorted(mine, key=lambda r: r["fold"]):
                doc[mode].setdefault(f"fold_{r['fold']}", {})[r["metric"]] = r["value"]
        elif mine:
            doc[mode] = {r["metric"]: r["value"] for r in mine}
    return doc


def evaluate(
    spark: SparkSession,
    prediction_path: str,
    metric_path: str,
    dataset_path: str,
    metrics: Sequence[str] | None = None,
    model_name: str | None = None,
    split: str | None = None,
    target: str | None = None,
    fold: int | None = None,
    modes: Sequence[str] | None = None,
    variables: Sequence[str] = (),
) -> Path | str:
    """Score predictions against a dataset folder and write the document; returns its path.

    The dataset may declare variables (``variables`` in its ``manifest.json``), the predictions too;
    both must then declare the same. Without ``variables`` of the caller these are the keys beside
    the sequence. Every mode and fold must have a prediction for each of its records.
    """
    names = list(REGISTRY) if metrics is None else list(metrics)
    if not exists(spark, prediction_path):
        return write_document(failure_document(f"Prediction file not found: {prediction_path}", names), metric_path, spark)
    if not target:
        raise ValueError("A target is needed.")
    tables = read_dataset(spark, dataset_path)
    folds = is_split(dataset_path)
    if folds and (split is None or fold is None):
        raise ValueError("A split and a fold are needed for a dataset with splits.")
    truth, predicted = tables["records"], spark.read.option("pathGlobFilter", "*.parquet").parquet(prediction_path)
    metadata: dict = {"dataset": Path(dataset_path).stem, **{k: v for k, v in (("model", model_name), ("split", split), ("target", target)) if v}}
    check_target(truth, predicted, target)
    declared, given = declared_variables(spark, dataset_path), declared_variables(spark, prediction_path)
    if given is not None:
        check_variables(declared or [], given)
    variables = list(variables) or declared or []
    if folds:
        membership = tables["fold_membership"].where(F.col("split") == split)
        ids = [r["fold"] for r in membership.select("fold").distinct().orderBy("fold").collect()]  # a row a fold
        modes = list(modes or ("test", "train_available", "per_fold"))
        meta = with_top_k(tables["fold_meta"]).where(F.col("split") == split)
        rows = score_modes(truth, predicted, membership, target, fold, names, modes, meta, variables, coverage=True).collect()  # a row for each mode, fold and metric
        metadata |= {"test_fold": fold, "test_folds": [fold], "train_available_folds": [i for i in ids if i != fold], "total_folds": len(ids)}
    else:
        modes = ["full_dataset"]
        rows = score_modes(truth, predicted, truth.select("record_idx", F.lit(0).alias("fold")), target, None, names, modes, None, variables, coverage=True).collect()
    check_coverage(rows)
    return write_document(score_document(rows, metadata, modes), metric_path, spark)


def long_scores(docs: DataFrame) -> DataFrame:
    """(path, metadata keys, mode, metric, value) of score documents."""
    parts = None
    for mode in ("test", "train_available", "full_dataset"):
        part = docs.select("path", "metadata", F.lit(mode).alias("mode"), F.explode(mode).alias("metric", "value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def aggregate_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for (mode, metric): mean and std over the fold documents that a glob finds."""
    return aggregate(long_scores(read_score_docs(spark, path)))


def aggregate_run(spark: SparkSession, path: str, output: str, fallback: dict | None = None) -> Path | str:
    """The aggregate document of the fold documents that a glob finds."""
    docs = read_score_docs(spark, path)
    rows = aggregate(long_scores(docs)).collect()
    first = first_metadata(docs.withColumn("_all", F.lit(0)), ["_all"]).collect()
    doc: dict = {"metadata": dict(first[0]["metadata"]) if first else dict(fallback or {})}
    for r in rows:
        block = doc.setdefault(r["mode"], {})
        block[r["metric"]] = r["mean"]
        if r["mode"] != "full_dataset":
            block[f"{r['metric']}_std"] = r["std"]
    return write_document(doc, output, spark)


def leaderboard_rows(spark: SparkSession, folder: str, game: str) -> DataFrame:
    """A wide row for each aggregate document of a folder, with its ``path``, the order of the documents."""
    docs = read_aggregates(spark, folder)
    keyed = docs.select(F.lit(game).alias("game"), *[map_get("metadata", k, F.lit(UNKNOWN)).alias(k) for k in KEYS[1:]], "path", "test", "train_available", "full_dataset")
    cells = None
    for mode in ("test", "train_available", "full_dataset"):
        part = keyed.select(*KEYS, "path", F.explode(mode).alias("name", "value")).withColumn("name", F.concat_ws("_", F.lit(mode), "name"))
        cells = part if cells is None else cells.unionByName(part)
    return cells.groupBy(*KEYS, "path").pivot("name").agg(F.first("value"))  # a value for each document and name


def publish(spark: SparkSession, folder: str, csv: str, game: str) -> Path | str:
    """Aggregate documents merged into the leaderboard file; of documents of one key the last by path stays."""
    return upsert_csv(spark, leaderboard_rows(spark, folder, game), csv, order="path")


def train_predict(records: DataFrame, membership: DataFrame, model: str, target: str, test_fold: int, **settings) -> DataFrame:
    """(sequence, target, split): predictions of a registered model, fitted on the training folds' one-hot sequences."""
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    rows = with_one_hot(train_test(records, membership, target, test_fold), unknown="zero")
    fitted = MODELS[model](rows.where("split = 'train'"), "features", "target", **settings)
    return rows.select("sequence", fitted.predict("features").alias(target), "split")


def train(spark: SparkSession, dataset_path: str, output: str, model: str, split: str, target: str, test_fold: int, settings: dict | None = None) -> str:
    """Fit a model on a dataset folder and write a prediction for each of its records."""
    tables = read_dataset(spark, dataset_path)
    membership = tables["fold_membership"].where(F.col("split") == split)
    train_predict(tables["records"], membership, model, target, test_fold, **(settings or {})).write.mode("overwrite").parquet(output)
    return output


def card_settings(spark: SparkSession, path: str, model: str) -> dict:
    """The hyper-parameters of a model card that the model has a setting for."""
    card = read_cards(spark, path).first()
    found = {k: json.loads(v) for k, v in (card["hyper_parameters"] if card else {}).items()}
    names = {"pls": {"n_components": "components", "components": "components"}, "ridge": {"alpha": "alpha"}}[model]
    return {names[k]: v for k, v in found.items() if k in names}


def datasets_list(spark: SparkSession, catalog: str, output: str, manifests: str | None = None) -> dict[str, int]:
    """The catalog documents from a CSV of datasets; returns their counts."""
    rows = read_csv(spark, catalog)
    listed = rows.select("name", "input_filename", *[F.split(c, r"\s+").alias(c) for c in ("splits", "targets", "kinds")])
    jobs = catalog_rows(listed).join(listed.select("name", "kinds"), "name")
    paths = {r["name"]: Path(manifests) / r["name"] / "manifest.lock" for r in rows.select("name").distinct().collect()} if manifests else None
    return write_catalogs(jobs, output, paths)


__all__ = ["aggregate_documents", "aggregate_run", "card_settings", "datasets_list", "evaluate", "flatten_wide", "int_of", "leaderboard_rows", "publish", "train", "train_predict"]
