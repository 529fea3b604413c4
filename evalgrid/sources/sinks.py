"""Sinks: score documents, leaderboard CSV, and dataset folders."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions.columns import named
from evalgrid.operators.aggregate import KEYS
from evalgrid.operators.leaderboard import upsert

from .readers import read_csv
from .staging import exists, move_single_part, write_text


def write_document(doc: dict, path: str | Path, spark: SparkSession | None = None) -> Path | str:
    """A small JSON document, null and NaN kept apart; folders are made.

    With ``spark`` on the path's own file system, else on the driver's.
    """
    if spark is not None:
        return _local(write_text(spark, str(path), json.dumps(doc, indent=2)))
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(doc, indent=2))
    return path


def _local(path: str) -> Path | str:
    """A Path where the file system is the driver's own."""
    return path if ":/" in path else Path(path)


def failure_document(message: str, metrics: list[str]) -> dict:
    return {"error": message, "status": "failed", **dict.fromkeys(metrics)}


def write_dataset(path: str, records: DataFrame, membership: DataFrame | None = None, fold_meta: DataFrame | None = None) -> None:
    for name, df in (("records", records), ("fold_membership", membership), ("fold_meta", fold_meta)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_predictions(df: DataFrame, path: str) -> None:
    """Parquet partitioned by model, split and fold; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "split", "fold").parquet(path)


def combine_predictions(frames: list[DataFrame], path: str) -> None:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    out.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str | Path) -> Path | str:
    """One CSV file with a header, for tables of a leaderboard's size.

    Written beside its place on the file system of ``path``, then moved there.
    """
    path = str(path)
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(aside)
    move_single_part(df.sparkSession, aside, path)
    return _local(path)


def upsert_csv(spark: SparkSession, new: DataFrame, path: str | Path, keys: tuple[str, ...] = KEYS, order: str | None = None) -> Path | str:
    """New rows merged into a leaderboard file by its keys; the file may not exist yet.

    Of new rows of one key the one of the highest ``order`` stays; that column is not written.
    """
    path = str(path)
    if not exists(spark, path):
        merged = upsert(new.limit(0), new, keys, order)
    else:
        kinds = dict(new.dtypes)
        existing = read_csv(spark, path)
        existing = existing.select(*[named(c) if c in keys else named(c).try_cast(kinds.get(c, "double")).alias(c) for c in existing.columns])
        if order:
            existing = existing.withColumn(order, F.lit(None).cast(kinds[order]))
        merged = upsert(existing, new, keys, order)
    return write_csv(merged.drop(order) if order else merged, path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """A table of any size as a folder of CSV files with headers, as models are trained from."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_catalogs(jobs: DataFrame, folder: str | Path, manifests: Mapping[str, Path] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    """The catalog documents of a site: ``datasets-list.json`` and ``<kind>/datasets.json`` for each kind of benchmark.

    ``jobs``: (name, input_filename, split, target, kinds array), a row a job. Manifests that
    exist are copied to ``static/datasets/<name>.lock``. Returns the counts of datasets, splits and targets.
    """
    rows = jobs.orderBy("name", "split", "target").collect()  # a catalog: a row a job
    names = sorted({r["name"] for r in rows})
    write_document({"datasets": names}, f"{folder}/datasets-list.json", spark)
    for kind in sorted({k for r in rows for k in r["kinds"]}):
        mine = [{c: r[c] for c in ("name", "input_filename", "split", "target")} for r in rows if kind in r["kinds"]]
        write_document({"datasets": mine}, f"{folder}/{kind}/datasets.json", spark)
    for name, manifest in (manifests or {}).items():
        if Path(manifest).exists():
            target = Path(folder) / "static" / "datasets" / f"{name}.lock"
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(manifest, target)
    return {"datasets": len(names), "splits": len({(r["name"], r["split"]) for r in rows}), "targets": len({(r["name"], r["target"]) for r in rows})}

