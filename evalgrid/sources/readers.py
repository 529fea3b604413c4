"""Readers: benchmark tables, metric documents, catalogs, cards and archives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions.columns import dataset_label, names_of, overview, path_segment

from .staging import exists

RECORDS, MEMBERSHIP, FOLDS, PREDICTIONS = "records", "fold_membership", "fold_meta", "predictions"
SCORE_DOC = (
    "metadata map<string,string>, test map<string,double>, train_available map<string,double>, full_dataset map<string,double>, "
    "per_fold map<string,map<string,double>>"
)
CATALOG = "name string, input_filename string, split string, target string"


def file_path() -> Column:
    """The path of a row's file, its characters as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a dataset folder: records, and for ``.splits`` folders fold_membership and fold_meta.

    Layout: ``<path>/records`` (record_idx, sequence, variables, targets), ``<path>/fold_membership``
    (split, fold, assay_idx, record_idx), ``<path>/fold_meta`` (split, fold, metadata map), all Parquet.
    """
    names = [RECORDS, MEMBERSHIP, FOLDS] if is_split(path) else [RECORDS]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def declared_variables(spark: SparkSession, path: str) -> list[str] | None:
    """The names of the ``variables`` (objects with a name) that a folder's ``manifest.json`` declares; None without one."""
    file = f"{path.rstrip('/')}/manifest.json"
    if not exists(spark, file):
        return None
    found = spark.read.schema("variables array<struct<name: string>>").option("multiLine", True).json(file)
    return list(found.select(F.coalesce(names_of("variables"), F.array().cast("array<string>"))).first()[0])


def read_fold_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all ``fold*/predictions.json`` (one JSON array a file) under a folder, with ``path`` and ``fold``."""
    df = spark.read.option("multiLine", True).json(f"{folder.rstrip('/')}/fold*/predictions.json")
    file = file_path()
    return df.select("*", file.alias("path"), F.regexp_extract(file, r"/fold_?(\d+)/predictions\.json$", 1).try_cast("int").alias("fold"))


def read_json_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that holds one array of objects, as rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def is_split(path: str) -> bool:
    return ".splits" in path.rstrip("/").rsplit("/", 1)[-1]


def read_predictions(spark: SparkSession, path: str, model: str | None = None, split: str | None = None, fold: int | None = None) -> DataFrame:
    """Predictions partitioned by model, split and fold; the filters prune partitions."""
    df = spark.read.parquet(path)
    for name, value in (("model", model), ("split", split), ("fold", fold)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def read_score_docs(spark: SparkSession, path: str) -> DataFrame:
    """Metric documents (JSON, one a file; bare NaN allowed) with their path and fold."""
    df = spark.read.schema(SCORE_DOC).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    file = file_path()
    return df.select("*", file.alias("path"), F.regexp_extract(file, r"fold_?(\d+)[^/]*$", 1).try_cast("int").alias("fold_of_file"))


def read_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """``*_aggregated.json`` documents with their path, which orders them; those without metadata are left out."""
    df = spark.read.schema(SCORE_DOC).option("multiLine", True).option("allowNonNumericNumbers", True).option("pathGlobFilter", "*_aggregated.json").json(folder)
    return df.select("*", file_path().alias("path")).where(F.col("metadata").isNotNull())


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header: typed by ``schema``, else all strings; blank lines are skipped."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``{"datasets": [...]}`` as rows."""
    df = spark.read.schema(f"datasets array<struct<{CATALOG.replace(' string', ': string')}>>").option("multiLine", True).json(path)
    return df.select(F.inline("datasets"))


def read_slugs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of slugs, or an object with one, as rows."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.regexp_extract("value", r"(?s)(\[.*\])", 1), "array<string>")).alias("slug"))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Markdown with front matter: slug, name, tags, hyper_parameters (JSON texts), overview, content; broken cards are left out."""
    text = spark.read.text(path, wholetext=True).select(file_path().alias("path"), "value")
    parts = text.select("path", F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$", 1).alias("front"), F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$", 2).alias("content"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                try:
                    front = yaml.safe_load(r.front)
                except yaml.YAMLError:
                    continue
                if isinstance(front, dict):
                    params = {str(k): json.dumps(v) for k, v in (front.get("hyper_parameters") or {}).items()}
                    rows.append((r.path, front.get("name"), [str(t) for t in front.get("tags") or []], params, r.content))
            yield pd.DataFrame(rows, columns=["path", "name", "tags", "hyper_parameters", "content"])

    cards = parts.mapInPandas(parse, "path string, name string, tags array<string>, hyper_parameters map<string,string>, content string")
    return cards.select(path_segment("path", -2).alias("slug"), "name", "tags", "hyper_parameters", overview("content").alias("overview"), "content")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """TOML files as (slug, data JSON); those that can't be parsed are left out."""
    text = spark.read.text(path, wholetext=True).select(file_path().alias("path"), "value")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.path, json.dumps(tomllib.loads(r.value), default=str)))
                except tomllib.TOMLDecodeError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "data"])

    return text.mapInPandas(parse, "path string, data string").select(dataset_label("path").alias("slug"), F.parse_json("data").alias("data"))


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(slug, key, value, nested): top-level entries of each manifest; nested ones are sections, others tags."""
    entries = F.explode(F.map_entries(F.from_json(F.to_json("data"), "map<string,string>"))).alias("e")
    nested = F.rlike(F.col("e.value"), F.lit(r"^\s*[\[{]"))
    return manifests.select("slug", entries).select("slug", F.col("e.key").alias("key"), F.col("e.value").alias("value"), nested.alias("nested"))


def read_archive_members(spark: SparkSession, folder: str, members: tuple[str, ...], pattern: str = "*.splits.pgdata") -> DataFrame:
    """(path, content): a member of a zip, or of a zip within it when several names are given; archives without it are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                data = bytes(r.content)
                try:
                    for name in members:
                        data = zipfile.ZipFile(io.BytesIO(data)).read(name)
                except (zipfile.BadZipFile, KeyError):
                    continue
                rows.append((r.path, data))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.mapInPandas(unpack, "path string, content binary")


def read_config(*paths: str) -> dict:
    """Driver-side YAML and JSON files merged, later ones first."""
    out: dict = {}
    for path in paths:
        with open(path) as f:
            if path.endswith(".json"):
                out |= json.load(f)
            else:
                import yaml

                out |= yaml.safe_load(f) or {}
    return out


def job_matrix(datasets: DataFrame, models: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Every dataset with every model (and fold): the cells of a benchmark, a few rows each."""
    cells = datasets.crossJoin(F.broadcast(models))
    return cells if folds is None else cells.crossJoin(F.broadcast(folds))


def catalog_rows(splits: DataFrame) -> DataFrame:
    """(name, input_filename, split, target) from (name, input_filename, splits array, targets array)."""
    return splits.select("name", "input_filename", F.explode("splits").alias("split"), "targets").select("name", "input_filename", "split", F.explode("targets").alias("target"))
