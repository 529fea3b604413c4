"""Keys that tell the rows of a table of documents apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: str = "text") -> Column:
    """A hash of a row's text by which, with the doc_id, rows are told apart; null is not the empty text."""
    return F.xxhash64(F.col(text).cast("string"), F.col(text).isNull())


def without_rows(docs: DataFrame, listed: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose doc_id (null equals null) and text are in ``listed`` (doc_id, text_key)."""
    return _matched(docs, listed, text, doc_id, "left_anti")


def only_rows(docs: DataFrame, listed: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that ``without_rows`` leaves out."""
    return _matched(docs, listed, text, doc_id, "left_semi")


def _matched(docs: DataFrame, listed: DataFrame, text: str, doc_id: str, how: str) -> DataFrame:
    keyed = docs.withColumns({"_row_id": F.col(doc_id).cast("long"), "_row_text": text_key(text)})
    keys = listed.select(F.col("doc_id").alias("_a"), F.col("text_key").alias("_b")).distinct()
    same = keyed["_row_id"].eqNullSafe(keys["_a"]) & (keyed["_row_text"] == keys["_b"])
    return keyed.join(keys, same, how).select(*docs.columns)


def with_row_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row_key, doc_id, text): rows with one key are equal in both columns.

    The key is the doc_id where that is unique and not null, which one aggregate over the ids
    finds out; else a hash of doc_id and text, so that repeated ids with other texts stay apart.
    """
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    repeated = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text") if repeated else F.col("doc_id")
    return found.select(key.alias("row_key"), "doc_id", "text")
