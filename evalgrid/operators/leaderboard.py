"""The leaderboard: keyed upsert, filters, sorting and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.columns import contains_text, named, parse_float

from .aggregate import KEYS

UNKNOWN = "unknown"


def concat_strict(*frames: DataFrame) -> DataFrame:
    """All rows; ValueError unless the schemas are equal."""
    out = frames[0]
    for df in frames[1:]:
        if df.dtypes != frames[0].dtypes:
            raise ValueError(f"schemas differ: {frames[0].dtypes} and {df.dtypes}")
        out = out.union(df)
    return out


_WIDTH = {"boolean": 0, "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def _common(a: str, b: str) -> str:
    return a if a == b else (max(a, b, key=_WIDTH.__getitem__) if a in _WIDTH and b in _WIDTH else "string")


def concat_relaxed(*frames: DataFrame, diagonal: bool = False) -> DataFrame:
    """All rows by name, columns cast to their common type; numbers and text meet as text.

    ``diagonal``: columns that a frame lacks are null; else they are an error.
    """
    kinds: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds[name] = _common(kinds.get(name, kind), kind)
    out = None
    for df in frames:
        lacking = [n for n in kinds if n not in df.columns]
        if lacking and not diagonal:
            raise ValueError(f"columns missing: {lacking}")
        part = df.select(*[(named(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
        out = part if out is None else out.union(part)
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*[named(k) for k in keys]).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, order: str | None = None) -> DataFrame:
    """Existing and new rows, the last of each key: new before existing, then the highest ``order``.

    Metric columns of either side stay; where a side lacks one its rows have null.
    """
    both = concat_relaxed(existing.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1)), diagonal=True)
    last = [F.col("_new").desc(), *([named(order).desc()] if order else [])]
    return latest_per_key(both, keys, *last).drop("_new")


def filled_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumns({k: F.coalesce(named(k), F.lit(UNKNOWN)) for k in keys})


def search(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows in which every column holds its filter text, in any case; empty filters hold always."""
    for name, text in filters.items():
        df = df.where(contains_text(named(name), text))
    return df


def search_any(df: DataFrame, query: str, *columns: Column) -> DataFrame:
    """Rows in which some of the columns holds the text: a name, or tags joined."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(contains_text(c, query), F.lit(False))
    return df.where(found) if query else df


def first_row(df: DataFrame, order: str, what: str) -> DataFrame:
    """The row of the smallest ``order``; an error that names ``what`` when there is none (one row is read)."""
    found = df.orderBy(order).limit(1)
    if not found.head(1):
        raise ValueError(f"no {what}")
    return found


def lookup(df: DataFrame, slug: str, column: str = "slug") -> DataFrame:
    """The row of a slug."""
    return df.where(named(column) == slug).limit(1)


def catalog_filter(df: DataFrame, split: str | None = None, tag: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Catalog rows of a split, with a tag, and of one of some names; what is not given holds always."""
    if split is not None:
        df = df.where(F.col("split") == split)
    if tag is not None:
        df = df.where(F.array_contains("tags", tag))
    return df.where(F.col("name").isin(*names)) if names else df


def catalog_counts(df: DataFrame, by: str = "split", name: str = "name") -> DataFrame:
    """(by, jobs, datasets): catalog rows and distinct names of each value."""
    return df.groupBy(by).agg(F.count("*").alias("jobs"), F.countDistinct(name).alias("datasets"))


def sorted_rows(df: DataFrame, column: str | None, direction: str | None, tie: str, numeric: bool = False) -> DataFrame:
    """Rows in the order of a column, as number or as collated text; ties by a unique column."""
    if column is None or direction is None:
        return df.orderBy(tie)
    key = parse_float(named(column)) if numeric else F.collate(named(column), "UNICODE")
    return df.orderBy(key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last(), tie)


def page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    """A page of rows in total order, from 1."""
    return df.offset((max(number, 1) - 1) * size).limit(size)


@dataclass(frozen=True)
class View:
    """State of a table: sorted column and direction, filters, page."""

    column: str | None = None
    direction: str | None = None
    filters: tuple[tuple[str, str], ...] = ()
    page: int = 1

    def toggle(self, column: str) -> View:
        """Ascending, descending, unsorted, and to the first page."""
        if column != self.column:
            return View(column, "asc", self.filters)
        return View(column, "desc", self.filters) if self.direction == "asc" else View(None, None, self.filters)

    def with_filter(self, column: str, text: str) -> View:
        kept = tuple((c, t) for c, t in self.filters if c != column)
        return View(self.column, self.direction, (*kept, (column, text)) if text else kept)

    def turn(self, to: int, pages: int) -> View:
        return View(self.column, self.direction, self.filters, min(max(to, 1), max(pages, 1)))


def leaderboard(df: DataFrame, view: View, tie: str, numeric: Sequence[str] = (), size: int = 10) -> DataFrame:
    """The rows that a view shows."""
    rows = sorted_rows(search(df, dict(view.filters)), view.column, view.direction, tie, view.column in numeric)
    return page(rows, view.page, size)
