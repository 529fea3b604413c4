"""Substring dedup: difference-cover anchors find windows of words that repeat anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import with_row_key
from .scratch import Scratch
from .text import Windows, Words, byte_table, mix, signed, slices, starts

_SPACE = byte_table("space")
# Perfect difference sets, by period.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}


def cover(window: int) -> tuple[int, np.ndarray, int]:
    """Period, flags of the cover's positions, and words of an anchor.

    For any positions i and j some shift below the period takes both to the cover, so two equal
    windows have equal anchors of ``window - period + 1`` words at one shift. The longest period
    that leaves anchors of at least two fifths of the window.
    """
    period = max((p for p in COVERS if window - p + 1 >= 0.4 * window), default=1)
    flags = np.zeros(period, bool)
    flags[list(COVERS.get(period, (0,)))] = True
    return period, flags, window - period + 1


def _words(part: pa.RecordBatch, text: int) -> tuple[Words, np.ndarray]:
    words = Words(part.column(text), _SPACE, lower=False)
    return words, words.hashes()


def _anchors(window: int):
    period, flags, size = cover(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, hashes = _words(part, 1)
                at, text = starts(words.first, size)
                place = at - words.first[:-1][text]
                keep = flags[place % period] & (words.counts[text] >= window)
                at, text, place = at[keep], text[keep], place[keep]
                found = signed(Windows(hashes).at(at, size))
                keys = part.column(0).to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(keys, pa.int64()), pa.array(place.astype(np.int32))], ["anchor", "row_key", "place"])

    return run


def _windows(window: int):
    """Windows that hold an anchor seen elsewhere at one shift; two hashes tell 96 bits of each."""
    period = cover(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, hashes = _words(part, 1)
                lists = part.column(2)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                # Marks +1 and -1 at the ends of each run of starts that an anchor allows.
                low = words.first[row] + np.maximum(place - period + 1, 0)
                high = np.minimum(words.first[row] + place, words.first[row + 1] - window)
                ok = high >= low
                marks = np.zeros(words.start.size + 2, np.int64)
                np.add.at(marks, low[ok], 1)
                np.add.at(marks, high[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(marks)[: words.start.size] > 0)
                text = np.searchsorted(words.first, at, side="right") - 1
                first = signed(Windows(hashes).at(at, window))
                second = Windows(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)), 0x8CB92BA72F3D8DD7).at(at, window)
                keys = part.column(0).to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(keys, pa.int64()), pa.array((at - words.first[:-1][text]).astype(np.int32))],
                    ["w1", "w2", "row_key", "place"],
                )

    return run


def _cutter(window: int):
    """Texts without the words that the listed windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), _SPACE, lower=False)
                lists = part.column(2)
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), length)
                at = words.first[row] + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                marks = np.zeros(words.start.size + 1, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + window, -1)
                kept = np.cumsum(marks)[: words.start.size] == 0
                left, start, end = words.joined(kept)
                first = np.concatenate(([0], np.cumsum(kept)))[words.first]
                some = np.diff(first) > 0
                cuts = [(0, 0)] * part.num_rows
                for i, a, b in zip(np.flatnonzero(some).tolist(), start[first[:-1][some]].tolist(), end[first[1:][some] - 1].tolist(), strict=True):
                    cuts[i] = (a, b)
                texts = pa.array([left[a:b].decode() for a, b in cuts], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), texts, pa.array(words.counts.astype(np.int64)), pa.array(words.counts - np.diff(first), pa.int64())],
                    ["doc_id", "kept_text", "n_words", "n_removed"],
                )

    return run


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed) for every row.

    Words are runs of non-blank bytes, unchanged. A word goes if some window of ``window`` words
    that covers it also starts anywhere else, in the same text too; windows are judged on the
    input. Kept words are joined by one space. Null, empty and short texts lose nothing (null
    counts as no words); a repeated row is another text, so both lose their windows; an empty table
    gives no rows; other columns are not read.

    Anchors at the cover's positions are counted over all documents; those that repeat name the
    windows worth hashing whole, and these are counted in turn. Counts are combined before the
    shuffle, and the repeated hashes are a written table of unique keys, so the joins that go back
    to the rows broadcast it when small and otherwise split a hash that very many rows share.
    """
    scratch = Scratch(spark, "substring")
    rows = with_row_key(docs, text, doc_id)
    anchors = rows.select("row_key", "text").mapInArrow(_anchors(window), "anchor long, row_key long, place int")
    seen = scratch.write(anchors.groupBy("anchor").count().where("count > 1").select("anchor"))
    spots = scratch.write(anchors.join(seen, "anchor").groupBy("row_key").agg(F.collect_list("place").alias("places")))
    scratch.drop(seen)
    windows = scratch.write(rows.join(spots, "row_key").select("row_key", "text", "places").mapInArrow(_windows(window), "w1 long, w2 int, row_key long, place int"))
    seen = scratch.write(windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"))
    covered = scratch.write(windows.join(seen, ["w1", "w2"]).groupBy("row_key").agg(F.collect_set("place").alias("places")))
    scratch.drop(windows, seen, spots)
    final = rows.join(covered, "row_key", "left").select("doc_id", "text", "places")
    return final.mapInArrow(_cutter(window), "doc_id long, kept_text string, n_words long, n_removed long")
