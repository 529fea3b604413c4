"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import text_key
from .scratch import Scratch
from .text import Windows, Words, byte_table, signed, slices, starts

#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Bits of a token filter: 16 a token, between these powers of two. The largest is 16 MB.
FILTER_BITS = (16, 27)
#: Prefix tokens in one Arrow batch.
HITS = 4096
_ALNUM = byte_table("alnum")


def _item_windows(size: int):
    """Windows of each item as text, and their shingles' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), _ALNUM, lower=True)
                joined, start, end = words.joined()
                hashes, first, counts = Windows(words.hashes()), words.first, words.counts
                items, texts, sizes, tokens = [], [], [], []
                ids = part.column(0).to_pylist()
                for i in np.flatnonzero(counts).tolist():
                    n = min(size, int(counts[i]))
                    k = min(SHINGLE, n)
                    for a in range(first[i], first[i + 1] - n + 1):
                        items.append(ids[i])
                        texts.append(joined[start[a] : end[a + n - 1]].decode())
                        sizes.append(n)
                        tokens.append(signed(hashes.at(np.arange(a, a + n - k + 1), k)).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "window", "size", "tokens"])

    return run


def token_filter(tokens: DataFrame, column: str) -> np.ndarray:
    """Bits set for the tokens, a power of two of them: a fixed bound for what is broadcast.

    More tokens than the largest filter holds make it let more through, never less.
    """
    n = tokens.count()
    log = min(max(FILTER_BITS[0], int(16 * max(n, 1)).bit_length()), FILTER_BITS[1])
    bit = F.pmod(F.col(column), F.lit(1 << log))
    groups = tokens.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(cast(pmod({column}, {1 << log}L) % 32768 as int))").alias("bits"))
    out = np.zeros(1 << (log - 3), np.uint8)
    for row in groups.collect():  # at most 2**(log - 15) rows of 4 KB
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[row["bucket"] << 12 : (row["bucket"] << 12) + bits.size] = bits
    return out


def passes_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(bits.size * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_tokens(shared, shingles: list[int]):
    """How often each token that passes the filter occurs, summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(0), _ALNUM, lower=True)
                hashes = Windows(words.hashes())
                for k in shingles:
                    found = hashes.at(starts(words.first, k)[0], k)
                    token, n = np.unique(found[passes_filter(shared.value, found)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def _find_tokens(shared, shingles: list[int], size: int):
    """Each row's key and word count (no token), and a row for each prefix token with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), _ALNUM, lower=True)
                hashes = Windows(words.hashes())
                at, token, text = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for k in shingles:
                    begin, row = starts(words.first, k)
                    found = hashes.at(begin, k)
                    hit = np.flatnonzero(passes_filter(shared.value, found))
                    at.append(begin[hit])
                    token.append(found[hit])
                    text.append(row[hit])
                at, token, text = np.concatenate(at), np.concatenate(token), np.concatenate(text)
                keys, n = part.column(0).to_numpy(), part.num_rows
                none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *part.columns[2:], pa.array(words.counts.astype(np.int64)), *none], _FOUND)
                if not at.size:
                    continue
                joined, start, end = words.joined()
                low = np.maximum(words.first[text], at - size + 1)
                high = np.minimum(words.first[text + 1], at + size)
                for i in range(0, at.size, HITS):
                    now = slice(i, i + HITS)
                    around = [joined[a:b].decode() for a, b in zip(start[low[now]].tolist(), end[high[now] - 1].tolist(), strict=True)]
                    place, lead = (at - words.first[text])[now], (at - low)[now]
                    none = [pa.nulls(len(around), pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(keys[text[now]]), *none, pa.array(signed(token[now])), pa.array(lead.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(around, pa.string())], _FOUND)

    return run


_FOUND = ["row_key", "doc_id", "text_key", "n_words", "token", "lead", "place", "around"]


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, n_words, hit, item_ids) for every row of ``docs``; ``text_key`` is that of rows.py.

    ``hit``: [begin, end) runs of words inside occurrences of any item window, ascending and
    disjoint; ``item_ids``: the distinct items with a window there, as strings in order. Words are
    runs of letters, digits and non-ASCII characters, A-Z lower-cased; a window is ``window``
    consecutive words, or all words of a shorter item. Null and empty texts have no words; items
    without words match nothing; an item with a null id hits words but is not listed; repeated
    rows of documents stay, repeated items count once. An empty table on the left gives no rows,
    on the right no hits.

    Shingles of the windows are counted over all documents; a window's rarest shingle is the one
    token it has to share with a text (a window whose rarest shingle never occurs is left out). Documents
    send the words around such tokens only, chosen by a filter of bounded size; the join on the
    token then checks position and length bounds and all the words.
    """
    scratch = Scratch(spark, "decontaminate")
    texts = F.col(text).cast("string").alias("text")
    windows = scratch.write(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_windows(window), "item_id string, window string, size int, tokens array<long>"))
    shingles = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())
    distinct = windows.dropDuplicates(["window"])
    tokens = scratch.write(distinct.select(F.explode("tokens").alias("token")).distinct())
    shared = spark.sparkContext.broadcast(token_filter(tokens, "token"))
    counts = docs.select(texts).mapInArrow(_count_tokens(shared, shingles), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts.join(tokens, "token", "left_semi"))
    shared.unpersist()
    placed = distinct.select("window", "size", F.posexplode("tokens").alias("offset", "token"))
    rarest = placed.join(counts, "token", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("r"))
    prefix = scratch.write(rarest.where("r.n > 0").select("window", "size", "r.token", "r.offset"))
    shared = spark.sparkContext.broadcast(token_filter(prefix.select("token").distinct(), "token"))
    schema = "row_key long, doc_id long, text_key long, n_words long, token long, lead int, place int, around string"
    source = docs.select(F.monotonically_increasing_id().alias("row_key"), texts, F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"))
    found = scratch.write(source.mapInArrow(_find_tokens(shared, shingles, window), schema))
    shared.unpersist()
    spots = found.where("token is not null").select("row_key", "token", "lead", "place", "around")
    bounds = (F.col("lead") >= F.col("offset")) & (F.col("place") >= F.col("offset"))
    words = F.slice(F.split("around", " "), F.greatest(F.col("lead") - F.col("offset"), F.lit(0)) + 1, F.col("size"))
    same = F.array_join(words, " ") == F.col("window")
    begin = F.col("place") - F.col("offset")
    hits = scratch.write(spots.join(prefix, "token").where(bounds & same).select("row_key", "window", begin.alias("begin"), (begin + F.col("size")).alias("end")))
    # Runs that touch are one: each row's hits in order, a new run where one begins after all before it end.
    before = Window.partitionBy("row_key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = hits.select("row_key", "begin", "end").distinct().withColumn("reach", F.max("end").over(before))
    runs = runs.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("begin") > F.col("reach"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row_key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    runs = runs.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("hit"))
    owners = windows.select("window", "item_id").where("item_id is not null").distinct()
    listed = hits.select("row_key", "window").distinct().join(owners, "window").groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = found.where("token is null").select("row_key", "doc_id", "text_key", "n_words").join(runs, "row_key", "left").join(listed, "row_key", "left")
    empty_hit, empty_items = F.array().cast("array<struct<begin: int, end: int>>"), F.array().cast("array<string>")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("hit", empty_hit).alias("hit"), F.coalesce("item_ids", empty_items).alias("item_ids"))
