"""Line dedup: minimal perfect hashes over repeated lines, probed by the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import mix, slices

#: Keys in one shard, and bytes of shards that one probing pass broadcasts.
SHARD_KEYS, PASS_BYTES = 200_000, 48 << 20
_BLANK = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def _keys(text: str | None, least: int) -> list[bytes | None]:
    """The hashed key of each line, or None for one too short to count."""
    import xxhash

    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_BLANK).lower()
        long = len(key) >= least and (key.isascii() or len(key.decode()) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class PerfectHash:
    """A minimal perfect hash of 128-bit keys as levels of bits.

    A key's place is the rank of its bit, in the first level where no other key fell on that bit;
    about 3 bits a key. Any other key gets some place or none, so callers compare fingerprints.
    """

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1.view(np.uint64) ^ mix(h2.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
        """Sizes of the levels, their bits, and the place of each key."""
        left, sizes, bits, place, done = np.arange(h1.size), [], [], np.zeros(h1.size, np.int64), 0
        while left.size:
            size = -(-2 * left.size // 64) * 64
            slot = cls._slot(h1[left], h2[left], len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            fits = alone[slot]
            place[left[fits]] = done + rank[slot[fits]]
            done += int(fits.sum())
            left = left[~fits]
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").tobytes())
        return sizes, b"".join(bits), place

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.words = sizes, np.frombuffer(bits, np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def place(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """-1 where no level has the key's bit."""
        out, left, base = np.full(h1.size, -1, np.int64), np.arange(h1.size), 0
        for level, size in enumerate(self.sizes):
            if not left.size:
                break
            slot = self._slot(h1[left], h2[left], level, size)
            word, bit = base + (slot >> 6), (slot & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            base += size >> 6
        return out


def _build_shard(group: pa.Table) -> pa.Table:
    h1, h2 = group["h1"].to_numpy(), group["h2"].to_numpy()
    sizes, bits, place = PerfectHash.build(h1, h2)
    arrays = {}
    for name, kind in (("h2", np.int64), ("n", np.int32), ("holder", np.int64)):
        values = np.empty(h1.size, kind)
        values[place] = np.minimum(group[name].to_numpy(), np.iinfo(kind).max)
        arrays[name] = values.tobytes()
    row = {"shard": [group["shard"][0].as_py()], "sizes": [sizes], "bits": [bits], "prints": [arrays["h2"]], "counts": [arrays["n"]], "holders": [arrays["holder"]]}
    return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("holders", pa.binary())]))


class LineIndex:
    """Some shards of the index, as the documents probe them."""

    def __init__(self, shards: int, rows: list):
        self.shards = shards
        self.at = {r["shard"]: (PerfectHash(list(r["sizes"]), bytes(r["bits"])), *(np.frombuffer(bytes(r[c]), k) for c, k in (("prints", np.int64), ("counts", np.int32), ("holders", np.int64)))) for r in rows}

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, least_docs: int) -> np.ndarray:
        """Whether each line goes: its key is in enough documents and another one is the largest."""
        out = np.zeros(h1.size, bool)
        shard = h1 % self.shards
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], sorted(self.at))
        ends = np.searchsorted(shard[order], sorted(self.at), side="right")
        for s, i, j in zip(sorted(self.at), cuts, ends, strict=True):
            if i == j:
                continue
            mine = order[i:j]
            table, prints, counts, holders = self.at[s]
            place = table.place(h1[mine], h2[mine])
            ok = place >= 0
            mine, place = mine[ok], place[ok]
            out[mine] = (prints[place] == h2[mine]) & (counts[place] >= least_docs) & (holders[place] != doc[mine])
        return out


def repeated_lines(docs: DataFrame, least_length: int, least_docs: int) -> DataFrame:
    """(h1, h2, n, holder): keys of ``least_docs`` distinct doc_ids or more, and the largest doc_id that has each.

    Distinct pairs of key and doc_id are counted first, spread over all tasks; a key that very many
    documents share then comes as one partial count from each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, of = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    mine = {k for k in _keys(text, least_length) if k}
                    keys += mine
                    of += [_NO_ID if doc is None else doc] * len(mine)
                h1, h2 = _halves(keys)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(of, pa.int64())], ["h1", "h2", "doc"])

    found = docs.mapInArrow(run, "h1 long, h2 long, doc long")
    return found.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("holder")).where(F.col("n") >= least_docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, least_length: int = 20, least_docs: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and n_lines (before) and n_dropped added.

    A key (line stripped of blanks, A-Z lower-cased) of ``least_length`` code points or more in
    ``least_docs`` distinct doc_ids or more stays only in the largest doc_id that has it. Null and
    empty texts are one empty line; a null text stays null; null counts as one doc_id below all
    others; rows that repeat the largest doc_id all keep the line. Input columns named n_lines or n_dropped give way
    to the new ones. An empty table gives no rows.

    Keys that repeat go into shards of SHARD_KEYS; each shard is a minimal perfect hash with an
    array of 64-bit fingerprints (with the place, 128 bits of the key decide), counts and
    holders. Shards of PASS_BYTES at most are broadcast in one pass; more shards take more passes
    over the documents, whose drops are then joined on doc_id.
    """
    scratch = Scratch(spark, "lines")
    id_text = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    keys = scratch.write(repeated_lines(docs.select(*id_text), least_length, least_docs))
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    schema = "shard long, sizes array<long>, bits binary, prints binary, counts binary, holders binary"
    index = scratch.write(keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(_build_shard, schema))
    per_pass = max(1, PASS_BYTES // (22 * SHARD_KEYS))
    passes = [index.where(F.col("shard").between(i, i + per_pass - 1)).collect() for i in range(0, shards, per_pass)] if shards <= per_pass else None
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    source = docs.select(*kept)
    schema = source.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept]).schema
    from pyspark.sql.types import LongType, StructField, StructType

    out_schema = StructType([*schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    source = source.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept])
    if passes is not None:
        shared = spark.sparkContext.broadcast((shards, [r.asDict() for r in passes[0]]))

        def direct() -> LineIndex:
            return LineIndex(*shared.value)

        return source.mapInArrow(_applier(direct, kept.index(text), kept.index(doc_id), least_length, least_docs), out_schema)
    drops = None
    for i in range(0, shards, per_pass):
        shared = spark.sparkContext.broadcast((shards, [r.asDict() for r in index.where(F.col("shard").between(i, i + per_pass - 1)).collect()]))
        some = scratch.write(docs.select(*id_text).mapInArrow(_prober(shared, least_length, least_docs), "doc_id long, h1 long, h2 long"))
        shared.unpersist()
        drops = some if drops is None else drops.unionByName(some)
    gone = scratch.write(drops.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("_gone")).withColumnRenamed("doc_id", "_gone_id"))
    joined = source.join(gone, F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)) == F.col("_gone_id"), "left").drop("_gone_id")
    return joined.mapInArrow(_applier(None, kept.index(text), kept.index(doc_id), least_length, least_docs), out_schema)


def _line_arrays(part: pa.RecordBatch, text: int, doc_id: int, least: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys by row, then for each line with a key: hash halves, doc_id and row."""
    keys = [_keys(t, least) for t in part.column(text).to_pylist()]
    row = np.array([i for i, ks in enumerate(keys) for k in ks if k], np.int64)
    h1, h2 = _halves([k for ks in keys for k in ks if k])
    ids = np.array([_NO_ID if d is None else d for d in part.column(doc_id).cast(pa.int64()).to_pylist()], np.int64)
    return keys, h1, h2, ids[row] if row.size else np.zeros(0, np.int64), row


def _prober(shared, least: int, least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(*shared.value)
        for batch in batches:
            for part in slices(batch):
                _, h1, h2, doc, _ = _line_arrays(part, 1, 0, least)
                go = index.drops(h1, h2, doc, least_docs)
                yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (doc, h1, h2)], ["doc_id", "h1", "h2"])

    return run


def _applier(load, text: int, doc_id: int, least: int, least_docs: int):
    """Rows with the lines gone; without ``load``, the last column lists the keys to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load() if load else None
        for batch in batches:
            name = batch.schema.names[text]
            for part in slices(batch, name):
                keys, h1, h2, doc, row = _line_arrays(part, text, doc_id, least)
                if index:
                    go = index.drops(h1, h2, doc, least_docs)
                else:
                    listed = [{(x["h1"], x["h2"]) for x in g or ()} for g in part.column(part.num_columns - 1).to_pylist()]
                    go = np.array([(a, b) in listed[r] for a, b, r in zip(h1.tolist(), h2.tolist(), row.tolist(), strict=True)], bool)
                    part = part.select(part.schema.names[:-1])
                dropped = np.bincount(row[go], minlength=part.num_rows) if row.size else np.zeros(part.num_rows, np.int64)
                texts, at = part.column(text).to_pylist(), 0
                for i, ks in enumerate(keys):
                    n = sum(k is not None for k in ks)
                    if dropped[i]:
                        flags = iter(go[at : at + n].tolist())
                        texts[i] = "\n".join([x for x, k in zip(texts[i].split("\n"), ks, strict=True) if k is None or not next(flags)])
                    at += n
                arrays = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in range(part.num_columns)]
                arrays += [pa.array([len(ks) for ks in keys], pa.int64()), pa.array(dropped.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "n_lines", "n_dropped"])

    return run
