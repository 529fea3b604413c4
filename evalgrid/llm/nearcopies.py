"""Near copies by SimHash: candidates from whole and sampled fingerprints, checked on shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .decontaminate import passes_filter, token_filter
from .rows import text_key
from .scratch import Scratch
from .simhash import fingerprint_links, fingerprints
from .text import Windows, Words, byte_table, mix, signed, slices

#: Shingles drawn from a text by least hash, and the triples of them that make a sampled
#: fingerprint: two ways to part the draws, any two triples with one draw in common at most. At
#: Jaccard similarity 0.8 a pair shares none with probability about (1 - 0.8 ** 3) ** 16 = 1e-5.
DRAWS = 24
TRIPLES = [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(8)] + [(i, i + 8, i + 16) for i in range(8)]
SAMPLES = len(TRIPLES)
#: Texts and shingles in one block of a group of candidates.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 18
_SPACE = byte_table("space")


def _shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle; a text of fewer words is one shingle, one without words has none."""
    counts = words.counts
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    text = np.repeat(np.arange(counts.size), shingles)
    at = np.arange(text.size) - (np.cumsum(shingles) - shingles)[text] + words.first[:-1][text]
    return Windows(words.hashes()).at(at, np.minimum(size, counts[text])), text


def _digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each text's words, in two halves."""
    import xxhash

    joined, start, end = words.joined()
    spans = [(start[a], end[b - 1]) if b > a else (0, 0) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:b]) for a, b in spans), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sketch(shingle: int):
    """For each row: digest of its words, whole fingerprint, and sampled fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(2), _SPACE, lower=True)
                d1, d2 = _digests(words)
                hashes, text = _shingle_hashes(words, shingle)
                some = np.unique(text)
                cut = np.searchsorted(text, some)
                samples = np.zeros((part.num_rows, SAMPLES), np.uint64)
                draws = [np.minimum.reduceat(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (d + 1) & (1 << 64) - 1)), cut) for d in range(DRAWS if some.size else 0)]
                for s, triple in enumerate(TRIPLES if draws else ()):
                    x, y, z = (draws[d] for d in triple)
                    samples[some, s] = (x & y) | (x & z) | (y & z)  # the SimHash of three features
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SAMPLES), pa.array(signed(samples.ravel())))
                whole = signed(fingerprints(part.column(2), shingle))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d1), pa.array(d2), pa.array(whole), lists], ["doc_id", "text_key", "d1", "d2", "fp", "samples"])

    return run


def _sets(shared, shingle: int):
    """The distinct shingle hashes of texts whose digest passes the filter, once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for part in slices(batch):
                words = Words(part.column(0), _SPACE, lower=True)
                d1, d2 = _digests(words)
                maybe = np.flatnonzero(passes_filter(shared.value, d1.view(np.uint64)))
                some = []
                for i, key in zip(maybe.tolist(), zip(d1[maybe].tolist(), d2[maybe].tolist(), strict=True), strict=True):
                    if key not in seen:
                        seen.add(key)
                        some.append(i)
                hashes, text = _shingle_hashes(words, shingle)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                sets = [np.unique(hashes[cut[i] : cut[i + 1]]) for i in some]
                arrays = [pa.array(d1[some]), pa.array(d2[some]), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.size for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["d1", "d2", "shingles", "size"])

    return run


def _similar(similarity: float):
    """The pairs (a, b) whose sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep[i] = shared >= similarity * (x.size + y.size - shared) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _trees(similarity: float):
    """For a pair of blocks of one group: edges between texts of different components that links connect.

    A text is compared with all texts of other components so far, whole columns at once; so every
    link between two components counts, and what is connected already is not compared.
    """

    def solve(group: pa.Table) -> pa.Table:
        nodes, sizes, home = (group[c].to_numpy() for c in ("node", "size", "home"))
        root = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
        flat = np.frombuffer(b"".join(group["shingles"].to_pylist()), np.uint64)
        names, flat = np.unique(flat, return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        a, b = [], []
        marked = np.zeros(names.size, bool)
        for x in np.argsort(nodes, kind="stable").tolist():
            near = np.flatnonzero((root != root[x]) & (sizes * 1.0 >= similarity * sizes[x]) & (sizes[x] >= similarity * sizes) & (sizes > 0) & (nodes > nodes[x]) & (home | home[x]))
            if not near.size:
                continue
            mine = flat[begin[x] : begin[x] + sizes[x]]
            marked[mine] = True
            lengths = sizes[near]
            ends = np.cumsum(lengths)
            index = np.arange(int(ends[-1])) + np.repeat(begin[near] - (ends - lengths), lengths)
            shared = np.add.reduceat(marked[flat[index]].astype(np.int64), ends - lengths)
            marked[mine] = False
            for y in near[shared >= similarity * (sizes[x] + lengths - shared) - 1e-9].tolist():
                if root[y] != root[x]:
                    a.append(int(nodes[x]))
                    b.append(int(nodes[y]))
                    root[root == root[y]] = root[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return solve


def near_copies(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, component_id, first): one row for each row of ``docs``.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word shingles (blank-separated
    words, A-Z lower-cased; fewer words: the whole sequence) reaches ``similarity``; texts of equal
    words are copies. ``component_id`` is the smallest doc_id that links reach (null if all are),
    ``text_key`` a hash of the row's text (``text_key``), and ``first`` says whether the row is the
    one to keep: of the smallest doc_id (null ranks last), then of the least text_key; equal rows
    are equal in this too. Null and empty texts are copies of each other; repeated rows and null
    ids stay; an empty table gives no rows; other columns are not read.

    Candidates are texts that share a sampled fingerprint, or whose whole fingerprints are
    connected by distances of 2 bits (pigeonring keys); at similarity 0.8 a whole fingerprint of 64
    bits is some 10 bits off, so the samples bring most. Equal texts are one node. A text is first
    compared with the least node of each of its keys, which settles groups of near copies of any
    size by one comparison a text and key; only keys that hold texts of several components then
    compare these, in bands of alike sizes and blocks of bounded size.
    """
    scratch = Scratch(spark, "nearcopies")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    rows = scratch.write(source.mapInArrow(_sketch(shingle), "doc_id long, text_key long, d1 long, d2 long, fp long, samples array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = rows.groupBy("d1", "d2").agg(F.min(order).alias("least"), F.min("fp").alias("fp"), F.min("samples").alias("samples"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()))
    links = fingerprint_links(nodes.select("fp").distinct(), scratch)
    roots = connected_components(links, scratch).withColumnRenamed("node", "fp")
    whole = nodes.select("node", "fp").join(roots, "fp", "left").select("node", F.lit(SAMPLES).alias("at"), F.coalesce("root", "fp").alias("print"))
    prints = nodes.select("node", F.posexplode("samples").alias("at", "print")).unionByName(whole)
    hubs = scratch.write(prints.groupBy("at", "print").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    shared = scratch.write(prints.join(hubs.drop("n"), ["at", "print"]).select("node", "at", "print", "hub"))
    scratch.drop(hubs, links)

    # The sets of the texts that share a key, and of few others that a bounded filter lets through.
    members = scratch.write(nodes.select("node", "d1", "d2").join(shared.select("node").distinct(), "node"))
    wanted = spark.sparkContext.broadcast(token_filter(members.select("d1"), "d1"))
    sets = source.select("text").mapInArrow(_sets(wanted, shingle), "d1 long, d2 long, shingles binary, size long")
    sets = sets.groupBy("d1", "d2").agg(F.first("shingles").alias("shingles"), F.first("size").alias("size"))
    sets = scratch.write(sets.join(members, ["d1", "d2"]).select("node", "shingles", "size"))
    wanted.unpersist()
    scratch.drop(members)

    stars = shared.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # Sizes first: a pair of too unlike ones moves no sets.
    for c in "ab":
        stars = stars.join(sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}")), c)
    alike = (F.col("size_a") >= similarity * F.col("size_b")) & (F.col("size_b") >= similarity * F.col("size_a")) & (F.col("size_a") > 0)
    stars = scratch.write(stars.where(alike).select("a", "b"))
    pairs = stars
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    near = scratch.write(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_similar(similarity), "a long, b long"))

    roots = connected_components(near, scratch)
    held = shared.join(roots, "node", "left").select("at", "print", "node", F.coalesce("root", "node").alias("root"))
    held = scratch.write(held)
    open_ = scratch.write(held.groupBy("at", "print").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("at", "print"))
    band = F.floor(F.log("size") / F.log(F.lit(1 / similarity))).cast("int") if similarity < 1 else F.col("size").cast("int")
    sizes = sets.where("size > 0").select("node", "size", band.alias("own"))
    cells = held.join(open_, ["at", "print"]).join(sizes, "node").select("*", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
    cells = scratch.write(cells.withColumn("home", F.col("own") == F.col("band")))
    blocks = cells.groupBy("at", "print", "band").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("root").alias("x"), F.max("root").alias("y"), F.max("home").alias("z"))
    count = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("total") / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    blocks = scratch.write(blocks.where("z and x != y").select("at", "print", "band", count.alias("blocks")))
    cells = cells.join(blocks, ["at", "print", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("next"))
    cells = cells.withColumns({"low": F.least("block", "next"), "high": F.greatest("block", "next")}).drop("size")
    cells = cells.join(sets, "node").select("node", "root", "home", "shingles", "size", "at", "print", "band", "low", "high")
    more = scratch.write(cells.groupBy("at", "print", "band", "low", "high").applyInArrow(_trees(similarity), "a long, b long"))
    scratch.drop(sets, shared, stars, held, open_, blocks)

    roots = connected_components(near.unionByName(more), scratch)
    labels = scratch.write(nodes.join(roots, "node", "left").select("d1", "d2", "least", F.coalesce("root", "node").alias("root")))
    least = scratch.write(labels.groupBy("root").agg(F.min("least").alias("first")))
    labels = scratch.write(labels.join(least, "root").select("d1", "d2", "first"))
    scratch.drop(near, more, nodes, least)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_key").eqNullSafe(F.col("first.text_key"))
    return rows.select("doc_id", "text_key", "d1", "d2").join(labels, ["d1", "d2"]).select("doc_id", "text_key", F.col("first.doc_id").alias("component_id"), same.alias("first"))
