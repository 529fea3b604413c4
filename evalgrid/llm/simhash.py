"""SimHash near-duplicates: fingerprints linked by pigeonring keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .text import Words, byte_table, slices

#: Bits of a fingerprint that may differ, and segments of the ring.
MAX_BITS, SEGMENTS = 2, 8
#: Fingerprints of one key whose pairs are written out; larger keys are linked through shared neighbours.
PAIR_LIMIT = 32
_SPACE = byte_table("space")


def fingerprints(column: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: bit set if set in over half of the XXH64 hashes of its shingles.

    Words are runs of non-blank bytes, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle, a text without words has fingerprint 0, as has null.
    """
    import xxhash

    words = Words(column, _SPACE, lower=True)
    joined, start, end = words.joined()
    counts = words.counts
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    text = np.repeat(np.arange(counts.size), shingles)
    begin = np.cumsum(shingles) - shingles
    left = np.arange(text.size) - begin[text] + words.first[:-1][text]
    right = np.minimum(left + shingle, words.first[1:][text]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[left].tolist(), end[right].tolist(), strict=True)), np.uint64, text.size)
    out = np.zeros(counts.size, np.uint64)
    some = np.flatnonzero(shingles)
    if not some.size:
        return out
    # Eight byte-wide counters in each word of 64 bits hold 255 shingles at most.
    parts = -(-shingles[some] // 255)
    of = np.repeat(np.arange(some.size), parts)
    part_begin = np.cumsum(parts) - parts
    cut = begin[some][of] + 255 * (np.arange(of.size) - part_begin[of])
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & ones, cut)
        bytes_ = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(bytes_, part_begin, axis=0)
        for byte in range(8):
            out[some] |= (2 * total[:, byte] > shingles[some]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_table(docs: DataFrame, shingle: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: Column, segment: int) -> Column:
    """The ring turned so that ``segment`` holds the top bits."""
    width = 64 // SEGMENTS
    return fp if segment == 0 else F.shiftleft(fp, segment * width).bitwiseOR(F.shiftrightunsigned(fp, 64 - segment * width))


def _keys(fp: Column) -> Column:
    """The 16 join keys of a fingerprint.

    At most 2 differing bits on a ring of 8 segments: some chain of segments keeps, for every
    length l, to the proportional budget floor(l * 2 / 8). Its first three segments (24 bits)
    agree, and of the next four (32 bits) at most one bit differs, so one half of these (16 bits)
    agrees. A key is the chain's start, the half and these 40 bits.
    """
    keys = []
    for segment in range(SEGMENTS):
        turned = _rotated(fp, segment)
        head = F.shiftrightunsigned(turned, 40)
        for half in range(2):
            body = F.shiftrightunsigned(turned, 24 - 16 * half).bitwiseAND(F.lit(0xFFFF))
            keys.append(F.lit((segment * 2 + half) << 40).bitwiseOR(F.shiftleft(head, 16)).bitwiseOR(body))
    return F.array(*keys)


def _within_chain(x: Column, y: Column, segment: Column) -> Column:
    """The chain that starts at ``segment`` keeps its budgets, and so does the whole ring."""
    differ = x.bitwiseXOR(y)
    turned = F.lit(False)
    for s in range(SEGMENTS):
        t = _rotated(differ, s)
        fits = (F.shiftrightunsigned(t, 40) == 0) & (F.bit_count(F.shiftrightunsigned(t, 8)) <= 1)
        turned = F.when(segment == s, fits).otherwise(turned)
    return turned & (F.bit_count(differ) <= MAX_BITS)


def fingerprint_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all that differ in 2 bits or fewer.

    Keys of up to PAIR_LIMIT fingerprints are compared pair by pair: chain budgets first, then the
    whole distance. In a larger key the 24 other bits differ in 2 places at most, which is to say
    that both fingerprints share a value one flip away or less; each such value links its
    fingerprints to the smallest one. So no key makes pairs with the square of its size.
    """
    keys = scratch.write(fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key")))
    sizes = scratch.write(keys.groupBy("key").count().where("count > 1"))
    shared = scratch.write(keys.join(sizes, "key"))
    small = shared.where(F.col("count") <= PAIR_LIMIT).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    pairs = small.select("key", F.posexplode("all").alias("i", "x"), "all").select("key", "x", F.explode(F.slice("all", F.col("i") + 2, PAIR_LIMIT)).alias("y"))
    segment = F.shiftrightunsigned(F.col("key"), 41)
    close = pairs.where(_within_chain(F.col("x"), F.col("y"), segment)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    # The bits outside a key: turned right by its segment, the half not taken and the last segment.
    rest = [F.lit(0)] + [F.lit(1 << bit if bit < 63 else -(1 << 63)) for bit in range(64)]
    free = F.shiftrightunsigned(F.col("key"), 40)
    masks = F.create_map(*[x for tag in range(2 * SEGMENTS) for x in (F.lit(tag).cast("long"), F.lit(_free_mask(tag)))])
    flips = F.filter(F.array(*[x.cast("long") for x in rest]), lambda bit: (bit == 0) | (bit.bitwiseAND(masks[free]) != 0))
    near = shared.where(F.col("count") > PAIR_LIMIT).select("fp", "key", F.explode(flips).alias("flip")).select("fp", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    hubs = near.groupBy("key", "at").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hung = near.join(hubs, ["key", "at"]).where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    links = scratch.write(close.unionByName(hung))
    scratch.drop(keys, sizes, shared)
    return links


def _free_mask(tag: int) -> int:
    segment, half = divmod(tag, 2)
    free = 0xFF | (0xFFFF << (8 if half == 0 else 24))
    turn = segment * 8
    mask = ((free >> turn) | (free << (64 - turn))) & ((1 << 64) - 1)
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most 2 differing fingerprint bits
    reach. Null and empty texts have fingerprint 0 and are linked like any other; a null doc_id
    keeps its row and never names a component. Equal fingerprints are one node, so groups of
    copies cost one row. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprint_table(docs, shingle, text, doc_id))
    classes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(classes.select("fp"), scratch)
    roots = connected_components(links, scratch).withColumnRenamed("node", "fp")
    labels = scratch.write(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = scratch.write(labels.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = scratch.write(labels.join(least, "root").select("fp", "component_id"))
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")
