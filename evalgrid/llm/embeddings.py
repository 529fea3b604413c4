"""Embedding near-dedup: spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Codes at least, filters of each that a vector passes on average, vectors of one label that a filter should hold, and rows in a block.
CODES, LIST, BUCKET, BLOCK = 3, 7, 32, 1024
SEED = 20_240_601
#: Share of pairs at the threshold itself that have to share a filter, pairs that measure it, and codes beyond which none is tried.
RECALL, PAIRS, MOST_CODES = 0.97, 2048, 64


class ProductCode:
    """Filter directions: a random rotation, then one code word for each part of the coordinates.

    ``decode`` lists, for each unit vector, all directions whose inner product with it exceeds the
    threshold: parts are added one after the other and combinations that even the best remaining
    code words can't lift over the threshold are cut. A vector that passes none gets its best one.
    """

    def __init__(self, dim: int, vectors: int, number: int = 0):
        want = max(512.0, vectors * LIST / BUCKET)
        self.parts = min(2, dim)  # three would be smaller tables, but find far fewer pairs
        self.words = max(4, int(np.ceil(want ** (1 / self.parts))))
        self.size = self.words**self.parts
        rng = np.random.default_rng([SEED, dim, self.parts, self.words, number])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((self.words, b - a))
            self.codes.append((c / np.linalg.norm(c, axis=1, keepdims=True)).T)
        probe = rng.standard_normal((256, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        low, high = 0.0, float(sum(p.max(axis=1) for p in self._products(probe)).max())
        self.threshold = high / 2
        for _ in range(20):  # lists of LIST filters on average over random directions
            low, high = (low, self.threshold) if self._passed(probe)[0].size < LIST * len(probe) else (self.threshold, high)
            self.threshold = (low + high) / 2

    def _products(self, x: np.ndarray) -> list[np.ndarray]:
        x = x @ self.turn
        return [x[:, a:b] @ c for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]

    def _passed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        products = self._products(x)
        best = [p.max(axis=1) for p in products]
        row, filter_, total = np.arange(x.shape[0]), np.zeros(x.shape[0], np.int64), np.zeros(x.shape[0])
        for i, p in enumerate(products):
            rest = sum(best[i + 1 :], np.zeros(x.shape[0]))
            sums = total[:, None] + p[row]
            at, word = np.nonzero(sums + rest[row][:, None] >= self.threshold)
            row, filter_, total = row[at], filter_[at] * self.words + word, sums[at, word]
        return row, filter_, products

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter."""
        row, filter_, products = self._passed(x)
        none = np.setdiff1d(np.arange(x.shape[0]), row)
        if none.size:
            code = np.zeros(none.size, np.int64)
            for p in products:
                code = code * self.words + p[none].argmax(axis=1)
            row, filter_ = np.concatenate([row, none]), np.concatenate([filter_, code])
        return row, filter_


class Codes:
    """Several product codes; their filters are numbered one code after the other.

    ``number``: how many; else as many as pairs of cosine ``threshold`` need for RECALL.
    """

    def __init__(self, dim: int, vectors: int, number: int | None = None, threshold: float = 0.93):
        self.all = [ProductCode(dim, vectors, i) for i in range(number or CODES)]
        if number is None and dim > 1 and -1 < threshold < 1:
            self._extend(dim, vectors, threshold)

    def _extend(self, dim: int, vectors: int, threshold: float) -> None:
        rng = np.random.default_rng([SEED, dim])
        x, z = rng.standard_normal((2, PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + np.sqrt(1 - threshold**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        found, done = np.zeros(PAIRS, bool), 0
        while True:
            for code in self.all[done:]:
                (r, f), (s, g) = code.decode(x), code.decode(y)
                found[np.intersect1d(r * code.size + f, s * code.size + g) // code.size] = True
            done = len(self.all)
            if found.mean() >= RECALL:
                return
            if done == MOST_CODES:
                raise ValueError(f"{done} codes find {found.mean():.2f} of the pairs at cosine {threshold} in {dim} dimensions")
            self.all.append(ProductCode(dim, vectors, done))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter, ascending."""
        found = [(row, filter_ + i * code.size) for i, code in enumerate(self.all) for row, filter_ in [code.decode(x)]]
        row, filter_ = np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found])
        order = np.lexsort((filter_, row))
        return row[order], filter_[order]


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, null where they can't be compared: floats where these lose nothing, else doubles.

    ``dim`` is negative for doubles.
    """
    for batch in batches:
        raw, dims = [], []
        lists = batch.column(2)
        values = lists.values.to_numpy(zero_copy_only=False)  # null components are NaN
        for begin, size in zip(lists.offsets[:-1].to_pylist(), pc.fill_null(pc.list_value_length(lists), 0).to_pylist(), strict=True):
            x = values[begin : begin + size]
            ok = size and np.isfinite(x).all() and x.any()
            short = x.astype(np.float32) if ok and np.abs(x).max() < 1e30 and np.abs(x[x != 0]).min() > 1e-30 else None
            exact = short is not None and (short == x).all()
            x = x + 0.0  # one zero
            raw.append(((short + np.float32(0)) if exact else x).tobytes() if ok else None)
            dims.append((x.size if exact else -x.size) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(dims, pa.int64())], ["vec_id", "label", "vector", "dim"])


def _units(vectors: list[bytes], dims: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, all of one length."""
    x = np.stack([np.frombuffer(v, np.float32 if d > 0 else np.float64).astype(np.float64) for v, d in zip(vectors, dims.tolist(), strict=True)])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=32)
def _codes(dim: int, vectors: int, number: int) -> Codes:
    return Codes(dim, vectors, number)


def label_sizes(nodes: DataFrame) -> DataFrame:
    """(label, size, most) of each label and vector length: its number of vectors, up to the next power of two."""
    counts = nodes.groupBy("label", F.abs("dim").alias("size")).count()
    return counts.select("label", "size", F.pow(F.lit(2.0), F.ceil(F.log2("count"))).cast("long").alias("most"))


def _filters(numbers: dict[tuple[int, int], int]):
    """A row for each vector and filter it passes, with all its filters. ``numbers``: codes by length and size of the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                vectors, dims, most = part.column(3).to_pylist(), part.column(4).to_numpy(), part.column(5).to_numpy()
                part = part.select(["node", "n", "label", "vector", "dim"])
                for size, vectors_of in np.unique(np.stack([np.abs(dims), most]), axis=1).T.tolist():
                    mine = np.flatnonzero((np.abs(dims) == size) & (most == vectors_of))
                    row, found = _codes(size, vectors_of, numbers[size, vectors_of]).decode(_units([vectors[i] for i in mine], dims[mine]))
                    cut = np.searchsorted(row, np.arange(mine.size + 1))
                    every = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(found))
                    rows = part.take(pa.array(mine[row]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(row.size, size)), pa.array(found), every.take(pa.array(row))], ["node", "n", "label", "vector", "dim", "size", "filter", "filters"])

    return run


_RUN = ["label", "size", "filter", "low", "high"]


def _links(threshold: float):
    """For each block pair of a filter: links of each vector that this filter is the first to see, and a root among them.

    Rows come sorted by block pair; a pair's rows are at most two blocks.
    """

    def solve(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        group = group.combine_chunks()
        node, n, block = (group[c].to_numpy() for c in ("node", "n", "block"))
        low, high, now = (group[c][0].as_py() for c in ("low", "high", "filter"))
        x = _units(group["vector"].to_pylist(), group["dim"].to_numpy())
        close = x @ x.T >= threshold
        np.fill_diagonal(close, False)
        if low != high:  # pairs within one block are seen in that block's own pair
            close &= block[:, None] != block[None, :]
        if not close.any():
            return None
        lists = group["filters"].combine_chunks()
        flat = lists.flatten().to_numpy()
        of = np.repeat(np.arange(group.num_rows), np.diff(lists.offsets.to_numpy()))
        early = flat < now
        if early.any():
            names, column = np.unique(flat[early], return_inverse=True)
            shared = np.zeros((group.num_rows, names.size), np.float32)
            shared[of[early], column] = 1
            close &= shared @ shared.T == 0
        has = np.flatnonzero(close.any(axis=1))
        if not has.size:
            return None
        close = close[np.ix_(has, has)]
        node, n = node[has], n[has]
        root = node.copy()
        while True:
            least = np.minimum(root, np.where(close, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                break
            root = least
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(close @ n.astype(np.int64)), pa.array(root)], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held.select(_RUN).combine_chunks()
            change = np.zeros(held.num_rows, bool)
            for c in _RUN:
                v = keys[c].combine_chunks()
                v = v.dictionary_encode().indices.to_numpy() if pa.types.is_string(v.type) else v.to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1 and (out := solve(held.slice(a, b - a))) is not None:
                    yield out
            held = held.slice(cuts[-1])
        if held is not None and (out := solve(held)) is not None:
            yield out

    return run


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null, their vectors as long, and the cosine in
    double precision reaches ``threshold``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id that links reach. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, as do rows without a label; repeated rows
    are linked rows of their own; a null vec_id keeps its row and never names a component. An empty
    table gives no rows; other columns are not read.

    Equal vectors are one node. A pair is found if both vectors pass one filter, which misses
    few pairs at the threshold and hardly any above it: codes are added until RECALL of made pairs
    at the threshold share a filter. Filters grow in number with the vectors of their own label, so
    that each holds BUCKET vectors at most on average; larger ones,
    such as those of one very common vector, are split into pairs of blocks.
    """
    scratch = Scratch(spark, "embeddings")
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = scratch.write(source.mapInArrow(_directions, "vec_id long, label string, vector binary, dim long"))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    nodes = rows.where(usable).groupBy("label", "vector", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = scratch.write(label_sizes(nodes))
    classes = [(r["size"], r["most"]) for r in sizes.select("size", "most").distinct().collect()]  # some powers of two a length
    numbers = {c: len(Codes(*c, threshold=threshold).all) for c in classes}
    nodes_of = nodes.withColumn("size", F.abs("dim")).join(sizes, ["label", "size"]).select("node", "n", "label", "vector", "dim", "most")
    schema = "node long, n long, label string, vector binary, dim long, size long, filter long, filters array<long>"
    passed = scratch.write(nodes_of.mapInArrow(_filters(numbers), schema))
    held = passed.groupBy("label", "size", "filter").agg(F.count("*").alias("held")).where("held > 1")
    held = scratch.write(held.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")))
    found = passed.join(held, ["label", "size", "filter"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    found = found.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    found = found.select("node", "n", "vector", "dim", "filters", "block", *_RUN).repartition(*_RUN).sortWithinPartitions(*_RUN)
    links = scratch.write(found.mapInArrow(_links(threshold), "node long, links long, root long"))
    scratch.drop(passed, held)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    labels = nodes.join(roots, "node", "left").join(counts, "node", "left").select("label", "vector", "dim", "least", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    labels = scratch.write(labels)
    labels = labels.join(scratch.write(labels.groupBy("root").agg(F.min("least").alias("component"))), "root")
    labels = scratch.write(labels.select("label", "vector", "dim", (F.col("links") + F.col("n") - 1).alias("n_links"), "component"))
    out = rows.join(labels, ["label", "vector", "dim"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
