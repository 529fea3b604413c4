"""Mixing to target weights: soft domain memberships and fitted document rates."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch
from .text import Words, byte_table, slices

#: About so many labelled rows train the classifier; word hashes fall into so many buckets.
SAMPLE, BUCKETS = 20_000, 1 << 14
#: Pull of each rate towards 1, steps at most, the change of all totals at which they end, and steps after which the rates so far are written.
PULL, STEPS, SETTLED, STORED = 1e-3, 1000, 1e-6, 16
#: Words whose average evidence a posterior may weigh like so many independent ones.
EVIDENCE = (1.0, 3.0, 10.0, 30.0, 100.0)
_ALNUM = byte_table("alnum")


def _buckets(part: pa.RecordBatch, text: int) -> tuple[Words, np.ndarray]:
    words = Words(part.column(text), _ALNUM, lower=True)
    return words, (words.hashes() >> np.uint64(40)).astype(np.int64) % BUCKETS


class DomainModel:
    """Naive Bayes over hashed words; evidence is averaged over the words, so long texts stay soft."""

    def __init__(self, domains: list[str], counts: np.ndarray, rows: np.ndarray):
        self.domains = domains
        smooth = counts + 0.5
        self.word = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
        self.prior = np.log((rows + 0.5) / (rows + 0.5).sum())
        self.evidence = 10.0

    def log_odds(self, part: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text and their mean log likelihood by domain."""
        words, bucket = _buckets(part, text)
        n = words.counts
        out = np.zeros((n.size, len(self.domains)))
        some = np.flatnonzero(n)
        if some.size:
            out[some] = np.add.reduceat(self.word[bucket], words.first[some], axis=0) / n[some][:, None]
        return n, out

    def posterior(self, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
        x = self.prior + mean * np.minimum(n, self.evidence)[:, None]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def fit_domains(spark: SparkSession, labelled: DataFrame, text: str = "text", domain: str = "domain", doc_id: str = "doc_id", most: int = SAMPLE) -> DomainModel:
    """A classifier from about ``most`` rows of (doc_id, text, domain); null domains are left out.

    Rows are drawn by a hash of doc_id and text, so a much repeated text is drawn in proportion.
    Labelled rows of which none is drawn are an error.
    """
    scratch = Scratch(spark, "domains")
    rows = labelled.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(domain).cast("string").alias("domain"), F.col(doc_id).alias("_id")).where("domain is not null")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("_id", "text"), F.lit(1_000_003)) < int(1_000_003 * most / n))
    rows = scratch.write(rows.drop("_id"))
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    if n and not sizes:
        raise ValueError("no labelled row was drawn; raise the bound on rows")
    domains = sorted(sizes)
    place = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(domains), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                words, bucket = _buckets(part, 0)
                of = np.array([place[d] for d in part.column(1).to_pylist()], np.int64)
                half = np.array([_half(t) for t in part.column(0).to_pylist()], np.int64)
                row = np.repeat(np.arange(part.num_rows), words.counts)
                np.add.at(counts, (half[row], of[row], bucket), 1)
        h, d, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(b), pa.array(counts[h, d, b])], ["half", "domain", "bucket", "n"])

    counts = np.zeros((2, len(domains), BUCKETS))
    for r in rows.mapInArrow(count, "half long, domain long, bucket long, n long").groupBy("half", "domain", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["half"], r["domain"], r["bucket"]] = r["n"]
    weight = np.array([sizes[d] for d in domains], float)
    half = DomainModel(domains, counts[0], weight)
    model = DomainModel(domains, counts.sum(axis=0), weight)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(EVIDENCE))
        for batch in batches:
            for part in slices(batch):
                held = np.array([_half(t) == 1 for t in part.column(0).to_pylist()], bool)
                of = np.array([place[d] for d in part.column(1).to_pylist()], np.int64)
                n, mean = half.log_odds(part, 0)
                for i, e in enumerate(EVIDENCE):
                    half.evidence = e
                    total[i] -= np.log(half.posterior(n, mean)[held, of[held]] + 1e-12).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["at", "loss"])

    if domains:
        loss = {r["at"]: r["loss"] for r in rows.mapInArrow(losses, "at long, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()}
        model.evidence = EVIDENCE[min(range(len(EVIDENCE)), key=lambda i: (loss.get(i, 0.0), i))]
    scratch.drop(rows)
    return model


def _half(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text.encode()) & 1


def _rates(p: np.ndarray, gaps: list[np.ndarray], rate: np.ndarray | None = None, ahead: np.ndarray | None = None, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps with these gaps, and the point where the next gap is taken.

    Projected gradient steps of length 1 / (1 + PULL) in the metric of token shares, with momentum;
    from rates 1, or from the state after ``done`` steps.
    """
    if rate is None or ahead is None:
        rate = ahead = np.ones(p.shape[0])
    for t, gap in enumerate(gaps, done):
        following = np.maximum(0.0, ahead - (p @ gap + PULL * (ahead - 1)) / (1 + PULL))
        ahead = following + t / (t + 3) * (following - rate)
        rate = following
    return rate, ahead


_STATE = ["doc_id", "n", "p", "rate", "ahead"]


def mix(spark: SparkSession, docs: DataFrame, model: DomainModel, targets: dict[str, float], text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, rate, copies, domain) for every row, and the columns ``carry``.

    Rates r >= 0 minimise, over all documents with n tokens (words) and posteriors p, the squared
    gaps between the expected domain totals sum(r n p) and the targets (``targets`` made to sum to
    1, times all tokens), as shares of all tokens, plus PULL / 2 times the token-weighted squares of
    r - 1, which settles rates that the targets leave open. Each step sums K totals over all
    documents; a rate follows from its posteriors and the gaps of the steps, and is written every
    STORED steps, so that a step takes the last few anew at most. Steps that have not settled after
    STEPS give a warning. ``domain``s are what the labelled table gives (languages in the query) and
    tokens are words; of equal posteriors the first domain by name is the likeliest. ``copies``: the rate rounded up or down by a hash of the doc_id, with the rate as
    mean. ``domain``: the likeliest. Null and empty texts have 0 tokens and the prior's
    posteriors; domains without labelled rows can't be met and are left out; repeated rows stay;
    an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(spark, "mixing")
    shared = spark.sparkContext.broadcast(model)
    k = len(model.domains)

    def posteriors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in slices(batch, "_text"):
                n, mean = shared.value.log_odds(part, 1)
                yield part, n, shared.value.posterior(n, mean) if k else np.zeros((n.size, 0))

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, p in posteriors_of(batches):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n.size + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            ones = pa.array(np.ones(n.size))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), lists, ones, ones], _STATE)

    soft = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(posteriors, "doc_id long, n long, p array<double>, rate double, ahead double")
    soft = scratch.write(soft)
    want = np.array([max(float(targets.get(d, 0.0)), 0.0) for d in model.domains])
    want = want / want.sum() if want.sum() > 0 else want
    gaps: list[np.ndarray] = []
    stored = 0  # steps that the written state has taken

    def memberships(part: pa.RecordBatch) -> np.ndarray:
        return part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, k)

    def state(part: pa.RecordBatch, steps: list[np.ndarray], done: int) -> tuple[np.ndarray, np.ndarray]:
        return _rates(memberships(part), steps, part.column(3).to_numpy(), part.column(4).to_numpy(), done)

    def advanced(steps: list[np.ndarray], done: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, state(batch, steps, done))], _STATE)

        return run

    def totals(steps: list[np.ndarray], done: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(k + 1)
            for batch in batches:
                if batch.num_rows:
                    p, n = memberships(batch), batch.column(1).to_numpy()
                    sums += np.append((state(batch, steps, done)[1] * n) @ p, n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()])], ["sums"])

        return run

    before = None
    for _ in range(STEPS if k and want.any() else 0):
        # K + 1 numbers a task: summed here, as a shuffle a step would take longer than the step.
        sums = np.zeros(k + 1)
        for row in soft.mapInArrow(totals(gaps[stored:], stored), "sums array<double>").collect():
            sums += row["sums"]
        if sums[-1] == 0:
            break
        now = sums[:-1] / sums[-1]
        if before is not None and np.abs(now - before).max() < SETTLED:
            break
        before = now
        gaps.append(now - want)
        if len(gaps) - stored == STORED:
            following = scratch.write(soft.mapInArrow(advanced(gaps[stored:], stored), soft.schema))
            scratch.drop(soft)
            soft, stored = following, len(gaps)
    else:
        if k and want.any():
            warnings.warn(f"the rates have not settled in {STEPS} steps", stacklevel=2)

    names = np.array([*model.domains, None], object)

    def decided(doc: pa.Array, n: pa.Array, p: np.ndarray, rates: np.ndarray, more: list[pa.Array]) -> pa.RecordBatch:
        top = p.argmax(axis=1) if k else np.full(p.shape[0], -1)
        arrays = [doc, n, pa.array(rates), pa.array(names[top].tolist(), pa.string()), *more]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "rate", "domain", *(carry if more else ())])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield decided(batch.column(0), batch.column(1), memberships(batch), state(batch, gaps[stored:], stored)[0], [])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in posteriors_of(batches):
            part, n, p = batch
            yield decided(part.column(0), pa.array(n.astype(np.int64)), p, _rates(p, gaps)[0], part.columns[2:])

    schema = StructType.fromDDL("doc_id long, n_tokens long, rate double, domain string")
    if carry:  # posteriors anew rather than a join that would move the texts
        whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"), *carry)
        out = whole.mapInArrow(carried, StructType([*schema.fields, *whole.schema.fields[2:]]))
    else:
        out = soft.mapInArrow(final, schema)
    chance = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return out.select("doc_id", "n_tokens", "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"), "domain", *carry)
