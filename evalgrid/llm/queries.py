"""The corpus queries of the driver contract, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(spark, _table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["begin"])
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, all_spans, personal_data
    from .spans import listed

    found = personal_data(spark, _table(spark, sf_dir, "documents"))
    counts = [_count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_spans()).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import RULES, secrets
    from .spans import listed

    found = secrets(spark, _table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in RULES]
    rank = F.array(*[F.lit(k) for k in kinds])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [_count(r.kind) for r in RULES if r.base]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts, vocabulary_path

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicate_vectors

    return near_duplicate_vectors(spark, _table(spark, sf_dir, "embeddings"))


#: Target shares of the domains (languages) in the mix.
MIX = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def domain_model(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """The classifier of domains (languages) learned from the documents in the labelled table."""
    from .mixing import fit_domains

    known = docs.select("doc_id", "text", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")
    return fit_domains(spark, known)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = _table(spark, sf_dir, "documents")
    return mix(spark, docs, domain_model(spark, docs, _table(spark, sf_dir, "labels")), MIX)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    found = dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def held_out() -> Column:
    """The fold of documents whose labels nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """The toxicity model learned from the labelled rows of ``docs`` outside the held-out fold."""
    from .toxicity import EXAMPLES, fit

    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    few = F.lit(False)
    for label, n in sizes.items():  # about EXAMPLES rows of each class, by a hash of the doc_id
        few = few | ((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, EXAMPLES / n)) + 1))
    # At most some 2 * EXAMPLES rows of two numbers.
    return fit(spark, docs, docs.select("doc_id", "text").join(F.broadcast(known.where(few)), "doc_id"), labelled=sizes)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    docs = _table(spark, sf_dir, "documents")
    found = score(spark, docs, toxicity_model(spark, docs, _table(spark, sf_dir, "labels")))
    evidence = F.array_join(F.transform("neighbours", lambda x: x["doc_id"].cast("string")), ",").alias("evidence")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), evidence)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    found = dedup_substrings(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_ALL = (op1_simhash, op2_decontaminate, op3_personal_data, op4_secrets, op5_token_counts, op6_embedding_dedup, op7_mixing, op8_line_dedup, op9_toxicity, op10_substring_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
