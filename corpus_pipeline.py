"""A corpus pipeline: each stage works on all that its predecessor kept.

The stages return the columns of ``documents``; the last adds what the mix decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.decontaminate import contamination
from evalgrid.llm.lines import dedup_lines
from evalgrid.llm.mixing import mix
from evalgrid.llm.nearcopies import near_copies
from evalgrid.llm.queries import MIX, domain_model, toxicity_model
from evalgrid.llm.rows import only_rows, without_rows
from evalgrid.llm.scratch import Scratch
from evalgrid.llm.toxicity import score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Scores from here on reject a document.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts get the base rate of the labels; repeated rows are scored alike; other
    columns than those of ``documents`` are not read.
    """
    model = toxicity_model(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(spark, docs, model, carry=COLUMNS[1:]).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more of them share, except in the largest doc_id.

    A null text stays null; a document of which no line is left stays with an empty text; a null
    doc_id ranks below all others; rows of one doc_id keep or lose a line together.
    """
    found = dedup_lines(spark, docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, null last.

    Null and empty texts are copies of each other. Rows are told apart by doc_id and text, so
    another text of a repeated doc_id stays, and of equal rows one stays.
    """
    scratch = Scratch(spark, "others")
    groups = scratch.write(near_copies(spark, docs))
    kept = without_rows(docs.select(*COLUMNS), groups.where("not first"))
    again = scratch.write(groups.where("first").groupBy("doc_id", "text_key").count().where("count > 1"))
    if not again.head(1):
        return kept
    once = only_rows(kept, again).groupBy("doc_id", "text").agg(F.min(F.struct(*COLUMNS[2:])).alias("rest"))
    return without_rows(kept, again).unionByName(once.select("doc_id", "text", "rest.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay, as do other texts of the doc_id of a leak; a leak goes whatever its
    doc_id, and so do rows equal to it.
    """
    found = contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = Scratch(spark, "leaks").write(found.where(F.size("hit") > 0).select("doc_id", "text_key").distinct())
    return without_rows(docs.select(*COLUMNS), leaks)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a positive rate, with the rate and copies that meet the domain targets.

    Null and empty texts have no tokens and the rate of the prior's domains; repeated rows get
    one rate; an empty table gives no rows.
    """
    model = domain_model(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = mix(spark, docs, model, MIX, carry=COLUMNS[1:])
    return found.where("rate > 0").select(*COLUMNS, "n_tokens", "rate", "copies", F.col("domain").alias("mix_domain"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_domains),
]
#: No SQL: the first and the last stage fit models. tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
