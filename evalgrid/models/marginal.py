"""Scores of mutants from tables of log-probabilities by position and residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.operators.leaderboard import first_row

STRATEGIES = ("wt-marginals", "masked-marginals", "pseudo-ppl")


def log_probabilities(logits: DataFrame, by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``logp``: log-softmax of ``logit`` over the residues of each position."""
    w = Window.partitionBy(*by)
    top = F.max("logit").over(w)
    return logits.withColumn("_top", top).withColumn("logp", F.col("logit") - F.col("_top") - F.log(F.sum(F.exp(F.col("logit") - F.col("_top"))).over(w))).drop("_top")


def wild_type(records: DataFrame, order: str = "record_idx", kind: str = "type", sequence: str = "sequence") -> str:
    """The sequence of the first record of type WILD_TYPE; an error when there is none."""
    found = first_row(records.where(F.col(kind) == "WILD_TYPE"), order, "wild type sequence")
    return found.select(sequence).first()[0]


def difference_scores(mutants: DataFrame, wild_type: str, logp: DataFrame, key: str, sequence: str = "sequence", offset: int = 1) -> DataFrame:
    """(key, score): sum over differing places of logp(mutant) - logp(wild type).

    ``logp`` has (pos, aa, logp); ``offset`` is the table's position of the first residue.
    Sequences of other lengths are an error, equal ones score 0.
    """
    wild = F.lit(wild_type)
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    pairs = F.zip_with(letters, F.filter(F.split(wild, ""), lambda c: c != ""), lambda m, w: F.struct(m.alias("m"), w.alias("w")))
    checked = F.when(F.length(sequence) == F.length(wild), pairs).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("array<struct<m: string, w: string>>"))
    # Both residues of a differing place, the wild type's with weight -1.
    places = F.filter(F.transform(checked, lambda p, i: F.struct((i + offset).alias("pos"), p["m"].alias("m"), p["w"].alias("w"))), lambda p: p["m"] != p["w"])
    terms = F.flatten(F.transform(places, lambda p: F.array(F.struct(p["pos"].alias("pos"), p["m"].alias("aa"), F.lit(1.0).alias("sign")), F.struct(p["pos"].alias("pos"), p["w"].alias("aa"), F.lit(-1.0).alias("sign")))))
    rows = mutants.select(key, F.explode_outer(terms).alias("t")).select(key, "t.*")
    return rows.join(logp, ["pos", "aa"], "left").groupBy(key).agg(F.coalesce(F.sum(F.col("sign") * F.col("logp")), F.lit(0.0)).alias("score"))


def pseudo_perplexity(logp: DataFrame, sequences: DataFrame, key: str, sequence: str = "sequence", compat: bool = False) -> DataFrame:
    """(key, score): sum of the log-probability of each residue, from (key, pos, aa, logp), pos from 0.

    ``compat``: only masked places 1 .. length - 2 count, each for the residue of its own index.
    """
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    rows = sequences.select(key, F.posexplode(letters).alias("pos", "aa"), F.length(sequence).alias("_n"))
    if compat:
        rows = rows.where((F.col("pos") >= 1) & (F.col("pos") < F.col("_n") - 1))
    return rows.join(logp, [key, "pos", "aa"]).groupBy(key).agg(F.sum("logp").alias("score"))


def marginal_scores(strategy: str, **inputs) -> DataFrame:
    """Scores by a strategy's name; both marginals differ only in the table they are given."""
    if strategy in ("wt-marginals", "masked-marginals"):
        return difference_scores(**inputs)
    if strategy == "pseudo-ppl":
        return pseudo_perplexity(**inputs)
    raise ValueError(f"unknown strategy: {strategy}")
