"""The e-mail guard lets through whatever the generator finds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_email_guard_passes_every_writing_of_the_training_rows(spark):
    from evalgrid.llm.pii import GENERATORS, personal_data, training_rows

    made = training_rows(spark).where("kind = 'email' and label = 1").select("hit").distinct()
    texts = sorted({f"we write to {r['hit']} today" for r in made.collect()} | {f"write to ann.lee at {h}" for h in ("mail.com", "mail [dot] com", "mail[dot]com", "mail(dot)com", "mail dot com")})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert docs.where(F.rlike("text", F.lit(GENERATORS["email"]))).count() == len(texts) > 100
    found = {r["doc_id"]: {(s["kind"], s["hit"]) for s in r["added"]} for r in personal_data(spark, docs).collect()}
    # The trees' score, and so the verdict, is the same whatever else the document holds.
    opened = docs.withColumn("text", F.concat("text", F.lit(" and then, after all that, far from everything else: x [at] y z")))
    beside = {r["doc_id"]: {(s["kind"], s["hit"]) for s in r["added"]} for r in personal_data(spark, opened).collect()}
    assert found == beside
    assert [t for i, t in enumerate(texts) if not found[i]] == []


def test_email_guard_is_a_necessary_condition(spark):
    from evalgrid.llm.pii import GENERATORS, GUARD_EMAIL

    rng = random.Random(7)
    pieces = ["ann", "a-b", " ", " at ", "at", "[at]", "( at )", "{at", ".", " . ", ". ", "dot", " dot ", "[dot]", "( dot )", "{dot]", "com", "-", "\n", "x" * 90]
    docs = [("".join(rng.choice(pieces) for _ in range(rng.randrange(3, 14))),) for _ in range(20_000)]
    docs += [(f"ann at {h * 100} dot com",) for h in ("x", "x-")]
    df = spark.createDataFrame(docs, "text string")
    matched = df.where(F.rlike("text", F.lit(GENERATORS["email"])))
    assert matched.count() > 300 and matched.where(~F.rlike("text", F.lit(GUARD_EMAIL))).count() == 0


def _addresses(spark):
    """200 texts of 20 addresses each, half of them with a part above 255."""
    rng = random.Random(11)
    lines = [f"{rng.choice(['host ', 'the ', 'version ', 'ping ', 'page '])}{rng.randrange(250)}.{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(256 if i % 2 else 99) + (0 if i % 2 else rng.choice([256, 900, 4000]))}" for i in range(4_000)]
    return spark.createDataFrame([(i, "\n".join(lines[20 * i : 20 * i + 20])) for i in range(200)], "doc_id long, _t string")


def test_every_match_of_the_documents_is_learned_from(spark):
    from evalgrid.llm.pii import NATURAL, UNIT, examples
    from evalgrid.llm.scratch import Scratch

    found = examples(Scratch(spark, "test"), _addresses(spark)).where("not made").groupBy("kind", "label").agg(F.sum("n").alias("n"), F.sum("units").alias("units")).collect()
    assert {(r["kind"], r["label"], r["n"], r["units"]) for r in found} == {("ip", 0.0, 2_000, NATURAL * UNIT), ("ip", 1.0, 2_000, NATURAL * UNIT)}


def test_trees_and_thresholds_are_those_of_the_whole_corpus(spark):
    from evalgrid.llm.pii import train

    docs = _addresses(spark)
    # Twice the same matches, so half the weight each: a draw of some would be another one.
    assert train(spark, docs) == train(spark, docs.unionAll(docs))


def test_exported_trees_score_as_the_model(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from evalgrid.llm.pii import UNIT, _fit, _probability

    columns = [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)]
    rows = spark.range(400).select((F.xxhash64("id", F.lit("y")) % 3 == 0).cast("double").alias("label"), F.lit(UNIT).alias("units"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)).cast("int") for i, n in enumerate((4, 2, 2))]).alias("bins"))
    model = _fit(rows, columns)
    sql = _probability(model, lambda j: f"c.f[{columns[j][0]}] <= {columns[j][1]}")
    scored = rows.withColumn("v", array_to_vector(F.array(*[(F.get("bins", F.lit(i)) > k).cast("double") for i, k in columns]))).withColumn("c", F.struct(F.col("bins").alias("f")))
    both = model.transform(scored).select(F.expr(sql).alias("p"), F.get(vector_to_array("probability"), F.lit(1)).alias("q")).collect()
    assert len({round(r["p"], 6) for r in both}) > 8 and all(abs(r["p"] - r["q"]) < 1e-12 for r in both)
