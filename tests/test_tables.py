from __future__ import annotations

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalgrid.functions import columns as X
from evalgrid.models.features import joined, last_pool, mean_pool, row_numbered, with_one_hot
from evalgrid.models.linear import fit_pls, fit_ridge
from evalgrid.models.marginal import difference_scores, log_probabilities, marginal_scores, pseudo_perplexity
from evalgrid.operators import leaderboard as L
from evalgrid.operators.aggregate import KEYS, aggregate, flatten_wide
from evalgrid.plans.evaluate import aggregate_run, evaluate, publish
from evalgrid.sources import readers as R
from evalgrid.sources import sinks as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_aggregate_rules(spark):
    rows = [("a", 0.8), ("b", None), ("b", 0.8), ("b", 0.9), ("c", None), ("d", math.nan), ("d", 1.0)]
    found = {r["metric"]: r for r in aggregate(spark.createDataFrame(rows, "metric string, value double"), ["metric"]).collect()}
    assert (found["a"]["mean"], found["a"]["std"]) == (0.8, 0.0)
    assert found["b"]["mean"] == pytest.approx(0.85) and found["b"]["std"] == pytest.approx(0.0707106781)
    assert "c" not in found and math.isnan(found["d"]["mean"])


def test_wide_columns(spark):
    rows = [("m", "test", "rho", 0.5, 0.1), ("m", "full_dataset", "rho", 0.4, 0.0)]
    wide = flatten_wide(spark.createDataFrame(rows, "model string, mode string, metric string, mean double, std double"), ["model"])
    assert set(wide.columns) == {"model", "test_rho", "test_rho_std", "full_dataset_rho"}


def test_upsert_is_idempotent_and_widens(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, m double")
    new = spark.createDataFrame([("b", 3.0, 9.0), ("c", 4.0, 8.0)], "k string, m double, extra double")
    once = L.upsert(old, new, ["k"])
    twice = L.upsert(once, new, ["k"])
    expected = [("a", 1.0, None), ("b", 3.0, 9.0), ("c", 4.0, 8.0)]
    assert sorted(map(tuple, once.select("k", "m", "extra").collect())) == sorted(map(tuple, twice.select("k", "m", "extra").collect())) == expected


def test_concat_rules(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1.5,)], "x double")
    assert L.concat_relaxed(a, b).dtypes == [("x", "double")]
    assert L.concat_relaxed(a, spark.createDataFrame([("q",)], "x string")).dtypes == [("x", "string")]
    with pytest.raises(ValueError, match="schemas differ"):
        L.concat_strict(a, b)
    with pytest.raises(ValueError, match="columns missing"):
        L.concat_relaxed(a, spark.createDataFrame([(1,)], "y int"))


def test_view_states(spark):
    view = L.View(page=3).toggle("s")
    assert (view.direction, view.page) == ("asc", 1)
    assert view.toggle("s").direction == "desc" and view.toggle("s").toggle("s").column is None
    assert view.with_filter("model", "x").with_filter("model", "").filters == ()
    assert L.View().turn(9, 4).page == 4 and L.View().turn(0, 4).page == 1
    rows = spark.createDataFrame([(i, f"m{i % 3}", str(i / 10) if i else "n/a") for i in range(25)], "id int, model string, s string")
    shown = L.leaderboard(rows, L.View("s", "desc", (("model", "M1"),)), "id", ["s"], 3).collect()
    assert [r["id"] for r in shown] == [22, 19, 16]
    assert L.search_any(rows, "M2", F.col("model")).count() == 8


@pytest.mark.parametrize(("text", "number", "shown"), [("0.85abc", 0.85, "0.8500"), ("-.5", -0.5, "-0.5000"), ("abc", None, "abc"), ("1e3", 1000.0, "1000.0000")])
def test_parse_float(spark, text, number, shown):
    found = value(spark, X.parse_float(F.lit(text)))
    assert math.isnan(found) if number is None else found == number
    assert value(spark, X.fixed(F.lit(text))) == shown


def test_strings(spark):
    assert value(spark, X.path_stem(F.lit("/a/X.splits.pgdata"))) == "X.splits"
    assert value(spark, X.dataset_label(F.lit("/a/X.splits.pgdata"))) == "X"
    assert value(spark, X.overview(F.lit("# T\n\n> q\n\nFirst line\nsecond.\n\nMore"))) == "First line\nsecond."
    assert value(spark, X.top_k_of(F.create_map(F.lit("top_k"), F.lit("10.7")))) == 10
    assert value(spark, X.top_k_of(F.create_map(F.lit("other"), F.lit("1")))) is None
    assert value(spark, X.contains_text(F.lit("50%_A"), "%_a"))
    assert value(spark, X.map_text(F.create_map(F.lit("k"), F.lit("v")))) == "k v"


def test_sequences(spark):
    assert value(spark, X.one_hot(F.lit("CA"), "AC", 3)) == [0, 1, 1, 0, 0, 0]
    assert value(spark, X.one_hot(F.lit("Z"), "AC", 1, "zero")) == [0, 0]
    with pytest.raises(PySparkException, match="not in the alphabet"):
        value(spark, X.one_hot(F.lit("Z"), "AC"))
    assert value(spark, X.differing_positions(F.lit("ACD"), F.lit("AXD"))) == [2]
    with pytest.raises(PySparkException, match="differ in length"):
        value(spark, X.hamming(F.lit("A"), F.lit("AB")))
    found = value(spark, X.log_softmax(F.array(F.lit(1.0), F.lit(2.0))))
    assert np.exp(found).sum() == pytest.approx(1.0)


def test_features(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 2, [5.0, 9.0])], "k string, p int, embedding array<double>")
    assert mean_pool(rows, "k").first()["pooled"] == [3.0, 5.0]
    assert last_pool(rows, "k", "p").first()["pooled"] == [3.0, 4.0]
    assert rows.select(joined("embedding", F.reverse("embedding")).alias("b")).first()["b"] == [1.0, 2.0, 2.0, 1.0]
    assert sorted(r["embedding_index"] for r in row_numbered(spark.range(50), "id").collect()) == list(range(50))
    assert {len(r["features"]) for r in with_one_hot(spark.createDataFrame([("A",), ("ACD",)], "sequence string")).collect()} == {60}


def test_linear_models(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4)) * [1, 2, 3, 4] + 1
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.standard_normal(60) * 0.1
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)] + [([0.0] * 4, math.nan)], "x array<double>, y double")
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = fit_ridge(df, "x", "y", 2.0)
    assert np.allclose(ridge.coefficients, np.linalg.solve(xc.T @ xc + 2 * np.eye(4), xc.T @ yc))
    xs, ys = xc / x.std(0, ddof=1), yc / y.std(ddof=1)
    left, w_, p_, q_ = xs.copy(), [], [], []
    for _ in range(2):
        w = left.T @ ys / np.linalg.norm(left.T @ ys)
        t = left @ w
        p, q = left.T @ t / (t @ t), ys @ t / (t @ t)
        left = left - np.outer(t, p)
        w_.append(w), p_.append(p), q_.append(q)
    b = np.array(w_).T @ np.linalg.solve(np.array(p_) @ np.array(w_).T, q_)
    pls = fit_pls(df, "x", "y", 2)
    predicted = [r["p"] for r in df.where(~F.isnan("y")).select(pls.predict("x").alias("p")).collect()]
    assert np.allclose(sorted(predicted), sorted(xs @ b * y.std(ddof=1) + y.mean()))


def test_marginals(spark):
    logits = spark.createDataFrame([(p, a, float(p + i)) for p in (1, 2) for i, a in enumerate("AC")], "pos int, aa string, logit double")
    logp = log_probabilities(logits).select("pos", "aa", "logp")
    rows = spark.createDataFrame([(1, "AA"), (2, "CA"), (3, "CC")], "id int, sequence string")
    found = {r["id"]: r["score"] for r in difference_scores(rows, "AA", logp, "id").collect()}
    assert found == {1: 0.0, 2: pytest.approx(1.0), 3: pytest.approx(2.0)}
    table = spark.createDataFrame([(1, p, "A", -1.0) for p in range(3)], "id int, pos int, aa string, logp double")
    three = spark.createDataFrame([(1, "AAA")], "id int, sequence string")
    assert pseudo_perplexity(table, three, "id").first()["score"] == -3.0
    assert pseudo_perplexity(table, three, "id", compat=True).first()["score"] == -1.0
    with pytest.raises(ValueError, match="unknown strategy"):
        marginal_scores("other")


def dataset(spark, path):
    n = 10
    records = spark.createDataFrame([(i, f"S{i}", float(i)) for i in range(n)], "record_idx int, sequence string, t double")
    membership = spark.createDataFrame([("random", i // 2, 0, i) for i in range(n)], "split string, fold int, assay_idx int, record_idx int")
    meta = spark.createDataFrame([("random", f, {"top_k": "1"}) for f in range(5)], "split string, fold int, metadata map<string,string>")
    S.write_dataset(f"{path}/X.splits", records, membership, meta)
    S.write_dataset(f"{path}/X", records)
    records.write.parquet(f"{path}/pred")
    return f"{path}/X.splits", f"{path}/X", f"{path}/pred"


def test_runs_end_to_end(spark, tmp_path):
    splits, plain, pred = dataset(spark, str(tmp_path))
    for fold in (0, 1):
        out = evaluate(spark, pred, str(tmp_path / f"m/fold_{fold}.json"), splits, ["spearman", "recovery"], "pls", "random", "t", fold)
    doc = json.loads(out.read_text())
    assert doc["test"] == {"spearman": 1.0, "recovery": 1.0} and doc["train_available"]["recovery"] is None
    assert doc["metadata"]["train_available_folds"] == [0, 2, 3, 4] and len(doc["per_fold"]) == 5
    whole = json.loads(evaluate(spark, pred, str(tmp_path / "w.json"), plain, ["spearman"], target="t").read_text())
    assert whole["full_dataset"]["spearman"] == 1.0
    failed = json.loads(evaluate(spark, str(tmp_path / "none"), str(tmp_path / "deep/f.json"), plain, ["spearman"]).read_text())
    assert failed["status"] == "failed" and failed["spearman"] is None
    with pytest.raises(ValueError, match="split and a fold"):
        evaluate(spark, pred, str(tmp_path / "x.json"), splits, target="t")
    total = json.loads(aggregate_run(spark, str(tmp_path / "m/fold*.json"), str(tmp_path / "agg/a_aggregated.json")).read_text())
    assert total["test"] == {"spearman": 1.0, "spearman_std": 0.0, "recovery": 1.0, "recovery_std": 0.0}
    assert "test_fold" not in total["metadata"] and total["metadata"]["total_folds"] == "5"
    for _ in range(2):
        csv = publish(spark, str(tmp_path / "agg"), str(tmp_path / "board.csv"), "supervised")
    rows = R.read_csv(spark, str(csv)).collect()
    assert len(rows) == 1 and float(rows[0]["test_spearman"]) == 1.0 and rows[0]["game"] == "supervised"
    assert set(KEYS) <= set(rows[0].asDict())


def test_prediction_partitions(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", f, "A", float(f)) for f in range(3)], "model string, split string, fold int, sequence string, t double")
    S.write_predictions(df, str(tmp_path / "p"))
    S.write_predictions(df.where("fold = 1").withColumn("t", F.lit(9.0)), str(tmp_path / "p"))
    assert R.read_predictions(spark, str(tmp_path / "p")).count() == 3
    assert R.read_predictions(spark, str(tmp_path / "p"), fold=1).first()["t"] == 9.0


def test_catalog_readers(spark, tmp_path):
    (tmp_path / "datasets.json").write_text(json.dumps({"datasets": [{"name": "a", "input_filename": "a.splits", "split": "random", "target": "t"}]}))
    assert R.read_catalog(spark, str(tmp_path / "datasets.json")).first()["split"] == "random"
    (tmp_path / "list.json").write_text('{"slugs": ["a", "b"]}')
    assert [r["slug"] for r in R.read_slugs(spark, str(tmp_path / "list.json")).collect()] == ["a", "b"]
    for name, text in (("pls", "---\nname: pls\ntags: [x, y]\nhyper_parameters:\n  n: 2\n  alphabet: [A, C]\n---\n# PLS\n\nA model.\n"), ("bad", "no front matter")):
        (tmp_path / "cards" / name).mkdir(parents=True)
        (tmp_path / "cards" / name / "README.md").write_text(text)
    card = R.read_cards(spark, str(tmp_path / "cards/*/README.md")).collect()
    assert [(c["slug"], c["tags"], c["overview"]) for c in card] == [("pls", ["x", "y"], "A model.")]
    assert json.loads(card[0]["hyper_parameters"]["alphabet"]) == ["A", "C"]
    (tmp_path / "toml").mkdir()
    (tmp_path / "toml/a.toml").write_text('name = "A"\n[section]\nx = 1\n')
    (tmp_path / "toml/b.toml").write_text("= broken")
    entries = R.manifest_entries(R.read_manifests(spark, str(tmp_path / "toml"))).collect()
    assert {(e["key"], e["nested"]) for e in entries} == {("name", False), ("section", True)}
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("manifest.lock", "locked")
    with zipfile.ZipFile(tmp_path / "a.splits.pgdata", "w") as z:
        z.writestr("dataset.pgdata", inner.getvalue())
    (tmp_path / "b.splits.pgdata").write_text("a pointer, no archive")
    members = R.read_archive_members(spark, str(tmp_path), ("dataset.pgdata", "manifest.lock")).collect()
    assert [bytes(m["content"]) for m in members] == [b"locked"]
    (tmp_path / "c.yaml").write_text("metrics: [spearman]\nfolds: [0, 1]\n")
    assert R.read_config(str(tmp_path / "c.yaml"), str(tmp_path / "datasets.json")).keys() == {"metrics", "folds", "datasets"}


def test_stream_upserts(spark, tmp_path):
    from evalgrid.streaming.upsert import stream_to_leaderboard

    rows = spark.createDataFrame([("g", "m", "d", "s", "t", 0.5)], "game string, model string, dataset string, split string, target string, test_rho double")
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_to_leaderboard(stream, tmp_path / "board.csv", str(tmp_path / "cp")).awaitTermination(120)
    assert R.read_csv(spark, str(tmp_path / "board.csv")).count() == 1


def test_cli_ping(capsys):
    from evalgrid.cli import main

    assert main(["ping"]) == 0 and capsys.readouterr().out == "pong\n"


def test_a_gap_in_one_fold_is_found_though_others_repeat(spark, tmp_path):
    splits, _, _ = dataset(spark, str(tmp_path))
    rows = [(i, f"S{i}", float(i)) for i in range(9)] + [(0, "S0", 0.0)]  # S9 of fold 4 lacks, S0 of fold 0 is there twice
    spark.createDataFrame(rows, "record_idx int, sequence string, t double").write.parquet(str(tmp_path / "gap"))
    with pytest.raises(ValueError, match=r"Missing 1 prediction\(s\)\."):
        evaluate(spark, str(tmp_path / "gap"), str(tmp_path / "m.json"), splits, ["spearman"], None, "random", "t", 0)
    evaluate(spark, str(tmp_path / "gap"), str(tmp_path / "m.json"), splits, ["spearman"], None, "random", "t", 0, ["test"])


def test_records_outside_every_fold_need_no_prediction(spark, tmp_path):
    splits, _, _ = dataset(spark, str(tmp_path))
    extra = spark.createDataFrame([(99, "extra", 1.0)], "record_idx int, sequence string, t double")
    extra.write.mode("append").parquet(f"{splits}/records")
    assert evaluate(spark, str(tmp_path / "pred"), str(tmp_path / "m.json"), splits, ["spearman"], None, "random", "t", 0)


def test_declared_variables_must_agree(spark, tmp_path):
    splits, _, pred = dataset(spark, str(tmp_path))
    for folder, names in ((splits, ["temp"]), (pred, ["ph"])):
        with open(f"{folder}/manifest.json", "w") as f:
            json.dump({"variables": [{"name": n} for n in names]}, f)
    assert R.declared_variables(spark, splits) == ["temp"] and R.declared_variables(spark, str(tmp_path)) is None
    with pytest.raises(ValueError, match="Variables differ"):
        evaluate(spark, pred, str(tmp_path / "m.json"), splits, ["spearman"], None, "random", "t", 0)


def test_ranks_by_ranges_equal_those_of_whole_groups(spark):
    from evalgrid.operators.metrics import score, value_cuts

    df = spark.range(4000).selectExpr("id as row_id", "id % 3 as g", "case when id % 50 = 0 then null else cast(pmod(hash(id), 700) as double) end as y", "case when id % 2 = 0 then 5.0 else cast(pmod(hash(id, 1), 90) as double) end as yhat", "20 as top_k")
    df = df.withColumn("y", F.when(F.col("g") == 0, F.coalesce("y", F.lit(1.0))).otherwise(F.col("y")))
    cuts = value_cuts(y=(df, "y"), yhat=(df, "yhat"))
    assert len(cuts["y"]) > 20
    a = score(df, ["spearman", "recovery"], ["g"]).orderBy("g").collect()
    b = score(df, ["spearman", "recovery"], ["g"], cuts=cuts).orderBy("g").collect()
    assert [r["n"] for r in a] == [r["n"] for r in b] and [r["recovery"] for r in a] == [r["recovery"] for r in b]
    assert all(math.isnan(x["spearman"]) and math.isnan(y["spearman"]) or abs(x["spearman"] - y["spearman"]) < 1e-12 for x, y in zip(a, b, strict=True))


def test_global_rank_keeps_nulls(spark):
    from evalgrid.operators.metrics import average_rank, global_average_rank

    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, None, 1.0, math.nan, None, 2.0])], "i int, v double")
    expected = {r["i"]: r["rank"] for r in average_rank(df, "v").collect()}
    assert {r["i"]: r["rank"] for r in global_average_rank(df, "v").collect()} == expected and len(expected) == 6


def test_row_numbers_of_millions(spark):
    df = spark.range(0, 2_000_000, 1, 7).selectExpr("pmod(id * 1103515245, 4294967291) as k")
    stats = row_numbered(df, "k").agg(F.count("*").alias("n"), F.countDistinct("embedding_index").alias("d"), F.max("embedding_index").alias("m"), F.min("embedding_index").alias("l")).first()
    assert tuple(stats) == (2_000_000, 2_000_000, 1_999_999, 0)


def test_last_of_repeated_new_keys_stays(spark, tmp_path):
    for i in (1, 2, 3):
        S.write_document({"metadata": {"model": "m", "dataset": "d", "split": "s", "target": "t"}, "test": {"rho": float(i)}}, tmp_path / f"docs/{i}_aggregated.json")
    csv = publish(spark, str(tmp_path / "docs"), str(tmp_path / "board.csv"), "g")
    rows = R.read_csv(spark, str(csv)).collect()
    assert [float(r["test_rho"]) for r in rows] == [3.0] and "path" not in rows[0].asDict()


def test_linear_models_with_many_features(spark, monkeypatch):
    from evalgrid.models import linear

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 12))
    y = x @ rng.standard_normal(12) + 0.1 * rng.standard_normal(60)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    dense = [fit(df, "x", "y") for fit in (fit_ridge, fit_pls)]
    monkeypatch.setattr(linear, "DENSE", 0)
    monkeypatch.setattr(linear, "SPAN", 5)
    for a, b in zip(dense, (fit_ridge(df, "x", "y"), fit_pls(df, "x", "y")), strict=True):
        assert np.allclose(a.coefficients, b.coefficients, atol=1e-8) and abs(a.intercept - b.intercept) < 1e-8
    centred = x - x.mean(axis=0)
    assert np.allclose(dense[0].coefficients, np.linalg.solve(centred.T @ centred + np.eye(12), centred.T @ (y - y.mean())))


def test_model_command_writes_predictions(spark, tmp_path):
    from evalgrid.plans.evaluate import card_settings, datasets_list, train

    letters = "ACDEFGHIKL"
    records = spark.createDataFrame([(i, letters[i] + "A", float(i)) for i in range(10)], "record_idx int, sequence string, t double")
    member = spark.createDataFrame([("random", i // 2, 0, i) for i in range(10)], "split string, fold int, assay_idx int, record_idx int")
    S.write_dataset(str(tmp_path / "D.splits"), records, member, spark.createDataFrame([("random", 0, {})], "split string, fold int, metadata map<string,string>"))
    card = tmp_path / "card.md"
    card.write_text("---\nname: pls\nhyper_parameters:\n  n_components: 1\n  other: 5\n---\ntext\n")
    assert card_settings(spark, str(card), "pls") == {"components": 1}
    for model in ("pls", "ridge"):
        rows = spark.read.parquet(train(spark, str(tmp_path / "D.splits"), str(tmp_path / model), model, "random", "t", 0)).collect()
        assert len(rows) == 10 and sum(r["split"] == "test" for r in rows) == 2 and all(np.isfinite(r["t"]) for r in rows)
    with pytest.raises(ValueError, match="unknown model"):
        train(spark, str(tmp_path / "D.splits"), str(tmp_path / "x"), "other", "random", "t", 0)
    (tmp_path / "list.csv").write_text("name,input_filename,splits,targets,kinds\na,a.splits,random modulo,t u,supervised\nb,b.splits,random,t,supervised zero_shot\n")
    (tmp_path / "locks/a").mkdir(parents=True)
    (tmp_path / "locks/a/manifest.lock").write_text("locked")
    counts = datasets_list(spark, str(tmp_path / "list.csv"), str(tmp_path / "site"), str(tmp_path / "locks"))
    assert counts == {"datasets": 2, "splits": 3, "targets": 3}
    assert len(json.loads((tmp_path / "site/supervised/datasets.json").read_text())["datasets"]) == 5
    assert (tmp_path / "site/static/datasets/a.lock").read_text() == "locked" and not (tmp_path / "site/static/datasets/b.lock").exists()


def test_no_wild_type_is_an_error(spark):
    from evalgrid.models.marginal import wild_type

    df = spark.createDataFrame([(1, "AAA", "MUTANT"), (3, "CCC", "WILD_TYPE"), (2, "AAC", "WILD_TYPE")], "record_idx int, sequence string, type string")
    assert wild_type(df) == "AAC"
    with pytest.raises(ValueError, match="no wild type"):
        wild_type(df.where("type = 'MUTANT'"))


def test_embeddings_are_made_once(spark, tmp_path):
    from evalgrid.models.features import Embedder, cached_embeddings

    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [3.0]), ("b", 1, [5.0])], "sequence string, pos int, embedding array<double>")

    for _ in range(2):
        tokens = cached_embeddings(spark, str(tmp_path / "cache"), make)
    assert len(made) == 1
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "sequence string")
    assert {r["sequence"]: r["features"] for r in Embedder("mean").fit(tokens).transform(df).collect()} == {"a": [2.0], "b": [5.0]}
    with pytest.raises(ValueError, match="unknown pooling"):
        Embedder("max").fit(tokens)
