"""Queries of the driver contract that go through readers, sinks and whole runs, with their SQL.

Each writes small files to a folder of its own in the shared folder and reads them back.
"""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions import columns as X
from evalgrid.models import features as E
from evalgrid.models import marginal as M
from evalgrid.models.linear import fit_pls, fit_ridge
from evalgrid.operators import folds as G
from evalgrid.operators import leaderboard as L
from evalgrid.operators.metrics import REGISTRY, global_average_rank, known_metrics, score
from evalgrid.operators.scoring import check_variables
from evalgrid.sources import readers as R
from evalgrid.sources import sinks as K
from evalgrid.sources.staging import new_folder, write_text

from . import evaluate as V
from .catalog import _FOLD_SCORES, _MODES, _PAIRS, _orders, _r, _sides, _table, query

# Score documents and the leaderboard


def _fold_documents(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A score document for each fold of the orders, and one that failed."""
    for r in score(_orders(spark, sf_dir), ["spearman"], ["fold"]).collect():  # a row a fold
        metadata = {"dataset": "orders", "model": "balance", "split": "modulo", "target": "price", "test_fold": r["fold"], "total_folds": 5}
        K.write_document({"metadata": metadata, "test": {"spearman": r["spearman"], "recovery": None}}, f"{folder}/fold_{r['fold']}.json", spark)
    K.write_document(K.failure_document("Prediction file not found: x", ["spearman"]), f"{folder}/fold_9.json", spark)


@query(f"""{_FOLD_SCORES} select fold, 'balance' as model, 'test' as mode, 'spearman' as metric, round(value, 6) as value from scores
union all select fold, 'balance', 'test', 'recovery', null from scores""")
def metric_documents_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "documents")
    _fold_documents(spark, sf_dir, folder)
    rows = V.long_scores(R.read_score_docs(spark, f"{folder}/*.json"))
    fold = F.regexp_extract("path", r"fold_(\d+)", 1).cast("int").alias("fold")
    return rows.select(fold, X.map_get("metadata", "model", F.lit("none")).alias("model"), "mode", "metric", _r("value").alias("value"))


@query(f"""{_FOLD_SCORES} select 'test' as mode, 'spearman' as metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from scores""")
def aggregate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "documents")
    _fold_documents(spark, sf_dir, folder)
    return V.aggregate_documents(spark, f"{folder}/*.json").select("mode", "metric", _r("mean").alias("mean"), _r("std").alias("std"))


@query(f"""{_FOLD_SCORES} select 'game' as game, 'balance' as model, 'orders' as dataset, 'modulo' as split, 'unknown' as target,
  round(avg(value), 6) as test_spearman, round(stddev_samp(value), 6) as test_spearman_std from scores
union all select 'game', 'old', 'orders', 'modulo', 'price', 0.5, 0.1""")
def leaderboard_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate documents published twice into a file that has other rows; of one key the last document stays."""
    folder = new_folder(spark, "leaderboard")
    _fold_documents(spark, sf_dir, f"{folder}/folds")
    V.aggregate_run(spark, f"{folder}/folds/*.json", f"{folder}/b_aggregated.json")
    doc = spark.read.text(f"{folder}/b_aggregated.json", wholetext=True).first()[0]
    doc = json.loads(doc)
    del doc["metadata"]["target"]
    K.write_document(doc, f"{folder}/docs/b_aggregated.json", spark)
    K.write_document(doc | {"test": {"spearman": 9.0}}, f"{folder}/docs/a_aggregated.json", spark)
    K.write_document({"test": {"spearman": 8.0}}, f"{folder}/docs/c_aggregated.json", spark)
    old = spark.createDataFrame([("game", "old", "orders", "modulo", "price", 0.5, 0.1)], "game string, model string, dataset string, split string, target string, test_spearman double, test_spearman_std double")
    K.write_csv(old, f"{folder}/board.csv")
    for _ in range(2):
        V.publish(spark, f"{folder}/docs", f"{folder}/board.csv", "game")
    board = R.read_csv(spark, f"{folder}/board.csv")
    return board.select("game", "model", "dataset", "split", "target", *[_r(F.col(c).cast("double")).alias(c) for c in ("test_spearman", "test_spearman_std")])


@query("select 'failed' as status, 'Prediction file not found: /nowhere' as error, 1 as n")
def missing_prediction_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "failed")
    V.evaluate(spark, "/nowhere", f"{folder}/out.json", f"{folder}/none", ["spearman"])
    doc = R.read_json_table(spark, f"{folder}/out.json", "status string, error string, spearman double")
    return doc.groupBy("status", "error").agg(F.count_if(F.col("spearman").isNull()).cast("int").alias("n"))


def _dataset(spark: SparkSession, sf_dir: str, folder: str) -> tuple[str, str]:
    """A dataset folder with five folds, and predictions for it."""
    truth, predicted, membership = _sides(spark, sf_dir)
    meta = spark.range(5).select(F.lit("modulo").alias("split"), F.col("id").cast("int").alias("fold"), F.create_map(F.lit("top_k"), F.lit("50")).alias("metadata"))
    member = membership.select(F.lit("modulo").alias("split"), "fold", F.lit(0).alias("assay_idx"), "record_idx")
    K.write_dataset(f"{folder}/orders.splits", truth.withColumn("var", F.lit(None).cast("string")), member, meta)
    predicted.drop("record_idx").write.parquet(f"{folder}/predictions")
    for name in ("orders.splits", "predictions"):
        write_text(spark, f"{folder}/{name}/manifest.json", json.dumps({"variables": [{"name": "var"}]}))
    return f"{folder}/orders.splits", f"{folder}/predictions"


@query(_MODES.replace("select mode, case", "select * from (select mode, case", 1) + ") where mode <> 'full_dataset'")
def evaluate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: files, declared variables, coverage by fold, document."""
    folder = new_folder(spark, "evaluate")
    dataset, predictions = _dataset(spark, sf_dir, folder)
    V.evaluate(spark, predictions, f"{folder}/out.json", dataset, ["spearman", "recovery"], "balance", "modulo", "price", 0)
    docs = R.read_score_docs(spark, f"{folder}/out.json")
    plain = V.long_scores(docs).select("mode", F.lit(-1).alias("fold"), "metric", "value")
    folds = docs.select(F.explode("per_fold").alias("f", "m")).select(F.lit("per_fold").alias("mode"), F.replace("f", F.lit("fold_")).cast("int").alias("fold"), F.explode("m").alias("metric", "value"))
    counts = _sides(spark, sf_dir)[2].groupBy("fold").count()
    n = F.when(F.col("mode") == "per_fold", F.col("own")).when(F.col("mode") == "test", F.col("first")).otherwise(F.col("all") - F.col("first"))
    whole = counts.agg(F.sum("count").alias("all"), F.sum(F.when(F.col("fold") == 0, F.col("count"))).alias("first"))
    rows = plain.unionByName(folds).join(counts.withColumnRenamed("count", "own"), "fold", "left").join(F.broadcast(whole))  # one row
    return rows.select("mode", "fold", "metric", _r("value").alias("value"), n.alias("n"))


# Tables and files


@query("select o_orderkey % 5 as fold, count(*) as n, sum(o_custkey) as customers from orders group by 1")
def dataset_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "dataset")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_idx"), F.col("o_custkey").alias("customer"))
    member = orders.select(F.lit("modulo").alias("split"), G.modulo_folds(F.col("record_idx"), 5).alias("fold"), F.lit(0).alias("assay_idx"), "record_idx")
    K.write_dataset(f"{folder}/orders.splits", orders, member, spark.createDataFrame([("modulo", 0, {})], "split string, fold int, metadata map<string,string>"))
    tables = R.read_dataset(spark, f"{folder}/orders.splits")
    return G.slice_records(tables["records"], tables["fold_membership"]).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.sum("customer").alias("customers"))


@query("select o_orderkey as row_id, o_totalprice as price from orders where o_orderkey % 5 = 3")
def predictions_partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions partitioned by model, split and fold, one fold written anew; the scan prunes."""
    folder = new_folder(spark, "predictions")
    rows = _orders(spark, sf_dir).select("row_id", F.col("yhat").alias("price"), F.lit("m").alias("model"), F.lit("modulo").alias("split"), "fold")
    K.write_predictions(rows, folder)
    K.write_predictions(_orders(spark, sf_dir).where("fold = 3").select("row_id", F.col("y").alias("price"), F.lit("m").alias("model"), F.lit("modulo").alias("split"), "fold"), folder)
    return R.read_predictions(spark, folder, "m", "modulo", 3).select("row_id", "price")


@query("select n_name as sequence, n_nationkey::double as price, n_regionkey as fold from nation")
def fold_predictions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "folds")
    by_fold: dict[int, list] = {}
    for r in _table(spark, sf_dir, "nation").collect():  # 25 rows
        by_fold.setdefault(r["n_regionkey"], []).append({"sequence": r["n_name"], "price": float(r["n_nationkey"])})
    for fold, rows in by_fold.items():
        write_text(spark, f"{folder}/fold_{fold}/predictions.json", json.dumps(rows))
    write_text(spark, f"{folder}/fold_7/other.json", "[]")
    return R.read_fold_predictions(spark, folder).select("sequence", F.col("price").cast("double").alias("price"), "fold")


@query("select p_partkey, p_name, p_retailprice from part")
def csv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'csv')}/part.csv"
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    K.write_csv(part, path)
    return R.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey from customer")
def csv_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    K.write_table_csv(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return R.read_csv(spark, path)


@query("""select n_name as name, n_name || '.splits' as input_filename, 'random' as split, t.target from nation, (select unnest(['a', 'b']) as target) t where n_regionkey = 1""")
def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog documents of two kinds of benchmark written, one read and filtered by split and names."""
    folder = new_folder(spark, "catalog")
    kinds = F.when(F.col("n_regionkey") < 3, F.array(F.lit("supervised"), F.lit("zero_shot"))).otherwise(F.array(F.lit("zero_shot")))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(".splits")).alias("input_filename"), F.array(F.lit("random"), F.lit("modulo")).alias("splits"), F.array(F.lit("a"), F.lit("b")).alias("targets"), kinds.alias("kinds"), "n_regionkey")
    K.write_catalogs(R.catalog_rows(rows).join(rows.select("name", "kinds"), "name"), folder, spark=spark)
    names = [r["name"] for r in rows.where("n_regionkey = 1").collect()]  # five
    return L.catalog_filter(R.read_catalog(spark, f"{folder}/supervised/datasets.json"), split="random", names=names)


@query("select n_name as slug from nation")
def slugs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "slugs")
    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").select("n_name").collect()]
    K.write_document({"datasets": names}, f"{folder}/datasets-list.json", spark)
    return R.read_slugs(spark, f"{folder}/datasets-list.json")


@query("""select lower(r_name) as slug, r_name as name, 'region ' || r_regionkey::varchar as tags, r_regionkey::varchar as size, 'About ' || r_name || '.' as overview from region""")
def model_cards_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "cards")
    for r in _table(spark, sf_dir, "region").collect():  # five
        front = f"name: {r['r_name']}\ntags: [region, \"{r['r_regionkey']}\"]\nhyper_parameters:\n  size: {r['r_regionkey']}\n"
        write_text(spark, f"{folder}/{r['r_name'].lower()}/README.md", f"---\n{front}---\n# {r['r_name']}\n\n> a note\n\nAbout {r['r_name']}.\n\nMore.\n")
    write_text(spark, f"{folder}/broken/README.md", "---\nname: [\n---\ntext")
    cards = R.read_cards(spark, f"{folder}/*/README.md")
    return cards.select("slug", "name", F.array_join("tags", " ").alias("tags"), X.map_get("hyper_parameters", "size", F.lit("none")).alias("size"), "overview")


@query("""select r_name as slug, 'kind' as key, 'region' as value, false as nested from region
union all select r_name, 'place', '{"key":' || r_regionkey::varchar || '}', true from region""")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "manifests")
    for r in _table(spark, sf_dir, "region").collect():
        write_text(spark, f"{folder}/{r['r_name']}.splits.toml", f"kind = \"region\"\n[place]\nkey = {r['r_regionkey']}\n")
    write_text(spark, f"{folder}/broken.toml", "= 1")
    return R.manifest_entries(R.read_manifests(spark, folder))


@query("select r_name || '.splits.pgdata' as name, r_regionkey::varchar as content from region")
def archive_members_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of an archive within an archive; those without it, and files that are none, are left out."""
    folder = new_folder(spark, "archives")

    def zipped(name: str, data: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    for r in _table(spark, sf_dir, "region").collect():
        write_text(spark, f"{folder}/{r['r_name']}.splits.pgdata", zipped("inner.zip", zipped("key.txt", str(r["r_regionkey"]).encode())))
    write_text(spark, f"{folder}/other.splits.pgdata", zipped("else.zip", b"x"))
    write_text(spark, f"{folder}/broken.splits.pgdata", b"no archive")
    found = R.read_archive_members(spark, folder, ("inner.zip", "key.txt"))
    return found.select(X.path_segment("path", -1).alias("name"), F.col("content").cast("string").alias("content"))


# Models and features


@query("select row_number() over (order by o_orderkey) - 1 as embedding_index, o_orderkey from orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.row_numbered(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("embedding_index", "o_orderkey")


@query("""select vec_id, round((select avg(e.embedding[1]::double) from embeddings e where e.label = v.label), 6) as first from embeddings v""")
def embedder_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings cached as a table, pooled by an embedder, and joined to the rows of their key."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    tokens = E.cached_embeddings(spark, f"{new_folder(spark, 'cache')}/tokens", lambda: rows.select("label", F.col("vec_id").alias("pos"), "embedding"))
    model = E.Embedder("mean", key="label").fit(tokens)
    return model.transform(rows.select("vec_id", "label")).select("vec_id", _r(F.col("features")[0]).alias("first"))


@query("""select label, round(embedding[1]::double, 6) as first from (
  select *, row_number() over (partition by label order by vec_id desc) as place from embeddings) where place = 2""")
def embedding_last_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    return E.last_pool(rows, "label", "pos").select("label", _r(F.col("pooled")[0]).alias("first"))


_TWO = """rows as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, 2 * embedding[1]::double - embedding[2]::double + sin(vec_id) / 10 as y from embeddings),
fitted as (select * from rows where vec_id % 5 <> 0),
m as (select count(*)::double as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_samp(a) as va, var_samp(b) as vb, covar_samp(a, b) as ab, covar_samp(a, y) as ay, covar_samp(b, y) as by_, stddev_samp(y) as sy from fitted)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("x"))
    return rows.withColumn("y", F.lit(2.0) * F.col("x")[0] - F.col("x")[1] + F.sin("vec_id") / F.lit(10.0))


@query(f"""with {_TWO}, s as (select *, va * (n - 1) + 0.5 as aa, vb * (n - 1) + 0.5 as bb, ab * (n - 1) as c, ay * (n - 1) as p, by_ * (n - 1) as q from m),
w as (select *, (p * bb - q * c) / (aa * bb - c * c) as wa, (q * aa - p * c) / (aa * bb - c * c) as wb from s)
select vec_id, round(my + wa * (a - ma) + wb * (b - mb), 5) as predicted from rows, w""")
def ridge_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(spark, sf_dir)
    return rows.select("vec_id", _r(fit_ridge(rows.where("vec_id % 5 <> 0"), "x", "y", alpha=0.5).predict("x"), 5).alias("predicted"))


@query(f"""with {_TWO}, s as (select *, sqrt(va) as sa, sqrt(vb) as sb, ay / sqrt(va) / sy as ra, by_ / sqrt(vb) / sy as rb, ab / sqrt(va) / sqrt(vb) as r from m),
u as (select *, ra / sqrt(ra * ra + rb * rb) as wa, rb / sqrt(ra * ra + rb * rb) as wb from s),
k as (select *, (wa * ra + wb * rb) / (wa * wa + wb * wb + 2 * wa * wb * r) as q from u)
select vec_id, round(my + sy * q * (wa * (a - ma) / sa + wb * (b - mb) / sb), 5) as predicted from rows, k""")
def pls_one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(spark, sf_dir)
    return rows.select("vec_id", _r(fit_pls(rows.where("vec_id % 5 <> 0"), "x", "y", components=1).predict("x"), 5).alias("predicted"))


@query(f"""with {_PAIRS}, t as (select row_id, fold, length(row_id::varchar)::double as size, y from pairs),
m as (select avg(size) as ms, avg(y) as my, covar_samp(size, y) as c, var_samp(size) as v from t where fold <> 2)
select fold = 2 as test, count(*) as n from t, m group by 1""")
def train_predict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered model fitted on the training folds writes a prediction for each record."""
    truth, _, membership = _sides(spark, sf_dir)
    out = V.train_predict(truth, membership, "ridge", "price", 2, alpha=1.0)
    return out.where(F.col("price").isNotNull()).groupBy((F.col("split") == "test").alias("test")).agg(F.count("*").alias("n"))


@query("select event_type as first from events where event_type <> 'view' order by event_id limit 1")
def wild_type_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    records = events.select(F.col("event_id").alias("record_idx"), F.col("event_type").alias("sequence"), F.when(F.col("event_type") != "view", "WILD_TYPE").otherwise("OTHER").alias("type"))
    return spark.range(1).select(F.lit(M.wild_type(records)).alias("first"))


@query("""with r as (select p_partkey, i as pos, lpad(p_partkey::varchar, 8, '0')[i + 1] as aa from part, range(0, 8) t(i)),
c as (select pos, aa, count(*)::double as n from r group by all), l as (select pos, aa, n - m - ln(sum(exp(n - m)) over (partition by pos)) as logp from (select *, max(n) over (partition by pos) as m from c))
select p_partkey as id, round(sum(logp), 4) as score from r join l using (pos, aa) where pos between 1 and 6 group by 1""")
def pseudo_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("sequence"))
    letters = rows.select("id", F.posexplode(X.residues("sequence")).alias("pos", "aa"))
    logp = M.log_probabilities(letters.groupBy("pos", "aa").agg(F.count("*").cast("double").alias("logit")))
    table = letters.join(logp, ["pos", "aa"]).select("id", "pos", "aa", "logp")
    return M.marginal_scores("pseudo-ppl", logp=table, sequences=rows, key="id", compat=True).select("id", _r("score", 4).alias("score"))


@query("select event_id, round(rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double, 1) as rank from events")
def average_rank_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_average_rank(_table(spark, sf_dir, "events").select("event_id", "value"), "value").select("event_id", F.round("rank", 1).alias("rank"))


# Catalog pages


@query("select c_custkey, c_name from customer where contains(lower(c_name), '00001') or contains(lower('segment ' || c_mktsegment || ' nation ' || c_nationkey::varchar), 'nation 7')")
def dataset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    rows = _table(spark, sf_dir, "customer").withColumn("tags", tags)
    for_name = L.search_any(rows, "00001", F.col("c_name"))
    return for_name.unionByName(L.search_any(rows, "NATION 7", X.map_text("tags"))).select("c_custkey", "c_name").distinct()


@query("select s_suppkey, s_name as slug from supplier where s_suppkey = 7")
def lookup_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("slug"))
    return L.lookup(rows, rows.where("s_suppkey = 7").first()["slug"])


@query("select p_partkey from part where p_brand = 'Brand#11' or p_type = 'Brand#11'")
def catalog_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags"), F.col("p_name").alias("name"))
    return L.catalog_filter(rows, tag="Brand#11").select("p_partkey")


@query("""select event_id, 'fold_' || (event_id % 5)::varchar as label, event_type || '/' || printf('%.2f', value) as path, 'id,k,type' as keys, coalesce(case when event_id % 3 = 0 then event_type end, 'unknown') as known,
  'id=' || event_id::varchar as kept, 'none' as absent, 'temp,ph' as variables, '3,4' as page from events""")
def map_and_label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("type"), F.col("event_type"), F.lit("id"), F.col("event_id").cast("string"), F.lit("k"), F.lit("1"))
    events = _table(spark, sf_dir, "events").withColumn("m", meta)
    kept = X.without_keys("m", "type", "k")
    declared = F.array(F.struct(F.lit("temp").alias("name")), F.struct(F.lit("ph").alias("name")))
    return events.select(
        "event_id", X.label("fold_%d", F.col("event_id") % 5).alias("label"), X.label("%s/%.2f", "event_type", "value").alias("path"), F.array_join(X.key_set("m"), ",").alias("keys"),
        X.filled_or(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("known"), F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"),
        X.map_get("m", "gone", F.lit("none")).alias("absent"), F.array_join(X.names_of(declared), ",").alias("variables"),
        F.array_join(X.page_slice(F.array(*[F.lit(str(i)) for i in range(1, 6)]), 2, 2), ",").alias("page"),
    )


@query("""select * from (values (1, 'v', 'asc', 1), (2, 'v', 'desc', 1), (3, null, null, 1), (4, 'w', 'asc', 1), (5, 'v', 'asc', 4), (6, 'v', 'asc', 1)) t(step, sorted, direction, page)""")
def view_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorting by turns, another column, a page beyond the last, and a filter that goes back to the first page."""
    one = L.View(page=3).toggle("v")
    states = [one, one.toggle("v"), one.toggle("v").toggle("v"), one.toggle("w"), one.turn(9, 4), one.turn(9, 4).with_filter("v", "x")]
    return spark.createDataFrame([(i, s.column, s.direction, s.page) for i, s in enumerate(states, 1)], "step int, sorted string, direction string, page int")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O')")
def concat_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    parts = [orders.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice") for s in ("F", "O")]
    return G.shuffled(L.concat_strict(*parts), 7)


@query("select 'spearman' as metric, true as known, true as same_variables union all select 'absent', false, false")
def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        known = known_metrics(["spearman", "absent"])
    out = []
    for name, given in (("spearman", ["a"]), ("absent", ["b"])):
        try:
            check_variables(["a"], given)
            same = True
        except ValueError:
            same = False
        out.append((name, name in known and name in REGISTRY, same))
    return spark.createDataFrame(out, "metric string, known boolean, same_variables boolean")


@query("select c_custkey, c_name from customer order by c_name desc, c_custkey limit 10 offset 20")
def collated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return L.page(L.sorted_rows(rows, "c_name", "desc", "c_custkey"), 3)


