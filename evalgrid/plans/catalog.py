"""Queries of the driver contract for the evaluation operators, with their SQL.

Truth and predictions stand in as columns of the driver's tables: orders with the customer's
balance as prediction, events by type, documents against labels, embeddings as features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions import columns as X
from evalgrid.models.features import mean_pool, with_one_hot
from evalgrid.models.linear import fit_pls, fit_ridge
from evalgrid.models.marginal import difference_scores, log_probabilities
from evalgrid.operators import folds as G
from evalgrid.operators import leaderboard as L
from evalgrid.operators.aggregate import aggregate, flatten_wide
from evalgrid.operators.metrics import average_rank, score
from evalgrid.operators.modes import score_modes
from evalgrid.operators.scoring import join_keys, missing_count, missing_keys, predictions_delta, scoring_frame, unmatched_predictions
from evalgrid.sources.readers import catalog_rows, job_matrix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth o_totalprice and prediction c_acctbal by order, in five folds."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    rows = orders.join(customer, "o_custkey")
    return rows.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("yhat"), G.modulo_folds(F.col("o_orderkey"), 5).alias("fold"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same as records, predictions and fold membership."""
    rows = _orders(spark, sf_dir)
    key = F.col("row_id").cast("string").alias("sequence")
    return (
        rows.select(F.col("row_id").alias("record_idx"), key, F.col("y").alias("price")),
        rows.select(F.col("row_id").alias("record_idx"), key, F.col("yhat").alias("price")),
        rows.select(F.col("row_id").alias("record_idx"), "fold"),
    )


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_PAIRS = """pairs as (
  select o_orderkey as row_id, o_totalprice as y, c_acctbal as yhat, cast(o_orderkey % 5 as integer) as fold
  from orders join customer on o_custkey = c_custkey)"""


def _ranks(source: str, by: str) -> str:
    return f"""ranked as (
  select *, rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0::double as ry,
    rank() over (partition by {by} order by yhat) + (count(*) over (partition by {by}, yhat) - 1) / 2.0::double as rp,
    row_number() over (partition by {by} order by y desc, row_id desc) as py,
    row_number() over (partition by {by} order by yhat desc, row_id desc) as pp
  from {source})"""


# Scoring


@query(f"""with {_PAIRS}, {_ranks("pairs", "fold")}
select fold, count(*) as n, round(corr(ry, rp), 6) as spearman from ranked group by fold""")
def score_spearman_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_orders(spark, sf_dir), ["spearman"], ["fold"]).select("fold", "n", _r("spearman").alias("spearman"))


@query(f"""with {_PAIRS}, {_ranks("pairs", "fold")}
select fold, round(count(*) filter (py <= 100 and pp <= 100) / 100.0::double, 6) as recovery from ranked group by fold""")
def score_recovery_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("top_k", F.lit(100))
    return score(rows, ["recovery"], ["fold"]).select("fold", _r("recovery").alias("recovery"))


_MODES = f"""with {_PAIRS}, groups as (
  select 'per_fold' as mode, fold as grp, row_id, y, yhat from pairs
  union all select 'test', -1, row_id, y, yhat from pairs where fold = 0
  union all select 'train_available', -1, row_id, y, yhat from pairs where fold <> 0
  union all select 'full_dataset', -1, row_id, y, yhat from pairs), {_ranks("groups", "mode, grp")},
scored as (
  select mode, grp, count(*) as n, corr(ry, rp) as rho, count(*) filter (py <= 50 and pp <= 50) / 50.0::double as rec from ranked group by mode, grp)
select mode, case when mode = 'per_fold' then grp else -1 end as fold, 'spearman' as metric, round(rho, 6) as value, n from scored
union all
select mode, case when mode = 'per_fold' then grp else -1 end, 'recovery', case when mode in ('test', 'per_fold') then round(rec, 6) end, n from scored"""


def _all_modes(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    truth, predicted, membership = _sides(spark, sf_dir)
    meta = membership.select("fold").distinct().withColumn("top_k", F.lit(50))
    modes = ("test", "train_available", "per_fold", "full_dataset")
    return score_modes(truth, predicted, membership, "price", 0, ["spearman", "recovery"], modes, meta, plan=plan).withColumns({"value": _r("value"), "fold": F.coalesce("fold", F.lit(-1))})


@query(_MODES)
def score_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_modes(spark, sf_dir, "auto")


@query(_MODES)
def score_all_modes_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_modes(spark, sf_dir, "compat")


@query(f"""with {_PAIRS}, member as (
  select row_id, fold from pairs union all select row_id, 5 from pairs), groups as (
  select 'per_fold' as mode, a.fold as grp, p.row_id, p.y, p.yhat from pairs p join member a on a.row_id = p.row_id
  union all
  select 'train_available', -1, p.row_id, p.y, p.yhat from pairs p join member a on a.row_id = p.row_id and a.fold <> 0 join member b on b.row_id = p.row_id and b.fold <> 0),
{_ranks("groups", "mode, grp")}
select mode, case when mode = 'per_fold' then grp else -1 end as fold, 'spearman' as metric, round(corr(ry, rp), 6) as value, count(*) as n from ranked group by mode, grp""")
def score_overlapping_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted, membership = _sides(spark, sf_dir)
    member = membership.unionByName(membership.withColumn("fold", F.lit(5)))
    return score_modes(truth, predicted, member, "price", 0, ["spearman"], ("train_available", "per_fold")).withColumns({"value": _r("value"), "fold": F.coalesce("fold", F.lit(-1))})


@query(f"""with {_PAIRS}, {_ranks("(select *, 0 as g from pairs)", "g")}
select 'full_dataset' as mode, round(corr(ry, rp), 6) as spearman, count(*) as n from ranked""")
def score_full_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted, membership = _sides(spark, sf_dir)
    scores = score_modes(truth, predicted, membership, "price", None, ["spearman"], ("full_dataset",))
    return scores.select("mode", _r("value").alias("spearman"), "n")


@query("""select event_type, event_id, round(rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0::double, 1) as rank
from events""")
def spearman_ties_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return average_rank(events, "value", ["event_type"]).select("event_type", "event_id", F.round("rank", 1).alias("rank"))


@query("select event_type, count(*) as n, true as undefined from events group by event_type")
def spearman_constant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("row_id"), F.col("value").alias("y"), F.lit(5.0).alias("yhat"))
    return score(rows, ["spearman"], ["event_type"]).select("event_type", "n", F.isnan("spearman").alias("undefined"))


@query("select event_type, count(*) as n, count(*) filter (event_id % 100 = 0) > 0 as undefined from events group by event_type")
def spearman_nan_propagates(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 2)
    rows = _table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("row_id"), F.col("value").alias("y"), value.alias("yhat"))
    return score(rows, ["spearman"], ["event_type"]).select("event_type", "n", F.isnan("spearman").alias("undefined"))


# Joins and coverage


def _doc_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sequence"), "lang", "source", F.col("n_chars").cast("double").alias("size"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("q"))
    return docs, docs.join(labels, "doc_id").select("doc_id", "sequence", "lang", "source", F.col("q").alias("size"))


@query("""with p as (select d.text, d.lang, d.source, l.quality from documents d join labels l using (doc_id))
select d.doc_id, d.n_chars::double as size, p.quality::double as size_pred from documents d join p on d.text = p.text and d.lang = p.lang and d.source = p.source""")
def scoring_frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pred = _doc_sides(spark, sf_dir)
    keys = join_keys(docs, pred, ["lang", "source"])
    return scoring_frame(docs, pred, "size", keys, ["doc_id"]).select("doc_id", "size", "size_pred")


@query("""with p as (select d.text from documents d join labels l using (doc_id))
select count(*) as rows_joined, count(distinct d.doc_id) as docs_joined from documents d join p on d.text = p.text""")
def scoring_join_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pred = _doc_sides(spark, sf_dir)
    joined = scoring_frame(docs, pred, "size", ["sequence"], ["doc_id"])
    return joined.agg(F.count("*").alias("rows_joined"), F.countDistinct("doc_id").alias("docs_joined"))


@query("""with p as (select d.text from documents d join labels l using (doc_id))
select greatest((select count(*) from documents) - (select count(*) from documents d join p on d.text = p.text), 0)::bigint as missing""")
def coverage_missing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pred = _doc_sides(spark, sf_dir)
    missing = missing_count(docs, scoring_frame(docs, pred, "size", ["sequence"]))
    return spark.range(1).select(F.lit(missing).cast("long").alias("missing"))


@query("""with p as (select distinct d.text, d.lang, d.source from documents d join labels l using (doc_id))
select doc_id from documents d where not exists (select 1 from p where p.text = d.text and p.lang = d.lang and p.source = d.source)""")
def coverage_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pred = _doc_sides(spark, sf_dir)
    return missing_keys(docs, pred, ["sequence", "lang", "source"]).select("doc_id")


@query("""with t as (select doc_id, text, case when doc_id % 2 = 0 then lang end as var from documents)
select a.doc_id from t a join (select * from t where doc_id in (select doc_id from labels)) b on a.text = b.text and a.var = b.var""")
def join_keys_partly_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sequence"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("var"), F.lit(None).cast("string").alias("gone"), F.lit(1.0).alias("t"))
    pred = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    keys = join_keys(docs, pred, ["var", "gone", "absent"])  # an all-null variable is no key, a partly null one is
    return scoring_frame(docs, pred, "t", keys, ["doc_id"]).select("doc_id")


@query("select cast(o_orderkey as varchar) as sequence, o_custkey as customer, round(o_totalprice * 2, 2) as price from orders where o_orderstatus = 'F'")
def predictions_delta_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sequence"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))
    finished = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    some = finished.select(F.col("o_orderkey").cast("string").alias("sequence"), F.round(F.col("o_totalprice") * 2, 2).alias("price"))
    return predictions_delta(records, some, "price").select("sequence", "customer", "price")


@query("select count(*) as extra from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def predictions_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("sequence"))
    return unmatched_predictions(records, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sequence"))).agg(F.count("*").alias("extra"))


# Folds


@query("select cast(o_orderkey % 5 as integer) as fold, count(*) as n, min(o_orderkey) as lowest from orders group by 1")
def fold_membership_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", G.modulo_folds(F.col("o_orderkey"), 5).alias("fold"))
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lowest"))


@query("""select o_orderstatus, fold, count(*) as n, min(o_orderkey) as lowest from (
  select *, cast(ntile(5) over (partition by o_orderstatus order by o_orderkey) - 1 as integer) as fold from orders) group by 1, 2""")
def fold_membership_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.contiguous_folds(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, ("o_orderstatus",))
    return rows.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lowest"))


@query("select 'all' as split, cast(p_size % 5 as integer) as fold, cast(p_partkey % 10 as integer) as record_idx, count(*) as n from part group by 2, 3")
def fold_masks_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.lit("all").alias("split"), (F.col("p_size") % 5).cast("int").alias("fold"), F.lit(0).alias("assay_idx"), X.bool_mask(F.lit(10), F.array((F.col("p_partkey") % 10).cast("int"))).alias("mask"))
    return G.membership_from_masks(part).groupBy("split", "fold", "record_idx").agg(F.count("*").alias("n"))


@query("select o_orderkey as record_idx, case when o_orderkey % 5 = 2 then 'test' else 'train' end as split, o_totalprice as target from orders where o_orderkey % 7 <> 0")
def train_test_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    records = orders.select(F.col("o_orderkey").alias("record_idx"), price.alias("price"))
    membership = orders.select(F.col("o_orderkey").alias("record_idx"), G.modulo_folds(F.col("o_orderkey"), 5).alias("fold"))
    return G.train_test(records, membership, "price", 2).select("record_idx", "split", "target")


@query("""select 'modulo' as split, list_sort(list(distinct cast(o_orderkey % 5 as integer)))::varchar as folds, count(distinct o_orderkey % 5) as total_folds from orders""")
def fold_index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.lit("modulo").alias("split"), G.modulo_folds(F.col("o_orderkey"), 5).alias("fold"))
    return G.fold_indices(rows).select("split", F.concat(F.lit("["), F.array_join(F.col("folds").cast("array<string>"), ", "), F.lit("]")).alias("folds"), "total_folds")


@query("select event_id, try_cast(trunc(try_cast(json_extract_string(props, '$.k') as double)) as integer) as top_k from events")
def topk_metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", X.json_top_k("props", "k").alias("top_k"))


# Aggregates and the leaderboard


_FOLD_SCORES = f"with {_PAIRS}, {_ranks('pairs', 'fold')}, scores as (select fold, corr(ry, rp) as value from ranked group by fold)"


@query(f"""{_FOLD_SCORES} select 'test' as mode, 'spearman' as metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(*) as n_values from scores""")
def aggregate_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score(_orders(spark, sf_dir), ["spearman"], ["fold"]).select(F.lit("test").alias("mode"), F.lit("spearman").alias("metric"), F.col("spearman").alias("value"))
    return aggregate(scores).select("mode", "metric", _r("mean").alias("mean"), _r("std").alias("std"), "n_values")


@query("""select o_orderpriority as metric, round(avg(v), 6) as mean, case when count(v) = 1 then 0.0::double else round(stddev_samp(v), 6) end as std, count(v) as n_values
from (select o_orderpriority, case when o_orderkey % 3 = 0 then null else o_totalprice end as v from orders
  union all select 'single', max(o_totalprice) from orders union all select 'empty', null) group by 1 having count(v) > 0""")
def aggregate_single_fold_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderpriority").alias("metric"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("value"))
    rows = rows.unionByName(orders.agg(F.max("o_totalprice").alias("value")).withColumn("metric", F.lit("single"))).unionByName(spark.sql("select 'empty' as metric, cast(null as double) as value"))
    return aggregate(rows, ["metric"]).select("metric", _r("mean").alias("mean"), _r("std").alias("std"), "n_values")


@query("""select o_orderstatus as model, round(avg(o_totalprice) filter (o_orderkey % 2 = 0), 4) as test_price, round(stddev_samp(o_totalprice) filter (o_orderkey % 2 = 0), 4) as test_price_std,
  round(avg(o_totalprice) filter (o_orderkey % 2 = 1), 4) as full_dataset_price from orders group by 1""")
def metrics_flatten_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("o_orderkey") % 2 == 0, "test").otherwise("full_dataset")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), mode.alias("mode"), F.lit("price").alias("metric"), F.col("o_totalprice").alias("value"))
    wide = flatten_wide(aggregate(rows, ["model", "mode", "metric"]), ["model"], ["test_price", "test_price_std", "full_dataset_price"])
    return wide.select("model", *[_r(c, 4).alias(c) for c in ("test_price", "test_price_std", "full_dataset_price")])


@query("""with e as (select o_custkey as k, o_orderkey as seq, o_totalprice as v, cast(null as double) as extra, 0 as new from orders),
n as (select c_custkey, 0, c_acctbal, c_acctbal * 2, 1 from customer where c_mktsegment = 'BUILDING')
select k, v, extra from (select *, row_number() over (partition by k order by new desc, seq desc) as p from (select * from e union all select * from n)) where p = 1""")
def leaderboard_upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"))
    new = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.lit(0).alias("seq"), F.col("c_acctbal").alias("v"), (F.col("c_acctbal") * 2).alias("extra"))
    return L.upsert(existing, new, ["k"], "seq").select("k", "v", "extra")


@query("""select p_partkey, p_brand, p_retailprice from part where contains(lower(p_brand), 'brand#1') and contains(lower(p_type), 'a')
order by p_retailprice desc, p_partkey limit 10 offset 10""")
def leaderboard_filter_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = L.View().with_filter("p_brand", "BRAND#1").with_filter("p_type", "A").toggle("p_retailprice").toggle("p_retailprice").turn(2, 100)
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return L.leaderboard(part.withColumn("p_retailprice", F.col("p_retailprice")), view, "p_partkey", ["p_retailprice"]).select("p_partkey", "p_brand", "p_retailprice")


@query("select o_orderstatus, cast(ceil(count(*) / 12.0) as bigint) as pages from orders group by 1")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(X.page_count(F.count("*"), 12).alias("pages"))


@query("select p_partkey from part where contains(lower(p_name), 'a1') or contains(lower(p_brand || ' ' || p_type), '#2')")
def search_name_or_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("tags", F.array("p_brand", "p_type"))
    found = [L.search_any(part, "A1", F.col("p_name")), L.search_any(part, "#2", F.array_join("tags", " "))]
    return found[0].select("p_partkey").union(found[1].select("p_partkey")).distinct()


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as p from events) where p = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return L.latest_per_key(events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("select cast(c_custkey as varchar) as id, c_acctbal::double as v from customer union all select s_name, s_suppkey::double from supplier")
def concat_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.col("s_suppkey").alias("v"))
    return L.concat_relaxed(customer, supplier)


@query("select c_custkey as k, c_mktsegment as seg, cast(null as varchar) as name from customer union all select s_suppkey, null, s_name from supplier")
def concat_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    return L.concat_relaxed(customer, _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), diagonal=True)


@query("""select p_size, count(*) filter (a <= 5 and b <= 5) as shared from (
  select p_size, row_number() over (partition by p_size order by p_retailprice desc, p_partkey desc) as a, row_number() over (partition by p_size order by p_partkey % 97 desc, p_partkey desc) as b from part)
group by p_size having count(*) >= 5""")
def topk_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_size", F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97).alias("yhat"))
    sizes = rows.groupBy("p_size").count().where("count >= 5").select("p_size")
    scored = score(rows.join(sizes, "p_size").withColumn("top_k", F.lit(5)), ["recovery"], ["p_size"])
    return scored.select("p_size", F.round(F.col("recovery") * 5).cast("long").alias("shared"))


# Catalogs


@query("select n_name as dataset, r_name as model, f.fold from nation, region, (select unnest([0, 1, 2, 3, 4]) as fold) f")
def job_matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"))
    region = _table(spark, sf_dir, "region").select(F.col("r_name").alias("model"))
    return job_matrix(nation, region, spark.range(5).select(F.col("id").cast("int").alias("fold")))


@query("select n_name as name, n_name || '.splits' as input_filename, s.split, t.target from nation, (select unnest(['random', 'modulo']) as split) s, (select unnest(['a', 'b', 'c']) as target) t")
def job_rows_split_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(".splits")).alias("input_filename"), F.array(F.lit("random"), F.lit("modulo")).alias("splits"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("targets"))
    return catalog_rows(splits)


@query("select split, count(*) as jobs, count(distinct name) as datasets from (select n_name as name, unnest(['random', 'modulo']) as split from nation) group by split")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(F.array(F.lit("random"), F.lit("modulo"))).alias("split"))
    return L.catalog_counts(rows)


# Scalars


@query("""select p_partkey, coalesce(try_cast(nullif(regexp_extract(p_name, '^\\s*([+-]?(\\d+\\.?\\d*))', 1), '') as double), -1) as head,
  printf('%.4f', p_retailprice) as price, p_brand as brand from part""")
def parse_float_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = X.parse_float("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", F.when(F.isnan(head), F.lit(-1.0)).otherwise(head).alias("head"), X.fixed(F.col("p_retailprice").cast("string")).alias("price"), X.fixed("p_brand").alias("brand"))


@query("""select o_orderkey, 'X' || o_orderkey::varchar as label, o_orderpriority as segment, 'price model' as title from orders""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), "o_orderpriority", F.lit("/X"), F.col("o_orderkey").cast("string"), F.lit(".splits.pgdata"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.dataset_label(path).alias("label"), X.path_segment(path, 3).alias("segment"), X.title(F.lit("price_model")).alias("title"))


# Sequences and models


_LETTERS = "translate(regexp_replace(c_mktsegment, '[^A-Z]', '', 'g'), 'BJOUXZ', 'ADEFGH')"


@query(f"""with s as (select {_LETTERS} as letters from customer), p as (select letters[i] as aa, i from s, range(1, 30) t(i) where i <= length(letters))
select cast(i - 1 as integer) as pos, aa, count(*)::double as n from p group by all""")
def sequence_onehot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.translate(F.regexp_replace("c_mktsegment", "[^A-Z]", ""), "BJOUXZ", "ADEFGH")
    rows = with_one_hot(_table(spark, sf_dir, "customer").select(letters.alias("sequence")))
    flat = rows.select(F.posexplode("features").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("n")).where("n > 0")
    width = len(X.AMINO_ACIDS)
    return flat.select(F.floor(F.col("at") / width).cast("int").alias("pos"), F.substring(F.lit(X.AMINO_ACIDS), F.col("at") % width + 1, F.lit(1)).alias("aa"), "n")


@query("""select p_partkey, (select count(*) from range(1, 9) t(i) where a[i] <> b[i]) as hamming from (
  select p_partkey, lpad(p_partkey::varchar, 8, '0') as a, lpad((p_partkey * 7 % 10007)::varchar, 8, '0') as b from part)""")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c: F.lpad(c.cast("string"), 8, "0")
    part = _table(spark, sf_dir, "part").select("p_partkey", pad(F.col("p_partkey")).alias("a"), pad(F.col("p_partkey") * 7 % 10007).alias("b"))
    return part.select("p_partkey", X.hamming("a", "b").cast("long").alias("hamming"))


@query("""select p_partkey, list_aggregate([i for i in range(1, 9) if a[i] <> b[i]], 'string_agg', ',') as places from (
  select p_partkey, lpad(p_partkey::varchar, 8, '0') as a, lpad((p_partkey * 7 % 10007)::varchar, 8, '0') as b from part)""")
def sequence_diff_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c: F.lpad(c.cast("string"), 8, "0")
    part = _table(spark, sf_dir, "part").select("p_partkey", pad(F.col("p_partkey")).alias("a"), pad(F.col("p_partkey") * 7 % 10007).alias("b"))
    found = F.array_join(X.differing_positions("a", "b").cast("array<string>"), ",")
    return part.select("p_partkey", F.when(found != "", found).alias("places"))


@query("""with d as (select p_partkey, lpad(p_partkey::varchar, 8, '0') as s from part), r as (select p_partkey, i as pos, s[i] as aa from d, range(1, 9) t(i)),
c as (select pos, aa, count(*)::double as logit from r group by all), l as (
  select pos, aa, logit - max(logit) over (partition by pos) - ln(sum(exp(logit - m)) over (partition by pos)) as logp from (select *, max(logit) over (partition by pos) as m from c)),
w as (select pos, aa from r where p_partkey = 1)
select r.p_partkey as id, round(sum(case when r.aa <> w.aa then a.logp - b.logp else 0.0::double end), 4) as score
from r join w using (pos) join l a on a.pos = r.pos and a.aa = r.aa join l b on b.pos = w.pos and b.aa = w.aa group by 1""")
def marginal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    mutants = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("sequence"))
    letters = mutants.select(F.posexplode(X.residues("sequence")).alias("pos", "aa")).withColumn("pos", F.col("pos") + 1)
    logp = log_probabilities(letters.groupBy("pos", "aa").agg(F.count("*").cast("double").alias("logit"))).select("pos", "aa", "logp")
    return difference_scores(mutants, "00000001", logp, "id").select("id", _r("score", 4).alias("score"))


@query("""select label, i - 1 as dim, round(avg(embedding[i]::double), 6) as v from embeddings, range(1, 65) t(i) group by all""")
def embedding_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return mean_pool(rows, "label").select("label", F.posexplode("pooled").alias("dim", "v")).select("label", F.col("dim").cast("long").alias("dim"), _r("v").alias("v"))


@query("""select vec_id, round(list_sum([x::double for x in list_concat(embedding, list_reverse(embedding))]), 4) as total, (2 * len(embedding))::bigint as size from embeddings""")
def embedding_concat_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("embedding", F.reverse("embedding")).cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select("vec_id", _r(X.array_sum(both), 4).alias("total"), F.size(both).cast("long").alias("size"))


@query("""select event_type, event_id, round(value - m - ln(s), 6) as logp from (
  select *, sum(exp(value - m)) over (partition by event_type) as s from (select *, max(value) over (partition by event_type) as m from events))""")
def log_softmax_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").alias("logit"))
    return log_probabilities(rows, ("event_type",)).select("event_type", "event_id", _r("logp").alias("logp"))


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.withColumn("y", F.lit(2.0) * F.col("x")[0] - F.col("x")[1] + F.sin("vec_id") / F.lit(10.0)).withColumn("fold", F.pmod("vec_id", F.lit(5)).cast("int"))


def _fitted(spark: SparkSession, sf_dir: str, fit: Callable) -> DataFrame:
    rows = _labelled_vectors(spark, sf_dir)
    model = fit(rows.where("fold <> 0"), "x", "y")
    return rows.select("vec_id", "fold", "y", _r(model.predict("x")).alias("predicted"))


@query()
def ridge_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, fit_ridge)


@query()
def pls_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, fit_pls)


@query("""select doc_id, coalesce(trim([x for x in string_split(text, chr(10)) if not regexp_matches(x, '^[ \t\x0b\f\r]*(#|>|$)')][1], ' '), '') as overview from documents""")
def front_matter_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.concat(F.lit("# Title\n\n> note\n\n"), F.regexp_replace("text", r"\n+", "\n\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.overview(card).alias("overview"))
