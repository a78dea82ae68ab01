"""Queries of boosting, validation and stored models; with the SQL of one round, whose results can be stated in full."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import draws
from terravane.operators import boosting, models, ranking
from terravane.plans import views
from terravane.plans.catalog import query
from terravane.sources import readers, shared, writers

#: So many levels that every distinct value of the rankings' features but the largest is a threshold, as SQL states them.
ALL = 64

_LINES = """l as (select l_orderkey as q, l_partkey * 100000 + l_suppkey as doc, min(l_extendedprice)::double as t, min(l_quantity)::double as x, min(l_discount)::double as y, min(l_tax)::double as z from lineitem group by 1, 2)"""
_BINS = f"""{_LINES},
o as (select q, doc, t, unnest([0, 1, 2]) as feature, unnest([x, y, z]) as v from l),
b as (select *, dense_rank() over (partition by feature order by v) - 1 as bin from o),
n as (select x.q, count(*) as pairs from l x join l y on x.q = y.q and x.t < y.t group by 1),
h as (select x.feature, x.bin as bin_i, y.bin as bin_j, sum(0.5e0 / pairs) as g, sum(1e0 / pairs) as h from b x join b y on x.q = y.q and x.feature = y.feature and x.t < y.t join n on n.q = x.q group by all)"""
_SPLITS = f"""{_BINS},
k as (select feature, v as threshold, bin as k, row_number() over (partition by feature order by bin desc) as down from (select distinct feature, v, bin from b)),
s as (select h.feature, k, threshold, coalesce(sum(g) filter (where bin_j > k and bin_i <= k), 0) - coalesce(sum(g) filter (where bin_i > k and bin_j <= k), 0) as a, coalesce(sum(h) filter (where (bin_i > k) <> (bin_j > k)), 0) as m
  from h join k on h.feature = k.feature where down > 1 group by all),
f as (select feature, k, threshold, case when m = 0 then 0 else -a * a / m end as score, case when m = 0 then 0 else a / (2 * m) end as leaf from s)"""


def _lines(spark, d) -> DataFrame:
    """Orders as lists of their parts by supplier, each of which an order has once."""
    x = views.table(spark, d, "lineitem")
    one = lambda c: F.min(c).cast("double")
    own = x.groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("doc_id"))
    return own.agg(one("l_extendedprice").alias("target"), F.array(one("l_quantity"), one("l_discount"), one("l_tax")).alias("features"))


def _round(spark, d) -> tuple[DataFrame, dict]:
    """Pairs of orders before any tree, in bins of every distinct value."""
    docs = _lines(spark, d).withColumn("model", F.lit(0))
    borders = boosting.model_borders(docs, ALL)
    return boosting.first_round(docs, None, borders), borders


@query(f"with {_BINS} select feature, bin_i::int as bin_i, bin_j::int as bin_j, round(g, 9) as g, round(h, 9) as h from h")
def gradient_histogram(spark, d):
    """Sums of gradients over the pairs of all orders, by the bins of both documents."""
    rows, _ = _round(spark, d)
    return boosting.histogram(rows).select("feature", "bin_i", "bin_j", F.round("g", 9).alias("g"), F.round("h", 9).alias("h"))


@query(f"with {_SPLITS} select feature, threshold, round(score, 6) as score, round(-leaf, 9) as low, round(leaf, 9) as high from f")
def split_scores(spark, d):
    """Score and leaf values of every first split."""
    rows, borders = _round(spark, d)
    found = boosting.best_splits(boosting.histogram(rows), 0, {m: [len(t) for t in own] for m, own in borders.items()}, every=True)
    table = spark.createDataFrame([(f, k, t) for f, ts in enumerate(borders[0]) for k, t in enumerate(ts)], "feature int, rank int, threshold double")
    return found.join(F.broadcast(table), ["feature", "rank"]).select("feature", "threshold", F.round("score", 6).alias("score"), F.round(F.col("leaves")[0], 9).alias("low"), F.round(F.col("leaves")[1], 9).alias("high"))


@query(f"""with {_SPLITS}, t as (select feature, threshold, leaf from f order by round(score, 12), feature, k limit 1),
p as (select q, doc, 0.5e0 * case when [x, y, z][feature + 1] > threshold then leaf else -leaf end as s from l, t)
select -1::bigint as query_id, count(distinct q) || ' 1' as value from p union all select q, string_agg(s::decimal(18, 9)::varchar, ' ' order by doc) from p group by 1""")
def trained_predictions(spark, d):
    """Trains a tree, stores it, loads it and writes the predictions file, whose lines come back."""
    home, docs = shared.work_dir(spark, "trained"), _lines(spark, d)
    model = boosting.fit(docs, boosting.Settings(iterations=1, step=0.5, depth=1, levels=ALL))
    models.save(models.as_rows(spark, {0: model}), f"{home}/models", 1)
    loaded = models.load(spark, f"{home}/models")
    scored = models.staged(docs, loaded).withColumn("staged", F.transform("staged", lambda s: s.cast("decimal(18,9)")))
    writers.write_predictions(scored, f"{home}/predictions")
    # A line doesn't name its query; the file has them in order.
    lines = spark.read.text(f"{home}/predictions").select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("at"))
    head = spark.read.text(f"{home}/predictions").select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("at")).orderBy("file_name", "at").limit(1).select(F.lit(-1).cast("long").alias("query_id"), "value")
    own = scored.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col("staged")[0].alias("s")))), lambda x: x["s"].cast("string")), " ").alias("value"))
    counted = lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return head.unionByName(own.join(counted, "value").select("query_id", "value"))


def _areas(spark, d) -> DataFrame:
    """Suppliers as areas: features are means over their lines, the target is the mean price."""
    x = views.table(spark, d, "lineitem")
    own = x.groupBy(F.col("l_suppkey").alias("doc_id")).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")], F.count(F.lit(1)).alias("n"))
    return own.select("doc_id", F.array("l_quantity", "l_discount", "l_tax", F.col("n").cast("double")).alias("features"), F.col("l_extendedprice").alias("target"))


@query()
def cross_validation(spark, d):
    """NDCG on the held-out areas of all rounds, whose models are grown in one run."""
    return boosting.cross_validate(spark, _areas(spark, d), boosting.Settings())


@query("select r.round::int as round, s_suppkey as doc_id, ('0x' || substr(md5('10:' || r.round || ':' || s_suppkey), 1, 8))::bigint / 4294967296e0 < 0.4e0 as is_test from supplier, unnest([1, 2, 3]) as r(round)")
def validation_folds(spark, d):
    return boosting.folds(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id")), 3, 0.4, 10)


_UPTO = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
_DRAW = "('0x' || substr(md5('10:3:' || l_orderkey || ':' || l_linenumber), 1, 8))::bigint / 4294967296e0"


@query(f"select l_orderkey as query_id, l_linenumber as i, {' + '.join(f'({_DRAW} >= {u!r}e0)::int' for u in _UPTO[:7])} as draws from lineitem group by all")
def bootstrap_draws(spark, d):
    """How often the pairs of a first document count in round 3 of a bootstrap."""
    return views.order_rankings(spark, d).select("query_id", F.col("doc_id").alias("i")).distinct().withColumn("draws", draws.poisson(draws.uniform(10, 3, "query_id", "i"), most=7))


@query(f"""with {_LINES}, k as (select *, dense_rank() over (order by q) - 1 as query_id, row_number() over (partition by q order by doc) - 1 as doc_id from l),
n as (select x.q, count(*) as pairs from l x join l y on x.q = y.q and x.t < y.t group by 1)
select query_id, doc_id, t as target, x, y, z, round(coalesce((select count(*) from l o where o.q = k.q and o.t > k.t) / n.pairs, 0), 6) as weight from k left join n on n.q = k.q""")
def ranking_queries_file(spark, d):
    """Lists of orders written as one stream of numbers over several files and read back in parallel; with the weight of the pairs that a document is first in."""
    path, rows = shared.work_dir(spark, "queries"), _lines(spark, d)
    w = ranking.pair_weights(rows)
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "features", "target"))).alias("docs"))
    lists = lists.join(w.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "w"))).alias("w")), "query_id", "left")
    own = F.flatten(F.transform("docs", lambda x: F.array_append(x["features"], x["target"])))
    matrix = F.flatten(F.transform("docs", lambda a: F.transform("docs", lambda b: F.coalesce(F.try_element_at("w", F.struct(a["doc_id"].alias("i"), b["doc_id"].alias("j"))), F.lit(0.0)))))
    line = F.concat_ws(" ", F.size("docs").cast("string"), F.array_join(own.cast("array<string>"), " "), F.array_join(matrix.cast("array<string>"), " "))
    head = lists.agg(F.concat(F.count(F.lit(1)), F.lit(" 3")).alias("value")).select(F.lit(-1).cast("long").alias("query_id"), "value")
    writers.write_lines(head.unionByName(lists.select("query_id", line.alias("value"))).orderBy("query_id").select("value"), path)
    docs, pairs = readers.read_ranking_queries(spark, path, 50_000)
    first = pairs.groupBy("query_id", F.col("i").alias("doc_id")).agg(F.sum("w").alias("weight"))
    x = F.col("features")
    return docs.join(first, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "target", x[0].alias("x"), x[1].alias("y"), x[2].alias("z"), F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))
