"""Ranks, pair weights and quality measures of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import draws


def dense_ranks(rows: DataFrame, query: str = "query_id", target: str = "target") -> DataFrame:
    """``rows`` with rank: equal targets share one, the lowest target has 1."""
    return rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(query).orderBy(target)))


def positions(rows: DataFrame, order: list[str | Column], query: str = "query_id") -> DataFrame:
    """``rows`` with position, from 1, in the given order; name enough columns to break ties."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with a random position of each within the whole, the same for the same seed; no single task sorts all rows.

    The draw is the order; ``orderBy('draw', key)`` sorts by ranges when the order itself is wanted.
    """
    return rows.withColumn("draw", draws.uniform(seed, key))


def _gain(rank: Column, n: Column) -> Column:
    return F.pow(F.lit(2.0), (n - rank + 1) / n) - 1


def ndcg(rows: DataFrame, k: int = 10, query: str = "query_id", target: str = "target", prediction: str = "prediction", ties: tuple[str, ...] = ()) -> DataFrame:
    """(query, dcg, ideal, ndcg): gain 2**rel - 1 with rel = (n - rank + 1) / n, discount log2(position + 1), the first k positions.

    Rows are ordered by rising prediction, then by ``ties``; of fewer than k rows all count.
    """
    whole = Window.partitionBy(query)
    n = F.count(F.lit(1)).over(whole)
    placed = rows.select(query, target, F.dense_rank().over(whole.orderBy(target)).alias("rank"), n.alias("n"), F.row_number().over(whole.orderBy(prediction, *ties)).alias("p"), F.row_number().over(whole.orderBy(target)).alias("best"))
    gain = _gain(F.col("rank"), F.col("n"))
    own = F.sum(F.when(F.col("p") <= k, gain / F.log2(F.col("p") + 1)))
    ideal = F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1)))
    out = placed.groupBy(query).agg(own.alias("dcg"), ideal.alias("ideal"))
    return out.withColumn("ndcg", F.col("dcg") / F.col("ideal"))


def pairs(rows: DataFrame, query: str = "query_id", doc: str = "doc_id", target: str = "target") -> DataFrame:
    """(query, i, j, rank_i, rank_j, target_i, target_j) of all pairs within a query whose first target is lower.

    A pairwise loss is over these pairs, so a query's documents are meant to be few.
    """
    ranked = dense_ranks(rows.select(query, doc, target), query, target)
    a = ranked.select(query, F.col(doc).alias("i"), F.col("rank").alias("rank_i"), F.col(target).alias("target_i"))
    b = ranked.select(query, F.col(doc).alias("j"), F.col("rank").alias("rank_j"), F.col(target).alias("target_j"))
    return a.join(b, query).where(F.col("target_i") < F.col("target_j"))


def equal_weight() -> Column:
    return F.lit(1.0)


def rank_weight() -> Column:
    return F.ln(1.0 + F.col("rank_j") - F.col("rank_i"))


def diff_weight() -> Column:
    """By the difference of targets, which is positive for every pair."""
    return F.ln(1.0 + F.col("target_j") - F.col("target_i"))


#: Weights of pairs that follow from the pair alone.
WEIGHTS = {"equal": equal_weight, "rank": rank_weight, "diff": diff_weight}


def pair_weights(rows: DataFrame, kind: str = "equal", query: str = "query_id", doc: str = "doc_id", target: str = "target") -> DataFrame:
    """(query, i, j, w): weights of a query's pairs, which sum to 1."""
    if kind == "ndcg":
        raw = _ndcg_pairs(rows, query, doc, target)
    elif kind in WEIGHTS:
        raw = pairs(rows, query, doc, target).select(query, "i", "j", WEIGHTS[kind]().alias("w"))
    else:
        raise ValueError(f"kind is one of {sorted([*WEIGHTS, 'ndcg'])}")
    return raw.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(query)))


def _ndcg_pairs(rows: DataFrame, query: str, doc: str, target: str) -> DataFrame:
    """exp(-(1 - NDCG of the ideal order with i and j exchanged)), from the two positions alone."""
    whole = Window.partitionBy(query)
    placed = dense_ranks(rows.select(query, doc, target), query, target)
    placed = placed.withColumns({"n": F.count(F.lit(1)).over(whole), "p": F.row_number().over(whole.orderBy(target, doc))})
    placed = placed.withColumn("g", _gain(F.col("rank"), F.col("n"))).withColumn("d", 1 / F.log2(F.col("p") + 1))
    placed = placed.withColumn("ideal", F.sum(F.col("g") * F.col("d")).over(whole))
    a = placed.select(query, "ideal", F.col(doc).alias("i"), F.col(target).alias("t_i"), F.col("g").alias("g_i"), F.col("d").alias("d_i"))
    b = placed.select(query, F.col(doc).alias("j"), F.col(target).alias("t_j"), F.col("g").alias("g_j"), F.col("d").alias("d_j"))
    lost = (F.col("g_i") - F.col("g_j")) * (F.col("d_i") - F.col("d_j")) / F.col("ideal")
    return a.join(b, query).where(F.col("t_i") < F.col("t_j")).select(query, "i", "j", F.exp(-lost).alias("w"))


def kappa(rows: DataFrame, real: str = "real", predicted: str = "predicted") -> DataFrame:
    """One row: Cohen's kappa over any number of classes; null without rows, or where chance alone agrees fully."""
    cells = rows.groupBy(F.col(real).alias("a"), F.col(predicted).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    all_ = cells.agg(F.sum("n").cast("double").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    a = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "c").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    agree, by_chance = F.col("same") / F.col("total"), F.col("both") / (F.col("total") * F.col("total"))
    return all_.join(chance, F.lit(True)).select(F.try_divide(agree - by_chance, 1 - by_chance).alias("kappa"))


def position_means(rows: DataFrame, values: str) -> DataFrame:
    """(position, mean) of arrays by position, from 0."""
    return rows.select(F.posexplode(values).alias("position", "v")).groupBy("position").agg(F.avg("v").alias("mean"))


def row_means(rows: DataFrame, values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def best_position(means: DataFrame) -> DataFrame:
    """One row: the position of the largest mean, the first of equal ones."""
    return means.agg(F.max_by("position", F.struct("mean", -F.col("position"))).alias("position"), F.max("mean").alias("mean"))


def feature_levels(rows: DataFrame, features: str = "features") -> DataFrame:
    """(feature, levels): distinct values of each feature."""
    return rows.select(F.posexplode(features).alias("feature", "v")).groupBy("feature").agg(F.count_distinct("v").alias("levels"))
