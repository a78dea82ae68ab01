"""Tree ensembles as tables: stored in versions, loaded and applied without any literal tree in a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.trees import Ensemble, ObliviousTree

ROWS = "{0} int, step double, trees array<struct<features: array<int>, thresholds: array<double>, leaves: array<double>>>"


def as_rows(spark: SparkSession, fitted: dict[int, Ensemble], model: str = "model") -> DataFrame:
    """(model, step, trees): one row for each model. Its size follows from the settings of the training, not from the data."""
    rows = [(m, e.step, [(list(t.features), [float(x) for x in t.thresholds], list(t.leaves)) for t in e.trees]) for m, e in fitted.items()]
    return spark.createDataFrame(rows, ROWS.format(model))


def from_rows(rows: DataFrame, model: str = "model") -> dict[int, Ensemble]:
    return {r[model]: Ensemble(tuple(ObliviousTree(tuple(t["features"]), tuple(t["thresholds"]), tuple(t["leaves"])) for t in r["trees"]), r["step"]) for r in rows.collect()}


def save(rows: DataFrame, path: str, version: int, model: str = "model") -> None:
    """Adds a version of models; each is a folder of its own, never overwritten by another."""
    rows.withColumn("version", F.lit(version)).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version; of the latest without one."""
    own = spark.read.option("basePath", path).parquet(path)
    wanted = F.lit(version) if version is not None else own.agg(F.max("version").alias("v")).first()["v"]
    return own.where(F.col("version") == wanted).drop("version")


def _value(x: Column, t: Column) -> Column:
    """A tree's value; features that are null or missing count as not above."""
    bits = F.transform(t["features"], lambda f, p: F.when(F.get(x, f) > F.get(t["thresholds"], p), F.pow(F.lit(2.0), p).cast("int")).otherwise(F.lit(0)))
    return F.element_at(t["leaves"], F.aggregate(bits, F.lit(0), lambda a, b: a + b) + 1)


def staged(docs: DataFrame, rows: DataFrame, features: str = "features", on: str | None = None) -> DataFrame:
    """``docs`` with staged, the scores after each tree: of the model that ``on`` names, or of the only one."""
    own = rows.select(*([on] if on else []), F.col("step").alias("_step"), F.col("trees").alias("_trees"))
    joined = docs.join(F.broadcast(own), on) if on else docs.crossJoin(F.broadcast(own.limit(1)))
    first = F.array().cast("array<double>")
    scores = F.aggregate("_trees", first, lambda a, t: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + F.col("_step") * _value(F.col(features), t)))
    return joined.withColumn("staged", scores).drop("_step", "_trees")
