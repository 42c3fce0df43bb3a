"""Choice among models by validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import average_precision


def objective(scored: DataFrame, window: str, service: str) -> DataFrame:
    """pr_auc (step-wise average precision), top1 (share of windows with a faulty service whose highest score, ties by name,
    is a faulty one; 0 without any) and their mean, of rows with score and truth."""
    first = F.row_number().over(Window.partitionBy(window).orderBy(F.col("score").desc(), F.col(service)))
    best = scored.withColumn("_r", first).groupBy(window).agg(F.max("truth").alias("_any"), F.max(F.when(F.col("_r") == 1, F.col("truth"))).alias("_hit")).where("_any = 1")
    top = best.agg(F.coalesce(F.avg("_hit"), F.lit(0.0)).alias("top1"))
    curve = average_precision(scored, "score", "truth").select(F.coalesce("average_precision", F.lit(0.0)).alias("pr_auc"))
    return curve.join(F.broadcast(top)).withColumn("objective", (F.col("pr_auc") + F.col("top1")) / 2)


def select_model(candidates: Iterable[tuple[str, DataFrame]], window: str, service: str, patience: int = 4) -> DataFrame:
    """One row a tried candidate (step, name, pr_auc, top1, objective, best). The first with the largest objective is best;
    the trial ends after ``patience`` candidates in a row that are no better. Only one row a model reaches the driver."""
    tried, best, stale, spark = [], -1.0, 0, None
    for step, (name, scored) in enumerate(candidates):
        spark = scored.sparkSession
        row = objective(scored, window, service).first()
        tried.append((step, name, float(row["pr_auc"]), float(row["top1"]), float(row["objective"])))
        stale = 0 if row["objective"] > best else stale + 1
        best = max(best, row["objective"])
        if stale >= patience:
            break
    if spark is None:
        raise ValueError("there is no candidate to choose from")
    chosen = next(t[0] for t in tried if t[4] == best)
    return spark.createDataFrame([(*t, t[0] == chosen) for t in tried], "step int, name string, pr_auc double, top1 double, objective double, best boolean")


def class_weights(df: DataFrame, truth: str) -> DataFrame:
    """df with ``weight``: rows / (classes * rows of the class), so that each class weighs the same."""
    counts = df.groupBy(F.col(truth).alias("_truth")).agg(F.count(F.lit(1)).alias("_n"))  # a row a class
    total = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    weight = F.col("_total") / (F.col("_classes") * F.col("_n"))
    return df.join(F.broadcast(counts.join(F.broadcast(total)).select("_truth", weight.alias("weight"))), F.col(truth) == F.col("_truth")).drop("_truth")


def dropout_replicas(df: DataFrame, key: list[str], modalities: list[str], replicas: int) -> DataFrame:
    """Each row as it is (replica 0) and ``replicas`` times with some modalities hidden (``no_<name>``): the mask is one of all
    but the one that hides everything, by a hash of the row's key and the replica."""
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.col("replica").cast("string")), 256), 1, 6), 16, 10).cast("long")
    mask = F.when(F.col("replica") == 0, 0).otherwise(F.pmod(number, F.lit(2 ** len(modalities) - 1)))
    rows = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas)))).withColumn("_mask", mask)
    return rows.withColumns({f"no_{m}": F.col("_mask").bitwiseAND(F.lit(1 << i)) > 0 for i, m in enumerate(modalities)}).drop("_mask")
