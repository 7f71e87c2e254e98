"""Evaluation of readings: one pass of conditional aggregates, calibration, ranking, thresholds, bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Edges of ten calibration bins as doubles, and the thresholds of risk-coverage curves.
ECE_EDGES = [float(x) for x in np.linspace(0, 1, 11)]
THRESHOLDS = [round(float(x), 3) for x in np.linspace(0, 0.99, 34)]
TAU_GRID = [round(0.5 + 0.01 * i, 2) for i in range(50)]


def share(condition: Column, among: Column) -> Column:
    """Mean of a boolean over the rows of a subset; null without rows."""
    return F.avg(F.when(among, condition.cast("double")))


def summarise(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Measures of outcomes (handwritten, blank, checkbox, correct, accepted), all in one aggregation: 14, and with dash and missed all 19."""
    h, b, c = F.col("handwritten"), F.col("blank"), F.col("checkbox")
    ok, acc = F.col("correct"), F.col("accepted")
    every = F.lit(True)
    measures = [
        F.count(F.lit(1)).alias("n_fields"), share(ok, every).alias("all_fields_accuracy"), F.count_if(h).alias("n_handwritten"), share(ok, h).alias("accuracy"), share(acc, h).alias("auto_accepted_share"),
        share(ok, h & acc).alias("accuracy_when_auto_accepted"), share(~acc, h).alias("flagged_for_review_share"), share(~ok, h & acc).alias("silent_error_rate"), share(~ok, acc).alias("all_fields_silent_error_rate"),
        F.count_if(b).alias("n_blank"), share(ok, b).alias("blank_accuracy"), F.count_if(b & ~ok).alias("blank_errors"), F.count_if(c).alias("n_checkbox"), share(ok, c).alias("checkbox_accuracy"),
    ]
    if {"dash", "missed"} <= set(rows.columns):
        d = F.col("dash")
        measures += [
            share(F.col("missed"), h).alias("missed_as_blank_share"), share(~acc, every).alias("all_fields_review_share"), F.count_if(d).alias("n_dash"), share(ok, d).alias("dash_accuracy"), share(~ok, c & acc).alias("checkbox_silent_error_rate"),
        ]
    return rows.groupBy(*(by or [])).agg(*measures)


def ece_bins(rows: DataFrame, edges: list[float] = ECE_EDGES) -> DataFrame:
    """(bin, n, accuracy, confidence) of bins with rows; [lo, hi), the last closed."""
    conf = F.col("confidence")
    number = sum((F.when(conf >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return rows.where(conf.between(edges[0], edges[-1])).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))


def ece(rows: DataFrame) -> DataFrame:
    bins = ece_bins(rows)
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by average ranks; null if one class is missing. Confidences are counted before they are ranked."""
    counted = rows.groupBy("confidence").agg(F.count_if("correct").alias("pos"), F.count_if(~F.col("correct")).alias("neg"))
    below = F.sum("neg").over(Window.orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1))
    scored = counted.withColumn("below", F.coalesce(below, F.lit(0)))
    total = scored.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def risk_coverage(rows: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, coverage, error) for each threshold, in one aggregation; without accepted rows the error is 0."""
    conf, ok = F.col("confidence"), F.col("correct")
    points = F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(conf >= t).alias("kept"), F.count_if((conf >= t) & ~ok).alias("wrong")) for t in thresholds))
    return rows.agg(points.alias("points"), F.count(F.lit(1)).alias("n")).select("n", F.inline("points")).select("threshold", (F.col("kept") / F.col("n")).alias("coverage"), F.coalesce(F.try_divide("wrong", "kept"), F.lit(0.0)).alias("error"))


def tau_search(rows: DataFrame, target: float, grid: list[float] = TAU_GRID) -> DataFrame:
    """The smallest threshold of the grid with an error of at most `target` among accepted rows."""
    return risk_coverage(rows, grid).agg(F.min(F.when(F.col("error") <= target, F.col("threshold"))).alias("tau"))


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the most frequent value of each key; ties go to the value seen first in `order`."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "seen"))
    return counted.withColumn("place", best).where("place = 1").select(key, value)


def cluster_sums(rows: DataFrame, cluster: str, hit: Column, among: Column) -> DataFrame:
    return rows.groupBy(cluster).agg(F.count_if(hit & among).alias("num"), F.count_if(among).alias("den"))


def bootstrap(sums: DataFrame, cluster: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float] | None:
    """Percentile interval of sum(num) / sum(den) over resampled clusters; None with fewer than two. Gathers one row for each cluster."""
    rows = sums.orderBy(cluster).select("num", "den").toPandas().to_numpy(float)
    if len(rows) < 2:
        return None
    rng = np.random.default_rng(seed)
    picks = rng.choice(len(rows), (draws, len(rows)))
    num, den = rows[picks, 0].sum(axis=1), rows[picks, 1].sum(axis=1)
    low = (1 - level) / 2
    return tuple(float(x) for x in np.quantile(num[den > 0] / den[den > 0], [low, 1 - low]))
