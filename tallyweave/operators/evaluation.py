"""Evaluation runs: outcomes from ground truth and predictions, baselines, quality gates, held-out thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

MISSING_GLYPH = "�"
READABLE, EMPTY = ["KNOWN", "NEEDS_REVIEW"], ["NOT_PROVIDED", "NOT_APPLICABLE"]


def glyph_pattern(raw: Column, fold) -> Column:
    """A regular expression for a folded text of which some glyphs are missing: each stands for up to two characters."""
    parts = F.transform(F.split(raw, MISSING_GLYPH), lambda p: F.regexp_replace(fold(p), r"([^\p{L}\p{N}_\s])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(parts, ".{0,2}"), F.lit("$"))


def values_match(truth: Column, truth_raw: Column, predicted: Column, value_type: Column, fold) -> Column:
    """Whether a prediction has the true value: texts by their folded forms, others as they are; false without a prediction."""
    text = value_type == "text"
    glyphs = text & F.coalesce(truth_raw.contains(MISSING_GLYPH), F.lit(False)) & truth.isNotNull()
    same = F.when(glyphs, F.regexp_like(fold(predicted), glyph_pattern(truth_raw, fold))).when(text, fold(predicted) == fold(truth)).otherwise(predicted == truth)
    return predicted.isNotNull() & F.coalesce(same, F.lit(False))


def outcomes(truth: DataFrame, predictions: DataFrame, match: Column) -> DataFrame:
    """One row for each true field: what was predicted, whether that is right and whether it was accepted without review.

    truth (item, field_id, page_type, kind, gt_status, value, raw, value_type, ...) is left-joined with predictions (item, field_id, page_type, status, value, confidence,
    source, flags); one of another page type counts as missing. match is over columns t_value, t_raw, p_value and value_type.
    """
    t = truth.withColumnsRenamed({"value": "t_value", "raw": "t_raw"}).alias("t")
    p = predictions.withColumnsRenamed({"value": "p_value", "status": "p_status", "confidence": "p_confidence", "source": "p_source", "flags": "p_flags"}).withColumn("present", F.lit(True)).alias("p")
    joined = t.join(p, (F.col("t.item") == F.col("p.item")) & (F.col("t.field_id") == F.col("p.field_id")) & (F.col("t.page_type") == F.col("p.page_type")), "left")
    rows = joined.select("t.*", "p_value", F.coalesce("p_status", F.lit("MISSING")).alias("pred_status"), F.coalesce("p_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("p_source", F.lit("none")).alias("source"), "p_flags", F.coalesce("present", F.lit(False)).alias("present"))
    shown, blank = F.col("pred_status").isin(READABLE), F.col("pred_status").isin(EMPTY)
    same = F.coalesce(match, F.lit(False))
    correct = (
        F.when(F.col("kind") == "checkbox", F.coalesce(F.col("p_value") == "true", F.lit(False)) == F.coalesce(F.col("t_value") == "true", F.lit(False)))
        .when(F.col("gt_status").isin(READABLE), shown & same)
        .when(F.col("gt_status") == "NOT_PROVIDED", blank)
        .otherwise(F.col("gt_status") == F.col("pred_status"))
    )
    accepted = F.col("present") & ~F.col("pred_status").isin("NEEDS_REVIEW", "ILLEGIBLE") & ~F.coalesce(F.array_contains("p_flags", "confirm_special"), F.lit(False))
    return rows.withColumns({"correct": correct, "accepted": accepted}).drop("present")


def subsets(rows: DataFrame) -> DataFrame:
    """Outcomes with the flags of the measured subsets (one scan serves all): handwritten, blank, dash, checkbox, missed."""
    text = F.col("kind") == "text"
    return rows.withColumns({
        "handwritten": text & F.col("gt_status").isin(READABLE), "blank": text & (F.col("gt_status") == "NOT_PROVIDED"), "dash": text & (F.col("gt_status") == "NOT_APPLICABLE"),
        "checkbox": F.col("kind") == "checkbox", "missed": F.col("pred_status").isin(EMPTY),
    })


def breakdowns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n_handwritten, accuracy, auto_accepted_share, silent_error_rate, all_fields_accuracy) by each key, in one aggregation over grouping sets."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    cut = metrics.summarise(rows.withColumn("__at", F.explode(pairs)).select("*", "__at.*"), ["key", "value"])
    return cut.select("key", "value", "n_handwritten", "accuracy", "auto_accepted_share", "silent_error_rate", "all_fields_accuracy")


def baselines(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(n, majority, pipeline): how often a field's majority answer (field_id, answer) and the pipeline are right; without an answer the baseline says false."""
    joined = rows.join(answers, "field_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("answer", F.lit("false")) == F.col("t_value")).cast("double")).alias("majority"), F.avg(F.col("correct").cast("double")).alias("pipeline"))


def gate(rows: DataFrame, by: str, ok: str) -> DataFrame:
    """(level, n, retake_share, accuracy_accepted, accuracy_rejected) of captures; one without a verdict passes the gate."""
    passed = F.coalesce(F.col(ok), F.lit(True))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((~passed).cast("double")).alias("retake_share"), metrics.share(F.col("correct"), passed).alias("accuracy_accepted"), metrics.share(F.col("correct"), ~passed).alias("accuracy_rejected"))


def folds(rows: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out: each row once for every other group, with that group as `fold` (the complement is the training set). Groups are few: patients of a calibration set."""
    names = rows.select(F.col(group).alias("fold")).distinct()
    return rows.join(names, F.col(group) != F.col("fold"))


def held_out_sums(rows: DataFrame, group: str, feature: str) -> DataFrame:
    """Per-fold training sums without copying rows: totals minus the group's own. For statistics that are ratios of sums."""
    own = rows.groupBy(group).agg(F.sum(feature).alias("own"), F.count(feature).alias("n"))
    whole = own.agg(F.sum("own").alias("whole"), F.sum("n").alias("total"))
    return own.join(F.broadcast(whole)).select(group, ((F.col("whole") - F.col("own")) / (F.col("total") - F.col("n"))).alias("held_out_mean"))


def calibrate(rows: DataFrame, target: float, grid: list[float] | None = None, fallback: float = 0.99) -> DataFrame:
    """(tau, target_reached): the smallest threshold with a silent error of at most `target` among outcomes whose confidence is from models that didn't see their group."""
    return metrics.tau_search(rows, target, grid or metrics.TAU_GRID).select(F.coalesce("tau", F.lit(fallback)).alias("tau"), F.col("tau").isNotNull().alias("target_reached"))
