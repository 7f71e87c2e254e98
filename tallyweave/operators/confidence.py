"""Confidence of a reading and the decision whether to accept it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the untrained model and its intercept.
DEFAULT_WEIGHTS = {"lp_mean": 2.0, "lp_min": 0.8, "second_agree": 1.6, "parse_ok": 1.2, "lexicon_score": 0.8, "n_flags": -1.2, "out_of_range": -1.5, "reg_similarity": 0.5}
INTERCEPT = 0.3


def logistic(features: dict[str, Column], weights: dict[str, float], intercept: float, mean: dict[str, float] | None = None, scale: dict[str, float] | None = None) -> Column:
    """Sigmoid of the weighted standardised features, as plain arithmetic that stays in generated code."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + (F.coalesce(features[name], F.lit(0.0)) - (mean or {}).get(name, 0.0)) / (scale or {}).get(name, 1.0) * w
    return 1 / (1 + F.exp(-z))


def checkbox_confidence(fill: Column, on: float = 0.06) -> Column:
    d = F.abs(fill - on)
    return F.when(d < 0.08, F.least(F.lit(0.995), 0.5 + d / 0.08 * 0.5)).otherwise(0.995)


def finalise(status: Column, source: Column, confidence: Column, parse_ok: Column, n_flags: Column, several: Column, tau: float = 0.8) -> tuple[Column, Column]:
    """(status, confirm_special) by confidence and flags."""
    machine = source == "ocr"
    known = status == "KNOWN"
    decided = (
        F.when((source == "checkbox") & several, "NEEDS_REVIEW")
        .when(~machine, status)
        .when(known & ~parse_ok & (confidence < 0.15), "ILLEGIBLE")
        .when(known & ((confidence < tau) | (n_flags > 0)), "NEEDS_REVIEW")
        .otherwise(status)
    )
    return decided, machine & status.isin("NOT_APPLICABLE", "UNKNOWN") & (confidence < tau)


def fit(rows: DataFrame, names: list[str], label: str, c: float = 1.0, steps: int = 50) -> dict:
    """Standardised L2 logistic regression by Newton steps: each is one aggregation of X'WX and X'(y - p), so no row is gathered."""
    stats = rows.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    mean = {n: float(stats[f"m_{n}"] or 0) for n in names}
    scale = {n: float(stats[f"s_{n}"] or 0) if (stats[f"s_{n}"] or 0) > 1e-9 else 1.0 for n in names}
    x = [F.lit(1.0), *((F.col(n) - mean[n]) / scale[n] for n in names)]
    w = np.zeros(len(x))
    for _ in range(steps):
        z = sum((xi * float(wi) for xi, wi in zip(x, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        gradient = [F.sum((F.col(label).cast("double") - p) * xi).alias(f"g{i}") for i, xi in enumerate(x)]
        hessian = [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
        r = rows.agg(*gradient, *hessian).first()
        h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] or 0 for j in range(len(x))] for i in range(len(x))], float)
        penalty = np.diag([0.0] + [1 / c] * len(names))
        move = np.linalg.solve(h + penalty + 1e-12 * np.eye(len(x)), np.array([r[f"g{i}"] or 0 for i in range(len(x))]) - penalty @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return {"intercept": float(w[0]), "weights": dict(zip(names, map(float, w[1:]), strict=True)), "mean": mean, "scale": scale}
