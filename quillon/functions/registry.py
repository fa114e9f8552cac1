"""Named extension points: metrics (Column builders), transforms (frame to frame) and Python fallbacks as Arrow UDFs."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_metrics: dict[str, Callable[..., Column]] = {}
_transforms: dict[str, Callable[[DataFrame], DataFrame]] = {}


def metric(name: str):
    """Registers a builder (result, expected) -> Column in [0, 1]."""
    def keep(fn):
        _metrics[name] = fn
        return fn

    return keep


def transform(name: str):
    def keep(fn):
        _transforms[name] = fn
        return fn

    return keep


def python_metric(name: str, fn: Callable[[object, object], float]) -> None:
    """A Python function of two values as a vectorised UDF: the slow path, where no Column can say it."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    _metrics[name] = lambda a, b: run(a, b)


def resolve(name: str) -> Callable:
    """A registered metric or transform, or a function by dotted path (module:function)."""
    if name in _metrics or name in _transforms:
        return _metrics.get(name) or _transforms[name]
    if ":" in name:
        module, _, attr = name.partition(":")
        return getattr(importlib.import_module(module), attr)
    raise KeyError(name)


def pipeline(df: DataFrame, names: list[str]) -> DataFrame:
    """Transforms in order."""
    for n in names:
        df = df.transform(resolve(n))
    return df


def scored(df: DataFrame, weights: dict[str, float], result: str, expected: str, threshold: float = 0.7) -> DataFrame:
    """score (weighted mean of clamped metrics; equal weights where they sum to 0) and passed; null metrics count 0 and fail."""
    parts = {m: resolve(m)(F.col(result), F.col(expected)).cast("double") for m in weights}
    total = sum(weights.values())
    w = {m: (x if total else 1.0) for m, x in weights.items()}
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    score = sum((clamp(c) * w[m] for m, c in parts.items()), F.lit(0.0)) / (sum(w.values()) or 1.0)
    whole = F.lit(True)
    for c in parts.values():
        whole = whole & c.isNotNull()
    return df.withColumn("score", score).withColumn("passed", whole & (F.col("score") + 1e-9 >= threshold))


@metric("exact_match")
def exact_match(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("double")


@metric("contains")
def contains(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)).cast("double")
