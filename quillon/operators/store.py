"""Versioned documents, lineage, metric scores and run summaries as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shapes import in_order


def latest(store: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row of the greatest version of each key, by aggregation (no window)."""
    rest = [c for c in store.columns if c not in keys]
    return store.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def rollback(store: DataFrame, keys: list[str], to: int, version: str = "version") -> DataFrame:
    """Rows to append: version `to` of each key that has it, as the newest version, with rolled_back_from."""
    newest = store.groupBy(*keys).agg(F.max(version).alias("_last"))
    old = store.where(F.col(version) == to).join(newest, keys)
    return old.withColumn("rolled_back_from", F.col("_last")).withColumn(version, (F.col("_last") + 1).cast(store.schema[version].dataType)).drop("_last")


def against_parent(scores: DataFrame, keys: list[str], version: str, parent: str, score: str) -> DataFrame:
    """Mean score of each version, of its parent, the difference, and whether to roll back."""
    s = scores.groupBy(*keys, version, parent).agg(F.avg(score).alias("mean"))
    p = s.select(*keys, F.col(version).alias(parent), F.col("mean").alias("parent_mean"))
    out = s.join(p, [*keys, parent], "left")
    return out.withColumn("delta", F.col("mean") - F.col("parent_mean")).withColumn("roll_back", F.coalesce(F.col("delta") < 0, F.lit(False)))


def weighted_score(metrics: DataFrame, by: list[str], value: str, weight: str, threshold: float) -> DataFrame:
    """Sum of weighted values clamped to [0, 1] over the sum of weights (score 0 if that is 0); a null value counts 0 and fails."""
    v, w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))), F.col(weight)
    out = metrics.groupBy(*by).agg(F.sum(v * w).alias("_s"), F.sum(w).alias("_w"), F.bool_and(F.col(value).isNotNull()).alias("_ok"))
    out = out.withColumn("score", F.col("_s") / F.when(F.col("_w") == 0, 1.0).otherwise(F.col("_w")))
    return out.withColumn("passed", F.col("_ok") & (F.col("score") + 1e-9 >= threshold)).drop("_s", "_w", "_ok")


def triggers(runs: DataFrame, by: list[str], order: str, failed: Column, pattern: Column, cooldown: int, committed: Column | None = None) -> DataFrame:
    """Runs that start an evolution: failed, at least cooldown runs after the last start (or the beginning), with a pattern
    that no committed evolution was started for. A suppressed run leaves no trace: its pattern stays new. Nulls in failed or
    committed count as no; a null pattern is a pattern.

    A start depends on the starts before it, so the runs of a key are read in order by one task."""
    x = runs.withColumns({"_f": F.coalesce(failed, F.lit(False)), "_p": F.coalesce(pattern.cast("string"), F.lit("")), "_c": F.coalesce(F.lit(True) if committed is None else committed, F.lit(False))})

    def step(state, row):
        since, seen = state[0] + 1, state[1]
        start = row["_f"] and since >= cooldown and row["_p"] not in seen
        if start and row["_c"]:
            seen = seen | {row["_p"]}
        return (0 if start else since, seen), {"trigger": start}

    return in_order(x, by, order, ["_f", "_p", "_c"], "trigger boolean", lambda: (0, frozenset()), step).drop("_f", "_p", "_c")


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """node, predecessors, successors, terminal."""
    i = edges.groupBy(F.col(dst).alias(node)).agg(F.count_distinct(src).alias("predecessors"))
    o = edges.groupBy(F.col(src).alias(node)).agg(F.count_distinct(dst).alias("successors"))
    out = nodes.select(node).distinct().join(i, node, "left").join(o, node, "left").fillna(0, ["predecessors", "successors"])
    return out.withColumn("terminal", F.col("successors") == 0)


def fitness(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """1 / (1 + RMSE)."""
    return df.groupBy(*by).agg((1 / (1 + F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(actual), 2))))).alias("fitness"))


def summary(tasks: DataFrame, by: list[str]) -> DataFrame:
    """passed, pass_rate, mean rounds of tasks that may evolve, and the share of these that ended early."""
    evolving = F.col("allow_evolution")
    return tasks.groupBy(*by).agg(
        F.count("*").alias("tasks"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.coalesce(F.avg(F.when(evolving, F.col("rounds"))), F.lit(0.0)).alias("mean_rounds"),
        F.coalesce(F.avg(F.when(evolving, (F.col("rounds") < F.col("max_rounds")).cast("double"))), F.lit(0.0)).alias("convergence"),
    )
