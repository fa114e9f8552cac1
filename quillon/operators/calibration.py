"""Confusion-matrix aggregates over tagged cases: one long table with an is_event flag, one exchange per roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shapes import safe_rate


def n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def with_window(rows: DataFrame, by: list[str], order: str, flag: str, reach: int = 1, out: str = "near") -> DataFrame:
    """out: the flag holds on some row of the same key within reach of the row's order value."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(-reach, reach)
    return rows.withColumn(out, F.max(F.col(flag).cast("int")).over(w) == 1)


def scores(rows: DataFrame, by: list[str], hit: str = "hit", strict: str = "strict", event: str = "is_event") -> DataFrame:
    """Counts, recall, precision and false-positive rate of each group, also of the strict prediction."""
    e, h, s = F.col(event), F.col(hit), F.col(strict)
    out = rows.groupBy(*by).agg(n(e).alias("events"), n(~e).alias("negatives"), n(e & h).alias("hits"), n(~e & h).alias("false_positives"), n(e & s).alias("strict_hits"), n(~e & s).alias("strict_false_positives"))
    return out.withColumns({
        "recall": safe_rate(F.col("hits"), F.col("events")), "precision": safe_rate(F.col("hits"), F.col("hits") + F.col("false_positives")),
        "fp_rate": safe_rate(F.col("false_positives"), F.col("negatives")), "strict_recall": safe_rate(F.col("strict_hits"), F.col("events")),
        "strict_fp_rate": safe_rate(F.col("strict_false_positives"), F.col("negatives")),
    })


def absent_years(present: DataFrame, by: list[str], year: str, first: Column, last: Column) -> DataFrame:
    """Every year of a key's range that isn't present."""
    grid = present.groupBy(*by).agg(first.alias("_a"), last.alias("_b")).select(*by, F.explode(F.sequence("_a", "_b")).alias(year))
    return grid.join(present.select(*by, year).distinct(), [*by, year], "left_anti")


def earlier_absent(present: DataFrame, by: list[str], year: str) -> DataFrame:
    """For each present year the nearest earlier one that is absent: one less than the start of its run."""
    p = present.select(*by, year).distinct()
    w = Window.partitionBy(*by).orderBy(year)
    p = p.withColumn("_g", F.col(year) - F.row_number().over(w))
    return p.withColumn("absent", F.min(year).over(Window.partitionBy(*by, "_g")) - 1).drop("_g")


def sweep(rows: DataFrame, variants: dict[str, Column], event: str = "is_event") -> DataFrame:
    """Scores of many predicates in one pass: each row is tested once, predicates are unpivoted as an array."""
    tests = F.array(*[F.struct(F.lit(k).alias("variant"), F.coalesce(c, F.lit(False)).alias("hit")) for k, c in variants.items()])
    long = rows.select(F.col(event).alias("is_event"), F.explode(tests).alias("t")).select("is_event", "t.*")
    return scores(long.withColumn("strict", F.col("hit")), ["variant"]).drop("strict_hits", "strict_false_positives", "strict_recall", "strict_fp_rate")


def mean_with_absent(metrics: DataFrame, row: str, name: str, value: str) -> DataFrame:
    """Mean of each metric over all rows, absent ones counting 0."""
    total = metrics.select(row).distinct().count()
    return metrics.groupBy(name).agg((F.sum(value) / F.lit(max(1, total))).alias("mean"))


def floor_rejections(means: DataFrame, floors: dict[str, float], name: str = "metric", value: str = "mean") -> DataFrame:
    """metric, floor, mean and the reason of every metric whose mean lies below its floor; a metric without a mean has 0. floors
    is a written list."""
    listed = means.sparkSession.createDataFrame(list(floors.items()), f"{name} string, floor double")
    out = listed.join(means.select(name, value), name, "left").withColumn(value, F.coalesce(value, F.lit(0.0))).where(F.col(value) < F.col("floor"))
    return out.withColumn("rejection", F.format_string("%s below floor %s: %.3f", F.col(name), F.col("floor").cast("string"), F.col(value)))


def one_sided(rows: DataFrame, event: str = "is_event", exact: str = "hit", strict: str = "strict") -> DataFrame:
    """rows with exact_match and strict_exact_match where the event is there, false_positive and strict_false_positive where it
    isn't; the other side is null, and so are all where it is unknown."""
    e = F.col(event)
    return rows.withColumns({
        "exact_match": F.when(e, F.col(exact)), "strict_exact_match": F.when(e, F.col(strict)),
        "false_positive": F.when(~e, F.col(exact)), "strict_false_positive": F.when(~e, F.col(strict)),
    })


def readiness(labels: DataFrame, profiles: DataFrame, id: str, fields: dict[str, Column]) -> DataFrame:
    """labels with the source and rating of their profile, scoring_ready, and blocking_reasons: no profile, and each check of
    fields (reason: condition that must hold) that fails or is null. Every label stays; of a profile's rows the least counts."""
    p = profiles.groupBy(id).agg(F.min(F.struct("source", "rating")).alias("_p"))
    out = labels.join(p, id, "left")
    why = [F.when(F.col("_p").isNull(), "missing reviewed profile"), *[F.when(~F.coalesce(c, F.lit(False)), reason) for reason, c in fields.items()]]
    out = out.withColumn("blocking_reasons", F.array_compact(F.array(*why)))
    return out.withColumns({"profile_source": F.col("_p.source"), "profile_rating": F.col("_p.rating"), "scoring_ready": F.size("blocking_reasons") == 0}).drop("_p")


def acceptance(baseline: DataFrame, best: DataFrame, validation: DataFrame) -> DataFrame:
    """One row: the five gates, all of them together, and the reasons of a rejection. baseline: average_score; best and
    validation: average_score, passed_floors, and for best passed_regression (one row each; validation may be empty)."""
    b = baseline.select(F.col("average_score").alias("_b"))
    s = best.select(F.col("average_score").alias("_s"), F.col("passed_floors").alias("_f"), F.col("passed_regression").alias("_r"))
    v = validation.agg(F.max("average_score").alias("_v"), F.bool_and("passed_floors").alias("_vf"), F.count("*").alias("_n"))
    x = s.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(v))  # one row each
    none = F.col("_n") == 0
    x = x.withColumns({
        "regression_gate": F.col("_r"), "metric_floors": F.col("_f"), "train_score_improved": F.col("_s") > F.col("_b"),
        "validation_metric_floors": none | F.coalesce("_vf", F.lit(False)), "validation_score_not_regressed": none | F.coalesce(F.col("_v") >= F.col("_b"), F.lit(False)),
    })
    gates = ["regression_gate", "metric_floors", "train_score_improved", "validation_metric_floors", "validation_score_not_regressed"]
    number = lambda c: F.format_string("%.3f", F.col(c))
    reasons = F.array_compact(F.array(
        F.when(~F.col(gates[0]), "selected candidate failed regression gate"), F.when(~F.col(gates[1]), "selected candidate failed metric floors"),
        F.when(~F.col(gates[2]), F.concat(F.lit("selected train score "), number("_s"), F.lit(" did not exceed baseline "), number("_b"))),
        F.when(~F.col(gates[3]), "validation candidate failed metric floors"),
        F.when(~F.col(gates[4]), F.concat(F.lit("validation score "), number("_v"), F.lit(" below baseline "), number("_b"))),
    ))
    accepted = F.lit(True)
    for g in gates:
        accepted = accepted & F.col(g)
    return x.select(*gates, accepted.alias("accepted"), F.array_join(reasons, "; ").alias("reasons"))


def partition_votes(votes: DataFrame, by: list[str], voter: str, value: str, threshold: float) -> DataFrame:
    """by, support (share of voters at or above the threshold), and the sorted lists of those for and against."""
    yes = F.col(value) >= threshold
    g = votes.groupBy(*by).agg(F.avg(F.coalesce(yes, F.lit(False)).cast("double")).alias("support"), F.array_sort(F.collect_set(F.when(yes, F.col(voter)))).alias("in_favour"), F.array_sort(F.collect_set(F.when(~F.coalesce(yes, F.lit(False)), F.col(voter)))).alias("against"))
    return g


def confidence(base: Column, parts: list[Column], low: float = 0.1, high: float = 0.95) -> Column:
    total = base
    for p in parts:
        total = total + p
    return F.least(F.greatest(F.round(total, 2), F.lit(low)), F.lit(high))
