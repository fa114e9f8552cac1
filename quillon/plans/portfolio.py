"""Portfolios of formulas: a seeded search over factors and weights, evaluated a whole generation at a time, and the cleaning
of a formula library with the first reason for each that goes."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsl
from ..operators import cross, quality
from ..sources import panels
from .base import USER_DAY, query, rounded


@dataclass(frozen=True)
class Portfolio:
    """Formulas and their weights."""

    formulas: tuple[str, ...]
    weights: tuple[float, ...]


def long_form(panel: DataFrame, columns: dict[str, str], target: str) -> DataFrame:
    """symbol, date, r, factor, f: the named columns as rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(f"`{c}`").alias("f")) for k, c in columns.items()])
    return panel.select("symbol", "date", F.col(f"`{target}`").alias("r"), F.explode(pairs).alias("_p")).select("symbol", "date", "r", "_p.*")


def figures(long: DataFrame, share: float = 1.0, cost: float = 0.001) -> DataFrame:
    """factor, ic, rank_ic, sharpe, max_drawdown, turnover (mean of daily means, the first date apart) and cost_adjusted of
    many factors in one pass; unknown ones are 0."""
    both = long.where("f is not null and r is not null")
    ranks = cross.with_columns(both, {"_rf": ("cs_rank", "f"), "_rr": ("cs_rank", "r")}, ["factor", "date"])
    daily = ranks.groupBy("factor", "date").agg(quality.pearson("f", "r").alias("ic"), quality.pearson("_rf", "_rr").alias("rank_ic"))
    ics = daily.groupBy("factor").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"), F.coalesce(F.avg("rank_ic"), F.lit(0.0)).alias("rank_ic"))
    w = cross.with_columns(long, {"w": ("abs_normalise", "f")}, ["factor", "date"])
    w = w.withColumn("t", F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("factor", "symbol").orderBy("date"))))
    moves = w.groupBy("factor", "date").agg(F.avg("t").alias("mean"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("sum"))
    so_far = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # over daily aggregates
    ls = quality.long_short_many(long).withColumn("equity", F.product(1 + share * F.col("ls")).over(so_far))
    ls = ls.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far) - 1).join(moves, ["factor", "date"], "full")
    bt = ls.groupBy("factor").agg(
        F.coalesce(quality.sharpe("ls"), F.lit(0.0)).alias("sharpe"), F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.avg("mean"), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.avg(F.col("ls") - 2 * cost * F.col("sum")) * quality.YEAR, F.lit(0.0)).alias("cost_adjusted"),
    )
    return bt.join(ics, "factor", "left").fillna(0.0, ["ic", "rank_ic"])


def scores(panel: DataFrame, portfolios: dict[str, Portfolio], target: str = "forward_return", share: float = 1.0) -> DataFrame:
    """figures() of each portfolio: the weighted sum of its formulas' z-scores by date, null where one of them is."""
    formulas = list(dict.fromkeys(f for p in portfolios.values() for f in p.formulas))
    name = {f: f"_e{k}" for k, f in enumerate(formulas)}
    values = dsl.evaluate(panel, {name[f]: f for f in formulas})
    z = cross.with_columns(values, {f"_z{k}": ("cs_zscore", name[f]) for k, f in enumerate(formulas)})
    sums = {}
    for k, p in portfolios.items():
        total = F.lit(0.0)
        for f, w in zip(p.formulas, p.weights, strict=True):
            total = total + F.lit(float(w)) * F.col(f"_z{formulas.index(f)}")
        sums[f"_s_{k}"] = total
    return figures(long_form(z.withColumns(sums), {k: f"_s_{k}" for k in portfolios}, target), share)


def leaderboard(train: DataFrame, test: DataFrame, portfolios: dict[str, Portfolio], n: int = 5, generation: dict[str, int] | None = None, share: float = 1.0) -> DataFrame:
    """rank, candidate_id, generation, train_sharpe, test_ic, test_rank_ic, test_sharpe, test_mdd, n_factors, weights,
    expressions of the n portfolios of greatest test Sharpe (ties by id)."""
    spark = test.sparkSession
    rows = [(k, (generation or {}).get(k, 0), len(p.formulas), [float(w) for w in p.weights], " | ".join(p.formulas)) for k, p in portfolios.items()]
    listed = spark.createDataFrame(rows, "factor string, generation int, n_factors int, weights array<double>, expressions string")
    held = scores(test, portfolios, share=share).select("factor", F.col("ic").alias("test_ic"), F.col("rank_ic").alias("test_rank_ic"), F.col("sharpe").alias("test_sharpe"), F.col("max_drawdown").alias("test_mdd"))
    fit = scores(train, portfolios, share=share).select("factor", F.col("sharpe").alias("train_sharpe"))
    found = listed.join(held, "factor", "left").join(fit, "factor", "left").fillna(0.0, ["test_ic", "test_rank_ic", "test_sharpe", "test_mdd", "train_sharpe"])
    best = found.orderBy(F.col("test_sharpe").desc(), "factor").limit(n)
    rank = F.row_number().over(Window.orderBy(F.col("test_sharpe").desc(), "factor"))  # n rows
    return best.select(rank.alias("rank"), F.col("factor").alias("candidate_id"), "generation", "train_sharpe", "test_ic", "test_rank_ic", "test_sharpe", "test_mdd", "n_factors", "weights", "expressions")


@dataclass
class PortfolioSearch:
    """Generations of portfolios from a library; the best by test Sharpe breed by changed weights and added, removed or swapped
    formulas. Only a few figures for each candidate reach the driver."""

    train: DataFrame
    test: DataFrame
    library: list[str]
    size: int = 10
    n_factors: int = 5
    elite: float = 0.2
    seed: int = 42
    patience: int = 3
    max_generations: int = 10
    share: float = 1.0
    population: dict[str, Portfolio] = field(default_factory=dict)
    archive: dict[str, tuple[int, Portfolio]] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        if len(self.library) < 2:
            raise ValueError("a library needs two formulas at least")
        self.rng = random.Random(self.seed)
        n = min(self.n_factors, len(self.library))
        while len(self.population) < self.size:
            draws = [self.rng.gammavariate(1.0, 1.0) for _ in range(n)]  # normalised: evenly over all weights
            self._add(Portfolio(tuple(self.rng.sample(self.library, n)), tuple(d / sum(draws) for d in draws)))

    def _add(self, p: Portfolio) -> None:
        name = f"c{len(self.archive)}"
        self.population[name] = p
        self.archive[name] = (len(self.history), p)

    def bred(self, p: Portfolio) -> Portfolio:
        """One change: noise on the weights, a formula more at a tenth, the least one less (two stay), or another in its place."""
        rng, formulas, weights = self.rng, list(p.formulas), list(p.weights)
        free = [f for f in self.library if f not in formulas]
        how = rng.choice(["weights", "add", "remove", "swap"])
        if how == "add" and free:
            return Portfolio((*formulas, rng.choice(free)), (*[w * 0.9 for w in weights], 0.1))
        if how == "remove" and len(formulas) > 2:
            k = weights.index(min(weights))
            del formulas[k], weights[k]
        elif how == "swap" and free:
            formulas[rng.randrange(len(formulas))] = rng.choice(free)
            return Portfolio(tuple(formulas), tuple(weights))
        elif how == "weights":
            weights = [max(0.0, w + rng.gauss(0, 0.1)) for w in weights]
        total = sum(weights) + 1e-8
        return Portfolio(tuple(formulas), tuple(w / total for w in weights))

    def step(self) -> dict:
        """One generation: evaluate, record, breed."""
        fit, held = ({r.factor: r for r in scores(p, self.population, share=self.share).collect()} for p in (self.train, self.test))
        ranked = sorted(self.population, key=lambda k: (-held[k].sharpe, k))
        best = ranked[0]
        self.history.append({"generation": len(self.history), "best_train_sharpe": max(fit[k].sharpe for k in ranked), "best_test_sharpe": held[best].sharpe, "best_test_ic": held[best].ic, "mean_test_sharpe": sum(held[k].sharpe for k in ranked) / len(ranked), "best": best})
        elites = ranked[: max(1, int(self.size * self.elite))]
        kept = {k: self.population[k] for k in elites}
        self.population = dict(kept)
        while len(self.population) < self.size:
            self._add(self.bred(kept[self.rng.choice(elites)]))
        return self.history[-1]

    def run(self) -> list[dict]:
        """Until max_generations, or the best test Sharpe hasn't risen for `patience` generations."""
        best, idle = -1.0, 0
        while len(self.history) < self.max_generations and idle < self.patience:
            now = self.step()["best_test_sharpe"]
            best, idle = (now, 0) if now > best + 1e-6 else (best, idle + 1)
        return self.history

    def leaderboard(self, n: int = 5) -> DataFrame:
        seen = {k: p for k, (g, p) in self.archive.items() if g < len(self.history) or not self.history}
        return leaderboard(self.train, self.test, seen, n, {k: g for k, (g, _) in self.archive.items()}, self.share)


# What a library's formulas must reach.
THRESHOLDS = {"train_ic": 0.005, "test_ic": 0.003, "test_sharpe": 0.0, "val_ic": 0.0, "val_sharpe": 0.0, "turnover": 0.5, "nulls": 0.2, "coverage": 0.5}


def clean_library(library: dict[str, str], folds: dict[str, DataFrame], thresholds: dict[str, float] | None = None, target: str = "forward_return", share: float = 1.0) -> DataFrame:
    """name, expression, reason (null for those that stay), detail and figures of each formula of a library.

    Reasons in this order, the first that holds: parse_error, constant_correlation, eval_error (a column that the panel lacks),
    degenerate_train / _test / _val (no values, too many nulls, infinite values, hardly any spread, too low a coverage by
    date), below_threshold. folds: train, test and, if wanted, val; with it the signs of train and val IC must agree. Each fold
    is evaluated by one job for all formulas; windows start cold in each."""
    limit = THRESHOLDS | (thresholds or {})
    spark = next(iter(folds.values())).sparkSession
    early, good = [], {}
    for name, text in library.items():
        try:
            node = dsl.parse(text)
        except dsl.FormulaError as e:
            early.append((name, text, "parse_error", str(e)))
            continue
        pairs = [n for n in node.walk() if n.op in dsl.ROLLING_PAIR]
        missing = [v for v in dsl.variables(node) if any(v not in p.columns for p in folds.values())]
        if any(dsl.is_constant(a) for n in pairs for a in n.args) or any(n.args[0] == n.args[1] for n in pairs):
            early.append((name, text, "constant_correlation", text))
        elif missing:
            early.append((name, text, "eval_error", f"no column {', '.join(missing)}"))
        else:
            good[name] = node
    columns = ["train_ic", "test_ic", "test_turnover", "test_sharpe", "val_ic", "val_turnover", "val_sharpe"]
    dropped = spark.createDataFrame([(*x, *[None] * 7) for x in early], "name string, expression string, reason string, detail string, " + ", ".join(f"{c} double" for c in columns))
    if not good:
        return dropped
    out = spark.createDataFrame([(k, library[k]) for k in good], "name string, expression string")
    names = {k: f"_f{i}" for i, k in enumerate(good)}
    for fold, panel in folds.items():
        long = long_form(dsl.evaluate(panel, {names[k]: n for k, n in good.items()}), names, target)
        by_day = long.groupBy("factor", "date").agg(F.count("*").alias("n"), F.count("f").alias("k"))
        shape = by_day.groupBy("factor").agg((1 - F.sum("k") / F.sum("n")).alias("nulls"), F.avg(F.col("k") / F.col("n")).alias("coverage"))
        spread = long.groupBy("factor").agg(F.when(F.min("f") == F.max("f"), 0.0).otherwise(F.stddev_samp("f")).alias("spread"), F.max((F.abs("f") == float("inf")) | F.isnan("f")).alias("odd"))
        both = shape.join(spread, "factor")
        bad = (F.col("nulls") > limit["nulls"]) | F.coalesce(F.col("odd"), F.lit(True)) | F.coalesce(F.col("spread") < quality.TINY, F.lit(True)) | (F.col("coverage") < limit["coverage"])
        both = both.select("factor", bad.alias(f"bad_{fold}"))
        f = figures(long, share).select("factor", *[F.col(c).alias(f"{fold}_{c}") for c in ("ic", "turnover", "sharpe")])
        out = out.join(both.join(f, "factor", "left").withColumnRenamed("factor", "name"), "name", "left")
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    reason = F.lit(None).cast("string")
    enough = (F.abs("train_ic") >= limit["train_ic"]) & (F.abs("test_ic") >= limit["test_ic"]) & (F.col("test_sharpe") >= limit["test_sharpe"]) & (F.col("test_turnover") <= limit["turnover"])
    detail = "train_ic=%.4f test_ic=%.4f sharpe=%.2f turnover=%.2f"
    if "val" in folds:
        enough = enough & (F.abs("val_ic") >= limit["val_ic"]) & (F.col("val_sharpe") >= limit["val_sharpe"]) & (F.signum("train_ic") == F.signum("val_ic"))
    reason = F.when(~F.coalesce(enough, F.lit(False)), "below_threshold")
    for fold in reversed([f for f in ("train", "test", "val") if f in folds]):
        reason = F.when(F.coalesce(F.col(f"bad_{fold}"), F.lit(True)), f"degenerate_{fold}").otherwise(reason)
    out = out.withColumn("reason", reason)
    why = F.when(F.col("reason") == "below_threshold", F.format_string(detail, "train_ic", "test_ic", "test_sharpe", "test_turnover")).when(F.col("reason").isNotNull(), F.col("expression"))
    return dropped.unionByName(out.select("name", "expression", "reason", why.alias("detail"), *columns))


# --- queries ---------------------------------------------------------------------------------------------------------

# Fixed values of the queries: portfolios and a library.
PORTFOLIOS = {
    "a": Portfolio(("close", "sub(high, low)"), (0.7, 0.3)), "b": Portfolio(("neg(open)", "close", "volume"), (0.5, 0.25, 0.25)), "c": Portfolio(("sub(high, low)",), (1.0,)), "d": Portfolio(("volume", "neg(close)"), (0.4, 0.6)),
}
DAY = "2024-01-16"


def _z(x: str) -> str:
    return f"({x} - avg({x}) over (partition by date)) / (stddev_samp({x}) over (partition by date) + 1e-8)"


def _figures_sql(fold: str, long: str) -> str:
    """Common table expressions c_, fig_ of a fold from rows (factor, symbol, date, f, r) in `long`."""
    k = fold
    rank = lambda x: f"(rank() over (partition by factor, date order by {x}) + (count(*) over (partition by factor, date, {x}) - 1) / 2.0) / count(*) over (partition by factor, date)"
    pear = lambda a, b: f"case when min({a}) <> max({a}) and min({b}) <> max({b}) then covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) end"
    return f"""c_{k} as (select *, {rank('f')} as rf, {rank('r')} as rr, list_sort(list_distinct(quantile_cont(f, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) over (partition by factor, date))) as e from {long} where f is not null and r is not null),
 i_{k} as (select factor, coalesce(avg(ic), 0) as ic, coalesce(avg(ric), 0) as rank_ic from (select factor, date, {pear('f', 'r')} as ic, {pear('rf', 'rr')} as ric from c_{k} group by 1, 2) group by 1),
 b_{k} as (select *, case when len(e) > 1 then greatest(0, len(list_filter(e, lambda y: y < f)) - 1) end as q from c_{k}),
 s_{k} as (select factor, date, coalesce(hi, 0) - coalesce(lo, 0) as ls from (select factor, date, avg(case when q = 4 then r end) as hi, avg(case when q = 0 then r end) as lo from b_{k} group by 1, 2) where hi is not null or lo is not null),
 w_{k} as (select factor, symbol, date, f / (sum(abs(f)) over (partition by factor, date) + 1e-8) as w from {long}), t_{k} as (select factor, date, abs(w - lag(w) over (partition by factor, symbol order by date)) as t from w_{k}),
 u_{k} as (select factor, coalesce(avg(m), 0) as turnover from (select factor, date, avg(t) as m from t_{k} group by 1, 2) group by 1),
 q_{k} as (select factor, date, ls, product(1 + 0.01 * ls) over (partition by factor order by date) as equity from s_{k}), d_{k} as (select *, equity / max(equity) over (partition by factor order by date) - 1 as dd from q_{k}),
 fig_{k} as (select i.factor, ic, rank_ic, turnover, coalesce(avg(ls) / (stddev_samp(ls) + 1e-8) * sqrt(252), 0) as sharpe, min(dd) as mdd from i_{k} i join u_{k} u using (factor) join d_{k} d on d.factor = i.factor group by all)"""


def _portfolio_sql() -> str:
    cte, term = [], {"close": "zc", "sub(high, low)": "zs", "neg(open)": "zo", "volume": "zv", "neg(close)": "-zc"}
    for k, where in (("train", f"date <= date '{DAY}'"), ("test", f"date >= date '{DAY}'")):
        cte.append(f"z_{k} as (select symbol, date, forward_return as r, {_z('close')} as zc, {_z('(high - low)')} as zs, {_z('(-open)')} as zo, {_z('volume')} as zv from p where {where})")
        parts = " union all ".join(f"select '{n}' as factor, symbol, date, r, {' + '.join(f'{w!r} * ({term[f]})' for f, w in zip(x.formulas, x.weights))} as f from z_{k}" for n, x in PORTFOLIOS.items())
        cte += [f"l_{k} as ({parts})", _figures_sql(k, f"l_{k}")]
    listed = ", ".join(f"('{n}', {len(x.formulas)}, '{','.join(map(str, x.weights))}', '{' | '.join(x.formulas)}')" for n, x in PORTFOLIOS.items())
    return f"""with {USER_DAY}, {', '.join(cte)}, n(factor, n_factors, weights, expressions) as (values {listed})
 select row_number() over (order by t.sharpe desc, t.factor)::int as rank, t.factor as candidate_id, round(a.sharpe, 4) + 0.0 as train_sharpe, round(t.ic, 6) + 0.0 as test_ic, round(t.rank_ic, 6) + 0.0 as test_rank_ic, round(t.sharpe, 4) + 0.0 as test_sharpe, round(t.mdd, 5) + 0.0 as test_mdd, n_factors::int as n_factors, weights, expressions
 from fig_test t join fig_train a on a.factor = t.factor join n on n.factor = t.factor qualify rank <= 3"""


@query("portfolio_leaderboard", _portfolio_sql())
def portfolio_leaderboard(spark, sf_dir):
    """The three best of four portfolios by Sharpe on the later fold."""
    train, test = panels.split(panels.user_day(spark, sf_dir), DAY)
    out = leaderboard(train, test, PORTFOLIOS, 3, share=0.01)
    return out.select("rank", "candidate_id", F.round("train_sharpe", 4).alias("train_sharpe"), F.round("test_ic", 6).alias("test_ic"), F.round("test_rank_ic", 6).alias("test_rank_ic"), F.round("test_sharpe", 4).alias("test_sharpe"), F.round("test_mdd", 5).alias("test_mdd"), "n_factors", F.array_join(F.transform("weights", lambda w: w.cast("string")), ",").alias("weights"), "expressions")


LIBRARY = {
    "spread": "sub(high, low)", "fall": "neg(close)", "busy": "volume", "flat": "mul(close, 0)", "broken": "sub(close", "unknown": "frobnicate(close)", "self": "ts_corr(close, close, 5)", "absent": "neg(earnings)", "sparse": "log(sub(close, 40))", "open": "open",
}
_LIB = {"spread": "high - low", "fall": "-close", "busy": "volume", "flat": "close * 0", "sparse": "case when close > 40 then ln(close - 40) end", "open": "open"}


def _library_sql() -> str:
    cte = []
    for k, where in (("train", f"date <= date '{DAY}'"), ("test", f"date >= date '{DAY}'")):
        parts = " union all ".join(f"select '{n}' as factor, symbol, date, forward_return as r, {x} as f from p where {where}" for n, x in _LIB.items())
        cte += [f"l_{k} as ({parts})", _figures_sql(k, f"l_{k}"), f"""g_{k} as (select factor, 1 - sum(n_) / sum(n) as nulls, avg(n_ / n) as coverage from (select factor, date, count(*) as n, count(f) as n_ from l_{k} group by 1, 2) group by 1),
 v_{k} as (select g.factor, nulls > 0.2 or coverage < 0.5 or coalesce(spread < 1e-8, true) as bad from g_{k} g join (select factor, case when min(f) = max(f) then 0 else stddev_samp(f) end as spread from l_{k} group by 1) s using (factor))"""]
    static = "('broken', 'parse_error'), ('unknown', 'parse_error'), ('self', 'constant_correlation'), ('absent', 'eval_error')"
    return f"""with {USER_DAY}, {', '.join(cte)}, e(name, reason) as (values {static})
 select v.factor as name, case when v.bad then 'degenerate_train' when w.bad then 'degenerate_test' when not coalesce(abs(a.ic) >= 0.005 and abs(b.ic) >= 0.003 and b.sharpe >= 0 and b.turnover <= 0.5, false) then 'below_threshold' end as reason,
  round(coalesce(a.ic, 0), 6) + 0.0 as train_ic, round(coalesce(b.ic, 0), 6) + 0.0 as test_ic, round(coalesce(b.sharpe, 0), 4) + 0.0 as test_sharpe, round(coalesce(b.turnover, 0), 6) + 0.0 as test_turnover
 from v_train v join v_test w using (factor) left join fig_train a using (factor) left join fig_test b using (factor) union all select name, reason, null, null, null, null from e"""


@query("factor_cleaning", _library_sql())
def factor_cleaning(spark, sf_dir):
    """A library with the first reason for each formula that goes."""
    train, test = panels.split(panels.user_day(spark, sf_dir), DAY)
    out = clean_library(LIBRARY, {"train": train, "test": test}, share=0.01)
    return rounded(out.select("name", "reason", "train_ic", "test_ic", F.round("test_sharpe", 4).alias("test_sharpe"), "test_turnover"))
