"""Micro-panels against pandas: ties, nulls, constants, one symbol, one date, cold folds, decays over long series."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import dsl
from quillon.operators import cross, indicators, quality, rolling
from quillon.sources import panels

DAY = datetime.date(2024, 1, 1)


def panel(spark, columns):
    """columns: name -> {symbol: values}."""
    first = next(iter(columns.values()))
    rows = [(s, DAY + datetime.timedelta(days=i), *[None if c[s][i] is None else float(c[s][i]) for c in columns.values()]) for s in first for i in range(len(first[s]))]
    return spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"`{c}` double" for c in columns))


def values(df, name="v"):
    out = df.select("symbol", "date", F.col(name).alias("v")).toPandas().sort_values(["symbol", "date"])
    return {s: [None if pd.isna(x) else float(x) for x in g.v] for s, g in out.groupby("symbol")}


def same(got, want):
    got = {s: [None if x is None or pd.isna(x) else float(x) for x in v] for s, v in got.items()}
    for s in want:
        w = [None if x is None or pd.isna(x) else float(x) for x in want[s]]
        assert [x is None for x in got[s]] == [x is None for x in w]
        assert np.allclose([x for x in got[s] if x is not None], [x for x in w if x is not None], rtol=1e-9, atol=1e-9)


def random_series(n, nulls, seed):
    r = np.random.default_rng(seed)
    return [None if r.random() < nulls else float(round(r.standard_normal(), 1)) for _ in range(n)]


def test_rolling_against_pandas(spark):
    data = {"a": random_series(40, 0.2, 1), "b": random_series(40, 0.0, 2), "c": [None] * 40, "d": [1.0] * 40}
    p = panel(spark, {"x": data})
    made = dsl.evaluate(p, {f"{op}_{n}": f"{op}(x, {n})" for op in dsl.ROLLING for n in (1, 3, 7)}).cache()
    for n in (1, 3, 7):
        def by(fn):
            return {s: list(fn(pd.Series(v, dtype=float))) for s, v in data.items()}

        roll = lambda x: x.rolling(n, min_periods=1)  # noqa: B023, E731
        z = lambda x: (x - roll(x).mean()) / (roll(x).std() + 1e-8)
        same(values(made, f"ts_mean_{n}"), by(lambda x: roll(x).mean()))
        same(values(made, f"ts_std_{n}"), by(lambda x: roll(x).std()))
        same(values(made, f"ts_sum_{n}"), by(lambda x: roll(x).sum()))
        same(values(made, f"ts_min_{n}"), by(lambda x: roll(x).min()))
        same(values(made, f"ts_max_{n}"), by(lambda x: roll(x).max()))
        same(values(made, f"ts_delta_{n}"), by(lambda x: x - x.shift(n)))  # noqa: B023
        same(values(made, f"ts_delay_{n}"), by(lambda x: x.shift(n)))  # noqa: B023
        same(values(made, f"ts_zscore_{n}"), by(z))
        same(values(made, f"ts_rank_{n}"), by(lambda x: roll(x).rank(pct=True)))
        same(values(made, f"ts_pct_change_{n}"), by(lambda x: (x.ffill() / x.ffill().shift(n).replace(0, np.nan) - 1)))  # noqa: B023
        same(values(made, f"ts_ema_{n}"), by(lambda x: x.ewm(span=n, adjust=True).mean()))  # noqa: B023

        def arg(best):
            def one(v):
                out = []
                for i in range(len(v)):
                    w = v[max(0, i - n + 1) : i + 1]  # noqa: B023
                    k = [x for x in w if x is not None]
                    out.append(None if not k else (w.index(None) if None in w else w.index(best(k))) / max(1, len(w) - 1))
                return out

            return {s: one(v) for s, v in data.items()}

        same(values(made, f"ts_argmax_{n}"), arg(max))
        same(values(made, f"ts_argmin_{n}"), arg(min))


def test_pair_windows(spark):
    x, y = {"a": random_series(30, 0.2, 3), "b": [2.0] * 30}, {"a": random_series(30, 0.2, 4), "b": random_series(30, 0, 5)}
    made = dsl.evaluate(panel(spark, {"x": x, "y": y}), {"r": "ts_corr(x, y, 6)", "c": "ts_cov(x, y, 6)"})
    def want(how):
        out = {}
        for s in x:
            u, v = pd.Series(x[s], dtype=float), pd.Series(y[s], dtype=float)
            ok = u.notna() & v.notna()
            res = []
            for i in range(30):
                a, b = u[max(0, i - 5) : i + 1][ok], v[max(0, i - 5) : i + 1][ok]
                if how == "r":
                    res.append(a.corr(b) if len(a) > 1 and a.nunique() > 1 and b.nunique() > 1 else None)
                else:
                    res.append(a.cov(b) if len(a) > 1 else None)
            out[s] = res
        return out

    same(values(made, "r"), want("r"))
    same(values(made, "c"), want("c"))


def test_ema_of_a_long_series_crosses_blocks(spark):
    x = random_series(5000, 0.3, 6)
    x[1000:3500] = [None] * 2500  # longer than two blocks
    got = values(rolling.with_ema(panel(spark, {"x": {"a": x}}), F.col("x"), 3, "v"))
    same(got, {"a": pd.Series(x, dtype=float).ewm(span=3, adjust=True).mean()})


@pytest.mark.parametrize("wide_", [False, True])
def test_cross_sections(spark, wide_):
    data = {f"s{k:02d}": [float(k % 7), 1.0, None if k % 3 else float(k), float(k)] for k in range(23)}
    p = panel(spark, {"x": data})
    wide = pd.DataFrame(data).T
    same(values(cross.with_columns(p, {"v": ("cs_rank", "x")}, wide=wide_)), wide.rank(pct=True).T.to_dict("list"))
    same(values(cross.with_columns(p, {"v": ("cs_zscore", "x")}, wide=wide_)), ((wide - wide.mean()) / (wide.std() + 1e-8)).T.to_dict("list"))
    same(values(cross.with_columns(p, {"v": ("winsorize", "x")}, wide=wide_)), wide.clip(wide.quantile(0.01), wide.quantile(0.99), axis=1).T.to_dict("list"))
    buckets = wide.apply(lambda c: pd.qcut(c, 5, labels=False, duplicates="drop") if c.nunique() > 1 else c * np.nan)
    same(values(cross.with_columns(p, {"v": ("bucket", "x", 5)}, wide=wide_).withColumn("v", F.col("v").cast("double"))), buckets.T.to_dict("list"))


def test_one_symbol_and_one_date(spark):
    p = panel(spark, {"x": {"a": [1.0, 2.0, 4.0]}, "y": {"a": [3.0, 1.0, 2.0]}})
    v = dsl.evaluate(p, {"r": "ts_corr(x, y, 3)", "z": "cs_zscore(x)", "k": "cs_rank(x)"}).toPandas()
    assert v.z.isna().all() and (v.k == 1).all() and abs(v.r.iloc[2] - np.corrcoef([1, 2, 4], [3, 1, 2])[0, 1]) < 1e-12
    q = p.limit(1).withColumn("forward_return", F.lit(0.1))
    assert quality.ic_score(quality.daily_ic(q, "x")).first().ic == 0.0 and quality.long_short(q, "x").count() == 0


def test_folds_start_cold_and_share_the_split_day(spark):
    p = panel(spark, {"x": {"a": [1.0, 2.0, 3.0, 4.0]}})
    train, test = panels.split(p, "2024-01-03")
    assert train.count() == 3 and test.count() == 2
    cold = values(dsl.evaluate(test, {"v": "ts_sum(x, 3)"}))
    assert cold == {"a": [3.0, 7.0]}
    assert {r.fold: r.n for r in panels.folds(p, "2024-01-03").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {"train": 3, "test": 2}
    assert [d.count() for d in panels.three_way(p, "2024-01-02", "2024-01-03")] == [2, 2, 2]


def test_scalars_follow_the_null_rules(spark):
    p = panel(spark, {"x": {"a": [1.0, None, -4.0, 0.0]}, "y": {"a": [0.0, 1.0, 2.0, None]}})
    v = dsl.evaluate(p, {"d": "div(x, y)", "g": "greater(x, y)", "i": "if_positive(x, y)", "e": "if_else(x, x, y)", "l": "log(x)", "s": "signed_power(x)"}).orderBy("date").collect()
    assert [r.d for r in v] == [None, None, -2.0, None] and [r.g for r in v] == [1, 0, 0, 0] and [r.i for r in v] == [0, 0, 0, 0]
    assert [r.e for r in v] == [1.0, 1.0, 2.0, None] and [r.l for r in v] == [0, None, None, None] and [r.s for r in v] == [1, None, -2, 0]


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(panels.known(F.col("x"))).collect()] == [None, None, 1.5, None]


@pytest.mark.parametrize("text", ["neg(cs_rank(ts_mean(return, 5)))", "div(sub(close, open), open)", "if_else(greater(return, 0.0), close, neg(close))", "ts_corr(close, volume, 20)", "add(forward_return, 1e-08)"])
def test_formulas_round_trip(text):
    node = dsl.parse(text)
    assert str(node) == text and dsl.parse(str(node)) == node and dsl.from_json(dsl.to_json(node)) == node


@pytest.mark.parametrize("text", ["ts_mean(x)", "ts_mean(x, 0)", "ts_delay(x, -1)", "nope(x)", "x + 1", "x.y", "__import__('os')", "ts_mean(x, n)", "abs(x=1)", "(", ""])
def test_bad_formulas_are_refused(text):
    with pytest.raises(dsl.FormulaError):
        dsl.parse(text)


def test_problems():
    assert dsl.problems(dsl.parse("ts_corr(x, 1.0, 5)")) and dsl.problems(dsl.parse("ts_cov(x, x, 5)")) and dsl.problems(dsl.parse("add(1.0, 2.0)"))
    assert dsl.problems(dsl.parse("if_else(a, b, c)"), ["a", "b"]) == ["no column c"] and not dsl.problems(dsl.parse("-x"))


def test_equal_subtrees_are_computed_once(spark):
    p = panel(spark, {"x": {"a": [1.0, 2.0]}})
    plan = dsl.evaluate(p, {"u": "add(ts_mean(x, 2), ts_mean(x, 2))", "w": "neg(ts_mean(x, 2))"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1


def wilder(x, n, first, rate):
    out, y = [None] * len(x), None
    for i, v in enumerate(x):
        if i == first + n - 2:
            y = float(np.mean(x[first - 1 : first + n - 1]))
        elif i > first + n - 2:
            y = y + rate * (v - y)
        out[i] = y
    return out


def test_recursive_indicators(spark):
    r = np.random.default_rng(1)
    close = list(50 + np.cumsum(r.standard_normal(200)))
    high, low = [c + abs(r.standard_normal()) for c in close], [c - abs(r.standard_normal()) for c in close]
    p = panel(spark, {"close": {"a": close}, "high": {"a": high}, "low": {"a": low}, "volume": {"a": [1.0] * 200}})
    got = indicators.adx(indicators.atr(indicators.macd(indicators.rsi(p)))).orderBy("date").toPandas()
    d = [None, *np.diff(close)]
    up, down = wilder([0 if x is None else max(x, 0) for x in d], 14, 2, 1 / 14), wilder([0 if x is None else max(-x, 0) for x in d], 14, 2, 1 / 14)
    same({"a": list(got.rsi_14)}, {"a": [None if u is None else 100 * u / (u + v) for u, v in zip(up, down)]})
    fast, slow = wilder(close, 12, 15, 2 / 13), wilder(close, 26, 1, 2 / 27)
    macd = [None if s is None else f - s for f, s in zip(fast, slow)]
    signal = wilder([0 if m is None else m for m in macd], 9, 26, 2 / 10)
    same({"a": list(got.macd)}, {"a": macd})
    same({"a": list(got.macd_signal)}, {"a": signal})
    tr = [0.0] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, 200)]
    same({"a": list(got.atr_14)}, {"a": wilder(tr, 14, 2, 1 / 14)})
    mv = [(0.0, 0.0)] + [(high[i] - high[i - 1], low[i - 1] - low[i]) for i in range(1, 200)]
    plus, minus = wilder([a if a > b and a > 0 else 0.0 for a, b in mv], 14, 2, 1 / 14), wilder([b if b > a and b > 0 else 0.0 for a, b in mv], 14, 2, 1 / 14)
    dx = [0.0 if x is None or x + y == 0 else 100 * abs(x - y) / (x + y) for x, y in zip(plus, minus)]
    same({"a": list(got.adx_14)}, {"a": wilder(dx, 14, 15, 1 / 14)})


def test_decay_of_an_ic_series(spark):
    s = spark.createDataFrame([(i, v) for i, v in enumerate([0.20, 0.18, 0.15, 0.12])], "g int, ic double")
    assert quality.trend(s, "g", "ic", 3).first().slope < -0.005 and quality.trend(s, "g", "ic", 5).first().slope == 0.0
