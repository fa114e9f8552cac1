"""Search over formulas: a seeded random grammar on the driver, evaluation of a whole generation in one distributed job.

Selection looks at train figures only; test figures are for the leaderboard."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.dsl import Node
from ..operators import quality

# Windows and variables a search draws from.
WINDOWS = [3, 5, 10, 20, 60]
VARIABLES = ["open", "high", "low", "close", "volume", "vwap", "return"]
UNARY = [op for op, n in dsl.ARITY.items() if n == 1]
BINARY = [op for op, n in dsl.ARITY.items() if n == 2]


def grow(rng: random.Random, depth: int = 3, variables: list[str] | None = None) -> Node:
    names = variables or VARIABLES
    if depth == 0 or rng.random() < 0.15:
        return Node("var", value=rng.choice(names))
    sub = lambda: grow(rng, depth - 1, names)
    kind = rng.random()
    if kind < 0.35:
        return Node(rng.choice(dsl.ROLLING), (sub(),), rng.choice(WINDOWS))
    if kind < 0.45:
        return Node(rng.choice(dsl.ROLLING_PAIR), (sub(), sub()), rng.choice(WINDOWS))
    if kind < 0.70:
        return Node(rng.choice(UNARY), (sub(),))
    if kind < 0.95:
        return Node(rng.choice(BINARY), (sub(), sub()))
    return Node("if_else", (sub(), sub(), sub()))


def valid(rng: random.Random, depth: int = 3, variables: list[str] | None = None, tries: int = 50) -> Node:
    """A random formula without problems (size, constants, degenerate pairs)."""
    for _ in range(tries):
        node = grow(rng, depth, variables)
        if node.op != "var" and not dsl.problems(node):
            return node
    return dsl.parse("neg(cs_rank(ts_mean(return, 5)))")


def _replace(root: Node, old: Node, new: Node) -> Node:
    if root is old:
        return new
    args, done = [], False
    for a in root.args:
        b = a if done else _replace(a, old, new)
        done = done or b is not a
        args.append(b)
    return Node(root.op, tuple(args), root.value) if done else root


def mutate(node: Node, rng: random.Random, variables: list[str] | None = None) -> Node:
    """A subtree grown anew, a window changed, or an operator swapped for one of the same arity."""
    target = rng.choice(list(node.walk()))
    if target.op in dsl.ROLLING + dsl.ROLLING_PAIR and rng.random() < 0.5:
        same = dsl.ROLLING if target.op in dsl.ROLLING else dsl.ROLLING_PAIR
        new = Node(rng.choice(same), target.args, rng.choice(WINDOWS))
    else:
        new = grow(rng, 2, variables)
    out = _replace(node, target, new)
    return out if not dsl.problems(out) and out.op != "var" else node


def _leaf(rng: random.Random, variables: list[str] | None) -> Node:
    return Node("var", value=rng.choice(variables or VARIABLES)) if rng.random() < 0.8 else Node("const", value=round(rng.uniform(0.5, 3.0), 3))


def _same_shape(op: str) -> list[str]:
    """Operators that can stand where op stands."""
    if op in dsl.ROLLING or op in dsl.ROLLING_PAIR:
        return dsl.ROLLING if op in dsl.ROLLING else dsl.ROLLING_PAIR
    return [x for x, n in dsl.ARITY.items() if n == dsl.ARITY.get(op)]


def _rewindow(node: Node, rng: random.Random, variables: list[str] | None) -> Node:
    some = [n for n in node.walk() if n.value is not None and n.args]
    return _replace(node, old := rng.choice(some), Node(old.op, old.args, rng.choice(WINDOWS))) if some else node


def _reop(node: Node, rng: random.Random, variables: list[str] | None) -> Node:
    some = [n for n in node.walk() if n.args]
    return _replace(node, old := rng.choice(some), Node(rng.choice(_same_shape(old.op)), old.args, old.value)) if some else node


def _join(node: Node, rng: random.Random, variables: list[str] | None) -> Node:
    pair = (node, _leaf(rng, variables))
    return Node(rng.choice(BINARY), pair if rng.random() < 0.5 else pair[::-1])


#: Edits of a formula by name.
EDITS = {
    "wrap": lambda n, rng, v: Node(rng.choice(UNARY), (n,)),
    "join": _join,
    "window": _rewindow,
    "operator": _reop,
    "subtree": lambda n, rng, v: _replace(n, rng.choice(list(n.walk())), grow(rng, 2, v)),
    "lag": lambda n, rng, v: Node("ts_shift", (n,), rng.choice([1, 2, 3, 5])),
    "signed scale": lambda n, rng, v: Node("mul", (Node("sign", (n,)), Node("const", value=round(rng.uniform(0.5, 3.0), 3)))),
}


def edit(node: Node, rng: random.Random, variables: list[str] | None = None, kind: str | None = None) -> Node:
    """One edit, drawn or named; the formula itself where the result is too large or degenerate."""
    out = EDITS[kind or rng.choice(list(EDITS))](node, rng, variables)
    return out if not dsl.problems(out) and out.op not in ("var", "const") else node


def perturb_constant(node: Node, rng: random.Random, scale: float = 0.1) -> Node:
    """One constant moved by at most that share of itself."""
    consts = [n for n in node.walk() if n.op == "const"]
    return _replace(node, old := rng.choice(consts), Node("const", value=round(old.value * (1 + rng.uniform(-scale, scale)), 4))) if consts else node


def cross(a: Node, b: Node, rng: random.Random) -> Node:
    """A subtree of b in place of one of a (not the root)."""
    inner = list(a.walk())[1:]
    if not inner:
        return a
    out = _replace(a, rng.choice(inner), rng.choice(list(b.walk())))
    return out if not dsl.problems(out) else a


@dataclass
class Search:
    """Generations of formulas over a train panel."""

    panel: DataFrame
    size: int = 8
    seed: int = 0
    elite: int = 2
    patience: int = 3
    target: str = "forward_return"
    mutator: str = "mutate"  # or "edit"
    population: list[Node] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.rng = random.Random(self.seed)
        seen: set[Node] = set(self.population)
        while len(self.population) < self.size:
            n = valid(self.rng)
            if n not in seen or len(seen) > 10 * self.size:
                seen.add(n)
                self.population.append(n)

    def evaluate(self, panel: DataFrame | None = None) -> dict[Node, dict]:
        """Figures of all formulas by one job; a few dozen rows come back."""
        names = {f"f{i}": n for i, n in enumerate(self.population)}
        scored = quality.scorecard(dsl.evaluate(self.panel if panel is None else panel, names), list(names), self.target)
        return {names[r.factor]: r.asDict() for r in scored.collect()}

    def step(self) -> dict:
        """One generation: evaluate, record, breed."""
        found = self.evaluate()
        ranked = sorted(self.population, key=lambda n: (-found[n]["score"], str(n)))
        best = found[ranked[0]]
        self.history.append({"generation": len(self.history), "best_score": best["score"], "best_ic": best["ic"], "mean_score": sum(f["score"] for f in found.values()) / len(found), "best_expression": str(ranked[0])})
        nxt = ranked[: self.elite]
        tries = 0
        while len(nxt) < self.size:
            a, b = (self.rng.choice(ranked[: max(2, self.size // 2)]) for _ in range(2))
            change = edit if self.mutator == "edit" else mutate
            child = change(cross(a, b, self.rng) if self.rng.random() < 0.5 else a, self.rng)
            tries += 1
            if child not in nxt or tries > 20 * self.size:
                nxt.append(child if child not in nxt else valid(self.rng))
        self.population = nxt
        return self.history[-1]

    def run(self, generations: int) -> list[dict]:
        """Stops early once the best score hasn't risen for `patience` generations."""
        for _ in range(generations):
            self.step()
            scores = [h["best_score"] for h in self.history]
            if len(scores) > self.patience and max(scores[-self.patience :]) <= max(scores[: -self.patience]) + 1e-6:
                break
        return self.history

    def leaderboard(self, test: DataFrame, n: int = 10) -> DataFrame:
        """rank, expression, train and test figures, by train score."""
        train, held = self.evaluate(), self.evaluate(test)
        rows = [(str(x), train[x]["score"], train[x]["ic"], held[x]["ic"], held[x]["turnover"]) for x in dict.fromkeys(self.population)]
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
        return test.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, expression string, train_score double, train_ic double, test_ic double, turnover double")


def tune_constants(formula: Node, panel: DataFrame, tries: int = 8, seed: int = 0) -> Node:
    """Constants redrawn around their values; all variants are scored on train in one job, the best is kept."""
    rng, variants = random.Random(seed), [formula]
    consts = [n for n in formula.walk() if n.op == "const"]
    for _ in range(tries if consts else 0):
        out = formula
        for c in consts:
            out = _replace(out, next((x for x in out.walk() if x is c), c), Node("const", value=c.value * rng.uniform(0.5, 2.0)))
        variants.append(out)
    names = {f"f{i}": n for i, n in enumerate(dict.fromkeys(variants))}
    got = {r.factor: r.score for r in quality.scorecard(dsl.evaluate(panel, names), list(names)).collect()}
    return names[max(names, key=lambda k: (got[k], -int(k[1:])))]


def clean(formulas: list[str], panel: DataFrame) -> list[tuple[str, str | None]]:
    """Each formula with the first reason to drop it (unreadable, problems, degenerate), or None."""
    out: list[tuple[str, str | None]] = []
    good: dict[str, Node] = {}
    for i, text in enumerate(formulas):
        try:
            node = dsl.parse(text)
            bad = dsl.problems(node, panel.columns)
            out.append((text, bad[0] if bad else None))
            if not bad:
                good[f"f{i}"] = node
        except dsl.FormulaError as e:
            out.append((text, str(e)))
    if good:
        values = dsl.evaluate(panel, good)
        row = values.agg(*[F.struct(F.avg(F.col(k).isNull().cast("double")).alias("nulls"), F.stddev_pop(k).alias("spread")).alias(k) for k in good]).first()
        for k in good:
            if row[k].nulls is None or row[k].nulls > 0.3 or (row[k].spread or 0.0) < 1e-8:
                out[int(k[1:])] = (formulas[int(k[1:])], "degenerate")
    return out
