"""Formula language over an entity-by-date panel: text -> tree -> staged Columns.

A formula is parsed into a tree of (op, arguments, value). Equal subtrees are one node. Nodes that need a window become
columns of their own, level by level over all formulas together: all rolling nodes of a level share the symbol exchange,
then all cross-sectional ones one aggregation by date and, for ranks, the date exchange (see operators.cross), so K formulas
pay about as many exchanges as the deepest of them.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cross, rolling

ARITY = {"abs": 1, "log": 1, "sign": 1, "neg": 1, "cs_rank": 1, "cs_zscore": 1, "signed_power": 1, "winsorize": 1, "add": 2, "sub": 2, "mul": 2, "div": 2, "greater": 2, "less": 2, "if_positive": 2, "if_else": 3}
ROLLING = ["ts_mean", "ts_std", "ts_sum", "ts_min", "ts_max", "ts_delta", "ts_delay", "ts_shift", "ts_ema", "ts_pct_change", "ts_zscore", "ts_rank", "ts_argmax", "ts_argmin"]
ROLLING_PAIR = ["ts_corr", "ts_cov"]
CROSS = ["cs_rank", "cs_zscore", "winsorize"]
MAX_NODES = 40


class FormulaError(ValueError):
    """A formula that can't be read or isn't allowed."""


@dataclass(frozen=True)
class Node:
    """op: 'var' and 'const' are leaves; value is a name, a number or a window."""

    op: str
    args: tuple[Node, ...] = ()
    value: str | float | int | None = None

    def __str__(self) -> str:
        if self.op == "var":
            return str(self.value)
        if self.op == "const":
            return repr(float(self.value))
        return f"{self.op}({', '.join([*map(str, self.args), *([str(self.value)] if self.value is not None else [])])})"

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()


def parse(text: str) -> Node:
    """The tree of a formula. Names may be Python keywords; windows are positive integers; keyword arguments and operators
    other than unary minus are refused."""
    safe = re.sub(r"(?<!\w)(return|class|is|in|lambda|global|pass)(?!\w)", r"kw_\1_kw", text)
    try:
        body = ast.parse(safe.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {text!r}") from e
    return _node(body)


def _node(x: ast.AST) -> Node:
    if isinstance(x, ast.Name):
        return Node("var", value=re.sub(r"^kw_(\w+)_kw$", r"\1", x.id))
    if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool):
        return Node("const", value=float(x.value))
    if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
        return Node("neg", (_node(x.operand),))
    if not isinstance(x, ast.Call) or not isinstance(x.func, ast.Name) or x.keywords:
        raise FormulaError(f"not allowed: {ast.unparse(x)}")
    op, n = x.func.id, len(x.args)
    inputs = ARITY.get(op) or (1 if op in ROLLING else 2 if op in ROLLING_PAIR else None)
    if inputs is None:
        raise FormulaError(f"unknown function {op}")
    windowed = op not in ARITY
    if n != inputs + windowed:
        raise FormulaError(f"{op} takes {inputs + windowed} arguments, not {n}")
    window = None
    if windowed:
        try:
            window = int(ast.literal_eval(x.args[-1]))
        except (ValueError, TypeError) as e:
            raise FormulaError(f"the window of {op} must be a number") from e
        if window < 1:
            raise FormulaError(f"the window of {op} must be positive: a negative one would look ahead")
    return Node(op, tuple(_node(a) for a in x.args[:inputs]), window)


def to_json(node: Node) -> str:
    def form(n: Node):
        if n.op in ("var", "const"):
            return {"type": n.op, "value": n.value}
        kind = "rolling" if n.op in ROLLING else "rolling_pair" if n.op in ROLLING_PAIR else "call"
        return {"type": kind, "op": n.op, "args": [form(a) for a in n.args]} | ({"window": n.value} if n.value is not None else {})

    return json.dumps(form(node), sort_keys=True)


def from_json(text: str) -> Node:
    def back(d: dict) -> Node:
        if d["type"] in ("var", "const"):
            return Node(d["type"], value=d["value"])
        return Node(d["op"], tuple(back(a) for a in d["args"]), d.get("window"))

    return back(json.loads(text))


def variables(node: Node) -> list[str]:
    return sorted({n.value for n in node.walk() if n.op == "var"})


def is_constant(node: Node) -> bool:
    """No variable anywhere below."""
    return not any(n.op == "var" for n in node.walk())


def problems(node: Node, columns: list[str] | None = None) -> list[str]:
    """Why a formula shouldn't enter a search: size, constants where a series is needed, unknown columns."""
    out = []
    if (size := sum(1 for _ in node.walk())) > MAX_NODES:
        out.append(f"{size} nodes")
    for n in node.walk():
        if n.op != "const" and is_constant(n) and n.op != "neg":
            out.append(f"constant: {n}")
        if n.op in ROLLING_PAIR and (any(is_constant(a) for a in n.args) or n.args[0] == n.args[1]):
            out.append(f"degenerate: {n}")
    if columns is not None:
        out += [f"no column {v}" for v in variables(node) if v not in columns]
    return out


def _scalar(op: str, a: list[Column]) -> Column:
    one = lambda c: c.cast("double")
    return {
        "abs": lambda: F.abs(a[0]),
        "log": lambda: F.when(a[0] > 0, F.log(a[0])),
        "sign": lambda: F.signum(a[0]),
        "neg": lambda: -a[0],
        "signed_power": lambda: F.signum(a[0]) * F.sqrt(F.abs(a[0])),
        "add": lambda: a[0] + a[1],
        "sub": lambda: a[0] - a[1],
        "mul": lambda: a[0] * a[1],
        "div": lambda: a[0] / F.nullif(a[1], F.lit(0.0)),
        "greater": lambda: F.coalesce(one(a[0] > a[1]), F.lit(0.0)),
        "less": lambda: F.coalesce(one(a[0] < a[1]), F.lit(0.0)),
        "if_positive": lambda: F.coalesce(F.when(a[0] > 0, a[1]), F.lit(0.0)),
        "if_else": lambda: F.when(a[0] > 0, a[1]).otherwise(a[2]),
    }[op]()


def evaluate(panel: DataFrame, formulas: dict[str, str | Node], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """panel with one double column for each formula. Unknown columns raise. Rows are those of panel."""
    trees = {k: parse(f) if isinstance(f, str) else f for k, f in formulas.items()}
    for k, t in trees.items():
        if missing := [v for v in variables(t) if v not in panel.columns]:
            raise FormulaError(f"{k}: no column {', '.join(missing)}")
    depth: dict[Node, int] = {}

    def level(n: Node) -> int:
        if n not in depth:
            below = max(map(level, n.args), default=0)
            depth[n] = below + (n.op in CROSS or n.op in ROLLING or n.op in ROLLING_PAIR)
        return depth[n]

    for t in trees.values():
        level(t)
    made: dict[Node, str] = {}
    taken = {c.lower() for c in panel.columns}

    def name() -> str:
        k = len(made)
        while f"_f{k}" in taken:
            k += 1
        taken.add(f"_f{k}")
        return f"_f{k}"

    def column(n: Node) -> Column:
        if n in made:
            return F.col(made[n])
        if n.op == "var":
            return F.col(f"`{n.value}`").cast("double")
        if n.op == "const":
            return F.lit(float(n.value))
        return _scalar(n.op, [column(a) for a in n.args])

    out = panel
    for at in range(1, max(depth.values(), default=0) + 1):
        todo = [n for n in depth if depth[n] == at and (n.op in CROSS or n.op in ROLLING or n.op in ROLLING_PAIR)]
        for group in ([n for n in todo if n.op not in CROSS], [n for n in todo if n.op in CROSS]):
            if not group:
                continue
            inputs, exprs, names = {}, {}, {}
            for n in group:  # windows and aggregates read plain columns
                for a in n.args:
                    if a.op == "var" or a in made:
                        names[a] = made[a] if a in made else a.value
                    else:
                        names[a] = inputs.setdefault(a, name()) if a not in inputs else inputs[a]
                exprs[n] = [column(a) if a.op == "var" or a in made else F.col(inputs[a]) for a in n.args]
            if inputs:
                out = out.withColumns({c: column(a) for a, c in inputs.items()})
                made.update(inputs)
            if group[0].op in CROSS:
                for n in group:
                    made[n] = name()
                out = cross.with_columns(out, {made[n]: (n.op, names[n.args[0]]) for n in group}, date, symbol)
                continue
            late = [n for n in group if n.op == "ts_ema"]
            plain = {}
            for n in group:
                if n.op == "ts_ema":
                    continue
                made[n] = name()
                plain[made[n]] = getattr(rolling, n.op)(*exprs[n], n.value, symbol=symbol, date=date)
            if plain:
                out = out.withColumns(plain)
            for n in late:  # stages of its own on the same exchange
                made[n] = name()
                out = rolling.with_ema(out, exprs[n][0], n.value, made[n], symbol=symbol, date=date)
    out = out.withColumns({k: column(t) for k, t in trees.items()})
    return out.drop(*made.values())
