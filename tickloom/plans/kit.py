"""Feature plans: a column expression algebra that stays lazy until ``build``.

A Feature is a node with a name, the columns it needs and a builder of a Column
(or of a DataFrame step for kernels).  Arithmetic makes new nodes.  ``build``
evaluates nodes level by level, each distinct node once, so that a shared
intermediate is one column of the plan; window functions get one select a level.
Plans are JSON of registered names only: no configuration imports code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import breaks, entropy, recursive, rolling
from tickloom.functions.rolling import TAPE, Over

#: Kernel steps that a plan may name: function(df, column, ..., name=..., order=...).
KERNELS: dict[str, Callable[..., DataFrame]] = {
    "ewma": recursive.ewma, "ew_std": recursive.ew_std, "rsi": recursive.rsi, "frac_diff": breaks.frac_diff, "frac_diff_rolling": breaks.frac_diff_rolling,
    "frac_diff_expanding": breaks.frac_diff_expanding, "adf_rolling": breaks.adf_rolling, "sadf": breaks.sadf, "rolling_entropy": entropy.rolling_entropy, "hurst": entropy.hurst, "approximate_entropy": entropy.approximate_entropy,
}


def _clip(x: Column, lo: float | None, hi: float | None) -> Column:
    x = x if lo is None else F.greatest(x, F.lit(float(lo)))
    return x if hi is None else F.least(x, F.lit(float(hi)))


_UNARY: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "exp": F.exp, "square": lambda x: x * x, "log": lambda x: F.when(x > 0, F.ln(x)), "log1p": lambda x: F.when(x > -1, F.log1p(x)), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "clip": lambda x, lo=None, hi=None: F.when(x.isNotNull(), _clip(x, lo, hi)),
}
_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide,
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
}
#: User functions by name, for Feature.apply and external(): a Column function of one or more Columns.
FUNCTIONS: dict[str, Callable[..., Any]] = {}


def register(name: str, f: Callable[..., Any]) -> None:
    """Makes a Column function known to plans and their JSON form."""
    FUNCTIONS[name] = f


class Feature:
    """A node of a plan."""

    def __init__(self, kind: str, name: str, inputs: Sequence[Feature | str | float] = (), **params: Any) -> None:
        self.kind, self.name, self.inputs, self.params = kind, name, list(inputs), params

    # building blocks
    @staticmethod
    def column(name: str) -> Feature:
        return Feature("column", name)

    @staticmethod
    def native(function: str, *inputs: str | Feature, name: str | None = None, **params: Any) -> Feature:
        """A registered native function of columns or features."""
        if function not in rolling.REGISTRY:
            raise ValueError(f"no native function {function}")
        shown = "_".join(map(str, params.values()))
        return Feature("native", name or f"{'_'.join(_named(i) for i in inputs)}_{function}{shown}", inputs, function=function, args=params)

    @staticmethod
    def kernel(function: str, x: str | Feature, name: str | None = None, **params: Any) -> Feature:
        if function not in KERNELS:
            raise ValueError(f"no kernel {function}")
        shown = "_".join(map(str, params.values()))
        return Feature("kernel", name or f"{_named(x)}_{function}{shown}", [x], function=function, args=params)

    @staticmethod
    def external(function: str, *inputs: str | Feature, name: str) -> Feature:
        return Feature("external", name, inputs, function=function)

    # algebra
    def _binary(self, op: str, other: Feature | float, swap: bool = False) -> Feature:
        pair = [other, self] if swap else [self, other]
        return Feature("binary", f"{op}({_named(pair[0])},{_named(pair[1])})", pair, op=op)

    def __add__(self, other): return self._binary("add", other)  # noqa: E704
    def __radd__(self, other): return self._binary("add", other, True)  # noqa: E704
    def __sub__(self, other): return self._binary("sub", other)  # noqa: E704
    def __rsub__(self, other): return self._binary("sub", other, True)  # noqa: E704
    def __mul__(self, other): return self._binary("mul", other)  # noqa: E704
    def __rmul__(self, other): return self._binary("mul", other, True)  # noqa: E704
    def __truediv__(self, other): return self._binary("div", other)  # noqa: E704
    def __rtruediv__(self, other): return self._binary("div", other, True)  # noqa: E704
    def __abs__(self): return self._unary("abs")  # noqa: E704

    def _unary(self, op: str, *args: Any) -> Feature:
        return Feature("unary", f"{op}({self.name}{''.join(f',{a}' for a in args)})", [self], op=op, args=list(args))

    def abs(self) -> Feature:
        return self._unary("abs")

    def log(self) -> Feature:
        return self._unary("log")

    def log1p(self) -> Feature:
        return self._unary("log1p")

    def exp(self) -> Feature:
        return self._unary("exp")

    def square(self) -> Feature:
        return self._unary("square")

    def sqrt(self) -> Feature:
        return self._unary("sqrt")

    def clip(self, lower: float | None = None, upper: float | None = None) -> Feature:
        return self._unary("clip", lower, upper)

    def lag(self, n: int) -> Feature:
        return Feature.native("lag", self, n=n)

    def rolling_mean(self, n: int) -> Feature:
        return Feature.native("sma", self, n=n)

    def rolling_sum(self, n: int) -> Feature:
        return Feature.native("rolling_sum", self, n=n)

    def rolling_std(self, n: int) -> Feature:
        return Feature.native("rolling_std", self, n=n)

    def ema(self, span: int) -> Feature:
        return Feature.kernel("ewma", self, span=span)

    def apply(self, function: str, suffix: str | None = None) -> Feature:
        """A registered user function of this feature, named with a suffix."""
        return Feature.external(function, self, name=f"{self.name}_{suffix or function}")

    @staticmethod
    def min(a: Feature, b: Feature | float) -> Feature:
        return a._binary("min", b)

    @staticmethod
    def max(a: Feature, b: Feature | float) -> Feature:
        return a._binary("max", b)

    def named(self, name: str) -> Feature:
        return Feature(self.kind, name, self.inputs, **self.params)

    # plan
    @property
    def parents(self) -> list[Feature]:
        return [i for i in self.inputs if isinstance(i, Feature)]

    @property
    def requires(self) -> set[str]:
        own = {self.name} if self.kind == "column" else {i for i in self.inputs if isinstance(i, str)}
        return own.union(*(p.requires for p in self.parents))

    def level(self) -> int:
        return 0 if self.kind == "column" else 1 + max((p.level() for p in self.parents), default=0)

    def to_config(self) -> dict:
        inputs = [i.to_config() if isinstance(i, Feature) else i for i in self.inputs]
        return {"kind": self.kind, "name": self.name, "inputs": inputs, "params": self.params}

    @staticmethod
    def from_config(cfg: dict) -> Feature:
        if cfg["kind"] not in ("column", "native", "kernel", "external", "unary", "binary"):
            raise ValueError(f"no such node: {cfg['kind']}")
        return Feature(cfg["kind"], cfg["name"], [Feature.from_config(i) if isinstance(i, dict) else i for i in cfg["inputs"]], **cfg["params"])

    def expression(self, over: Over) -> Column:
        value = lambda i: _quoted(i.name) if isinstance(i, Feature) else F.col(i) if isinstance(i, str) else F.lit(float(i))
        x = [value(i) for i in self.inputs]
        if self.kind == "column":
            return F.col(self.name)
        if self.kind == "native":
            f = rolling.REGISTRY[self.params["function"]]
            return f(*x, **self.params["args"], **({"over": over} if "over" in f.__code__.co_varnames else {}))
        if self.kind == "unary":
            return _UNARY[self.params["op"]](*x, *self.params.get("args", []))
        if self.kind == "binary":
            return _BINARY[self.params["op"]](*x)
        return FUNCTIONS[self.params["function"]](*x)


def _named(i: Feature | str | float) -> str:
    return i.name if isinstance(i, Feature) else str(i)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compose(first: Feature, *steps: Callable[[Feature], Feature]) -> Feature:
    """A chain of one-input steps."""
    for s in steps:
        first = s(first)
    return first


class FeatureKit:
    """A list of features and the columns to keep beside them."""

    def __init__(self, features: Sequence[Feature], retain: Sequence[str] = (), over: Over = TAPE) -> None:
        self.features, self.retain, self.over = list(features), list(retain), over

    def topological_order(self) -> list[Feature]:
        """All nodes, each after its parents, one for each name; two different nodes of one name are an error."""
        found: dict[str, Feature] = {}

        def visit(f: Feature) -> None:
            known = found.get(f.name)
            if known is None:
                for p in f.parents:
                    visit(p)
                found[f.name] = f
            elif known is not f and known.to_config() != f.to_config():
                raise ValueError(f"two different features are named {f.name}")

        for f in self.features:
            visit(f)
        return list(found.values())

    def edges(self) -> list[tuple[str, str]]:
        return [(_named(i), f.name) for f in self.topological_order() for i in f.inputs if not isinstance(i, (int, float))]

    def build(self, df: DataFrame) -> DataFrame:
        """retain, the ordering columns and the features, as one lazy plan."""
        nodes = [f for f in self.topological_order() if f.kind != "column"]
        for level in sorted({f.level() for f in nodes}):
            here = [f for f in nodes if f.level() == level]
            native = {f.name: f.expression(self.over) for f in here if f.kind != "kernel"}
            if native:
                df = df.withColumns(native)
            for k, f in enumerate(here):
                if f.kind == "kernel":
                    source = f.inputs[0]
                    plain = f"_in_{level}_{k}"
                    df = df.withColumn(plain, _quoted(_named(source)))
                    df = KERNELS[f.params["function"]](df, plain, **f.params["args"], name=plain + "_out", order=self.over.order)
                    df = df.withColumnRenamed(plain + "_out", f.name).drop(plain)
        names = list(dict.fromkeys([*self.over.by, *self.over.order, *self.retain]))
        return df.select(*names, *[_quoted(f.name) for f in self.features])

    def to_config(self) -> str:
        return json.dumps({"retain": self.retain, "by": self.over.by, "order": self.over.order, "features": [f.to_config() for f in self.features]})

    @staticmethod
    def from_config(text: str) -> FeatureKit:
        cfg = json.loads(text)
        return FeatureKit([Feature.from_config(f) for f in cfg["features"]], cfg["retain"], Over(tuple(cfg["by"]), tuple(cfg["order"])))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_config())

    @staticmethod
    def load(path: str) -> FeatureKit:
        with open(path) as f:
            return FeatureKit.from_config(f.read())
