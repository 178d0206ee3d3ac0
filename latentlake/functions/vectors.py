"""Vector scalars over array columns; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def as_double(arr: Column | str) -> Column:
    return F.transform(F.col(arr) if isinstance(arr, str) else arr, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def mean(arr: Column) -> Column:
    return _total(arr) / F.size(arr)


def var_pop(arr: Column, mu: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mu) * (x - mu)) / F.size(arr)


def softmax(arr: Column) -> Column:
    top = F.array_max(arr)
    exps = F.transform(arr, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / _total(exps))


def softplus(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


# (offset added under the root, offset added to the scale) per normalisation rule
_LAYER_RULES = {"layernorm": (0.0, 1e-8), "input_ln": (1e-5, 0.0)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable.

    A column that only a lambda refers to is inlined there by the optimizer and
    evaluated once per element; a bound variable is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(df, how: str, col: str = "features"):
    """Row-normalise an array column: ``l2``, ``layernorm`` or the affine-free ``input_ln``."""
    if how == "l2":
        scaled = lambda x: _let(F.sqrt(dot(x, x)) + 1e-8, lambda sd: F.transform(x, lambda v: v / sd))
    elif how in _LAYER_RULES:
        inside, outside = _LAYER_RULES[how]

        def scaled(x: Column) -> Column:
            spread = lambda mu: F.sqrt(var_pop(x, mu) + inside) + outside
            return _let(mean(x), lambda mu: _let(spread(mu), lambda sd: F.transform(x, lambda v: (v - mu) / sd)))

    else:
        raise ValueError(f"unknown normalisation: {how}")
    return df.withColumn(col, _let(as_double(col), scaled))
