"""Class decisions, probabilities and the exact forward pass of a given ReLU head."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textlab.functions.binding import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


# -- probabilities and decisions --------------------------------------------

def sigmoid_col(z: Column | str) -> Column:
    """``1 / (1 + exp(-z))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def _shifted_exps(z: Column | str) -> Column:
    zs = _doubles(z)
    return let(F.array_max(zs), lambda top: F.transform(zs, lambda v: F.exp(v - top)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def softmax_col(z: Column | str) -> Column:
    """Probabilities of an array of logits, shifted by the maximum."""
    return let(
        _shifted_exps(z),
        lambda e: let(_total(e), lambda total: F.transform(e, lambda v: v / total)),
    )


def predict_binary(z: Column | str) -> Column:
    """1 when the probability rounds to 1 (half to even, so a zero logit gives 0)."""
    return (_col(z) > 0).cast("int")


def predict_multiclass(z: Column | str) -> Column:
    """Class of the largest logit, the first one on ties."""
    c = _col(z)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


# -- losses per row ---------------------------------------------------------

def bce_term(z: Column | str, y: Column | str) -> Column:
    """Binary cross-entropy of one logit, without overflow for large ``|z|``."""
    zc, yc = _col(z), _col(y)
    return F.greatest(zc, F.lit(0.0)) - zc * yc + F.log1p(F.exp(-F.abs(zc)))


def nll_term(z: Column | str, y: Column | str) -> Column:
    """Negative log-likelihood of class ``y`` under an array of logits."""
    zs = _doubles(z)
    log_sum = F.array_max(zs) + F.log(_total(_shifted_exps(z)))
    return log_sum - F.get(zs, _col(y).cast("int"))


# -- vectors ----------------------------------------------------------------

def pool_first(tokens: Column | str) -> Column:
    """Vector of the first token of an array of token vectors."""
    return F.get(_col(tokens), F.lit(0))


def truncate_vector(v: Column | str) -> Column:
    """Elements cut to whole numbers, as a label-typed cast does for several classes."""
    return F.transform(_col(v), lambda x: x.cast("bigint"))


# -- ReLU head --------------------------------------------------------------

@dataclass(frozen=True)
class Layer:
    """One linear layer: ``weights[out][in]`` and ``bias[out]``."""

    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]

    @staticmethod
    def of(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Layer:
        if len(weights) != len(bias):
            raise ValueError("one bias per output is required")
        return Layer(tuple(tuple(map(float, w)) for w in weights), tuple(map(float, bias)))

    @property
    def products(self) -> int:
        return sum(len(w) for w in self.weights)


# A weight literal beyond this many products bloats the plan; numbers travel to the
# Python workers instead.
NATIVE_PRODUCTS = 4096


def _native_layer(x: Column, layer: Layer, relu: bool) -> Column:
    width = len(layer.weights[0])
    units = F.lit([list(w) + [b] for w, b in zip(layer.weights, layer.bias)])

    def unit(w: Column, inputs: Column) -> Column:
        dot = _total(F.zip_with(w, inputs, lambda a, b: a * b))
        return F.greatest(dot, F.lit(0.0)) if relu else dot

    checked = F.when(F.size(x) == width, x).when(
        x.isNotNull(), F.raise_error(F.lit(f"vector width differs from {width}"))
    )
    # The bias is the weight of a constant 1 behind the inputs.
    padded = F.concat(checked, F.array(F.lit(1.0)))
    return let(padded, lambda inputs: F.when(
        inputs.isNotNull(), F.transform(units, lambda w: unit(w, inputs))
    ))


def _arrow_head(layers: Sequence[Layer]):
    mats = [(np.asarray(m.weights), np.asarray(m.bias)) for m in layers]

    @pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            known = vectors.notna().to_numpy()
            out = np.full(len(vectors), None, dtype=object)
            if known.any():
                x = np.stack(vectors[known].to_list()).astype(np.float64)
                for depth, (w, b) in enumerate(mats):
                    x = x @ w.T + b
                    if depth < len(mats) - 1:
                        x = np.maximum(x, 0.0)
                for i, row in zip(np.flatnonzero(known), x):
                    out[i] = row
            yield pd.Series(out)

    return forward


def score_head(vector: Column | str, layers: Sequence[Layer], engine: str = "auto") -> Column:
    """Logits of a feed-forward head: ReLU after every layer but the last.

    A reduction layer is simply the first layer. Dropout is the identity when scoring,
    and so is an attention gate whose softmax runs over one value. ``native`` stays in
    the JVM, ``arrow`` multiplies whole batches with NumPy; ``auto`` picks by size.
    """
    if not layers:
        raise ValueError("a head needs at least one layer")
    if engine == "auto":
        engine = "native" if sum(m.products for m in layers) <= NATIVE_PRODUCTS else "arrow"
    if engine == "arrow":
        return _arrow_head(layers)(_col(vector))
    if engine != "native":
        raise ValueError("engine must be 'auto', 'native' or 'arrow'")
    x = _doubles(vector)
    for i, layer in enumerate(layers):
        x = _native_layer(x, layer, relu=i < len(layers) - 1)
    return x
