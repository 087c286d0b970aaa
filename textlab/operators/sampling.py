"""Random draws from a hyper-parameter space, one row per trial."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.keys import hash_uniform


@dataclass(frozen=True)
class Choice:
    """One of the listed values; null may be among them."""

    options: tuple

    def draw(self, u: Column) -> Column:
        known = [o for o in self.options if o is not None]
        kind = "double" if any(isinstance(o, float) for o in known) else None
        values = [F.lit(o) if kind is None else F.lit(o).cast(kind) for o in self.options]
        return F.get(F.array(*values), F.floor(u * len(self.options)).cast("int"))


@dataclass(frozen=True)
class LogUniform:
    """Log-uniform double in [low, high)."""

    low: float
    high: float

    def draw(self, u: Column) -> Column:
        a, b = math.log(self.low), math.log(self.high)
        return F.exp(F.lit(a) + u * F.lit(b - a))


@dataclass(frozen=True)
class RandInt:
    """Whole number in [low, high)."""

    low: int
    high: int

    def draw(self, u: Column) -> Column:
        return (F.lit(self.low) + F.floor(u * (self.high - self.low))).cast("int")


# The search space of the downstream classifier.
SEARCH_SPACE: Mapping[str, Choice | LogUniform | RandInt] = {
    "REDUX": Choice((None, 128, 256, 512)),
    "H_DIM": Choice((8, 16, 32, 64, 128)),
    "LR": LogUniform(2e-5, 5e-3),
    "WEIGHT_DECAY": LogUniform(1e-5, 5e-1),
    "L1": LogUniform(1e-6, 5e-4),
    "DROP_RATE": Choice((0.2, 0.3, 0.4, 0.5)),
    "BATCH_SIZE": Choice((8, 16, 32, 64)),
    "PATIENCE": RandInt(2, 6),
}


def sample_space(
    trials: DataFrame,
    trial: str = "trial",
    space: Mapping[str, Choice | LogUniform | RandInt] = SEARCH_SPACE,
    seed: int = 42,
) -> DataFrame:
    """Adds one independent draw per parameter to a table of trial ids; reproducible
    from the seed, the parameter name and the id."""
    return trials.withColumns({
        name: dist.draw(hash_uniform(f"{seed}:{name}", trial)) for name, dist in space.items()
    })
