"""Draws from a hyper-parameter space that follow the trials seen so far.

Per parameter the better and the worse trials each give a density: a uniform share for the
space itself and one kernel per trial. New values are drawn from the density of the better
ones, and of several draws the one with the greatest ratio of both densities is taken. All
of it is column expressions over the two lists of observed values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.binding import let
from textlab.functions.keys import hash_uniform
from textlab.operators.sampling import SEARCH_SPACE, Choice, LogUniform, RandInt

GAMMA, CANDIDATES = 0.25, 24
MAX_TRIALS = 1000
# Kernels are no narrower than this part of the parameter's range.
NARROWEST = 0.02


def split_trials(
    trials: DataFrame, score: str = "f1", trial: str = "trial", gamma: float = GAMMA
) -> DataFrame:
    """Trials with a score, and ``better``: the best ``gamma`` of them (rounded up), ties by
    trial. Of a longer table the best trials and the last others by id are used, so that
    both lists stay small: ``MAX_TRIALS`` in all."""
    known = trials.where(F.col(score).isNotNull() & ~F.isnan(score))
    n = known.count()
    best = known.orderBy(F.desc(score), trial).limit(min(math.ceil(gamma * n), MAX_TRIALS // 4))
    rest = known.join(best.select(trial), trial, "left_anti").orderBy(F.desc(trial)).limit(MAX_TRIALS * 3 // 4)
    return best.withColumn("better", F.lit(True)).unionByName(rest.withColumn("better", F.lit(False)))


def _logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


class _Range:
    """A parameter on a line: logistic kernels, cut off at the ends of the range."""

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def width(self, seen: Column) -> Column:
        """Kernel width: falls with the number of trials, from a quarter of the range."""
        n = F.greatest(F.size(seen), F.lit(1)).cast("double")
        span = self.high - self.low
        return F.greatest(F.lit(span / 4.0) / F.sqrt(n), F.lit(span * NARROWEST))

    def draw(self, seen: Column, pick: Column, u: Column) -> Column:
        """One draw: ``pick`` chooses the uniform share or a kernel, ``u`` the place in it."""
        at = F.floor(pick * (F.size(seen) + 1)).cast("int")
        centre, width = F.get(seen, at), self.width(seen)
        a, b = _logistic((self.low - centre) / width), _logistic((self.high - centre) / width)
        share = a + u * (b - a)
        inside = centre + width * F.log(share / (1.0 - share))
        uniform = F.lit(self.low) + u * (self.high - self.low)
        return F.when(at < F.size(seen), F.greatest(F.lit(self.low), F.least(F.lit(self.high), inside))).otherwise(
            uniform)

    def density(self, seen: Column, x: Column) -> Column:
        width = self.width(seen)

        def kernel(c: Column) -> Column:
            s = _logistic((x - c) / width)
            mass = _logistic((self.high - c) / width) - _logistic((self.low - c) / width)
            return s * (1.0 - s) / width / mass

        total = F.aggregate(seen, F.lit(1.0 / (self.high - self.low)), lambda acc, c: acc + kernel(c))
        return total / (F.size(seen) + 1)


class _Options:
    """A parameter with listed values, given as their places: counts over a uniform share."""

    def __init__(self, n: int):
        self.n = n

    def draw(self, seen: Column, pick: Column, u: Column) -> Column:
        at = F.floor(pick * (F.size(seen) + 1)).cast("int")
        return F.when(at < F.size(seen), F.get(seen, at)).otherwise(F.floor(u * self.n).cast("double"))

    def density(self, seen: Column, x: Column) -> Column:
        hits = F.aggregate(seen, F.lit(1.0 / self.n), lambda acc, c: acc + F.when(c == x, 1.0).otherwise(0.0))
        return hits / (F.size(seen) + 1)


def _kernels(dist: Choice | LogUniform | RandInt) -> _Range | _Options:
    if isinstance(dist, LogUniform):
        return _Range(math.log(dist.low), math.log(dist.high))
    return _Options(len(dist.options) if isinstance(dist, Choice) else dist.high - dist.low)


def _place(dist: Choice | LogUniform | RandInt, value: Column) -> Column:
    """An observed value as a number: logarithm, or place among the options."""
    if isinstance(dist, LogUniform):
        return F.log(value.cast("double"))
    if isinstance(dist, RandInt):
        return (value - dist.low).cast("double")
    place = F.lit(None).cast("double")
    for i, option in enumerate(dist.options):
        same = value.isNull() if option is None else value == F.lit(option)
        place = F.when(same, float(i)).otherwise(place)
    return place


def _value(dist: Choice | LogUniform | RandInt, place: Column) -> Column:
    if isinstance(dist, LogUniform):
        return F.exp(place)
    if isinstance(dist, RandInt):
        return (place + dist.low).cast("int")
    return dist.draw((place + 0.5) / len(dist.options))


def propose(
    ids: DataFrame,
    trials: DataFrame,
    trial: str = "trial",
    score: str = "f1",
    space: Mapping[str, Choice | LogUniform | RandInt] = SEARCH_SPACE,
    seed: int = 42,
    gamma: float = GAMMA,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Adds one draw per parameter to a table of trial ids, guided by ``trials``: former
    ids with their score and a column per parameter.

    Reproducible from the seed, the parameter's name, the id and the trials. Without a
    trial, or with one, draws are uniform over the space. A parameter value outside of the
    space (or null where it is no option) is not learned from.
    """
    marked = split_trials(trials, score, trial, gamma)
    places = {name: _place(dist, F.col(f"`{name}`")) for name, dist in space.items()}
    rows = marked.select("better", trial, *[p.alias(f"p{i}") for i, p in enumerate(places.values())]).orderBy(
        trial).collect()
    out = ids
    for i, (name, dist) in enumerate(space.items()):
        better, worse = ([float(r[f"p{i}"]) for r in rows if r["better"] is side and r[f"p{i}"] is not None]
                         for side in (True, False))
        out = out.withColumn(name, _guided(dist, f"{seed}:{name}", trial, better, worse, candidates))
    return out.select(*ids.columns, *space)


def _guided(
    dist: Choice | LogUniform | RandInt, key: str, trial: str, better: list[float], worse: list[float],
    candidates: int,
) -> Column:
    """The draw from the better ones with the greatest ratio of densities, the first on ties."""
    kernels = _kernels(dist)
    good, bad = (F.array(*[F.lit(x) for x in seen]).cast("array<double>") for seen in (better, worse))

    def weighed(c: Column) -> Column:
        pick, u = hash_uniform(f"{key}:pick", F.col(trial), c), hash_uniform(f"{key}:value", F.col(trial), c)
        return let(kernels.draw(good, pick, u), lambda x: F.struct(
            F.round(F.log(kernels.density(good, x)) - F.log(kernels.density(bad, x)), 9).alias("ratio"),
            (-c).alias("order"), x.alias("x")))

    drawn = F.transform(F.sequence(F.lit(0), F.lit(candidates - 1)), weighed)
    return let(F.array_max(drawn), lambda best: _value(dist, best["x"]))
