"""A search over typed parameters: density ratios propose them, successive halving spends fits on the better ones.

Trials seen so far are split at their best quarter. For each parameter the values of both parts get a density (numbers: a
mixture of normal curves around them, in the logarithm if so asked; choices: counts), candidates are drawn from that of the
better part, and the one with the greatest ratio of the densities is tried next. A round of trials starts with small
budgets; the better 1 / eta of it goes on with eta times the budget, up to the largest.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Whole:
    low: int
    high: int


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = dict[str, Whole | Real | Choice]


@dataclass
class Trial:
    params: dict[str, Any]
    budget: int
    value: float


def _unit(kind: Whole | Real, x: float) -> float:
    """A number's place in 0..1."""
    a, b = (math.log(kind.low), math.log(kind.high)) if isinstance(kind, Real) and kind.log else (kind.low, kind.high)
    x = math.log(x) if isinstance(kind, Real) and kind.log else x
    return (x - a) / (b - a) if b > a else 0.5


def _value(kind: Whole | Real, u: float) -> float | int:
    if isinstance(kind, Whole):
        return min(kind.high, max(kind.low, round(kind.low + u * (kind.high - kind.low))))
    if kind.log:
        return min(kind.high, max(kind.low, math.exp(math.log(kind.low) + u * (math.log(kind.high) - math.log(kind.low)))))
    return kind.low + u * (kind.high - kind.low)


def _random(space: Space, rng: random.Random) -> dict[str, Any]:
    return {n: rng.choice(k.values) if isinstance(k, Choice) else _value(k, rng.random()) for n, k in space.items()}


class _Density:
    """Of one parameter, by the values of some trials; the whole range counts as one more, wide value."""

    def __init__(self, kind, values: list):
        self.kind = kind
        if isinstance(kind, Choice):
            self.weights = [1 + values.count(v) for v in kind.values]
        else:
            self.centres = [_unit(kind, v) for v in values]
            self.width = max(0.05, 1 / (1 + len(values)))

    def draw(self, rng: random.Random):
        if isinstance(self.kind, Choice):
            return rng.choices(self.kind.values, self.weights)[0]
        at = rng.randrange(len(self.centres) + 1)
        u = rng.random() if at == len(self.centres) else rng.gauss(self.centres[at], self.width)
        return _value(self.kind, min(1.0, max(0.0, u)))

    def log(self, value) -> float:
        if isinstance(self.kind, Choice):
            return math.log(self.weights[self.kind.values.index(value)] / sum(self.weights))
        u = _unit(self.kind, value)
        curves = sum(math.exp(-0.5 * ((u - c) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi)) for c in self.centres)
        return math.log((1 + curves) / (1 + len(self.centres)))


def propose(space: Space, seen: list[Trial], rng: random.Random, sign: float, first: int, candidates: int) -> dict[str, Any]:
    """The next parameters; the `first` ones are random."""
    if len(seen) < first:
        return _random(space, rng)
    ranked = sorted(seen, key=lambda t: -sign * t.value)
    cut = max(1, math.ceil(len(ranked) / 4))
    good = {n: _Density(k, [t.params[n] for t in ranked[:cut]]) for n, k in space.items()}
    rest = {n: _Density(k, [t.params[n] for t in ranked[cut:]]) for n, k in space.items()}
    drawn = [{n: d.draw(rng) for n, d in good.items()} for _ in range(candidates)]
    return max(drawn, key=lambda p: sum(good[n].log(v) - rest[n].log(v) for n, v in p.items()))


def search(space: Space, evaluate: Callable[[dict[str, Any], int], float], direction: str = "maximize", rounds: int = 5, width: int = 4, budgets: tuple[int, int] = (1, 4), eta: int = 2, seed: int = 42, first: int = 6, candidates: int = 24, parallelism: int = 2) -> tuple[Trial, list[Trial]]:
    """The best trial of the largest budget, and every trial at the largest budget that it got, in order of proposal.

    evaluate(params, budget) gives the metric; rungs of a round run `parallelism` at a time. The same seed gives the same trials.
    """
    if direction not in ("maximize", "minimize"):
        raise ValueError("direction is maximize or minimize")
    if not space or rounds < 1 or width < 1 or not 1 <= budgets[0] <= budgets[1] or eta < 2:
        raise ValueError("a search needs parameters, rounds of at least one trial, rising budgets and eta of at least 2")
    sign, rng, trials = (1.0 if direction == "maximize" else -1.0), random.Random(seed), []
    with ThreadPoolExecutor(parallelism) as pool:
        for _ in range(rounds):
            of_round = []
            for _ in range(width):
                of_round.append(propose(space, trials, rng, sign, first, candidates))
            live, budget = [Trial(p, 0, math.nan) for p in of_round], budgets[0]
            trials += live
            while True:
                for t, value in zip(live, pool.map(lambda t, b=budget: evaluate(t.params, b), live), strict=True):
                    t.budget, t.value = budget, value if value == value else -sign * math.inf
                if budget >= budgets[1]:
                    break
                live = sorted(live, key=lambda t: -sign * t.value)[: max(1, math.ceil(len(live) / eta))]
                budget = min(budgets[1], budget * eta)
    return max((t for t in trials if t.budget == budgets[1]), key=lambda t: sign * t.value), trials
