"""Search over models' settings by the ratio of two densities, with early ends (Q5).

Trials so far are parted into good ones and the rest. Each setting gets a density of either part: one bump around every
value tried and a flat one. Candidates are drawn from the good density, and the one where it exceeds the other most is
tried next. A trial is scored fold by fold, and given up when its mean is worse than the median of earlier ones after as
many folds. Several trials run in the same passes over the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, u: float) -> float | int:
        """The setting at u, from 0 to 1."""
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = a + u * (b - a)
        x = math.exp(x) if self.log else x
        return round(min(max(x, self.low), self.high)) if self.whole else min(max(x, self.low), self.high)


@dataclass
class Trial:
    number: int
    at: dict[str, float]  # places from 0 to 1
    settings: dict[str, float | int]
    scores: list[float] = field(default_factory=list)
    given_up: bool = False

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores)


def _density(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of bumps that are cut off at 0 and 1, and a flat one."""
    if not len(centres):
        return np.ones(len(x))
    width = max(0.05, 1 / (1 + len(centres)))
    cdf = lambda t: 0.5 * (1 + np.vectorize(math.erf)((t - centres) / (width * math.sqrt(2))))
    bumps = np.exp(-0.5 * ((x[:, None] - centres) / width) ** 2) / (width * math.sqrt(2 * math.pi)) / (cdf(1.0) - cdf(0.0))
    return (bumps.sum(axis=1) + 1) / (len(centres) + 1)


def _draw(centres: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    width = max(0.05, 1 / (1 + len(centres)))
    pick = rng.integers(0, len(centres) + 1, n)  # the last is the flat one
    x = np.where(pick == len(centres), rng.random(n), rng.normal(np.append(centres, 0.5)[pick], width))
    return np.where((x < 0) | (x > 1), rng.random(n), x)


def propose(space: dict[str, Range], tried: Sequence[Trial], rng: np.random.Generator, startup: int = 5, good: float = 0.25, candidates: int = 24) -> dict[str, float]:
    """Places of the next trial: random ones at first."""
    known = sorted((t for t in tried if t.scores), key=lambda t: (t.given_up, t.mean))
    if len(known) < startup:
        return {k: float(rng.random()) for k in space}
    cut = max(1, math.ceil(good * len(known)))
    out = {}
    for k in space:
        a, b = (np.array([t.at[k] for t in part]) for part in (known[:cut], known[cut:]))
        x = _draw(a, candidates, rng)
        out[k] = float(x[np.argmax(np.log(_density(a, x)) - np.log(_density(b, x)))])
    return out


def search(score: Callable[[list[dict], int], list[float]], space: dict[str, Range], trials: int, folds: int, seed: int = 42, together: int = 4, least: int = 4) -> tuple[dict, list[Trial]]:
    """The best settings, and all trials in order. score(settings, fold) gives each one's error on the fold, from 1; fewer
    errors than settings aren't allowed. A trial is given up only once `least` others have as many folds."""
    rng, tried = np.random.default_rng(seed), []
    while len(tried) < trials:
        batch = []
        for _ in range(min(together, trials - len(tried))):
            at = propose(space, tried, rng)
            batch.append(Trial(len(tried) + len(batch), at, {k: r.value(at[k]) for k, r in space.items()}))
        for fold in range(1, folds + 1):
            going = [t for t in batch if not t.given_up]
            if not going:
                break
            for t, s in zip(going, score([t.settings for t in going], fold), strict=True):
                t.scores.append(float(s))
            reached = [sum(t.scores[:fold]) / fold for t in (*tried, *batch) if len(t.scores) >= fold]
            if fold < folds and len(reached) > least:
                middle = float(np.median(reached))
                for t in going:
                    t.given_up = t.mean > middle
        tried += batch
    best = min((t for t in tried if not t.given_up), key=lambda t: t.mean, default=min(tried, key=lambda t: t.mean))
    return best.settings, tried
