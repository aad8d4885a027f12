"""Search of parameters: a tree-structured Parzen estimator proposes trials, which climb rungs of growing effort side by side and are pruned below the median.

The proposals are arithmetic over the trials so far, a few dozen; the fits behind a score are Spark's work.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame

from tidemark.operators import learning


@dataclass
class Span:
    """A parameter between two bounds: real, on a logarithmic scale, or whole."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def place(self, value: float) -> float:
        """The value on a line from 0 to 1."""
        a, b, x = (math.log(v) if self.log else v for v in (self.low, self.high, value))
        return (x - a) / (b - a)

    def value(self, place: float) -> float:
        a, b = (math.log(v) if self.log else v for v in (self.low, self.high))
        x = a + min(max(place, 0.0), 1.0) * (b - a)
        x = math.exp(x) if self.log else x
        return min(max(round(x), int(self.low)), int(self.high)) if self.whole else x


@dataclass
class Trial:
    """Settings, their scores by rung, and whether they were given up before the last one."""

    settings: dict
    scores: list[float] = field(default_factory=list)
    pruned: bool = False


def _log_density(place: float, centres: list[float], width: float) -> float:
    """A mixture of normal densities around the centres, cut at 0 and 1, and one uniform density."""
    cut = lambda c: 0.5 * (math.erf((1 - c) / width / math.sqrt(2)) - math.erf(-c / width / math.sqrt(2)))
    bells = sum(math.exp(-0.5 * ((place - c) / width) ** 2) / (width * math.sqrt(2 * math.pi) * cut(c)) for c in centres)
    return math.log((bells + 1.0) / (len(centres) + 1))


def proposed(space: dict[str, Span], tried: Sequence[Trial], draw: random.Random, start: int = 10, candidates: int = 24, share: float = 0.25) -> dict:
    """Settings for the next trial: at random for the first ``start``; then, parameter by parameter, of ``candidates`` draws around the best ``share`` of the trials the one
    where the density of these is greatest against that of the rest. Trials that climbed further come before others, then the better score."""
    known = [t for t in tried if t.scores]
    if len(known) < start:
        return {name: span.value(draw.random()) for name, span in space.items()}
    ranked = sorted(known, key=lambda t: (len(t.scores), t.scores[-1]), reverse=True)
    cut = max(1, math.ceil(share * len(ranked)))
    out = {}
    for name, span in space.items():
        good, rest = ([span.place(t.settings[name]) for t in part] for part in (ranked[:cut], ranked[cut:]))
        near, wide = (max(0.05, 1.0 / (1 + len(part))) for part in (good, rest))
        drawn = [min(max(draw.gauss(draw.choice(good), near), 0.0), 1.0) if draw.random() < len(good) / (len(good) + 1) else draw.random() for _ in range(candidates)]
        out[name] = span.value(max(drawn, key=lambda p: _log_density(p, good, near) - _log_density(p, rest, wide)))
    return out


def searched(space: dict[str, Span], score: Callable[[dict, int], float], rungs: Sequence[int], trials: int = 30, seed: int = 42, seconds: float = math.inf, width: int = 1, least: int = 5) -> list[Trial]:
    """All trials in the order they were proposed. score(settings, effort) is asked at each effort of ``rungs`` in turn; a trial below the median of the scores at its rung,
    once ``least`` earlier trials have been there, is pruned. ``width`` trials are proposed at a time and scored side by side: the same settings for the same seed,
    however fast each is. None begins after ``seconds``."""
    draw, began, done = random.Random(seed), time.monotonic(), []

    def climb(trial: Trial, bars: list[float]) -> Trial:
        for effort, bar in zip(rungs, bars, strict=True):
            trial.scores.append(score(trial.settings, effort))
            if trial.scores[-1] < bar:
                trial.pruned = len(trial.scores) < len(rungs)
                break
        return trial

    with ThreadPoolExecutor(width) as pool:
        while len(done) < trials and (not done or time.monotonic() - began <= seconds):
            there = [[t.scores[k] for t in done if len(t.scores) > k] for k in range(len(rungs))]
            bars = [median(s) if len(s) >= least else -math.inf for s in there]
            batch = [Trial(proposed(space, done, draw)) for _ in range(min(width, trials - len(done)))]
            done += pool.map(lambda t: climb(t, bars), batch)
    return done


#: The parameters of boosted trees and their bounds.
TREES = {"depth": Span(3, 8, whole=True), "rate": Span(0.01, 0.2, log=True), "rows": Span(0.5, 1.0), "least": Span(5, 50, log=True, whole=True)}


def boosted_trees(train: DataFrame, valid: DataFrame, features: list[str], trials: int = 30, seed: int = 42, seconds: float = 1200.0, rounds: Sequence[int] = (20, 50, 100), width: int = 2, space: dict[str, Span] | None = None) -> tuple[dict, list[Trial]]:
    """The best settings of boosted trees by ``learning.objective`` on ``valid``, with their rounds, and all trials. A trial is fitted with more rounds at every rung."""

    def score(settings: dict, n: int) -> float:
        return learning.objective(learning.scored(learning.boosted_trees(train, features, rounds=n, **settings), valid))

    found = searched(space or TREES, score, rounds, trials, seed, seconds, width)
    best = max((t for t in found if not t.pruned), key=lambda t: t.scores[-1])
    return {**best.settings, "rounds": rounds[len(best.scores) - 1]}, found
