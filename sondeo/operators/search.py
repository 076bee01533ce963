"""Model-based search over declared ranges: tree-structured Parzen densities of past trials.

Trials are split into the better and the other ones. For each parameter both sides give a density: a mixture of bells
around the values that were tried, within the range. Values are drawn from the density of the better side, and of these
draws the one is tried whose density is highest relative to that of the other side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

Range = tuple[float, float, str]

RANDOM_TRIALS = 10
DRAWS = 24
BETTER_SHARE = 0.1
MOST_BETTER = 25


def _to_line(value: float, kind: str) -> float:
    return math.log(value) if kind == "log" else float(value)


def _bounds(spec: Range) -> tuple[float, float]:
    low, high, kind = spec
    # A whole number stands for the interval that rounds to it.
    return (low - 0.5, high + 0.5) if kind == "int" else (_to_line(low, kind), _to_line(high, kind))


def _from_line(x: float, spec: Range) -> float:
    low, high, kind = spec
    if kind == "int":
        return min(max(round(x), low), high)
    return min(max(math.exp(x), low), high) if kind == "log" else min(max(x, low), high)


def _normal_below(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class Parzen:
    """A mixture of truncated bells around known points and one over the whole range."""

    def __init__(self, points: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        width = high - low
        ordered = sorted(points)
        around = [low, *ordered, high]
        narrowest = width / min(100, 1 + len(ordered))
        # A bell is as wide as the gap to its farther neighbour: narrow where trials are dense.
        self.bells = [
            (x, min(max(x - before, after - x, narrowest), width)) for before, x, after in zip(around, ordered, around[2:])
        ]
        self.bells.append(((low + high) / 2, width))

    def draw(self, rng: random.Random) -> float:
        centre, spread = self.bells[rng.randrange(len(self.bells))]
        while True:  # at least a fifth of a bell lies in the range
            x = rng.gauss(centre, spread)
            if self.low <= x <= self.high:
                return x

    def log_density(self, x: float) -> float:
        total = 0.0
        for centre, spread in self.bells:
            z = (x - centre) / spread
            inside = _normal_below((self.high - centre) / spread) - _normal_below((self.low - centre) / spread)
            total += math.exp(-z * z / 2) / (spread * math.sqrt(2 * math.pi) * inside)
        return math.log(max(total / len(self.bells), 1e-300))


def random_point(ranges: dict[str, Range], rng: random.Random) -> dict[str, float]:
    return {p: _from_line(rng.uniform(*_bounds(spec)), spec) for p, spec in ranges.items()}


def suggest(ranges: dict[str, Range], trials: Sequence[tuple[dict, float | None]], rng: random.Random) -> dict[str, float]:
    """The next point to try, given (point, score) of trials; a trial without a score counts as one of the worst."""
    known = sorted((t for t in trials if t[1] is not None), key=lambda t: -t[1])
    if len(known) < 2:
        return random_point(ranges, rng)
    n = min(MOST_BETTER, math.ceil(BETTER_SHARE * len(known)))
    better, others = known[:n], [*known[n:], *(t for t in trials if t[1] is None)]
    point = {}
    for p, spec in ranges.items():
        low, high = _bounds(spec)
        good, bad = (Parzen([_to_line(t[0][p], spec[2]) for t in side], low, high) for side in (better, others))
        draws = [good.draw(rng) for _ in range(DRAWS)]
        point[p] = _from_line(max(draws, key=lambda x: good.log_density(x) - bad.log_density(x)), spec)
    return point


def maximise(
    score: Callable[[dict], float | None], ranges: dict[str, Range], trials: int, seed: int = 42, in_flight: int = 2
) -> list[tuple[dict, float | None]]:
    """All (point, score) in the order they were tried; ``in_flight`` trials run at a time.

    Points of one round know each other as trials without a score, so that they keep apart. The result depends on the
    seed and on ``in_flight``, not on which trial ends first.
    """
    rng = random.Random(seed)
    done: list[tuple[dict, float | None]] = []
    with ThreadPool(in_flight) as pool:
        while len(done) < trials:
            waiting: list[tuple[dict, None]] = []
            for _ in range(min(in_flight, trials - len(done))):
                known = len(done) >= min(RANDOM_TRIALS, trials)
                point = suggest(ranges, [*done, *waiting], rng) if known else random_point(ranges, rng)
                waiting.append((point, None))
            scores = pool.map(score, [p for p, _ in waiting], chunksize=1)
            done += [(p, s) for (p, _), s in zip(waiting, scores)]
    return done
