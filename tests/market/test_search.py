import math
import random

import pytest

from tidemark.operators import search

SPACE = {"x": search.Span(-5, 5), "rate": search.Span(1e-4, 1, log=True), "n": search.Span(1, 40, whole=True)}


def hill(settings, effort=1):
    return -((settings["x"] - 2) ** 2) - math.log10(settings["rate"] / 0.01) ** 2 - ((settings["n"] - 30) / 10) ** 2


def test_proposals_beat_uniform_draws():
    better = 0
    for seed in range(10):
        draw = random.Random(seed)
        uniform = max(hill({k: s.value(draw.random()) for k, s in SPACE.items()}) for _ in range(60))
        better += max(t.scores[-1] for t in search.searched(SPACE, hill, [1], 60, seed)) > uniform
    assert better >= 8


def test_values_stay_within_their_bounds():
    for t in search.searched(SPACE, hill, [1], 40, 3):
        assert -5 <= t.settings["x"] <= 5 and 1e-4 <= t.settings["rate"] <= 1 + 1e-9
        assert t.settings["n"] in range(1, 41)


@pytest.mark.parametrize("width", [1, 3])
def test_pruned_trials_are_listed_and_seeds_repeat(width):
    asked = []

    def score(settings, effort):
        asked.append(effort)
        return hill(settings) - 1 / effort

    first = search.searched(SPACE, score, [1, 5, 25], 30, 7, width=width)
    assert len(first) == 30 and any(t.pruned for t in first) and not all(t.pruned for t in first)
    assert all(len(t.scores) < 3 for t in first if t.pruned) and all(len(t.scores) == 3 for t in first if not t.pruned)
    assert asked.count(25) < asked.count(1) == 30
    # what was pruned lay below the median of the earlier batches' scores at its rung
    again = search.searched(SPACE, score, [1, 5, 25], 30, 7, width=width)
    assert [t.settings for t in again] == [t.settings for t in first]


def test_time_ends_the_search():
    assert len(search.searched(SPACE, hill, [1], 30, seconds=-1.0)) == 1


def test_boosted_trees(spark):
    rows = [(float(k % 10), float(k % 7), int(k % 10 > 4), 0.01 if k % 10 > 4 else -0.01) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, label int, return_pct double")
    best, trials = search.boosted_trees(df, df, ["a", "b"], trials=2, rounds=(2, 3), space={"depth": search.Span(2, 3, whole=True)})
    assert best["rounds"] == 3 and best["depth"] in (2, 3) and len(trials) == 2 and trials[0].scores[-1] > 0.4
