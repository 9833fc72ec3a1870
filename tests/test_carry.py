"""Step functions of deadlines against a row-by-row fold."""

import numpy as np
import pytest

from emberkey.operators.carry import composed, step_function, through


def fold(clocks, owns, ttl, deadline):
    for clock, own in zip(clocks, owns, strict=True):
        if clock >= deadline:
            deadline = own + ttl
    return deadline


@pytest.mark.parametrize("late", [0, 40])
@pytest.mark.parametrize("seed", range(40))
def test_functions_and_their_composition(seed, late):
    rng = np.random.default_rng(seed)
    ttl = int(rng.integers(1, 60))
    owns = np.cumsum(rng.integers(0, 9, 60)) + 1000 - rng.integers(0, late + 1, 60)
    owns = owns if late else np.sort(owns)
    clocks = np.maximum.accumulate(owns)
    cuts = [0, *np.sort(rng.integers(0, 61, 5)).tolist(), 60]
    whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = step_function(clocks[lo:hi], owns[lo:hi], ttl)
        if hi > lo:
            for d in range(int(clocks[lo]) - late - ttl, int(clocks[lo]) + ttl + 1):
                assert through(*part, np.array([d]))[0] == fold(clocks[lo:hi], owns[lo:hi], ttl, d)
        whole = composed(whole, part)
        for d in range(int(clocks[0]) - 5, int(clocks[0]) + ttl + 1):
            assert through(*whole, np.array([d]))[0] == fold(clocks[:hi], owns[:hi], ttl, d)
