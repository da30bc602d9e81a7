import random

import numpy as np
import pytest

from strandloom.operators.graph import _shares


def brute(x, y, window, allowed):
    """Every window of x that starts before its length less the window's, on every place of y."""
    return any(sum(a != b for a, b in zip(x[i : i + window], y[j : j + window])) <= allowed for i in range(len(x) - window) for j in range(len(y) - window + 1))


@pytest.mark.parametrize("seed", range(40))
def test_shared_windows_equal_brute_force(seed):
    rng = random.Random(seed)
    x, y = ("".join(rng.choices("acgt" if seed % 4 else "aac", k=rng.randrange(0, 60))) for _ in range(2))
    part = list(x[5:30])
    for _ in range(rng.randrange(5)):
        if part:
            part[rng.randrange(len(part))] = rng.choice("acgtn")
    y = y[:20] + "".join(part) + y[20:]
    raw = lambda s: np.frombuffer(s.encode(), np.uint8)
    for window, allowed in ((20, 2), (12, 1), (24, 3), (9, 0)):
        assert _shares(raw(x), raw(y), window, allowed) == brute(x, y, window, allowed)
