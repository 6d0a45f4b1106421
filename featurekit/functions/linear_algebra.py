"""Small dense algebra on k x k summaries that Spark has already aggregated."""

from __future__ import annotations

import math

import numpy as np

# Below this, an eigenvalue or an unexplained share counts as 0.
NOTHING = 1e-13


def inflation_factors(corr: np.ndarray) -> list[float]:
    """1/(1-R2) of each variable regressed on the others, from their correlation matrix: the
    diagonal of its inverse, by one decomposition. Exact collinearity gives infinity for
    the variables involved, which are those that a vector of the null space moves, and
    only for them."""
    if not len(corr):
        return []
    values, vectors = np.linalg.eigh(corr)
    zero = values <= NOTHING * len(corr)
    involved = (np.abs(vectors[:, zero]) > 1e-7).any(axis=1)
    factors = (vectors[:, ~zero] ** 2 / values[~zero]).sum(axis=1)
    return [
        math.inf if bad or factor >= 1 / NOTHING else float(factor)
        for bad, factor in zip(involved, factors)
    ]
