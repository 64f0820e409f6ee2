"""Counter-based resampling: every draw is a pure function of its position.

Only 64-bit integer arithmetic is used, so a recomputed partition draws the same
values and any SQL engine can reproduce them.
"""

from __future__ import annotations

import math

import numpy as np

# The modulus is the Mersenne prime 2^31 - 1; squares stay below 2^62.
MODULUS = 2_147_483_647
SHIFT = 12_345
SEED_STEP, GROUP_STEP, REPLICATE_STEP, DRAW_STEP = 1_000_003, 7_919, 104_729, 1_299_709
_MODULUS, _SHIFT, _BITS = np.uint64(MODULUS), np.uint64(SHIFT), np.uint64(31)
# Weights up to this count; larger ones have a probability below the numbers' resolution.
TERMS = 13
# Weights from this one on are so rare that they are looked up for their rows alone.
_RARE = 4


def _below(v: np.ndarray, spare: np.ndarray) -> None:
    """``v`` below twice the Mersenne prime modulo it, in place: a difference below zero wraps
    to a large number."""
    np.subtract(v, v.dtype.type(MODULUS), out=spare)
    np.minimum(v, spare, out=v)


def _squared(v: np.ndarray, spare: np.ndarray, *added: np.ndarray | np.uint64) -> None:
    """``v * v + added`` in place, congruent and below twice the prime, as ``v`` has to be.  What
    is added stays below 2^32, so that nothing passes 2^62."""
    _below(v, spare)
    np.multiply(v, v, out=v)
    for a in added:
        np.add(v, a, out=v)
    np.right_shift(v, _BITS, out=spare)
    np.bitwise_and(v, _MODULUS, out=v)
    np.add(v, spare, out=v)


class Draws:
    """Draws of a group, whose own parts of the numbers are computed once for all replicates."""

    def __init__(self, seed: int, group: int, draw: np.ndarray):
        draw = np.asarray(draw, np.uint64)
        low, high = draw % _MODULUS, draw // _MODULUS
        self.base = np.uint64((seed * SEED_STEP + group * GROUP_STEP) % MODULUS)
        self.steps = low * np.uint64(DRAW_STEP) % _MODULUS
        self.low = low + _SHIFT
        # Draws beyond the modulus differ in a part of their own.
        self.high = [high % _MODULUS] if high.any() else []

    def unreduced(self, replicate: np.ndarray) -> np.ndarray:
        """The numbers of ``replicate``, broadcast against the draws, below twice the modulus."""
        replicate = np.asarray(replicate, np.uint64) % _MODULUS
        start = (self.base + replicate * np.uint64(REPLICATE_STEP)) % _MODULUS
        y = np.asarray(start + self.steps)
        spare = np.empty_like(y)
        _squared(y, spare, self.low)
        _squared(y, spare, replicate + _SHIFT, *self.high)
        _squared(y, spare, _SHIFT)
        return y


def numbers(seed: int, group: int, replicate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Pseudo-random integers in [0, MODULUS) of the draws ``draw`` of the replicates, which
    are broadcast against each other."""
    y = Draws(seed, group, draw).unreduced(replicate)
    _below(y, np.empty_like(y))
    return y


def positions(seed: int, group: int, replicate: np.ndarray, draw: np.ndarray, n: int) -> np.ndarray:
    """Drawn positions in [0, n), from two numbers each."""
    first = numbers(seed + 1, group, replicate, draw)
    return (first * _MODULUS + numbers(seed + 2, group, replicate, draw)) % np.uint64(n)


def poisson_mean(n: int) -> float:
    """Mean weight of a row: so much below one that the weights of n rows sum to n at most."""
    return max(0.0, 1.0 - 8.0 / math.sqrt(n))


def poisson_thresholds(mean: float, terms: int = TERMS) -> list[int]:
    """Cumulative Poisson probabilities on the scale of MODULUS."""
    total, term, out = 0.0, math.exp(-mean), []
    for k in range(terms):
        total += term
        term = term * mean / (k + 1)
        out.append(math.floor(total * MODULUS))
    return out


def poisson_weights(numbers_drawn: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts of uniform numbers, which may be below twice the modulus."""
    narrow = numbers_drawn.astype(np.uint32)
    _below(narrow, np.empty_like(narrow))
    limits = np.array(poisson_thresholds(mean), np.uint32)
    out = np.zeros(narrow.shape, np.uint8)
    for limit in limits[:_RARE]:
        out += (narrow >= limit).view(np.uint8)
    rare = np.nonzero(narrow >= limits[_RARE])
    out[rare] = np.searchsorted(limits, narrow[rare], side="right")
    return out
