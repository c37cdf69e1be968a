"""Pseudo-random permutations of 0 .. n - 1 that are computed place by place: no sort, no state, any cluster layout.

A place is written as two digits and sent through rounds that each replace one digit by its sum with a hash of the other, so
every round can be undone; results beyond n - 1 go through again until they fall below n. Everything is integer
arithmetic under 2 ** 62, which SQL can repeat (``bijection_sql``)."""

from __future__ import annotations

from math import isqrt

import numpy as np

#: The prime 2 ** 31 - 1, and a multiplier for the key of each round (an even number of rounds).
PRIME = 2147483647
MULTIPLIERS = (48271, 69621, 1226874159, 950706376, 742938285, 1343714438, 62089911, 1583458089)


def absorb(state, value):
    """The next state (under PRIME) after a number, or an array of numbers, from 0."""
    for part in (value % PRIME, value // PRIME):
        mixed = (state + part + 1) % PRIME
        state = (mixed * mixed % PRIME * 48271 + 11) % PRIME
    return state


def key(seed: int, *values):
    """The key of a permutation: of a seed and further numbers or arrays."""
    state = absorb(0, seed % (1 << 62))
    for value in values:
        state = absorb(state, value)
    return state


def sides(n: int) -> tuple[int, int]:
    """Numbers of values of the two digits: their product is n or little more."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def passes(n: int) -> int:
    """Digits of few values need more rounds until all orders are equally likely."""
    return 1 if n >= 64 else 6


def _by_prime(t: np.ndarray) -> np.ndarray:
    """t % PRIME for t under 2 ** 62, by shifts."""
    for _ in range(2):
        t = (t & PRIME) + (t >> 31)
    return t - PRIME * (t >= PRIME)


def _by(t: np.ndarray, size: int) -> np.ndarray:
    return t - t // size * size  # dividing by a number is vectorised, a remainder is not


def _hash(digit: np.ndarray, keys: np.ndarray, multiplier: int) -> np.ndarray:
    t = _by_prime(digit + keys * multiplier)
    return _by_prime(t * t)


def _schedule(n: int) -> list[tuple[int, int]]:
    """Multiplier and size of the changed digit of every round."""
    a, b = sides(n)
    return [((m + 2 * turn) % PRIME, b if k % 2 else a) for turn in range(passes(n)) for k, m in enumerate(MULTIPLIERS)]


def _rounds(x: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    _, b = sides(n)
    high = x // b
    low = x - high * b
    for multiplier, size in _schedule(n):
        high, low = low, _by(high + _hash(low, keys, multiplier), size)
    return high * b + low


def _undone(x: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    _, b = sides(n)
    high = x // b
    low = x - high * b
    for multiplier, size in reversed(_schedule(n)):
        high, low = _by(low + size - _by(_hash(high, keys, multiplier), size), size), high
    return high * b + low


def _walk(step, x, keys, n: int) -> np.ndarray:
    x, keys = np.asarray(x, np.int64), np.asarray(keys, np.int64)
    out = step(x, keys, n)
    if (far := out >= n).any():
        keys = np.broadcast_to(keys, out.shape)
        while far.any():
            out[far] = step(out[far], keys[far], n)
            far = out >= n
    return out


def bijection(x, keys, n: int) -> np.ndarray:
    """Where the permutations of ``keys`` send the places ``x``, elementwise; the arrays are broadcast together."""
    return _walk(_rounds, x, keys, n)


def inverse(x, keys, n: int) -> np.ndarray:
    """What the permutations of ``keys`` send to the places ``x``."""
    return _walk(_undone, x, keys, n)


def key_sql(*values: int | str) -> str:
    """``key`` as an SQL expression over numbers or columns, each under PRIME."""
    state = "0::BIGINT"
    for value in values:
        for part in (value, "0"):
            state = f"[{state} + {part} + 1]"
            state = f"list_transform({state}, lambda t: ((t % {PRIME}) * (t % {PRIME}) % {PRIME} * 48271 + 11) % {PRIME})[1]"
    return state


def bijection_sql(name: str, source: str, columns: list[str], n: str) -> str:
    """Common table expressions (of a recursive WITH) that end in ``name``: ``columns`` of ``source`` and ``y``, where the permutation of its
    ``key`` sends its ``x``. For n of 64 and more."""
    kept = ", ".join([*columns, "key", "step", "na", "nb", "nn"])
    layer = f"(SELECT {kept}, y // nb AS hi, y % nb AS lo FROM {name}_w WHERE step = 0 OR y >= nn)"
    for k, multiplier in enumerate(MULTIPLIERS):
        t = f"((lo + key * {multiplier}) % {PRIME})"
        layer = f"(SELECT {kept}, lo AS hi, (hi + {t} * {t} % {PRIME}) % {'nb' if k % 2 else 'na'} AS lo FROM {layer})"
    size = f"(SELECT n, ceil(sqrt(n))::BIGINT AS a FROM (SELECT {n}::BIGINT AS n))"
    start = f"SELECT {', '.join(columns)}, key, x AS y, 0 AS step, a AS na, (n + a - 1) // a AS nb, n AS nn FROM {source} CROSS JOIN {size}"
    go_on = f"SELECT {', '.join(columns)}, key, hi * nb + lo AS y, step + 1 AS step, na, nb, nn FROM {layer}"
    return f"{name}_w AS ({start} UNION ALL {go_on}), {name} AS (SELECT {', '.join(columns)}, y FROM {name}_w WHERE step > 0 AND y < nn)"
