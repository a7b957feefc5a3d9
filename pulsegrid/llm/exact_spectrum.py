"""Eigenvalues and eigenvectors of an integer scatter matrix by its exact characteristic polynomial.

The polynomial is computed modulo many primes at once (reduction to Hessenberg form, then
its recurrence) and put together by Chinese remaindering.  Its coefficients are bounded by
those of equal eigenvalues, so the number of primes is known before.  As the matrix is
symmetric all roots are real: the number of roots above a point is the number of sign
changes of the polynomial shifted there, exactly, so bisection isolates the largest roots,
and the sign of the polynomial refines them.  Each component is then an approximate null
vector of the matrix less its root, found by inverse iteration in fixed-point integers.

Everything here works on one ``d x d`` matrix of Python integers; its cost depends on the
dimension and the size of the entries, not on the number of rows behind it.
"""

from __future__ import annotations

import math

import numpy as np

# Bits after the point: of the isolated roots (relative to the trace) and of the inverse iteration.
ROOT_BITS, SOLVE_BITS = 200, 448
# Roots closer than this many bits (relative to the trace) count as one of higher multiplicity.
SAME_BITS = 160


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest odd primes below ``limit``."""
    sieve = np.ones(math.isqrt(limit) + 1, bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(len(sieve)) + 1):
        sieve[i * i :: i] = False if sieve[i] else sieve[i * i :: i]
    small, found, top = np.flatnonzero(sieve), [], limit
    while len(found) < count:
        low = top - 200_000
        part = np.ones(top - low, bool)
        for p in small.tolist():
            part[-low % p :: p] = False
        found += (low + np.flatnonzero(part))[::-1].tolist()
        top = low
    return found[:count]


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``a ** (p - 2)`` modulo the primes ``p`` (0 for 0)."""
    out, base, power = np.ones_like(a), a % p, p - 2
    while power.any():
        out = np.where(power & 1, out * base % p, out)
        base, power = base * base % p, power >> 1
    return out


def hessenberg_polynomials(residues: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Characteristic polynomials modulo ``p`` of the matrices ``residues[i]``; coefficients from the constant one upwards."""
    h, d, each = residues.copy(), residues.shape[1], np.arange(len(p))
    p1, p2 = p[:, None], p[:, None, None]
    for k in range(1, d - 1):
        # a row with a nonzero entry in column k - 1 goes to place k, its column alike
        pivot = k + np.argmax(h[:, k:, k - 1] != 0, axis=1)
        swap = h[each, pivot].copy()
        h[each, pivot], h[:, k] = h[:, k].copy(), swap
        swap = h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, k] = h[:, :, k].copy(), swap
        factor = h[:, k + 1 :, k - 1] * _inverse(h[:, k, k - 1], p)[:, None] % p1
        h[:, k + 1 :, :] = (h[:, k + 1 :, :] - factor[:, :, None] * h[:, None, k, :] % p2) % p2
        # the same change of basis on the columns; products are below 2**62, so each is reduced before the sum
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * factor[:, None, :] % p2).sum(axis=2)) % p1
    polynomials = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)
    polynomials[0, :, 0] = 1
    for k in range(1, d + 1):
        new = polynomials[k]
        new[:, 1:] = polynomials[k - 1, :, :-1]
        new -= h[:, k - 1, k - 1, None] * polynomials[k - 1] % p1
        below = np.ones(len(p), dtype=np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            new -= (below * h[:, k - i - 1, k - 1] % p)[:, None] * polynomials[k - i - 1] % p1
        new %= p1
    return polynomials[d]


def characteristic_polynomial(matrix: list[list[int]]) -> list[int]:
    """Coefficients, from the constant one upwards, of ``det(x I - matrix)`` of a positive semidefinite integer matrix."""
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    # symmetric functions of the eigenvalues are largest where all are equal
    mean = trace // d + 1
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 1)
    wide = np.array(matrix, dtype=object)
    p = np.array(primes, dtype=np.int64)
    residues = np.array([(wide % q).astype(np.int64) for q in primes])
    found = hessenberg_polynomials(residues, p)
    product, values = 1, [0] * (d + 1)
    for row, q in zip(found.tolist(), primes):
        lift = pow(product, -1, q)
        values = [v + product * ((r - v) * lift % q) for v, r in zip(values, row)]
        product *= q
    return [v - product if 2 * v > product else v for v in values]


def roots_above(polynomial: list[int], numerator: int, bits: int) -> int:
    """The number of roots above ``numerator / 2**bits``, for a polynomial with real roots only."""
    d = len(polynomial) - 1
    shifted = [c << bits * (d - i) for i, c in enumerate(polynomial)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            shifted[j] += numerator * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign_at(polynomial: list[int], numerator: int, bits: int) -> int:
    value, d = 0, len(polynomial) - 1
    for i in range(d, -1, -1):
        value = value * numerator + (polynomial[i] << bits * (d - i))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int, trace: int) -> list[tuple[int, int, int]]:
    """(numerator, bits, multiplicity) of the largest roots, falling, until ``count`` are covered; ``trace`` bounds them all.

    Numerators are scaled so that a unit is below ``trace / 2**ROOT_BITS``.
    """
    scale = max(0, ROOT_BITS - trace.bit_length())  # bits after the point
    same = max(0, scale + trace.bit_length() - SAME_BITS)
    found: list[tuple[int, int, int]] = []
    # intervals (low, high] in units of 2**-scale with the numbers of roots above their ends
    top = (trace + 1) << scale
    open_parts = [(-1 << scale, top, len(polynomial) - 1, 0)]
    covered = 0
    while open_parts and covered < count:
        low, high, above_low, above_high = open_parts.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1 and _sign_at(polynomial, high, scale):
            sign = _sign_at(polynomial, high, scale)
            while high - low > 1:
                middle = (low + high) // 2
                if _sign_at(polynomial, middle, scale) == sign:
                    high = middle
                else:
                    low = middle
        if high - low <= (1 if inside == 1 else 1 << same):
            found.append((high, scale, inside))
            covered += inside
            continue
        middle = (low + high) // 2
        above = _above(polynomial, middle, scale)
        open_parts += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def _above(polynomial: list[int], numerator: int, scale: int) -> int:
    """``roots_above``, of a point written with as few bits after the point as it needs."""
    spare = min(scale, (numerator & -numerator).bit_length() - 1) if numerator else scale
    return roots_above(polynomial, numerator >> spare, scale - spare)


def null_vectors(matrix: list[list[int]], root: int, bits: int, count: int, trace: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors that ``matrix - root / 2**bits`` maps to (nearly) zero, as doubles."""
    d, one = len(matrix), 1 << SOLVE_BITS
    a = np.array([[(x << SOLVE_BITS) // trace for x in row] for row in matrix], dtype=object)
    shift = (root << SOLVE_BITS) // (trace << bits)
    for i in range(d):
        a[i, i] -= shift
    # elimination with row exchanges; the exchanges and factors are applied to the right-hand sides
    steps = []
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, pivot]] = a[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1  # singular to the last bit
        factor = (a[k + 1 :, k] << SOLVE_BITS) // a[k, k] if k + 1 < d else a[k + 1 :, k]
        a[k + 1 :, k:] -= np.outer(factor, a[k, k:]) >> SOLVE_BITS
        steps.append((pivot, factor))

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k, (pivot, factor) in enumerate(steps):
            x[[k, pivot]] = x[[pivot, k]]
            x[k + 1 :] -= factor * x[k] >> SOLVE_BITS
        for k in range(d - 1, -1, -1):
            x[k] = (int(x[k] - (np.dot(a[k, k + 1 :], x[k + 1 :]) >> SOLVE_BITS if k + 1 < d else 0)) << SOLVE_BITS) // a[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        norm = math.isqrt(int(np.dot(x, x)))
        return np.array([(int(v) << SOLVE_BITS) // norm for v in x], dtype=object)

    found: list[np.ndarray] = []
    for start in range(count):
        # a fixed start that no symmetry of the data is likely to share
        x = unit(np.array([one // (3 + (i * 7 + start * 13) % 31) * (-1) ** (i * (start + 1) % 3) for i in range(d)], dtype=object))
        for _ in range(3):
            for known in found:
                x = x - (known * (int(np.dot(known, x)) >> SOLVE_BITS) >> SOLVE_BITS)
            x = unit(solve(x))
        for known in found:
            x = x - (known * (int(np.dot(known, x)) >> SOLVE_BITS) >> SOLVE_BITS)
        found.append(unit(x))
    out = [np.array([int(v) / one for v in x]) for x in found]
    return [x if x[np.argmax(np.abs(x))] > 0 else -x for x in out]


def leading_components(matrix: list[list[int]], count: int) -> tuple[list[float], np.ndarray, int]:
    """Shares of the trace, unit vectors (rows) and number of the leading components with an eigenvalue above zero.

    ``matrix`` is positive semidefinite with integer entries; vectors have their largest entry positive.
    """
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    if not d or not trace:
        return [], np.zeros((0, d)), 0
    divisor = math.gcd(*(x for row in matrix for x in row))
    reduced, small_trace = [[x // divisor for x in row] for row in matrix], trace // divisor
    shares: list[float] = []
    vectors: list[np.ndarray] = []
    for root, bits, times in largest_roots(characteristic_polynomial(reduced), min(count, d), small_trace):
        # a root of zero is isolated as the interval's upper end, at most one unit above it
        if root <= 1 << max(0, bits + small_trace.bit_length() - SAME_BITS):
            break
        share = root / (small_trace << bits)
        shares += [share] * times
        vectors += null_vectors(reduced, root, bits, times, small_trace)
    shares, vectors = shares[:count], vectors[:count]
    return shares, np.array(vectors).reshape(len(shares), d), len(shares)
