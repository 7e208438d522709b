"""Fixed-point arithmetic (30 fractional bits) on Python integers, exact at any size."""

from __future__ import annotations

import math

BITS = 30
ONE = 1 << BITS
TERMS = 14
LN2 = round(math.log(2) * ONE)


def from_float(x: float) -> int:
    return int(x * ONE)


def to_float(x: int) -> float:
    return x / ONE


def exp(x: int) -> int:
    """e^x: x = k ln 2 + r with |r| <= ln 2 / 2, a Taylor sum for r, then a shift; saturates at 2^62."""
    k = (2 * x + LN2) // (2 * LN2)
    r = x - k * LN2
    total = term = ONE
    for n in range(1, TERMS + 1):
        term = term * r // (n << BITS)
        total += term
    if k > 31:
        return 1 << 62
    return min(total << k, 1 << 62) if k >= 0 else total >> -k


def sigmoid(x: int) -> int:
    x = max(-20 * ONE, min(20 * ONE, x))
    e = exp(-x)
    return ONE * ONE // (ONE + e)


def silu(x: int) -> int:
    return x * sigmoid(x) >> BITS


def softmax(xs: list[int]) -> list[int]:
    if not xs:
        return []
    top = max(xs)
    es = [exp(x - top) for x in xs]
    total = sum(es)
    return [e * ONE // total for e in es] if total else [ONE // len(xs)] * len(xs)


def isqrt(x: int) -> int:
    return math.isqrt(x) if x > 0 else 0


def matmul(x: list[list[int]], w: list[list[int]], shift: int = BITS) -> list[list[int]]:
    """x times the transpose of w (rows of w are output columns), shifted right after each full sum."""
    return [[sum(a * b for a, b in zip(row, column)) >> shift for column in w] for row in x]


def layer_norm(x: list[int], gain: list[int], bias: list[int], eps: int = 1) -> list[int]:
    mean = sum(x) // len(x)
    centred = [v - mean for v in x]
    deviation = isqrt(sum(v * v for v in centred) // len(x) + eps)
    return [(v * g // max(deviation, 1)) + b for v, g, b in zip(centred, gain, bias)]


def rms_norm(x: list[int], gain: list[int], eps: int = 1) -> list[int]:
    size = isqrt(sum(v * v for v in x) // len(x) + eps)
    return [v * g // max(size, 1) for v, g in zip(x, gain)]


def rotate(x: list[float], position: int, base: float = 10_000.0) -> list[float]:
    """Rotary position embedding of one head: pairs (i, i + half) turn by position / base^(2i/n)."""
    half = len(x) // 2
    out = list(x)
    for i in range(half):
        a = position / base ** (2 * i / len(x))
        c, s = math.cos(a), math.sin(a)
        out[i], out[i + half] = x[i] * c - x[i + half] * s, x[i] * s + x[i + half] * c
    return out


def attention(q: list[list[int]], k: list[list[int]], v: list[list[int]], window: int | None = None, causal: bool = True) -> list[list[int]]:
    """Scaled dot-product attention of one head; window limits how far back a position sees."""
    scale = isqrt(len(q[0]) << (2 * BITS)) if q else ONE
    out = []
    for t, row in enumerate(q):
        last = t + 1 if causal else len(k)
        first = max(0, last - window) if window else 0
        scores = [(sum(a * b for a, b in zip(row, key)) >> BITS) * ONE // scale for key in k[first:last]]
        weights = softmax(scores)
        out.append([sum(w * value[d] for w, value in zip(weights, v[first:last])) >> BITS for d in range(len(v[0]))])
    return out


def gated_feed_forward(x: list[int], gate: list[list[int]], up: list[list[int]], down: list[list[int]]) -> list[int]:
    a, b = matmul([x], gate)[0], matmul([x], up)[0]
    return matmul([[silu(p) * q >> BITS for p, q in zip(a, b)]], down)[0]
