"""Rolling hashes and compact windows over arrays of code points."""

from __future__ import annotations

import numpy as np

U = np.uint64
_B1, _B2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_INV = {int(b): U(pow(int(b), -1, 2**64)) for b in (_B1, _B2)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(b: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(int(b))
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 18)
        p = np.full(n, b, U)
        q = np.full(n, _INV[int(b)], U)
        p[0] = q[0] = 1
        have = _POWERS[int(b)] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return have


class Hasher:
    """Hashes of any stretch of ``points`` (uint32 code points) in constant time."""

    def __init__(self, points: np.ndarray, wide: bool = False):
        self.n = len(points)
        self.parts = []
        for b in (_B1, _B2) if wide else (_B1,):
            up, down = _powers(b, self.n + 1)
            v = mix(points.astype(U) * U(2) + U(1) + b)
            total = np.zeros(self.n + 1, U)
            np.cumsum(v * up[: self.n], out=total[1:])
            self.parts.append((total, down))

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = None
        for total, down in self.parts:
            h = mix((total[stop] - total[start]) * down[start])
            out = h if out is None else mix(out + h * U(3))
        return out

    def pair(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of a wide hasher, 128 bits together; each by itself is as good as ``at`` of a plain one."""
        a, b = (mix((total[stop] - total[start]) * down[start]) for total, down in self.parts)
        return a, mix(b + U(1))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every stretch of length k, by start."""
        total, down = self.parts[0]
        m = self.n - k + 1
        return mix((total[k:] - total[:m]) * down[:m]) if m > 0 else np.zeros(0, U)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (w - size)], m[w - size :]) if size < w else m


def compact_windows(points: np.ndarray, row: np.ndarray, length: int, k: int):
    """The windows of ``length`` points grouped by the k-gram of least hash in them (leftmost on ties).

    For one fixed window length the Cartesian tree over the hashes, cut at that length, is the sequence of runs of window
    starts whose minimum is the same k-gram; each run is a compact window. ``row`` says to which text a point belongs; windows
    across two texts are left out. Returns first start, last start, gram position, gram hash per compact window.
    """
    n = len(points)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z.astype(U), None
    hasher = Hasher(points)
    g = hasher.grams(k)
    bits = max(28, int(n).bit_length())
    low = U((1 << bits) - 1)
    packed = (g & ~low) | np.arange(len(g), dtype=U)
    best = (sliding_min(packed, length - k + 1) & low).astype(np.int64)
    ok = row[: n - length + 1] == row[length - 1 :]
    first = ok.copy()
    first[1:] &= (best[1:] != best[:-1]) | ~ok[:-1]
    lo = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= (best[1:] != best[:-1]) | ~ok[1:]
    hi = np.flatnonzero(last)
    return lo, hi, best[lo], g[best[lo]], hasher


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, text number of each point, start of each text) of joined texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.repeat(np.arange(len(texts)), n), np.concatenate([[0], np.cumsum(n)])


def slices(texts: list[str], points: int = 1 << 18):
    """Ranges of texts of about so many points together, a longer text alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > points:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
