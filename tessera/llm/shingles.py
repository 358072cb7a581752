"""Sets of word shingles as sorted arrays of 64-bit hashes, vectorised over the bytes of many texts.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, after A-Z became a-z. A word's hash is a polynomial over a
random 64-bit value for each byte, taken from differences of one cumulative sum; a shingle mixes the hashes of its
words in order. Two different shingles share a hash with odds of about 2^-64."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 18
U = np.uint64
with np.errstate(over="ignore"):
    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    WORD_FACTORS = [U(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(64)]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUES = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        x = np.full(max(n, 2 * SEGMENT), base, np.uint64)
        x[0] = 1
        _powers[name] = np.cumprod(x)
    return _powers[name]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SEPARATOR[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers("up", BASE, len(data))[: len(data)], out=sums[1:])
    return starts, (sums[ends] - sums[starts]) * powers("down", INVERSE, len(data))[starts]


def words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text of any length, a segment at a time; segments end where a word does."""
    out, a = [], 0
    while a < len(data):
        b = min(a + SEGMENT, len(data))
        while b < len(data) and not SEPARATOR[data[b]]:
            stop = np.flatnonzero(SEPARATOR[data[b : b + SEGMENT]])
            b += int(stop[0]) if len(stop) else len(data[b : b + SEGMENT])
        out.append(_words(data[a:b])[1])
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(w: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words has its whole sequence as one, one without words has none."""
    if not len(w):
        return w
    if len(w) < width:
        return mix((w * np.array(WORD_FACTORS[: len(w)], np.uint64)).sum(dtype=np.uint64, keepdims=True) + U(len(w)))
    n = len(w) - width + 1
    total = w[:n] * WORD_FACTORS[0]
    for k in range(1, width):
        total += w[k : k + n] * WORD_FACTORS[k]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The set of each text; a null text has none."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    group, size = [], 0
    raw = [(t or "").encode() for t in texts]

    def flush() -> None:
        if group:
            at, hashes = _words(np.frombuffer(b" ".join(raw[i] for i in group), np.uint8))
            ends = np.cumsum([len(raw[i]) + 1 for i in group])
            stops = np.searchsorted(at, ends)
            for i, a, b in zip(group, [0, *stops[:-1]], stops, strict=True):
                out[i] = shingle_set(hashes[a:b], width)
            group.clear()

    for i, t in enumerate(raw):
        if len(t) > SEGMENT:
            out[i] = shingle_set(words(np.frombuffer(t, np.uint8)), width)
            continue
        group.append(i)
        size += len(t) + 1
        if size > SEGMENT:
            flush()
            size = 0
    flush()
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same for equal sets, as two signed longs."""
    a, b = mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s ^ U(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
