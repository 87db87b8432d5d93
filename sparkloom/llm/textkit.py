"""Vectorised word and shingle hashing for Python workers.

Texts are joined into one byte array at a time (about ``CHUNK`` characters), and
all hashes are prefix sums over it; there is no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 250_000
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: xor-shifts and odd multipliers."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _cache or len(_cache["up"]) < n:
        n = max(n, 2 * CHUNK)
        _cache["up"], _cache["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _cache["up"], _cache["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[0] = 0, so that (h[b] - h[a]) * down[a] depends on data[a:b] alone."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", *range(128, 256)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and offsets: the words of text i are hashes[offsets[i]:offsets[i + 1]].

    A word is a maximal run of letters, digits, underscores and non-ASCII
    characters of the lower-case text.
    """
    return placed_words([t.lower().encode("utf-8", "replace") for t in texts])[:2]


def placed_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The same of lower-case bytes, with these joined, and the places where each word starts and stops there."""
    joined = b"\n".join([*raw, b""])
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    h = prefix_hashes(data)
    _, down = powers(len(data) + 1)
    words = mix64((h[stops] - h[starts]) * down[starts])
    return words, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64), joined, starts, stops


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words, with offsets by text as in word_hashes.

    A text of 1 to width - 1 words has one shingle, of all its words; one without words has none.
    """
    counts = np.diff(offsets)
    many = np.maximum(counts - width + 1, 0)
    n = np.where(counts == 0, 0, np.maximum(many, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    total = max(len(words) - width + 1, 0)
    dense = np.zeros(total, dtype=np.uint64)
    for j in range(width):
        dense += words[j : j + total] * _U((2 * j + 1) * 0x9FB21C651E98DF25 % (1 << 64))
    out = np.zeros(at[-1], dtype=np.uint64)
    full = np.repeat(offsets[:-1] - at[:-1], n) + np.arange(at[-1])
    long = np.repeat(counts >= width, n)
    out[long] = mix64(dense[full[long]])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = words[offsets[i] : offsets[i + 1]]
        odd = np.array([(2 * j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64) for j in range(len(part))], dtype=np.uint64)
        out[at[i]] = mix64(np.array([(part * odd).sum(dtype=np.uint64)], dtype=np.uint64))[0]
    return out, at


def chunks(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) in groups of about ``size`` characters; null counts as empty."""
    group: list[str] = []
    first = total = 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if group and total + len(t) > size:
            yield first, group
            first, group, total = i, [], 0
        group.append(t)
        total += len(t)
    if group:
        yield first, group


def sliding_extreme(values: np.ndarray, width: int, largest: bool = False) -> np.ndarray:
    """Extreme of each full window of ``width`` values, from those of windows of doubled widths."""
    f = np.maximum if largest else np.minimum
    n = len(values)
    if n < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = f(out[: len(out) - step], out[step:]), have + step
    return out


def window_minima(values: np.ndarray, width: int, whole: np.ndarray) -> np.ndarray:
    """Positions that hold the least value of some window of ``width`` positions; ``whole`` tells the windows that count, by start."""
    least = sliding_extreme(values, width)
    if not len(least):
        return np.zeros(0, dtype=np.int64)
    least = np.where(whole[: len(least)], least, _U(0))
    edge = np.zeros(width - 1, dtype=np.uint64)
    reach = sliding_extreme(np.concatenate([edge, least, edge]), width, largest=True)
    return np.flatnonzero((reach == values) & (values != 0))
