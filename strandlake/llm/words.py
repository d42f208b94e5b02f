"""Words and five-word shingles of whole texts, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
SHINGLE = 5
_BASE = 0x100000001B3
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BYTE = np.array([(0x9E3779B97F4A7C15 * (i + 1) ^ (i * 0xD6E8FEB86659FD93)) & _MASK for i in range(256)], dtype=np.uint64)
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(_BASE, have, 1 << 64))
        have += step
    return out


_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS, _INVERSES = _powers(BLOCK + 1), None


def _inverses() -> np.ndarray:
    global _INVERSES
    if _INVERSES is None:
        out = np.empty(BLOCK + 1, dtype=np.uint64)
        out[0] = 1
        have = 1
        while have < BLOCK + 1:
            step = min(have, BLOCK + 1 - have)
            out[have : have + step] = out[:step] * np.uint64(pow(_INVERSE, have, 1 << 64))
            have += step
        _INVERSES = out
    return _INVERSES


def _hash_block(data: np.ndarray) -> np.ndarray:
    """Hashes of the words in at most BLOCK bytes."""
    return _placed_hashes(data)[1]


def _placed_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words in at most BLOCK bytes start, and their hashes."""
    blank = _SPACE[data]
    edge = np.diff(np.concatenate(([1], blank.astype(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * _POWERS[: len(data)])))
    return starts, mix64((total[ends] - total[starts]) * _inverses()[starts] + (ends - starts).astype(np.uint64))


def word_hashes_of(texts: list[str]) -> list[np.ndarray]:
    """word_hashes of each text; short texts are hashed many at a time."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        if held:
            starts, hashes = _placed_hashes(np.frombuffer(b" ".join(held), dtype=np.uint8))
            out.extend(np.split(hashes, np.searchsorted(starts, np.cumsum([len(h) + 1 for h in held])[:-1])))
            held.clear()

    for text in texts:
        data = text.lower().encode("utf-8", "surrogatepass")
        if size + len(data) + 1 > BLOCK:
            flush()
            size = 0
        if len(data) + 1 > BLOCK:
            out.append(word_hashes(text))
        else:
            held.append(data)
            size += len(data) + 1
    flush()
    return out


def word_hashes(text: str) -> np.ndarray:
    """The hash of each word of text: runs of non-blanks (ASCII blanks and control separators), without regard to case."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) <= BLOCK:
        return _hash_block(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            blanks = np.flatnonzero(_SPACE[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # one word longer than a block: hash what there is and go on at its end
                more = np.flatnonzero(_SPACE[data[end:]])
                stop = end + int(more[0]) if len(more) else len(data)
                h = np.uint64(stop - at)
                for i in range(at, stop, BLOCK):
                    piece = data[i : min(stop, i + BLOCK)]
                    h = mix64(np.array([h], dtype=np.uint64) + (_BYTE[piece] * _POWERS[: len(piece)]).sum(dtype=np.uint64))[0]
                out.append(np.array([h], dtype=np.uint64))
                at = stop
                continue
        out.append(_hash_block(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hashes of all runs of `size` words; a text of fewer words (but one) is one shingle."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of text, sorted, and how often each occurs."""
    return np.unique(shingles(word_hashes(text or "")), return_counts=True)


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of the smaller counts."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    return int(np.minimum(a[1][same], b[1][at[same]]).sum())


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones; 0 if both are empty."""
    both = common(a, b)
    return both / (int(a[1].sum()) + int(b[1].sum()) - both) if both else 0.0
