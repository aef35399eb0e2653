"""Words of whole texts as 64-bit hashes, in NumPy, many texts at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z are lower-cased
and every other byte stays as it is. Texts are UTF-8.
"""

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)
_BYTE[_SPACE] = 0
#: The same, with ASCII punctuation standing between words too.
_BARE = _BYTE.copy()
_BARE[[b for b in range(128) if not chr(b).isalnum()]] = 0
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Texts taken at a time; the arrays over their bytes take some 50 times as much.
CHUNK_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: each bit of the result depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_places(texts: list[bytes], bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words; for each text the place of its first word, and one more place at the end; for each word its first
    byte in the texts joined by one byte. bare: words end at ASCII punctuation too."""
    table = _BARE if bare else _BYTE
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = (table > 0)[data]
    first = np.flatnonzero(word & np.r_[True, ~word[:-1]]) if len(data) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), first
    run = np.diff(np.r_[first, len(data)])
    at = np.arange(first[0], len(data)) - np.repeat(first, run)
    sums = np.add.reduceat(table[data[first[0] :]] * powers(_BASE, int(run.max()))[at], first - first[0])
    return mix(sums), np.r_[0, np.searchsorted(first, ends)].astype(np.int64), first


def word_hashes(texts: list[bytes], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    return word_places(texts, bare)[:2]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words."""
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _STEP + words[i : n + i]
    return mix(h)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of so many words; of the whole sequence, if it has fewer; none
    without words."""
    words, bounds = word_hashes(texts)
    runs = windows(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(windows(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chunks(texts, limit: int = CHUNK_BYTES):
    """Slices (start, end) of a list of byte strings, each of about so many bytes or one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow column of strings as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
