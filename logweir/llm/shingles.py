"""Word shingles of whole texts and SuperMinHash signatures, as array work on bytes."""

import numpy as np

WORDS = 5
#: Bytes of a text that are hashed at once, and elements that are walked at once.
SLICE, ELEMENTS = 1 << 18, 40_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A random odd 64-bit multiplier and its inverse modulo 2**64.
_P = 0x5851F42D4C957F2D
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int):
    """Powers of the multiplier and of its inverse up to n."""
    if len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for i, p in enumerate((_P, _PINV)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _slices(b: np.ndarray, size: int):
    """``b`` in slices of about ``size`` bytes at most, cut after white space; a longer word stays whole."""
    while len(b) > size:
        gaps = np.flatnonzero(_SPACE[b[:size]])[-1:]
        if not len(gaps):
            gaps = np.flatnonzero(_SPACE[b[size:]])[:1] + size
        end = int(gaps[0]) + 1 if len(gaps) else len(b)
        yield b[:end]
        b = b[end:]
    if len(b):
        yield b


def word_hashes(raw: bytes, size: int = SLICE) -> np.ndarray:
    """A 64-bit hash of each white-space word, A-Z lower-cased; memory is bounded by ``size`` and the longest word, but for the hashes."""
    parts = [_word_hashes(b) for b in _slices(np.frombuffer(raw, np.uint8), size)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _word_hashes(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _grow(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[b]] * power[:len(b)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; one of all words if there are fewer; none without words."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * _GOLD + h[i:len(h) - n + 1 + i])
    if len(h) < words:
        out = mix(out + np.uint64(len(h)))
    return np.unique(out)


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def set_fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers; equal sets, equal bits."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ _GOLD).sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(s + _MIX1), initial=np.uint64(0)).astype(np.int64))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (len(sets) x m, unsigned 64-bit); the rows of empty sets are all ones.

    Each element walks a random permutation of the m slots: at step j it offers
    slot p[j] the value (j, random). A set stops at the first step below which
    all its slots lie, so large sets take few steps. Ranks of one element are
    correlated, which lowers the variance against independent hashes.
    """
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    group, total = [], 0
    for i in [*np.flatnonzero(sizes).tolist(), None]:
        if i is None or (group and total + sizes[i] > ELEMENTS):
            if group:
                out[group] = _signatures([sets[g] for g in group], m)
            group, total = [], 0
        if i is not None and sizes[i] > ELEMENTS:
            for a in range(0, sizes[i], ELEMENTS):
                np.minimum(out[i], _signatures([sets[i][a:a + ELEMENTS]], m)[0], out=out[i])
        elif i is not None:
            group.append(i)
            total += sizes[i]
    return out


def _signatures(sets, m):
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    perm = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
    rows = np.arange(len(x))
    for j in range(m):
        r = mix(x + np.uint64((j + 1) * int(_GOLD) % (1 << 64)))
        k = j + ((r >> np.uint64(40)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        value = np.uint64(j) << np.uint64(48) | mix(r) >> np.uint64(16)
        np.minimum.at(best, doc * m + slot, value)
        if j + 1 < m:
            # Later steps offer values of a higher level only.
            open_ = best.reshape(-1, m).max(axis=1) >= np.uint64(j + 1) << np.uint64(48)
            if not open_.any():
                break
            if not open_.all():
                live = open_[doc]
                if live.sum() < 0.7 * len(live):
                    x, doc, perm = x[live], doc[live], perm[live]
                    rows = np.arange(len(x))
    return best.reshape(-1, m)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` values (sets x bands, signed)."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _GOLD + parts[:, :, i])
    return key.astype(np.int64)
