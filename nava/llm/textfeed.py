"""Arrays over whole texts, shared by the operators that count word sequences."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Long words whose digests a worker keeps; a full table is emptied, which changes speed only.
KEPT = 200_000
#: Bytes of a short word, which is two numbers at most; masks of so many bytes; what tells lengths apart.
SHORT = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


class Digests(dict):
    """64-bit digests of long words, by a cryptographic hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) < 100:
            self[word] = found
        return found


_digests = Digests()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_digests(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: of a short one, its bytes as numbers, mixed; of a longer one, its digest."""
    joined = b" ".join(words) + bytes(SHORT)
    size = len(joined) - SHORT
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8, size) == 32)
    starts = np.concatenate([[0], breaks + 1])
    lengths = np.concatenate([breaks, [size]]) - starts
    windows = np.ndarray((size + 1,), "<u8", joined, strides=(1,))
    h = mixed((windows[starts] & _MASKS[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _LENGTH))
    middle = np.flatnonzero(lengths > 8)
    h[middle] = mixed(h[middle] ^ (windows[starts[middle] + 8] & _MASKS[np.minimum(lengths[middle] - 8, 8)]))
    long = np.flatnonzero(lengths > SHORT)
    if len(long):
        h[long] = np.fromiter(map(_digests.__getitem__, [words[i] for i in long.tolist()]), np.uint64, len(long))
    return h


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash for each run of n words, in order; with fewer words, one of the whole sequence; none without words.

    Words' digests enter one after the other, mixed in between, so the order counts and no sum of digests can be balanced by another.
    """
    if not words:
        return np.zeros(0, np.uint64)
    own = word_digests(words)
    n = min(n, len(words))
    count = len(words) - n + 1
    h = mixed(own[:count] + np.uint64(n))
    for k in range(1, n):
        h = mixed(h ^ own[k : k + count])
    return h
