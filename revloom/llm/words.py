"""Words and word-shingle hashes of whole texts, as numpy arrays inside Spark tasks."""

import numpy as np
import xxhash

# A-Z to a-z and nothing else
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
CACHE_WORDS = 200_000


class WordHashes(dict):
    """Word -> 64-bit hash; remembers at most ``CACHE_WORDS`` words per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space, of the whole text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_hashes(found: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in text order; a shorter text is one run of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(width, n)
    mixed = np.full(n - span + 1, span, dtype=np.uint64)
    for k in range(span):
        mixed = (mixed ^ (mixed >> _SHIFT)) * _MIX + hashes[k:n - span + 1 + k]
    mixed = (mixed ^ (mixed >> _SHIFT)) * _MIX
    return mixed ^ (mixed >> _SHIFT)


def text_of(batch, column: str):
    """The texts of an Arrow batch, one at a time."""
    for value in batch.column(column):
        yield value.as_py()
