"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

Words are the runs of bytes outside ASCII white space of the UTF-8 text, with A-Z
in lower case. A word's hash is a polynomial in its bytes, read off one running
sum over the whole buffer, then mixed. Two different words share a hash about once
in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes handled at once; longer texts are still handled whole.
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    return words_and_ends(texts, False)[:2]


def words_and_ends(texts: list[bytes], with_ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Word hashes, words of each text, and a hash of the last three bytes of each word (fewer in shorter words)."""
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers_up_to(len(buffer))
    with np.errstate(over="ignore"):
        total = np.cumsum(_VALUE[_LOWER[buffer]] * power[: len(buffer)], dtype=np.uint64)
        hashes = mixed((total[ends - 1] - total[starts - 1]) * inverse[starts])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1))
    if not with_ends:
        return hashes, counts, None
    code = np.zeros(len(ends), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        code = code << np.uint64(8) | np.where(at >= starts, _LOWER[buffer[np.maximum(at, 0)]], 0).astype(np.uint64)
    return hashes, counts, mixed(code * _BASE)


def letter_terms(texts: list[bytes], stem: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of letters, and of the first bytes of those of more bytes than stem; and how many each text has.

    Texts come in lower case. a-z and all bytes outside ASCII count as letters.
    """
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    other = ~(((buffer >= 97) & (buffer <= 122)) | (buffer >= 128))
    edges = np.flatnonzero(other[1:] != other[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers_up_to(len(buffer))
    with np.errstate(over="ignore"):
        total = np.cumsum(_VALUE[buffer] * power[: len(buffer)], dtype=np.uint64)
        words = mixed((total[ends - 1] - total[starts - 1]) * inverse[starts])
        long = ends - starts > stem
        stems = mixed((total[starts[long] + stem - 1] - total[starts[long] - 1]) * inverse[starts[long]] + np.uint64(1))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)]) + 1
    n_words, n_stems = np.diff(np.searchsorted(starts, bounds)), np.diff(np.searchsorted(starts[long], bounds))
    # Words of a text, then its stems.
    text_of = np.concatenate([np.repeat(np.arange(len(texts)), n_words), np.repeat(np.arange(len(texts)), n_stems)])
    return np.concatenate([words, stems])[np.argsort(text_of, kind="stable")], n_words + n_stems


def in_chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in groups of about CHUNK bytes, each with the position of its first text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of so many words.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for _, chunk in in_chunks(texts):
            words, counts = word_hashes(chunk)
            ends = np.cumsum(counts)
            total = len(words)
            runs = np.zeros(max(total - width + 1, 0), np.uint64)
            for k in range(width):
                runs = runs * _BASE + words[k : k + len(runs)]
            runs = mixed(runs)
            for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
                if n >= width:
                    out.append(np.unique(runs[end - n : end - width + 1]))
                elif n:
                    h = np.uint64(n)
                    for w in words[end - n : end]:
                        h = h * _INVERSE + w
                    out.append(mixed(np.array([h], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out
