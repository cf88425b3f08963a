"""Word hashes of many texts at once, with numpy and no Python object a word.

Words are maximal runs of the bytes of an alphabet; by default everything but ASCII white space
(0x20, 0x09-0x0D), which is what ``bytes.split()`` yields. Strings travel as UTF-8 bytes. A word's
64-bit hash is a polynomial of its bytes with a random odd base, finalised; a run of words hashes
likewise over its words' hashes, so any run costs two look-ups in a prefix sum.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes looked at together, and of those hashed at a time; a longer text is taken whole.
CHUNK = 1 << 20
_HASHED = 1 << 18


def alphabet(outside: bytes) -> np.ndarray:
    """Look-up of the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


SPACED = alphabet(b" \t\n\v\f\r")


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def decode(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass")


def ascii_lower(raw: bytes) -> bytes:
    """Lower-case A-Z only; every other byte is unchanged."""
    return raw.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection): spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & _MASK)) | np.uint64(1)


#: Powers kept between calls: longer tables are made anew, so that idle workers hold little.
_KEPT_POWERS = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(seed: int, n: int, most: int = _KEPT_POWERS) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a seed's odd base, and of its inverse, modulo 2^64."""
    if seed in _powers and len(_powers[seed][0]) >= n:
        return _powers[seed]
    n = 1 << (n - 1).bit_length() if n <= most else n
    base, tables = int(multipliers(1, seed * 7919 + 3)[0]), []
    for r in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, r, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, out=steps))
    if n <= most:
        _powers[seed] = tuple(tables)
    return tuple(tables)


def give_back() -> None:
    """Return memory that is free but held by this process's allocators, at the end of a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def hold() -> None:
    """Let this process keep what it frees for its next arrays, until ``give_back``: work on many large ones else spends its time on fresh pages."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 64 << 20)  # larger arrays are mapped and go at once
        libc.mallopt(-1, 256 << 20)


def lean(run):
    """A task function on batches that leaves no free memory behind in its worker."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Runs of words hashed at a time.
_RUNS = 1 << 16


class Words:
    """Hash of every word of some texts, in order; ``counts`` and ``first``: words of each text, and where they begin."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.first = np.cumsum(counts) - counts

    @classmethod
    def of(cls, raws: list[bytes], inside: np.ndarray = SPACED, lower: bool = False) -> Words:
        parts = [_hash_chunk(chunk, inside, lower) for chunk in chunks_of(raws, _HASHED)]
        if not parts:
            return cls(np.empty(0, np.uint64), np.empty(0, np.int64))
        return cls(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))

    def runs(self, first: np.ndarray, length: np.ndarray | int, seed: int) -> np.ndarray:
        """Hash of each run of words; equal for equal words and length. ``first`` in order: some runs at a time, which a short table serves."""
        first, length = np.asarray(first), np.broadcast_to(length, np.shape(first))
        out = np.empty(len(first), np.uint64)
        step = _RUNS if np.all(first[1:] >= first[:-1]) else max(1, len(first))
        for i in range(0, len(first), step):
            out[i : i + step] = self._runs(first[i : i + step], length[i : i + step], seed)
        return out

    def _runs(self, first: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
        base = int(first.min())  # a run's hash does not depend on where counting begins
        hashes = self.hashes[base : int((first + length).max())]
        n, first = len(hashes), first - base
        up, down = _table(seed, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(hashes, up[:n], out=sums[1:])
        np.cumsum(sums, out=sums)
        out = (sums[first + length] - sums[first]) * down[first]
        out += length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(out)

    def window_starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of every window, windows of each text)"""
        per_text = np.maximum(self.counts - size + 1, 0)
        return np.arange(per_text.sum()) + np.repeat(self.first - (np.cumsum(per_text) - per_text), per_text), per_text


def chunks_of(raws: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    """Texts in groups of about ``most`` bytes, one text at least."""
    held, size = [], 0
    for raw in raws:
        held.append(raw)
        size += len(raw) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Places:
    """Words of a line-separated text of texts: their hashes, and the byte before and the last byte of each."""

    def __init__(self, blob: bytes, sizes: list[int], inside: np.ndarray):
        raw = np.frombuffer(blob, np.uint8)
        word = inside[raw]
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.before, self.last = edges[0::2], edges[1::2]
        up, down = _table(0, len(raw), 2 * CHUNK)
        sums = raw + np.uint64(1)
        sums *= up[: len(raw)]
        np.cumsum(sums, out=sums)
        hashes = (sums[self.last] - sums[self.before]) * down[self.before]
        self.hashes = mix(hashes + (self.last - self.before).astype(np.uint64))
        ends = np.cumsum([x + 1 for x in sizes])
        self.counts = np.diff(np.searchsorted(self.before, ends), prepend=0).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts


def _hash_chunk(raws: list[bytes], inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    blob = b"\n" + b"\n".join(raws) + b"\n"
    places = Places(ascii_lower(blob) if lower else blob, [len(x) for x in raws], inside)
    return places.hashes, places.counts
