"""Texts of an Arrow batch as one byte array, and hashes of their words and substrings in vectorised passes.

A text is handled whole. Passes run over pieces of about PIECE bytes, cut between words, so memory follows the piece and
the result, not the batch; a longer text only adds pieces.

A word's hash mixes its length and then its bytes, eight at a time, each step a bijection of the state: words of the same
length up to eight bytes never share a hash, others only by chance (one in 2 ** 64); words over LONG bytes go through
BLAKE2b. Hashes of substrings (``_prefix``) are polynomials modulo 2 ** 64, for which unlike strings with equal hashes are
easily made: they only ever route, and whatever is decided on bytes is decided on bytes or on ``digest``.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
#: Longest word that is hashed eight bytes at a time.
LONG = 64
_MASK = (1 << 64) - 1
#: Hash parameters: an odd base and a random value for each byte.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = 20240607


def _tables() -> dict:
    """Powers and byte values, made once in each process."""
    import sys

    store = sys.__dict__.setdefault("_tessella_tables", {})
    if not store:
        n = PIECE + (PIECE >> 1)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        values = np.random.Generator(np.random.PCG64(_SEED)).integers(1, _MASK, 256, dtype=np.uint64)
        folded = np.arange(256, dtype=np.uint8)
        folded[65:91] += 32
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        store |= {"up": np.cumprod(up), "down": np.cumprod(down), "values": values, "folded": folded, "space": space}
    return store


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    t = _tables()
    if n > len(t["up"]):  # a piece that could not be cut
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)
    return t["up"], t["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; x is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it needs to clash with no taken one (in any case)."""
    lower, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in lower:
            n = "_" + n
        lower.add(n.lower())
        out.append(n)
    return out


def digest(raw: bytes) -> int:
    """64 bits of a text's BLAKE2b: equal for equal texts, else by a chance of one in 2 ** 64."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def trimmed(run: Callable) -> Callable:
    """The Arrow function, with memory that it has freed given back to the system at its end: workers outlive their tasks."""

    def lean(batches):
        yield from run(batches)
        try:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            return

    return lean


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, in slices of about ``limit`` bytes of text; at least one row each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
        start = 0
        while start < len(column):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def _prefix(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, word starts, word ends) of each piece, starts and ends counted within raw. No word crosses a text."""
    space = _tables()["space"]
    edges = np.zeros(len(raw) + 1, bool)
    edges[offsets] = True
    start = 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and not edges[end]:  # to the next place between words
            gap = np.flatnonzero(space[raw[end : end + 65536]] | edges[end : end + len(raw[end : end + 65536])])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + 65536)
        word = np.concatenate([[False], ~space[raw[start:end]], [False]])
        edge = edges[start : end + 1]
        starts = np.flatnonzero(word[1:] & (~word[:-1] | edge)) + start
        ends = np.flatnonzero(word[:-1] & (~word[1:] | edge)) + start
        yield start, end, starts, ends
        start = end


def span_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span of a piece."""
    n = ends - starts
    padded = np.concatenate([piece, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(piece) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    state = mix(n.astype(np.uint64) * np.uint64(_BASE))
    live, done = np.flatnonzero(n <= LONG), 0
    while len(live):
        left = n[live] - done
        got = eight[starts[live] + done] & (np.uint64(_MASK) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        state[live] = mix((state[live] ^ got) * np.uint64(_INVERSE))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(n > LONG).tolist():
        state[i] = digest(piece[starts[i] : ends[i]].tobytes()) & _MASK
    return state


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and each text's offset into them. fold: A-Z count as a-z."""
    folded = _tables()["folded"]
    hashes, starts_all = [], []
    for start, end, starts, ends in word_bounds(raw, offsets):
        piece = folded[raw[start:end]] if fold else raw[start:end]
        hashes.append(span_hashes(piece, starts - start, ends - start))
        starts_all.append(starts)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offsets)


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text."""
    starts = [s for _, _, s, _ in word_bounds(raw, offsets)]
    return np.diff(np.searchsorted(np.concatenate(starts) if starts else np.zeros(0, np.int64), offsets))
