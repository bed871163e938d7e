"""Ragged numpy arrays over Arrow text columns: bytes, words, hashes of words and of runs of words.

All functions work on the concatenated bytes of a batch with row offsets, in blocks, so that the temporary arrays stay
small also for a batch with very long texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        with np.errstate(over="ignore"):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK * 2
    while size < n:
        size *= 2
    return _powers(size)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each byte is taken for."""

    word: np.ndarray
    fold: np.ndarray


@cache
def alphanumeric() -> Alphabet:
    """Words of ASCII letters, digits and all bytes beyond ASCII; A-Z count as a-z."""
    byte = np.arange(256)
    word = (byte >= 0x80) | ((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x61) & (byte <= 0x7A)) | ((byte >= 0x41) & (byte <= 0x5A))
    fold = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    return Alphabet(word, fold.astype(np.uint64) + np.uint64(1))


@cache
def unspaced() -> Alphabet:
    """Words of all bytes but ASCII white space, unchanged."""
    byte = np.arange(256)
    word = ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))
    return Alphabet(word, byte.astype(np.uint64) + np.uint64(1))


@dataclass(frozen=True)
class Words:
    """Words of a batch: hash, first byte and end of each, and the first word of each row."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """Words of all texts, none across two texts."""
    hashes, starts, ends = [], [], []
    size, at = len(data), 0
    row_starts = offsets[:-1]
    while at < size:
        stop = min(size, at + BLOCK)
        while stop < size:
            # A block ends behind a separator, so that no word is cut.
            gaps = np.flatnonzero(~alphabet.word[data[max(at, stop - 4096) : stop]])
            if len(gaps):
                stop = max(at, stop - 4096) + int(gaps[-1]) + 1
                break
            stop = min(size, stop + 4096)
        block = data[at:stop]
        inside = alphabet.word[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = row_starts[(row_starts > at) & (row_starts < stop)] - at
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(alphabet.fold[block] * up[: len(block)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes; one value for each start, across row bounds too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        part = hashes[at : min(n, at + BLOCK) + k - 1]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[at : at + len(part) - k + 1] = mix((sums[k:] - sums[:-k]) * down[: len(part) - k + 1])
    return out


def valid_starts(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether a run of ``k`` from each of the ``n`` first positions stays inside its row."""
    keep = np.zeros(n, bool)
    lengths = np.diff(offsets)
    delta = np.zeros(n + 1, np.int64)
    has = lengths >= k
    np.add.at(delta, offsets[:-1][has], 1)
    np.add.at(delta, (offsets[1:] - k + 1)[has], -1)
    keep[:] = np.cumsum(delta[:n]) > 0
    return keep


def sliding(values: np.ndarray, width: int, take=np.minimum) -> np.ndarray:
    """Smallest (or largest) of each ``width`` consecutive values, by doubling the reach."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = take(out[:-step], out[step:])
        reach += step
    return out


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row of each element of a ragged array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19, rows: int = 2000):
    """Consecutive parts of a batch with at most ``most`` bytes of text and ``rows`` rows each; a longer text is a part of its own."""
    array = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_bytes(array)
    at = 0
    while at < len(array):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        stop = min(stop, at + rows, len(array))
        yield batch.slice(at, stop - at)
        at = stop


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
