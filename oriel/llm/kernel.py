"""Vectorised text hashing shared by the corpus operators.

Texts are read straight from Arrow buffers: no Python string is made for a document or a word.
A word is a maximal run of bytes other than space, tab, line feed, form feed and carriage return;
ASCII letters are compared without case. Hashes are 64-bit and depend on content alone, so every
executor and every run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240117)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
for _c in range(65, 91):
    BYTE[_c] = BYTE[_c + 32]
K1, K2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
#: The same words in SQL: split on this class, after folding ASCII letters.
SQL_SPACE = r"[ \t\n\f\r]+"
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 12), base, np.uint64)
        full[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(full)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text each, so that working arrays stay in cache."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words of a slice of documents: ``hash``, and ``doc``, the row that each one is in."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.data, self.n_docs = data, len(offsets) - 1
        inside = ~SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] |= inside[at]
        self.start = np.flatnonzero(begins)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.wide = data[inside]
        before = np.cumsum(inside) - 1
        self.first = before[self.start]
        self.length = np.diff(np.append(self.first, len(self.wide)))
        #: Index of the first word of each document, and one past the last at the end.
        self.bound = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.count = np.diff(self.bound)
        if len(self.start):
            place = np.arange(len(self.wide)) - np.repeat(self.first, self.length)
            value = BYTE[self.wide] * powers(K1, int(self.length.max()))[place]
            self.hash = mix(np.add.reduceat(value, self.first) + self.length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)


def rolling(hashes: np.ndarray, width: int, base: np.uint64 = K2) -> np.ndarray:
    """Hash of every run of ``width`` hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse(base), n))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of n words; a shorter document with words has one, of all its words."""
    h = rolling(words.hash, n)
    own = words.doc[: len(h)] == words.doc[n - 1 :] if len(h) else np.zeros(0, bool)
    doc, value = words.doc[: len(h)][own], h[own]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        extra = np.array([rolling(words.hash[a:b], b - a)[0] for a, b in zip(words.bound[short], words.bound[short + 1], strict=True)], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(extra + words.count[short].astype(np.uint64))])
    return doc, value


def distinct_shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, bounds) of the distinct shingles, sorted by document and hash."""
    doc, value = shingles(words, n)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return doc, value, np.searchsorted(doc, np.arange(words.n_docs + 1))


def grouped(batches: Iterator[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        if len(others):
            cut = int(others[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def pieces(batches: Iterator[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups out of batches that are sorted by ``key``, with True; a group of more than ``rows``
    rows comes as pieces of about that many, one after the other, with False: it is never held as a whole."""
    held: list[pa.RecordBatch] = []
    count, large = 0, None

    def given(end: bool) -> Iterator[tuple[pa.Table, bool]]:
        nonlocal held, count, large
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        begin = 0
        if large is not None:
            begin = int(np.searchsorted(keys != large, True)) if keys[0] == large else 0
            if begin:
                yield table.slice(0, begin), False
            if begin < len(keys):
                large = None
        last = begin + int(np.searchsorted(keys[begin:] == keys[-1], True)) if begin < len(keys) else begin
        if end:
            last = len(keys)
        if last > begin:
            yield table.slice(begin, last - begin), True
        if len(keys) - last >= rows:
            large = keys[-1]
            yield table.slice(last), False
            last = len(keys)
        held, count = table.slice(last).to_batches(), len(keys) - last

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield from given(False)
    if count:
        yield from given(True)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of slices of values."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
