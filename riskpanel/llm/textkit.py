"""Vectorised text kernels shared by the operators of this subpackage.

Texts travel as Arrow batches. A batch is cut into blocks of whole texts of about ``BLOCK_BYTES``, and every step
below is a numpy pass over one block's UTF-8 bytes, so a task holds one block's arrays however many rows it reads.
A single text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 21
_PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes that continue a UTF-8 character
CONT = (np.arange(256) & 0xC0) == 0x80

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CODES = _byte_codes()
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    have = _POW.get("p")
    if have is None or len(have) < n:
        m = max(n, _PIECE + 4096)
        with np.errstate(over="ignore"):
            for name, b in (("p", _BASE), ("q", _BASE_INV)):
                a = np.full(m, b, np.uint64)
                a[0] = 1
                _POW[name] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"][:n], _POW["q"][:n]


class Block:
    """Some whole texts: ``data`` their bytes, ``off`` the n + 1 byte offsets, ``lo`` the first row's index in the batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int):
        self.data, self.off, self.lo, self.n = data, off, lo, len(off) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words (runs of bytes that are not white space, never across texts), and the n + 1
        bounds of each text's words."""
        data = self.data if data is None else data
        word = ~SPACE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = self.off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] |= word[cut]
        last[cut - 1] |= word[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(s, self.off)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts (null: empty) as blocks of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    buf = column.buffers()
    off = np.frombuffer(buf[1], np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield Block(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], lo)
        lo = hi


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span [s, e) of ``data``; spans are sorted by start. Equal bytes have equal hashes; two
    different spans share one with a chance of about 2**-64."""
    out = np.empty(len(s), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(s, s[i] + _PIECE)))
            lo, hi = int(s[i]), int(e[i:j].max())
            p, q = powers(hi - lo + 1)
            acc = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(CODES[data[lo:hi]] * p[: hi - lo], out=acc[1:])
            a, b = s[i:j] - lo, e[i:j] - lo
            out[i:j] = mix64((acc[b] - acc[a]) * q[a] + (b - a).astype(np.uint64) * CODES[7])
            i = j
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each of len(h) - n + 1 positions of the hash sequence h."""
    m = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g = g * _BASE + h[k: k + m]
        return mix64(g)


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 n-gram starts keep within one text, given the texts' bounds in the sequence."""
    m = max(0, total - n + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:m]
    return np.arange(m) + n <= ends


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    acc = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=acc[1:])
    return acc[bounds[1:]] - acc[bounds[:-1]]


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text that each element belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary()}


def add_columns(df: DataFrame, text: str, new: dict[str, str], fn: Callable[[Block], dict]) -> DataFrame:
    """``df`` with the columns ``new`` (name to SQL type), made by ``fn`` block by block from the text column. The other
    columns of df pass through; those that have one of the new names are replaced."""
    df = df.drop(*new)
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in new.items())).fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made: dict[str, list] = {k: [] for k in new}
            for block in blocks(batch.column(batch.schema.get_field_index(text))):
                got = fn(block)
                for k in new:
                    made[k].append(got[k])
            cols = [pa.chunked_array([as_arrow(x, new[k]) for x in made[k]]).combine_chunks() for k in new]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    return df.mapInArrow(run, schema)


def as_arrow(x, kind: str) -> pa.Array:
    if isinstance(x, pa.Array):
        return x
    return pa.array(x, ARROW.get(kind))
