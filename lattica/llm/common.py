"""What the operators of this subpackage share: reading tables, keys of rows, words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import ship

#: Bytes that separate words (a fixed value of the word definition): space and \x09-\x0D.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same definition as a Java / RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
CHUNK_BYTES = 500_000
#: Rows of an Arrow batch of texts, unless the session sets another number than Spark's.
BATCH_ROWS = 1000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # texts are long, and a batch is held whole
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(key: str, text: str) -> Column:
    """A row's key (none, id, h): null ids come last, and a hash of the text tells rows of one id, or of none, apart."""
    return F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def hash_sample(rows: DataFrame, order: Column, size: int, n: int) -> DataFrame:
    """The `size` rows with the smallest 64-bit hash `order`, of about n; hashes far above what so many have are left out before the sort."""
    share = (2 * size + 200) / max(n, 1)
    some = rows if share >= 1 else rows.where(order < F.lit(-(1 << 63) + int(share * 2**64)))
    return some.orderBy(order).limit(size)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, so that every bit of a 64-bit name depends on every bit of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[list(SEPARATORS)] = 0
_BASE, _BASE2 = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have[0]))
        one = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            one.append(np.multiply.accumulate(a))
        have = _powers[base] = (one[0], one[1])
    return have


#: Values that one polynomial covers. Modulo 2 ** 64 some sequences of 1,024 or more values collide under every base.
_BLOCK = 64


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE2) -> np.ndarray:
    """One 64-bit hash of values[s:e] for every pair of starts and ends; equal sequences have equal hashes wherever they stand.

    A longer sequence is hashed in blocks from its own start, and the blocks' mixed hashes in blocks again, until one is left.
    """
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    sizes = ends - starts

    def polynomial(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((total[ends] - total[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))

    long = np.flatnonzero(sizes > _BLOCK)
    if not len(long):
        return polynomial(starts, ends)
    out = polynomial(starts, np.minimum(ends, starts + _BLOCK))
    blocks = -(-sizes[long] // _BLOCK)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts[long], blocks) + _BLOCK * (np.arange(first[-1] + blocks[-1]) - np.repeat(first, blocks))
    parts = polynomial(at, np.minimum(at + _BLOCK, np.repeat(ends[long], blocks)))
    out[long] = mix64(span_hashes(parts, first, first + blocks, base) ^ mix64(sizes[long].astype(np.uint64)))
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of several texts: byte spans, and which words each text has (first[i] to first[i + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = np.zeros(n + 2, bool)
        np.logical_not(_IS_SPACE[data], out=word[1:-1])
        cuts = np.zeros(n + 1, bool)
        cuts[offsets] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cuts[:-1]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | cuts[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; data: other bytes of the same length, such as lower-cased ones."""
        data = self.data if data is None else data
        return span_hashes(_BYTE[data], self.starts, self.ends, _BASE)


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, Words]]:
    """Rows [i, j) of a batch and their words, about CHUNK_BYTES of text at a time."""
    data, offsets = string_buffers(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
