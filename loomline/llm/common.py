"""Shared plumbing: reading tables, scratch folders, Arrow batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch of documents. Batches are cut further by bytes where numpy works on them.
ROWS_PER_BATCH = 512
_MADE: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where both are one process, a temporary one is set if
    none is named; on a cluster, a missing name is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def cleanup(spark: SparkSession) -> None:
    """Deletes what this driver has written into the shared folder. DataFrames that read it cannot be used after that."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_column(df: DataFrame, text_col: str) -> "F.Column":
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


#: What drops the things that operators keep in a Python worker beyond their tasks.
_KEPT: list[Callable[[], None]] = []


def kept(clear: Callable[[], None]) -> None:
    _KEPT.append(clear)


def forget() -> None:
    """Called in tasks: Spark gives its Python workers to one operator after the other, whose remembered things would add up."""
    for clear in _KEPT:
        clear()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column holds about `most` bytes in each; a longer value stands alone."""
    for batch in batches:
        ends = bytes_of(batch.column(column))[1][1:] if batch.num_rows else np.zeros(0, np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- hashing -----------------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes whose powers are held at once: a power is one of a table's, times one of the chunk's.
_CHUNK = 1 << 16
#: A prime: sums of powers of a base modulo a power of two would vanish for regular texts whatever the base.
_PRIME = np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, in place, for x under 2**62; the prime itself may stand for 0."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= _PRIME
        x += high
    return x


class Rolling:
    """Hashes of byte ranges by two polynomials modulo a prime: prefix sums, then any range in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.seed, self.sides = seed, []
        n = len(data)
        for base, inverse, table in _rolling(seed):
            prefix = np.zeros(n + 1, np.uint32)
            for k in range(0, n, _CHUNK):
                part = table[data[k : k + _CHUNK]]
                part *= _powers(base)[: len(part)]
                np.cumsum(_reduced(part), out=part)
                _reduced(part)
                part *= np.uint64(pow(base, k, int(_PRIME)))
                part += np.uint64(prefix[k])
                prefix[k + 1 : k + 1 + len(part)] = _reduced(part)
            high = np.array([pow(inverse, k, int(_PRIME)) for k in range(0, n + 1, _CHUNK)], np.uint64)
            self.sides.append((prefix, _powers(inverse), high))

    def _hashed(self, sides: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        one, two = (np.where(x == _PRIME, np.uint64(0), x) for x in sides)
        with np.errstate(over="ignore"):
            return mix((one << np.uint64(31) | two) + length * _ODD, self.seed)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sides = []
        for prefix, low, high in self.sides:
            x = prefix[end].astype(np.uint64)
            x += _PRIME  # at least what is taken off
            x -= prefix[start]
            _reduced(x)
            x *= low[start & (_CHUNK - 1)]
            _reduced(x)
            if len(high) > 1:
                x *= high[start >> 16]
                _reduced(x)
            sides.append(x)
        return self._hashed(sides, (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """of() for each range of this length, in the order of their starts."""
        count = max(0, len(self.sides[0][0]) - length)
        out = np.empty(count, np.uint64)
        for k in range(0, count, _CHUNK):
            start = np.arange(k, min(count, k + _CHUNK))
            out[k : k + _CHUNK] = self.of(start, start + length)
        return out


@lru_cache(maxsize=64)
def _powers(base: int) -> np.ndarray:
    out = np.ones(_CHUNK, np.uint64)
    done = 1
    while done < _CHUNK:
        out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
        done *= 2
    return out


@lru_cache(maxsize=32)
def _rolling(seed: int) -> list[tuple[int, int, np.ndarray]]:
    out = []
    for side in (11, 12):
        base = int(mix(np.array([seed * 2 + side], np.uint64), side)[0] % (_PRIME - np.uint64(1000))) + 500
        out.append((base, pow(base, -1, int(_PRIME)), mix(np.arange(256, dtype=np.uint64), seed * 2 + 77 + side) % (_PRIME - np.uint64(1)) + np.uint64(1)))
    return out


def words_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of many short byte ranges: eight bytes at a time, each mixed in before the next; long ones by XXH64."""
    padded = np.append(data, np.zeros(8, np.uint8))
    loads = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64), seed)
    at = np.flatnonzero(size <= _LONG)
    for k in range(0, _LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        with np.errstate(over="ignore"):
            out[at] = mix(out[at] * np.uint64(3) + (loads[starts[at] + k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))), seed)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return out


_LONG = 256


# --- words -------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D, and their documents."""
    ink = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink
    padded = np.append(ink, False)
    starts = np.flatnonzero(padded[:-1] & (~before[:-1] | cut[:-1]))
    ends = np.flatnonzero(before[1:] & (~padded[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def shingles(words: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, index of first word) of each run of `width` words within a document; a document with fewer
    words, but some, has its whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = []
        if n >= width:
            first = np.flatnonzero(docs[: n - width + 1] == docs[width - 1 :])
            h = np.zeros(len(first), np.uint64)
            for j in range(width):
                h = mix(h * np.uint64(3) + words[first + j], j)
            out.append((h, docs[first], first))
        heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        counts = np.diff(np.append(heads, n))
        short = counts < width
        if short.any():
            first, counts = heads[short], counts[short]
            h = np.zeros(len(first), np.uint64)
            for j in range(width - 1):
                at = np.minimum(first + j, n - 1)
                h = np.where(counts > j, mix(h * np.uint64(3) + words[at], j), h)
            out.append((mix(h, 99), docs[first], first))
        h, d, f = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(d, kind="stable")
    return h[order], d[order], f[order]
