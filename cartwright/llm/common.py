"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_cartwright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "cartwright.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("cartwright", os.path.relpath(full, PACKAGE)))
    context.addPyFile(path)
    context._cartwright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def words_of(text: Column) -> Column:
    """The words of a text: runs of other characters than ``SPACES``; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+")
    return F.array_remove(parts, "")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


# ---------------------------------------------------------------- hashing of words in batches

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, ASCII letters and every byte of a character outside ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power_table(n: int, inverse: bool) -> np.ndarray:
    if len(_powers[inverse]) < n:
        steps = np.full(n, _BASE_INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        _powers[inverse] = np.cumprod(steps)
    return _powers[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of several texts: the hashes of all words, and the number of words of each text.

    A word is a run of digits, letters a-z (A-Z count as a-z) and characters outside ASCII.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * _power_table(len(data), False), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power_table(len(data), True)[starts])
    text_ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return hashes, counts


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Slices of batches with about ``limit`` bytes of texts and at most ``rows`` rows."""
    for batch in batches:
        size = batch.column("text").nbytes if batch.num_rows else 0
        step = max(1, min(rows, batch.num_rows * limit // max(size, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def encoded(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
