"""Shared pieces: lineage cuts, size-checked broadcasts, the Arrow word kernel."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.kernels import BASE, BASE_INVERSE, mix, power, span_hashes
from grainsift.functions.lineage import checkpoint_folder
from grainsift.functions.lineage import cut as checkpointed
from grainsift.functions.ship import ship

BROADCAST_BYTES = 192 << 20
"""A side is broadcast only while its hash table stays below this: rows x width, where"""
LONG_KEY, WIDE_KEY = 88, 128
"""a row with a single long as its key takes some 88 bytes, any other some 128."""

BATCH_ROWS = 512
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The package goes to the workers, and a checkpoint folder is seen to. Rows are
    whole documents, so Arrow batches get short, unless the session has a length of
    its own for them."""
    ship(spark)
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    checkpoint_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return checkpointed(df)


def small(df: DataFrame, rows: int, width: int = LONG_KEY, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint while ``rows * width`` is below ``limit``;
    beyond it Catalyst plans a shuffle join."""
    return F.broadcast(df) if rows * width <= limit else df


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns c0, c1, ... and where each exact name went, so that
    neither extra columns nor names that differ in case only can clash.
    ``.toDF(*df.columns)`` undoes it."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return inner, {n: f"c{i}" for i, n in reversed(list(enumerate(df.columns)))}


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, can't clash."""
    inner, at = renamed(df)
    return inner.select(*[F.col(at[n]).alias(n) for n in names])


TOKEN = r"[^ \t\r\n]+"


def token_count(text: Column) -> Column:
    """Words between spaces, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(kernel: Kernel) -> Kernel:
    """The kernel, after which the worker gives freed memory back to the system: Spark
    keeps workers for later stages, and their peaks would add up."""

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    return run


# --- word kernel -----------------------------------------------------------

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32

class Words:
    """The words of a batch of texts.

    A word is a maximal run of ASCII letters, digits and bytes above 127; ASCII
    letters are compared without case. ``hashes`` holds a 64-bit hash per word,
    ``starts``/``ends`` byte positions in ``raw``, ``first`` (n + 1) the range of
    words of each text, ``offsets`` (n + 1) the range of bytes of each text.
    """

    __slots__ = ("ends", "first", "hashes", "offsets", "raw", "starts")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        folded = _FOLD[raw]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = folded > 0
        edge = inside[1:] != inside[:-1]
        # runs that touch across two texts are cut at the boundary
        cut_at = offsets[1:-1]
        cut_at = cut_at[(cut_at > 0) & (cut_at < n)]
        both = np.unique(cut_at[inside[cut_at] & inside[cut_at + 1]]) if len(cut_at) else cut_at
        bounds = np.flatnonzero(edge)
        self.starts, self.ends = bounds[::2], bounds[1::2]
        if len(both):
            self.starts = np.sort(np.concatenate([self.starts, both]))
            self.ends = np.sort(np.concatenate([self.ends, both]))
        self.hashes = span_hashes(folded, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)

    def owner(self) -> np.ndarray:
        """The index of its text for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries (length ``len(h) - k + 1``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power("inv", BASE_INVERSE, len(h)), out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * power("pow", BASE, len(h) + 1)[:n])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive entries, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
