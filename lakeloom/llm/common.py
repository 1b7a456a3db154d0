"""Helpers shared by the training-data operators: shared-folder cuts, size-checked
broadcasts and vectorised shingle hashing of text batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Rows of an id-only table that may be broadcast (16 MB of longs); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one vectorised pass takes at a time (a longer text is a pass of its own).
PASS_BYTES = 1 << 19

U64 = np.uint64
_M1, _M2, _P = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Session settings of these operators: small Arrow batches (long texts),
    a checkpoint folder, and this package on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")


def cut(df: DataFrame, kind: str = "llm-cut") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: lineage
    ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, else as it is (the join shuffles)."""
    return F.broadcast(df) if df.count() <= rows else df


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * _M1
    h = h ^ (h >> U64(27))
    h = h * _M2
    return h ^ (h >> U64(31))


def passes(texts: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes, so that array memory stays bounded."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, first word index of every text, with the total at the end, bytes of every word).

    A-Z are lower-cased; words are maximal runs without blanks (space, \\t..\\r).  A word's
    hash is a polynomial over its bytes, read off one prefix sum per pass."""
    parts, sizes, starts, done = [], [], [0], 0
    for lo, hi in passes(texts):
        buf = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", dtype=np.uint8)
        buf = _UPPER[buf]
        blank = _BLANK[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        first, last = edge[0::2], edge[1::2]                       # word = buf[first:last]
        n = min(len(first), len(last))
        first, last = first[:n], last[:n]
        with np.errstate(over="ignore"):
            power = _powers(len(buf))
            total = np.concatenate([[U64(0)], np.cumsum((buf.astype(U64) + U64(1)) * power, dtype=U64)])
            h = (total[last] - total[first]) * _inverse_powers(len(buf))[first]
            parts.append(mix(h + (last - first).astype(U64) * _P))
            sizes.append(last - first)
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        starts.extend((done + np.searchsorted(first, ends)).tolist())
        done += n
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.array(starts, dtype=np.int64), sizes


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * PASS_BYTES)
        step = np.full(size, U64(base), dtype=U64)
        step[0] = U64(1)
        with np.errstate(over="ignore"):
            have = np.cumprod(step, dtype=U64)
        if n <= 2 * PASS_BYTES:
            _TABLES[name] = have
    return have


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    return _table("up", _BASE, n)[:n]


def _inverse_powers(n: int) -> np.ndarray:
    return _table("down", pow(_BASE, -1, 1 << 64), n)[:n]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every text's ``width``-word shingles; a text of fewer words
    (one at least) is one shingle, a text without words or null has none.

    The first byte tells a shingle's size, 255 less its bytes: those of many letters, which are rare, sort first."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, starts, sizes = word_hashes(raw)
    reach = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    with np.errstate(over="ignore"):
        if len(words) >= width:
            h = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                h = mix(h * _P + words[k: len(words) - width + 1 + k])
            h = _sized(h, reach[width:] - reach[: len(words) - width + 1])
        else:
            h = np.zeros(0, U64)
        for i in range(len(raw)):
            lo, hi = int(starts[i]), int(starts[i + 1])
            if hi - lo >= width:
                out.append(np.unique(h[lo: hi - width + 1]))
            elif hi > lo:
                one = U64(hi - lo)
                for w in words[lo:hi]:
                    one = mix(np.array([one * _P + w], dtype=U64))[0]
                out.append(_sized(np.array([one], dtype=U64), reach[hi: hi + 1] - reach[lo: lo + 1]))
            else:
                out.append(np.zeros(0, U64))
    return out


def _sized(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    return h >> U64(8) | (U64(255) - np.minimum(size, 255).astype(U64)) << U64(56)


def char_shingles(text: str, width: int) -> np.ndarray:
    """Hashes of the ``width``-character shingles in order (a shorter text is one shingle)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    if not len(code):
        return np.zeros(0, U64)
    w = min(width, len(code))
    with np.errstate(over="ignore"):
        h = code[: len(code) - w + 1].copy()
        for k in range(1, w):
            h = h * _P + code[k: len(code) - w + 1 + k]
        return mix(h + U64(w))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def give_back() -> None:
    """Freed memory goes back to the system: a worker process serves many tasks, of different operators,
    and lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def streamed(fn: Callable) -> Callable:
    """A function over a task's batches that gives freed memory back when the task ends."""
    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch], *args, **named) -> Iterator[pa.RecordBatch]:
        yield from fn(batches, *args, **named)
        give_back()
    return run
