"""Packing token sequences by cutting stock with column generation.

Every text is tokenised once, in the scan; a document is cut into full pieces of ``SIZE`` ids
and a rest.  Lengths are rounded up to units of ``UNIT`` ids, so the length histogram has at
most SIZE/UNIT classes however large the corpus: it alone goes to the driver.  There a linear
program over patterns (how many pieces of each class share a sequence) is solved by column
generation: a revised simplex on the patterns known, and an unbounded-knapsack dynamic program
that prices the best new one.  Whole multiples of the optimal patterns are kept, what rounding
leaves (a bounded number of pieces) is placed first-fit decreasing.  Pieces are then ranked
within their class, in order of doc_id, by Spark, and the rank picks pattern, copy and slot.

Results.  One row per piece.  A null or empty text is one piece with only the end id.  Rows that
repeat a doc_id are packed each on its own.  Sequences are gapless from offset 0 and hold SIZE
ids at most; what lacks to SIZE is padding, unless the length is a power of two.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, prepare, streamed
from lakeloom.operators.scan import grouped_rank

SIZE, UNIT, END_ID = 2048, 16, 1
#: Word pieces whose ids a task remembers.
REMEMBERED = 100_000

# how byte-level BPE splits a text before merging (a fixed pattern of that vocabulary)
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same split by the faster standard module, for texts of Latin letters and plain ASCII only.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes; equal pieces are merged once.

    The file is a byte-level BPE of the ``tokenizers`` library.  Its vocabulary lists tokens in the
    order of their merges, so its ids are merge ranks; the pieces are merged by tiktoken's
    routine, which takes half the time of ``tokenizers`` and gives the same ids (tested)."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd:
            raise ValueError(f"added tokens that take in or look at what is beside them: {odd}")
        self.special = {t: struct.pack("<I", i) for t, i in special.items()}
        # the leftmost match, of those the longest
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        byte = _byte_letters()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("pieces", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """Ids as the file's tokenizer gives them as loaded: its added tokens within a text are one id each."""
        if not self.split:
            return self.encode(texts)
        out = []
        for t, plain in zip(texts, self.encode([t if not self.split.search(t) else "" for t in texts])):
            parts = self.split.split(t)
            if len(parts) > 1:
                between = self.encode(parts[0::2])
                plain = b"".join([between[0], *(self.special[x] + b for x, b in zip(parts[1::2], between[1:]))])
            out.append(plain)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts' ordinary pieces: added tokens are text like any other."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, merge, out = self.known, self.merge, []
        for t in texts:
            pieces = (PATTERN if NOT_LATIN.search(t) else LATIN).findall(t)
            for p in set(pieces).difference(known):
                ids = merge(p.encode("utf-8", "replace"))
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(b"".join([known[p] for p in pieces]))
        return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such a file: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and its memory of pieces, per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@streamed
def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for lo in range(0, len(ids), 64):
            for doc, b in zip(ids[lo: lo + 64], enc.encode_whole(texts[lo: lo + 64])):
                b += end
                for at in range(0, len(b), 4 * size):
                    piece = b[at: at + 4 * size]
                    for col, x in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(b) // 4)):
                        col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable counts of classes 1..len(value) within ``room`` units."""
    best, pick = np.zeros(room + 1), np.zeros(room + 1, dtype=int)
    for r in range(1, room + 1):
        n = min(r, len(value))
        gain = value[:n] + best[r - 1: r - 1 - n if r > n else None: -1]
        k = int(np.argmax(gain))
        best[r], pick[r] = (gain[k], k + 1) if gain[k] > best[r - 1] else (best[r - 1], 0)
    counts, r = np.zeros(len(value), dtype=int), room
    while r:
        if pick[r]:
            counts[pick[r] - 1] += 1
            r -= pick[r]
        else:
            r -= 1
    return float(best[room]), counts


def cutting_stock(demand: np.ndarray, room: int, rounds: int = 3000, gap: float = 2e-3) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): counts of classes 1..room whose sum over all patterns is ``demand``.

    ``demand[c-1]`` pieces of c units each; a pattern takes ``room`` units at most.  The linear program
    stops when the best new pattern's worth proves it within ``gap`` of the least number of sequences."""
    classes = np.flatnonzero(demand > 0)
    if not len(classes):
        return []
    m, d = len(classes), demand[classes].astype(float)
    value = np.zeros(room)
    pats = np.zeros((m, m))
    pats[np.arange(m), np.arange(m)] = room // (classes + 1)           # column j: pattern j
    inv = np.diag(1.0 / np.diag(pats))
    x = inv @ d
    for i in range(rounds):
        y = inv.sum(axis=0)                                            # duals: every pattern costs 1
        value[:] = 0
        value[classes] = np.maximum(y, 0)
        worth, counts = best_pattern(value, room)
        if worth <= 1 + gap:                                           # Farley's bound: optimum >= x.sum() / worth
            break
        col = counts[classes].astype(float)
        step = np.einsum("ij,j->i", inv, col)                        # small: no threaded BLAS
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        r = int(np.argmin(ratio))
        inv[r] /= step[r]
        step[r] = 0
        inv -= np.outer(step, inv[r])
        pats[:, r] = col
        if i % 200 == 199:
            inv = _inverse(pats)
        x = np.maximum(np.einsum("ij,j->i", inv, d), 0)
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        p = np.zeros(room, dtype=int)
        p[classes] = np.round(pats[:, j]).astype(int)
        used = p > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[used] // p[used]).min())) if used.any() else 0
        if times:
            out.append((p, times))
            left -= times * p
    return out + _first_fit(left, room)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with pivoting: against drift, without the threads of a linear-algebra library."""
    n = len(a)
    w = np.hstack([a, np.eye(n)])
    for i in range(n):
        j = i + int(np.argmax(np.abs(w[i:, i])))
        w[[i, j]] = w[[j, i]]
        w[i] /= w[i, i]
        f = w[:, i].copy()
        f[i] = 0
        w -= np.outer(f, w[i])
    return w[:, n:]


def _first_fit(left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Place what is left, longest first; equal fillings are one pattern taken many times."""
    left, out = left.copy(), []
    while left.any():
        p, r = np.zeros(room, dtype=int), room
        for c in range(room, 0, -1):
            n = int(min(left[c - 1], r // c))
            p[c - 1], r = n, r - n * c
        used = p > 0
        times = int((left[used] // p[used]).min())
        out.append((p, times))
        left -= times * p
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         size: int = SIZE, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    prepare(spark)
    room = size // unit
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(partial(_pieces, path=tokenizer or default_tokenizer(), size=size, end_id=end_id),
                                 "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    pieces = pieces.withColumn("cls", F.ceil(F.col("length") / unit).cast("int"))
    demand = np.zeros(room, dtype=np.int64)
    for r in pieces.groupBy("cls").count().collect():                  # at most size/unit rows
        demand[r["cls"] - 1] = r["count"]

    slots, taken, base = [], np.zeros(room, dtype=np.int64), 0
    for p, times in cutting_stock(demand, room):
        pos = 0
        for c in np.flatnonzero(p)[::-1]:
            n = int(p[c])
            slots.append((int(c) + 1, int(taken[c]), int(taken[c]) + n * times, n, base, pos))
            taken[c] += n * times
            pos += n
        base += times
    table = spark.createDataFrame(slots, "cls int, lo long, hi long, n long, base long, pos long")
    ranked = grouped_rank(pieces, ["cls"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "rank")
    # the slots are bounded by the classes: at most size/unit patterns and what rounding leaves
    placed = ranked.join(F.broadcast(table), "cls").where("rank > lo and rank <= hi").withColumn("i", F.col("rank") - 1 - F.col("lo"))
    placed = placed.withColumn("sequence_id", (F.col("base") + F.floor(F.col("i") / F.col("n"))).cast("long")).withColumn(
        "slot", F.col("pos") + F.col("i") % F.col("n"))
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
