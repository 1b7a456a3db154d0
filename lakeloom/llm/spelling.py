"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted in the scan and summed by Spark; the vocabulary is every word of at least ``MIN_LENGTH`` code
points and ``LEAST`` occurrences.  Two words are near if one inserted, deleted or replaced code point parts
them.  Each word generates half of its edits, all deletions and the replacements by a later letter of
the vocabulary's alphabet: every near pair is generated once, by its longer or its earlier word.

An edit's hash follows from its word's polynomial hash in O(1), so edits are probed before any is written
out.  The probe is a blocked Bloom filter (blocks of 512 bits, ``BITS`` bits a word, ``PROBES`` bits set), in
shards by length: a word's length picks the filter, its hash the block.  Filters are built on the executors,
a shard of ``SHARD`` blocks in one task's hands at a time, and broadcast in rounds of at most ``ROUND`` bytes:
a vocabulary of more takes more rounds, each over all words, so what is broadcast stays bounded and nothing is
left out.  Only edits that the filter takes are written and shuffled to the exact vocabulary join,
which drops its false positives.  A word's form is its near word of most occurrences if these are ``TIMES`` times its
own; roots come from pointer jumping along forms, whose counts at least double at each step, so chains are short.

Results.  One row per word of the vocabulary.  Null texts have no words; a null id counts as an empty
one in the deletion rule.  Repeated rows count each.  Ties between forms go to the smaller word in code-point order.
Other columns of the input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import U64, cut, mix, prepare, streamed

MIN_LENGTH, LEAST, TIMES, ONE_IN = 5, 3, 2, 97
#: Bits a word in a filter, bits set for each, blocks (of 64 bytes) of a shard, and bytes that one round broadcasts.
BITS, PROBES, SHARD, ROUND = 16, 8, 1 << 14, 32 << 20
#: Words of more code points share one filter.
LONG = 64
#: Words that a scan task counts before it hands them on, and edits that one vectorised pass probes.
HELD, PASS = 200_000, 1 << 19

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 and lower-cased: the latter all begin with the byte C3.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = U64(0x9E3779B97F4A7C15)
BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@streamed
def _count(batches: Iterator[pa.RecordBatch], least_length: int, one_in: int) -> Iterator[pa.RecordBatch]:
    """(word, n): a run whose crc32 of "<id>:<run>" ``one_in`` divides has lost one code point."""
    total: Counter = Counter()

    def told() -> pa.RecordBatch:
        words = [w for w in total if len(w) >= least_length and len(w.decode()) >= least_length]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
            for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
                h = zlib.crc32(run, start)
                if h % one_in == 0:
                    w = run.decode()
                    i = h % len(w)
                    run = (w[:i] + w[i + 1:]).encode()
                total[run] += n
            if len(total) > HELD:
                yield told()
    if total:
        yield told()


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U64)


def codes(words: list[str]) -> np.ndarray:
    """(words, code points) of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def hashes(letters: np.ndarray) -> np.ndarray:
    """Polynomial hashes of rows of code points: sum of c_i * BASE^i."""
    with np.errstate(over="ignore"):
        return (letters.astype(U64) * _powers(letters.shape[1])[None, :]).sum(axis=1, dtype=U64)


def blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block, of so many, of mixed hashes."""
    return ((h >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)


def bit_of(h: np.ndarray, k: int) -> np.ndarray:
    """The place of the ``k``-th bit in the block."""
    if k < 3:
        return (h >> U64(9 * k)) & U64(511)
    return (mix(h ^ BASE) >> U64(9 * (k - 3))) & U64(511)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


@streamed
def _placed(batches: Iterator[pa.RecordBatch], blocks: dict[int, int], first: dict[int, int], per_shard: int) -> Iterator[pa.RecordBatch]:
    """(shard, mixed hash) of every word."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        shard, mixed = np.zeros(len(words), np.int64), np.zeros(len(words), U64)
        for n, at in _by_length(words).items():
            kind = min(n, LONG)
            mixed[at] = mix(hashes(codes([words[i] for i in at])))
            shard[at] = first[kind] + blocks_of(mixed[at], blocks[kind]) // per_shard
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(mixed.view(np.int64))], ["shard", "h"])


@streamed
def _filters(batches: Iterator[pa.RecordBatch], blocks: dict[int, int], first: dict[int, int], per_shard: int) -> Iterator[pa.RecordBatch]:
    """(shard, bits) of rows sorted by shard."""
    kinds = sorted(first, key=first.get)
    starts = np.array([first[k] for k in kinds])
    at, bits = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["shard", "bits"])

    for batch in batches:
        shards = batch.column(0).to_numpy()
        h = batch.column(1).to_numpy().view(U64)
        for s in np.unique(shards).tolist():
            if s != at:
                if at is not None:
                    yield told()
                kind = kinds[int(np.searchsorted(starts, s, side="right")) - 1]
                at, lo = s, (s - first[kind]) * per_shard
                bits = np.zeros(min(per_shard, blocks[kind] - lo) * 8, dtype=U64)
            own = h[shards == s]
            word = (blocks_of(own, blocks[kind]) - lo) * 8
            for k in range(PROBES):
                b = bit_of(own, k)
                np.bitwise_or.at(bits, word + (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
    if at is not None:
        yield told()


class Bloom:
    """The filters of one round: of each length a range of blocks."""

    def __init__(self, blocks: dict[int, int], held: dict[int, tuple[int, np.ndarray]]):
        self.blocks, self.held = blocks, held

    def probe(self, length: int, h: np.ndarray) -> np.ndarray:
        """Indexes of the polynomial hashes that words of ``length`` may have."""
        kind = min(length, LONG)
        if kind not in self.held:
            return np.zeros(0, np.int64)
        lo, bits = self.held[kind]
        h = mix(h)
        word = (blocks_of(h, self.blocks[kind]) - lo) * 8
        at = np.flatnonzero((word >= 0) & (word < len(bits)))
        h, word = h[at], word[at]
        for k in range(PROBES):
            b = bit_of(h, k)
            hit = np.flatnonzero((bits[word + (b >> U64(6)).astype(np.int64)] >> (b & U64(63))) & U64(1))
            at, h, word = at[hit], h[hit], word[hit]
        return at


def _edits(words: list[str], alphabet: np.ndarray, bloom: Bloom) -> Iterator[tuple[int, int, int]]:
    """(word, place, letter or -1) of the edits of words of one length that the filters take."""
    letters = codes(words)
    m, n = letters.shape
    power = _powers(n)
    with np.errstate(over="ignore"):
        parts = letters.astype(U64) * power[None, :]
        whole = parts.sum(axis=1, dtype=U64)
        # without letter i: those before keep their powers, those after move down by one
        before = np.cumsum(parts, axis=1, dtype=U64) - parts
        gone = before + (whole[:, None] - before - parts) * BACK
        new = np.ones((m, n), dtype=bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]                    # of equal neighbours one deletion
        if n > 1:
            w, i = np.nonzero(new)
            for x in bloom.probe(n - 1, gone[w, i]).tolist():
                yield int(w[x]), int(i[x]), -1
        step = max(1, PASS // max(1, m * len(alphabet)))
        for lo in range(0, n, step):
            some = letters[:, lo: lo + step]
            w, i, a = np.nonzero(alphabet[None, None, :] > some[:, :, None])
            h = whole[w] + (alphabet[a] - some[w, i]).astype(U64) * power[lo + i]
            for x in bloom.probe(n, h).tolist():
                yield int(w[x]), lo + int(i[x]), int(alphabet[a[x]])


@streamed
def _probe(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray, bloom) -> Iterator[pa.RecordBatch]:
    """(near, word, n) of the edits that the filters take."""
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[], [], []]
        size = 0
        for n, at in _by_length(words).items():
            step = max(1, PASS // (n * max(1, len(alphabet))))
            for lo in range(0, len(at), step):
                own = at[lo: lo + step]
                for w, i, a in _edits([words[k] for k in own], alphabet, bloom.value):
                    word = words[own[w]]
                    for column, x in zip(out, (word[:i] + (chr(a) if a >= 0 else "") + word[i + 1:], word, counts[own[w]])):
                        column.append(x)
                    size += 2 * n
                    if size > 4_000_000:
                        yield _triples(out)
                        out, size = [[], [], []], 0
        yield _triples(out)


def _triples(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["near", "word", "n"])


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of the vocabulary."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(partial(_count, least_length=min_length, one_in=one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_pairs(words: DataFrame, round_bytes: int = ROUND, per_shard: int = SHARD) -> DataFrame:
    """(word, n, near, near_n) of every near pair of ``words`` (word, n; words distinct), once, either way round."""
    spark = words.sparkSession
    kind = F.least(F.char_length("word"), F.lit(LONG)).alias("kind")
    counts = {r.kind: r.c for r in words.groupBy(kind).agg(F.count("*").alias("c")).collect()}          # at most LONG rows
    blocks = {k: -(-c * BITS // 512) for k, c in counts.items()}
    first, shards = {}, 0
    for k in sorted(blocks):
        first[k] = shards
        shards += -(-blocks[k] // per_shard)
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("a")).where("a <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r.a) for r in letters), dtype=np.int64)                               # at most the code points of a run
    placed = words.select("word").mapInArrow(partial(_placed, blocks=blocks, first=first, per_shard=per_shard), "shard long, h long")
    filters = cut(placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(_filters, blocks=blocks, first=first, per_shard=per_shard), "shard long, bits binary"))
    found = None
    per_round = max(1, round_bytes // (per_shard * 64))
    for lo in range(0, shards, per_round):
        held: dict[int, tuple[int, np.ndarray]] = {}
        rows = sorted(filters.where(F.col("shard").between(lo, lo + per_round - 1)).collect(), key=lambda r: r.shard)    # round_bytes at most
        for k in sorted(first):
            # a shard that no word fell on has no row, but its blocks
            own = range(max(first[k], lo), min(first[k] + -(-blocks[k] // per_shard), lo + per_round))
            if len(own):
                start = (own[0] - first[k]) * per_shard
                bits = np.zeros((min((own[-1] + 1 - first[k]) * per_shard, blocks[k]) - start) * 8, dtype=U64)
                for r in rows:
                    if r.shard in own:
                        at = ((r.shard - first[k]) * per_shard - start) * 8
                        bits[at: at + len(r.bits) // 8] = np.frombuffer(r.bits, dtype=U64)
                held[k] = (start, bits)
        bloom = spark.sparkContext.broadcast(Bloom(blocks, held))
        edits = words.select("word", "n").mapInArrow(partial(_probe, alphabet=alphabet, bloom=bloom), "near string, word string, n long")
        pairs = cut(edits.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"))
        bloom.destroy()
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), following forms to the last."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = cut(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, *, times: int = TIMES, round_bytes: int = ROUND, per_shard: int = SHARD, **params) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    prepare(docs.sparkSession)
    words = cut(count_words(docs, **params))
    pairs = near_pairs(words, round_bytes, per_shard)
    both = pairs.select("word", "near", "near_n").union(pairs.select("near", "word", "n"))
    # most occurrences first, then the smaller word
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    led = -F.col("best.less") >= times * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"))
    rows = cut(rows)
    named = rows.join(roots(rows.where("form is not null")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
