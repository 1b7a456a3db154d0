"""Fuzzy line deduplication by MinHash.

Lines of all texts are compared by their character shingles, lower-cased and trimmed.  Lines
that are equal then are one class (by a 64-bit hash), whatever their number.  One hash per
shingle fills ``BANDS * ROWS`` bins (one-permutation MinHash); bins that stay empty copy a
pseudo-random filled one.  ``BANDS`` keys of ``ROWS`` bins each find a pair of similarity 0.8
with probability 0.99 and of 0.9 with 0.9999.  Classes that share a key are paired with the
key's smallest class first; each pair is verified by its exact Jaccard similarity; those that
fail elect leaders among themselves, key by key.  Then distributed union-find makes components, and
members of a key that are in different ones are all compared, so every pair that shares a key is
verified or connected already.  Of each component the line of the smallest (doc_id, line number) stays.

Results.  Every input row comes back once with all its columns, its text being the lines kept,
joined by newlines as before.  Lines of fewer than ``min_words`` words always stay; the registered query
and the pipeline set it to 1 (``EVERY``), so that every line that is not blank takes part, however short and
in whatever script.  Null texts stay null and empty ones empty; rows with a null id are neither
changed nor compared.  Rows that repeat an id and text are treated alike: lines are owned by
(doc_id, line number), so both keep the lines they own.  Columns of the input named like the
operator's own are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import U64, bounded, char_shingles, cut, mix, overlap, prepare, streamed
from lakeloom.llm.linking import RUN, components, verified

WIDTH, MIN_WORDS, EVERY = 9, 5, 1
BANDS, ROWS = 12, 5
#: Similarity, as num/den, from which two lines are the same.
NUM, DEN = 8, 10
#: Line classes that one scan task remembers, so that repeated lines are signed once.
REMEMBERED = 100_000
#: Characters of lines that a part of a key holds, and bits of a line's bitmap.
PART, BITS = 1 << 18, 1024
#: Characters that one vectorised pass takes.
PASS, MASK = 60_000, (1 << 64) - 1
#: The bin that an empty one tries, by attempt.
TRIES = (mix(np.arange(BANDS * ROWS, dtype=U64) * U64(1009) + np.arange(1, 200, dtype=U64)[:, None]) % U64(BANDS * ROWS)).astype(np.int64)


def normal(line: str) -> str:
    return line.strip().lower()


def class_of(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _passes(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``lines`` of fewer than PASS characters (a longer line is one of its own), whose arrays stay in a core's cache."""
    lo, size = 0, 0
    for i, x in enumerate(lines):
        if i > lo and size + len(x) >= PASS:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if lo < len(lines):
        yield lo, len(lines)


def _windows(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polynomial over ``width`` characters from each place on, places that begin a shingle, first place and length of every line).

    A line's last ``width`` - 1 places reach into the next line; a line has one shingle at least."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    n = np.array([len(x) for x in lines], dtype=np.int64)
    end = np.cumsum(n)
    start = end - n
    h, size, power = code.copy(), 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for bit in bin(width)[3:]:                                         # by doubling, then one more where the bit is set
            h[:-size] = h[:-size] * U64(power) + h[size:]
            size, power = 2 * size, power * power & MASK
            if bit == "1":
                h[:-size] = h[:-size] * U64(0x9E3779B97F4A7C15) + code[size:]
                size, power = size + 1, power * 0x9E3779B97F4A7C15 & MASK
    keep = np.ones(len(code), dtype=bool)
    for k in range(1, width):
        at = end - k
        keep[at[at > start]] = False
    return h, keep, start, n


def signatures(lines: list[str], width: int = WIDTH) -> np.ndarray:
    """(len(lines), BANDS) band keys of non-empty lines."""
    bins = BANDS * ROWS
    out = np.empty((len(lines), BANDS), dtype=np.int64)
    for lo, hi in _passes(lines):
        h, keep, start, n = _windows(lines[lo:hi], width)
        for i in np.flatnonzero(n < width):
            h[start[i]] = char_shingles(lines[lo + i], width)[0]
        h = mix(h[keep])
        at = np.repeat(np.arange(hi - lo) * bins, np.maximum(n - width, 0) + 1)
        at += ((h >> U64(40)) * U64(bins) >> U64(24)).view(np.int64)
        h &= U64((1 << 40) - 1)
        top = np.full((hi - lo) * bins, np.iinfo(np.uint64).max, dtype=U64)
        np.minimum.at(top, at, h)
        out[lo:hi] = _keys(_densify(top.reshape(-1, bins)))
    return out


def _densify(top: np.ndarray) -> np.ndarray:
    """Empty bins take the value of a pseudo-random bin, tried in an order fixed by bin and attempt."""
    none = U64(np.iinfo(np.uint64).max)
    full = top.copy()
    r, c = np.nonzero(top == none)
    for other in TRIES:
        if not len(r):
            break
        found = top[r, other[c]]
        full[r, c] = found
        left = found == none
        r, c = r[left], c[left]
    return full


def _keys(top: np.ndarray) -> np.ndarray:
    rows = top.reshape(len(top), BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(1), rows.shape[:2]).copy()
        for k in range(ROWS):
            h = mix(h * U64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return h.view(np.int64)


@streamed
def _scan(batches: Iterator[pa.RecordBatch], width: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """A row per line of ``min_words`` words or more; ``keys`` where this task has not signed its class yet."""
    seen: set[int] = set()
    for batch in batches:
        ids, at, cids, fresh, todo = [], [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, raw in enumerate(t.split("\n")):
                line = normal(raw)
                if len(line.split(None, min_words - 1)) < min_words:
                    continue
                c = class_of(line)
                ids.append(i)
                at.append(k)
                cids.append(c)
                new = c not in seen
                fresh.append(new)
                if new:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(c)
                    todo.append(line)
        if not ids:
            continue
        keys = signatures(todo, width)
        size = np.where(fresh, BANDS, 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)), mask=pa.array(~np.array(fresh)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(cids, pa.int64()), lists],
                                         ["doc", "line", "cid", "keys"])


def _alike(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    same = overlap(s, t)
    return same * den >= (len(s) + len(t) - same) * num


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BITS / 64): a bit per element's hash.  Bits that differ are elements not shared."""
    out = np.zeros((len(sets), BITS // 64), dtype=U64)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (np.concatenate(sets) if sets else np.zeros(0, U64)) >> U64(64 - BITS.bit_length() + 1)
    np.bitwise_or.at(out, (at, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return out


class _Held:
    """Sets at hand, with bitmaps and sizes that bound an intersection before it is counted, and their components' roots."""

    def __init__(self) -> None:
        self.ids, self.sets = [], []
        self.maps, self.sizes, self.roots = np.zeros((16, BITS // 64), dtype=U64), np.zeros(16, np.int64), np.zeros(16, np.int64)

    def add(self, cid: int, s: np.ndarray, bits: np.ndarray, root: int = 0) -> None:
        n = len(self.ids)
        if n == len(self.sizes):
            self.maps, self.sizes, self.roots = (np.concatenate([x, np.zeros_like(x)]) for x in (self.maps, self.sizes, self.roots))
        self.maps[n], self.sizes[n], self.roots[n] = bits, len(s), root
        self.ids.append(cid)
        self.sets.append(s.copy())                                         # not a view of a whole batch's sets

    def near(self, s: np.ndarray, bits: np.ndarray, num: int, den: int, root: int | None = None) -> np.ndarray:
        """Places of the sets, of other roots than ``root``, that the bounds leave."""
        n = len(self.ids)
        # |A and B| <= (|A| + |B| - apart) / 2 must reach num / (num + den) of |A| + |B|; sizes and roots leave few bitmaps to look at
        total = self.sizes[:n] + len(s)
        fits = (total - np.abs(self.sizes[:n] - len(s))) * (num + den) >= total * 2 * num
        at = np.flatnonzero(fits if root is None else fits & (self.roots[:n] != root))
        if not len(at):
            return at
        apart = np.bitwise_count(self.maps[at] ^ bits).sum(axis=1, dtype=np.int64)
        return at[(total[at] - apart) * (num + den) >= total[at] * 2 * num]

    def alike(self, s: np.ndarray, bits: np.ndarray, num: int, den: int) -> list[int]:
        return [self.ids[x] for x in self.near(s, bits, num, den) if _alike(s, self.sets[x], num, den)]


def _elect(members: DataFrame, lines: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the members of each key: a member joins the leaders it is like, or leads itself.

    A key's members are dealt to runs of about RUN members, each with leaders of its own; the
    leaders of a key's several runs are then compared run against run.  A task holds the sets of
    one run, so a key of any size spreads over tasks, and near copies of each other leave one leader a run."""
    runs = members.groupBy("key").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    dealt = members.join(runs, "key").withColumn("run", F.pmod(F.xxhash64("cid"), F.col("runs")).cast("int"))
    rows = dealt.join(lines, dealt["cid"] == lines["id"]).select("key", "run", "runs", "cid", "text")
    rows = rows.repartition("key", "run").sortWithinPartitions("key", "run", "cid")

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, _Held()
        for batch in batches:
            out = [[], [], []]
            key, part, several, cid, text = (batch.column(i).to_pylist() for i in range(5))
            sets = _sets(width, text)
            for i, (s, bits) in enumerate(zip(sets, _bitmaps(sets))):
                if (key[i], part[i]) != at:
                    at, leaders = (key[i], part[i]), _Held()
                found = leaders.alike(s, bits, num, den)
                if not found:
                    leaders.add(cid[i], s, bits)
                for other in found or ([None] if several[i] > 1 else []):
                    for column, x in zip(out, (key[i], other, cid[i])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "a", "b"])

    # a row without a is the leader of one of several runs
    found = cut(rows.mapInArrow(elect, "key long, a long, b long"))
    links = found.where("a is not null").select("a", "b")
    heads = found.where("a is null").select("key", F.col("b").alias("cid"))
    if not heads.limit(1).count():
        return links
    parts = heads.groupBy("key").agg(F.ceil(F.count("*") / RUN).cast("int").alias("parts"))
    heads = heads.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int"))
    heads = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid")
    rows = heads.join(lines, heads["cid"] == lines["id"]).select("key", "i", "j", "part", "cid", "text")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Held()
        for batch in batches:
            out = [[], []]
            key, i, j, part, cid, text = (batch.column(k).to_pylist() for k in range(6))
            sets = _sets(width, text)
            for k, (s, bits) in enumerate(zip(sets, _bitmaps(sets))):
                if (key[k], i[k], j[k]) != at:
                    at, held = (key[k], i[k], j[k]), _Held()
                if part[k] == j[k]:
                    for other in held.alike(s, bits, num, den):
                        out[0].append(other)
                        out[1].append(cid[k])
                if part[k] == i[k]:
                    held.add(cid[k], s, bits)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return links.union(rows.mapInArrow(compare, "a long, b long"))


def _across(members: DataFrame, lines: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the members (key, cid, root) of each key that have different roots: pairs of
    one root are connected already, every other pair is compared.

    A key's members are dealt to parts of about PART characters and parts are compared two by two, so
    a key of any size spreads over tasks.  Sizes and bitmaps bound each pair's intersection before its
    sets are compared, and a task forgets pairs whose roots it has linked itself."""
    rows = members.join(lines, members["cid"] == lines["id"]).select("key", "root", "cid", "text")
    rows = cut(rows)
    parts = rows.groupBy("key").agg(F.ceil(F.sum(F.length("text")) / PART).cast("int").alias("parts"))
    rows = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "cid", "text")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, up, held = None, {}, _Held()

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for batch in batches:
            out = [[], []]
            key, i, j, part, root, cid, text = (batch.column(k).to_pylist() for k in range(7))
            sets = _sets(width, text)
            for k, (s, bits) in enumerate(zip(sets, _bitmaps(sets))):
                if (key[k], i[k], j[k]) != at:
                    at, up, held = (key[k], i[k], j[k]), {}, _Held()
                if part[k] == j[k]:
                    for x in held.near(s, bits, num, den, root[k]):
                        a, b = find(int(held.roots[x])), find(root[k])
                        if a != b and _alike(s, held.sets[x], num, den):
                            up[a] = b
                            out[0].append(held.ids[x])
                            out[1].append(cid[k])
                if part[k] == i[k]:
                    held.add(cid[k], s, bits, root[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _lines_of(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id = class, text = line) of the classes in ``pairs``, read again from their owners' texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    owners = cut(classes.join(bounded(ids.select(F.col("id").alias("cid"))), "cid", "left_semi").select("cid", "owner.doc", "owner.line"))
    per_doc = owners.groupBy("doc").agg(F.collect_set("line").alias("lines"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, found = [], []
            for t, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have = t.split("\n")
                for k in want:
                    if k < len(have):
                        found.append(normal(have[k]))
                        cids.append(class_of(found[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(found, pa.string())], ["id", "text"])

    rows = texts.join(bounded(per_doc), "doc").select("text", "lines").mapInArrow(pick, "id long, text string")
    return rows.join(bounded(owners.select(F.col("cid").alias("id"))), "id", "left_semi").dropDuplicates(["id"])


def _sets(width: int, lines: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every line, as ``char_shingles`` has them; hashed for many lines in one pass."""
    lines = [x or "" for x in lines]
    return [s for lo, hi in _passes(lines) for s in _sets_of(lines[lo:hi], width)]


def _sets_of(lines: list[str], width: int) -> list[np.ndarray]:
    h, keep, start, n = _windows(lines, width)
    with np.errstate(over="ignore"):
        h = mix(h + U64(width))
    for i in np.flatnonzero((n > 0) & (n < width)):
        h[start[i]] = char_shingles(lines[i], width)[0]
    h = h[keep]
    count = np.where(n > 0, np.maximum(n - width, 0) + 1, 0)
    edge = np.concatenate([[0], np.cumsum(count)])
    line = np.repeat(np.arange(len(lines)), count)
    for a, b in zip(edge[:-1], edge[1:]):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    edge = np.concatenate([[0], np.cumsum(new)])[edge]
    h = h[new]
    return [h[a:b] for a, b in zip(edge[:-1], edge[1:])]


def _missed(lines: DataFrame, led: DataFrame, alone: DataFrame, links: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links of members that share a key and that ``links`` leave in different components.

    Of a key only the members beside its lead (``led``) count: each was compared with the lead.  A key
    none of whose members failed that comparison (``alone``) is one component."""
    roots = components(links).toDF("cid", "root")
    members = led.select("key", "cid").join(alone.select("key").distinct(), "key", "left_semi").join(roots, "cid", "left")
    members = members.select("key", "cid", F.coalesce("root", "cid").alias("root"))
    several = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = cut(members.join(several, "key"))
    if not members.limit(1).count():
        return links.limit(0)
    return cut(_across(members, lines, width, num, den))


def _led(lines: DataFrame) -> DataFrame:
    """(key, lead, cid) of every class beside the lead, the smallest, of a key; a class signed by several tasks counts once."""
    keyed = lines.where("keys is not null").select("cid", F.explode("keys").alias("key"))
    led = keyed.withColumn("lead", F.min("cid").over(Window.partitionBy("key"))).where("cid <> lead")
    return cut(led.select("key", "lead", "cid").distinct())


def _led_links(texts: DataFrame, classes: DataFrame, led: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect all alike classes that share a key; ``led``: (key, lead, cid) of all but the leads."""
    pairs = cut(led.select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct())
    lines = cut(_lines_of(texts, classes, pairs))                          # for every step below: the texts are read once
    tested = cut(verified(pairs, lines, partial(_sets, width)))
    links = tested.where(F.col("inter") * den >= (F.col("na") + F.col("nb") - F.col("inter")) * num).select("a", "b")
    # those that failed elect leaders among themselves, key by key, in one stream
    alone = cut(led.join(links.toDF("lead", "cid"), ["lead", "cid"], "left_anti").select("key", "cid"))
    left = cut(alone.join(alone.groupBy("key").count().where("count > 1").select("key"), "key"))
    if left.limit(1).count():
        links = links.union(_elect(left, lines, width, num, den))
    links = cut(links)
    return links.union(_missed(lines, led, alone, links, width, num, den))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc, lines): per id, the numbers (from 0) of the lines that a kept line elsewhere stands for."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    lines = cut(texts.mapInArrow(partial(_scan, width=width, min_words=min_words), "doc long, line int, cid long, keys array<long>"))
    classes = cut(lines.groupBy("cid").agg(F.min(F.struct("doc", "line")).alias("owner"), F.count("*").alias("n")))

    links = _led_links(texts, classes, _led(lines), width, num, den)
    roots = components(links)

    kept = classes.where("n > 1").select("cid", F.col("owner").alias("keep"))
    named = roots.join(classes, roots["id"] == classes["cid"]).select("id", "root", "owner")
    best = named.groupBy("root").agg(F.min("owner").alias("best"))
    named = named.join(best, "root").select(F.col("id").alias("cid"), "best")
    kept = kept.join(named, "cid", "full").select("cid", F.coalesce("best", "keep").alias("keep"))
    gone = lines.select("doc", "line", "cid").join(kept, "cid").where(F.struct("doc", "line") != F.col("keep"))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, params: dict) -> DataFrame:
    """``docs`` with its texts' kept lines, ``__before`` and ``__kept``."""
    gone = cut(repeated_lines(docs, id_col=id_col, text_col=text_col, **params)).toDF("__doc", "__gone")
    whole = F.col(text_col).cast("string")
    parts = F.split(whole, "\n", -1)
    # a column of its own, so that a text's lines are counted once, not wherever their number stands
    rows = docs.join(bounded(gone), F.col(id_col).cast("long") == F.col("__doc"), "left")
    rows = rows.select("*", F.when(whole.isNull(), F.lit(0)).otherwise(F.size(parts)).alias("__before"))
    left = F.filter(parts, lambda _, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    size = F.col("__before")
    # numbers of lines are distinct and sorted; those of another row of the same id may lie beyond this text
    own = F.when(F.try_element_at("__gone", F.lit(-1)) < size, F.size("__gone")).otherwise(F.size(F.array_intersect("__gone", F.sequence(F.lit(0), size - 1))))
    kept = F.when(F.col("__gone").isNull() | whole.isNull(), size).otherwise(size - own)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], size.cast("long").alias("__before"), kept.cast("long").alias("__kept"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, n_lines, n_kept, text) of every row, the text being its kept lines."""
    return _deduped(docs, id_col, text_col, params).select(F.col(id_col).alias("doc_id"), F.col("__before").alias("n_lines"), F.col("__kept").alias("n_kept"), F.col(text_col).alias("text"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs``, same columns, without repeated lines; documents that lost lines and have none but
    blank ones left were copies and go."""
    rows = _deduped(docs, id_col, text_col, params)
    return rows.where((F.col("__kept") == F.col("__before")) | F.col(text_col).rlike(r"\S")).select(*docs.columns)
