"""Exact set-similarity join of documents on word n-grams, with answers as components.

Method.  A document is the set of its n-word shingles.  Sets that are equal become one class.
Any two sets with Jaccard similarity t or more share an element among the first
``n - ceil(t*n) + 1`` of each set in one common order, so only those prefixes are indexed:
an inverted list (element, class, set size, position).  In the common order shingles of many letters come
first (long words are rare ones), and elements that many documents share (a passage, a license) last, so lists stay short.

*Answers from a similar set's answers.*  Every class has one leader, the smallest class that any of its lists
holds, and is compared with it alone; the intersection is kept.  Linked classes are one component.  After that a list matters
only if it holds several components, and of it only pairs across them: a class that is linked to its leader has
its leader's answers, and links inside a component are never enumerated.  For two classes of one leader
the kept intersections bound theirs from both sides, |A & B| <= min(|A & L|, |B & L|) + min(|A - L|, |B - L|) and
|A & B| >= |A & L| + |B & L| - |L|, so many pairs are settled, linked or not, without either's text.
*Block skipping.*  A list is held in blocks by size of bitmap; only the same and neighbouring blocks can match, and
inside them sizes and positions (elements left after the shared one) skip most.  A bitmap of two bits
an element then bounds the intersection (bits that differ are elements not shared).

Lists of more than ``SMALL`` members are compared inside tasks, parts of ``PART`` members against each other, so pairs that are ruled out are
never rows.  Nor are all that aren't: a task hands on a spanning forest of its possible links, one row a member at most; what
is verified on whole texts and holds joins components, what fails is remembered, and the lists still open go another
round.  After ``ROUNDS`` of these all possible pairs left are handed on at once, so the result is exact and the rounds are few.
The pairs of shorter lists, at most ``SMALL`` rows a member, come from one join afterwards, each pair once however many lists it shares.

Results.  One row per input row (repeated rows included): its id, set size and the smallest id
reachable by links, itself included.  Null and word-less texts have empty sets and link with
nothing.  A null id stays null and is no component's name unless all its members are null.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import U64, bounded, cut, prepare, shingle_sets, streamed
from lakeloom.llm.linking import components, verified

#: Elements that may be put last in the common order (8 bytes each; only the order depends on it).
COMMON_MAX = 200_000
#: Documents that share an element before it counts as common, and rows a scan task looks at for it.
COMMON_FROM, LOCAL_FROM, LOCAL_ROWS = 64, 3, 60_000
#: Members of a part of a list, and rounds that hand on forests.
PART, ROUNDS, SMALL = 2048, 2, 12


def prefix_length(n: int, num: int, den: int) -> int:
    """Elements to index of a set of ``n`` at similarity num/den."""
    return n - -(-num * n // den) + 1


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


@streamed
def _scan(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(id, class, size, bitmap) per row; and, for the search of common elements, (null, null, count, null, element) rows."""
    seen: Counter = Counter()

    def common():
        top = [(k, c) for k, c in seen.items() if c >= LOCAL_FROM]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int64()), pa.nulls(len(top), pa.int64()), pa.array([c for _, c in top], pa.int64()),
                                           pa.nulls(len(top), pa.binary()),
                                           pa.array(np.array([k for k, _ in top], dtype=np.uint64).view(np.int64), pa.int64())], ["id", "cid", "n", "bits", "element"])

    for batch in batches:
        ids, cids, ns, bits = batch.column(0), [], [], []
        for s in shingle_sets(batch.column(1).to_pylist(), width):
            ns.append(len(s))
            cids.append(_class_of(s))
            bits.append(bitmap(s))
            if len(s):
                seen.update(s[: prefix_length(len(s), num, den)].tolist())
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cids, pa.int64()), pa.array(ns, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(ns), pa.int64())],
                                         ["id", "cid", "n", "bits", "element"])
        if len(seen) > LOCAL_ROWS:
            yield common()
    if seen:
        yield common()


@streamed
def _postings(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, common) -> Iterator[pa.RecordBatch]:
    """(element, cid, n, pos) of every class's prefix, common elements last."""
    late = common.value
    for batch in batches:
        parts = ([], [], [], [])
        for s in shingle_sets(batch.column(1).to_pylist(), width):
            if not len(s):
                continue
            cid = _class_of(s)
            p = prefix_length(len(s), num, den)
            if len(late):
                at = np.searchsorted(late, s)
                at[at == len(late)] = 0
                hit = late[at] == s
                s = np.concatenate([s[~hit], s[hit]])
            parts[0].append(s[:p].view(np.int64))
            parts[1].append(np.full(p, cid, np.int64))
            parts[2].append(np.full(p, len(s), np.int32))
            parts[3].append(np.arange(p, dtype=np.int32))
        if parts[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], ["element", "cid", "n", "pos"])


def _common(counts: DataFrame) -> np.ndarray:
    """Sorted elements of the greatest counts, about COMMON_MAX at most."""
    n = counts.count()
    if n > COMMON_MAX:
        least = counts.agg(F.percentile_approx("c", 1 - COMMON_MAX / n, 100_000)).first()[0]
        counts = counts.where(F.col("c") > least)
    found = counts.select("element").toArrow()["element"].to_numpy()
    return np.sort(found.astype(np.int64).view(U64))


def _needed(na, nb, num: int, den: int):
    """The least intersection of two sets of these sizes that links them."""
    return -(-num * (na + nb) // (num + den))


class Members:
    """Those members of a part that have bitmaps of one size."""

    def __init__(self, width: int):
        self.width, self.count = width, 0
        self.numbers = np.zeros((64, 6), dtype=np.int64)                   # cid, n, pos, root, leader, shared with it
        self.led = np.zeros(64, dtype=bool)
        self.maps = np.zeros((64, width), dtype=np.uint8)

    def add(self, numbers: tuple, led: bool, bits: np.ndarray) -> None:
        if self.count == len(self.led):
            self.numbers, self.led, self.maps = (np.concatenate([x, np.zeros_like(x)]) for x in (self.numbers, self.led, self.maps))
        self.numbers[self.count], self.led[self.count], self.maps[self.count] = numbers, led, bits
        self.count += 1

    def possible(self, numbers: tuple, led: bool, leader_n: int, bits: np.ndarray, tested: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(members that may be linked with the given one, whether they are for certain)."""
        cid, n, pos, root, leader, shared = numbers
        m = self.numbers[: self.count]
        need = _needed(m[:, 1], n, num, den)
        fine = (m[:, 3] != root) & (np.minimum(m[:, 1], n) * den >= np.maximum(m[:, 1], n) * num) & (np.minimum(m[:, 1] - m[:, 2], n - pos) >= need)
        at = np.flatnonzero(fine)
        if len(tested) and len(at):
            at = at[~np.isin(m[at, 0], tested)]
        if not len(at):
            return at, np.zeros(0, bool)
        sure = np.zeros(len(at), bool)
        if led:
            same = self.led[at] & (m[at, 4] == leader)
            most = np.minimum(m[at, 5], shared) + np.minimum(m[at, 1] - m[at, 5], n - shared)
            sure = same & (m[at, 5] + shared - leader_n >= need[at])
            keep = ~same | (most >= need[at])
            at, sure = at[keep], sure[keep]
        mine, own = self.maps[at], bits
        while mine.shape[1] > len(own):
            mine = mine[:, : mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2:]
        while len(own) > mine.shape[1]:
            own = own[: len(own) // 2] ^ own[len(own) // 2:]
        apart = np.bitwise_count(mine ^ own[None, :]).sum(axis=1, dtype=np.int64)
        keep = sure | ((m[at, 1] + n - apart) // 2 >= need[at])
        return at[keep], sure[keep]


@streamed
def _candidates(batches: Iterator[pa.RecordBatch], num: int, den: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, sure) of members of two parts of a list that may be linked; with ``forest`` none that others connect."""
    at, held, up = None, {}, {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        out: list[list] = [[], [], []]
        for element, i, j, part, cid, n, pos, root, leader, shared, leader_n, bits, tested in zip(*cols):
            if (element, i, j) != at:
                at, held, up = (element, i, j), {}, {}
            bits = np.frombuffer(bits, np.uint8)
            led = leader is not None
            numbers = (cid, n, pos, root, leader or 0, shared or 0)
            if part == j:
                tried = np.array(tested or [], dtype=np.int64)
                for members in held.values():
                    if not len(bits) <= 2 * members.width <= 4 * len(bits):
                        continue
                    for x, sure in zip(*members.possible(numbers, led, leader_n or 0, bits, tried, num, den)):
                        other = members.numbers[x]
                        if forest:
                            a, b = find(int(other[3])), find(root)
                            if a == b:
                                continue
                            up[max(a, b)] = min(a, b)
                        for col, v in zip(out, (int(other[0]), cid, bool(sure))):
                            col.append(v)
            if part == i:
                held.setdefault(len(bits), Members(len(bits))).add(numbers, led, bits)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "sure"])


def similar_documents(docs: DataFrame, *, width: int = 4, num: int = 85, den: int = 100,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: see the module text.  Links need
    ``den * |A & B| >= num * |A | B|``.  Columns of ``docs`` other than the two named are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = cut(texts.mapInArrow(partial(_scan, width=width, num=num, den=den), "id long, cid long, n long, bits binary, element long"))
    rows = scan.where("element is null").select("id", "cid", "n", "bits")
    common = spark.sparkContext.broadcast(_common(scan.where("element is not null").groupBy("element").agg(F.sum("n").alias("c")).where(F.col("c") >= COMMON_FROM)))

    # a class is indexed by the text of its first id; copies of it stay out of the lists
    classes = cut(rows.where("cid is not null").groupBy("cid").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    firsts = bounded(classes.select(F.col("first").alias("id")).distinct())
    bodies = texts.join(firsts, texts["id"].eqNullSafe(firsts["id"]), "left_semi")
    lists = cut(bodies.mapInArrow(partial(_postings, width=width, num=num, den=den, common=common), "element long, cid long, n int, pos int"))
    common.destroy()
    # element lists with one class say nothing
    heads = lists.groupBy("element").agg(F.min(F.struct("cid", "n", "pos")).alias("leader"), F.count("*").alias("members")).where("members > 1")
    led = cut(lists.join(heads, "element"))

    to_sets = partial(shingle_sets, width=width)
    linked = F.col("inter") * den >= (F.col("na") + F.col("nb") - F.col("inter")) * num
    alike = (F.least("n", "leader.n") * den >= F.greatest("n", "leader.n") * num)
    first = led.where((F.col("cid") != F.col("leader.cid")) & alike).groupBy("cid").agg(F.min("leader.cid").alias("a"))
    pairs = _not_ruled_out(first.select("a", F.col("cid").alias("b")), classes, num, den)
    kept = cut(verified(pairs, _texts_of(texts, classes, pairs, width), to_sets))
    links = kept.where(linked).select("a", "b")
    roots = components(links)

    tested = kept.where(~linked).select("a", "b")
    facts = kept.select(F.col("b").alias("cid"), F.col("a").alias("leader"), F.col("inter").alias("shared"), F.col("na").alias("leader_n"))
    lists = led.where(F.col("members") > SMALL).select("element", "cid", "n", "pos")
    for turn in range(ROUNDS + 1):
        # lists whose members are in several components
        now = lists.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        several = now.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("lo <> hi")
        open_ = cut(now.join(several.select("element", "parts"), "element"))
        if not open_.limit(1).count():
            break
        tried = tested.select(F.greatest("a", "b").alias("cid"), F.least("a", "b").alias("o")).union(tested.select(F.least("a", "b").alias("cid"), F.greatest("a", "b").alias("o")))
        tried = tried.groupBy("cid").agg(F.collect_set("o").alias("tested"))
        told = open_.join(facts, "cid", "left").join(classes.select("cid", "bits"), "cid").join(tried, "cid", "left")
        dealt = told.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("element", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", F.col("n").cast("long"), F.col("pos").cast("long"),
                             "root", "leader", "shared", "leader_n", "bits", "tested")
        dealt = dealt.repartition("element", "i", "j").sortWithinPartitions("element", "i", "j", "part", "root", "cid")
        found = dealt.mapInArrow(partial(_candidates, num=num, den=den, forest=turn < ROUNDS), "a long, b long, sure boolean")
        found = cut(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_or("sure").alias("sure")))
        more = found.where("not sure").select("a", "b")
        checked = cut(verified(more, _texts_of(texts, classes, more, width), to_sets))
        joined = cut(found.where("sure").select("a", "b").union(checked.where(linked).select("a", "b")))
        tested = tested.union(checked.where(~linked).select("a", "b"))
        if joined.limit(1).count():
            links = links.union(joined)
            roots = components(links)
        elif not found.limit(1).count():
            break
        lists = open_.select("element", "cid", "n", "pos")

    # short lists: every pair across components, once
    short = led.where(F.col("members") <= SMALL).select("element", "cid", "n", "pos").join(roots.withColumnRenamed("id", "cid"), "cid", "left")
    short = cut(short.withColumn("root", F.coalesce("root", "cid")))
    x, y = (short.select("element", *[F.col(c).alias(f"{c}_{side}") for c in ("cid", "n", "pos", "root")]) for side in "xy")
    need = F.ceil(F.lit(num) * (F.col("n_x") + F.col("n_y")) / F.lit(num + den))
    pairs = x.join(y, "element").where((F.col("cid_x") < F.col("cid_y")) & (F.col("root_x") != F.col("root_y"))
                                       & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num) & (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= need))
    pairs = pairs.select(F.col("cid_x").alias("a"), F.col("cid_y").alias("b")).distinct()
    pairs = pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    pairs = _not_ruled_out(pairs, classes, num, den)
    joined = cut(verified(pairs, _texts_of(texts, classes, pairs, width), to_sets).where(linked).select("a", "b"))
    if joined.limit(1).count():
        roots = components(links.union(joined))

    names = roots.join(classes.select(F.col("cid").alias("id"), "first"), "id")
    names = names.select("id", "root", "first")
    roots = names.join(names.groupBy("root").agg(F.min("first").alias("component")), "root").select(F.col("id").alias("cid"), "component")
    named = classes.where("copies > 1").select("cid", F.col("first").alias("own")).join(roots, "cid", "full")
    named = named.select("cid", F.coalesce("component", "own").alias("component"))
    out = rows.where("cid is not null").join(named, "cid", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    empty = rows.where("cid is null").select("id", "n", F.col("id").alias("component"))
    return out.union(empty).toDF("doc_id", "n_shingles", "component_id")


def bitmap(s: np.ndarray) -> bytes:
    """Two bits or more for each element, flipped by every element that falls on them."""
    size = 1 << max(6, int(len(s)).bit_length() + 1)
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_shared(a: bytes, b: bytes, na: int, nb: int) -> int:
    """An upper bound of the intersection from two bitmaps: every bit that differs tells of an element that only one set has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    # the bit of an element is its hash modulo the size: the larger bitmap folds onto the smaller
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def _not_ruled_out(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps leave a link possible: texts are fetched for these only."""
    @streamed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)))
            keep = []
            for a, b, na, nb, x, y in rows:
                shared = most_shared(x, y, na, nb)
                keep.append(shared * den >= (na + nb - shared) * num)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "xa", "xb")
    return cut(rows.mapInArrow(run, "a long, b long"))


def _class_of(s: np.ndarray) -> int | None:
    return int.from_bytes(digest(s)[:8], "little", signed=True) if len(s) else None


def _texts_of(texts: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id = class, text) of every class in ``pairs``, from the row of the class's first id."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1)
            cids = [_class_of(s) for s in shingle_sets(t.to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), t], ["id", "text"])

    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("cid", "first"))
    firsts = bounded(needed.select(F.col("first").alias("id")).distinct())
    found = texts.join(firsts, texts["id"].eqNullSafe(firsts["id"]), "left_semi").mapInArrow(own, "id long, text string")
    return found.join(bounded(needed.select(F.col("cid").alias("id"))), "id", "left_semi").dropDuplicates(["id"])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs``, same columns, with one document of every component: that of the smallest id.

    Rows without an id stay.  Rows that repeat an id and text are one document."""
    found = cut(similar_documents(docs, id_col=id_col, text_col=text_col, **params))
    stays = found.groupBy(F.col("doc_id").alias("__doc")).agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("__stays"), F.count("*").alias("__rows"))
    gone = bounded(stays.where("__stays = 0").select("__doc"))
    rows = docs.join(gone, F.col(id_col).cast("long") == F.col("__doc"), "left_anti")
    again = stays.where("__rows > 1 and __doc is not null").select("__doc")
    if not again.limit(1).count():
        return rows
    again = bounded(again)
    on = F.col(id_col).cast("long") == F.col("__doc")
    return rows.join(again, on, "left_anti").union(rows.join(again, on, "left_semi").dropDuplicates([id_col, text_col]))
