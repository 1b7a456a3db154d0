"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the characters of trusted texts, n-grams of ``ORDER`` code points, all of them, in whatever script.
Strings are known by a 64-bit hash of their code points.  Tasks count n-grams in a table of fixed size, what doesn't
find a place is handed on at once; Spark sums the counts in shards by n-gram.  Continuation counts, totals of contexts,
discounts of every order and the interpolated probabilities are aggregations of these shards and joins between them, on
the context and on the shorter n-gram.  The model stays a sharded table of strings: probability of the last
character given the others, and weight of the string as a context.

Scoring never moves an n-gram per text.  A scan task packs its documents into blocks of about ``BLOCK`` characters, which
are shuffled once, compressed.  A block asks once for each of the distinct strings of 1 to ``ORDER`` characters in it.  The
requests are joined to the shards, and the answers meet the block in the task that holds it already (a cogroup on the block):
a text's log-probability is read off its block's answers, backing off where a longer string has none.  A block's name
contains a hash of its content, so an input that changes when it is read again is an error, not a wrong result.

A document is accepted if its perplexity lies between two quantiles of the trusted documents of its language.  Short texts
scatter more: the logarithm may be off by ``SLACK`` standard deviations of a character's log-probability over the root of
the length, for trusted texts and others alike.  A language without trusted documents uses those of all languages.

Results.  Null and empty texts have a null perplexity and are accepted: nothing speaks against
them.  A null language is a language.  Without trusted documents all are accepted.  Repeated rows are judged each; other
columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import U64, bounded, cut, give_back, mix, prepare, streamed

ORDER = 4
#: Quantiles of trusted texts between which a document is accepted, and the slack of short texts.
LOW, HIGH, SLACK = 0.0005, 0.999, 1.5
#: Characters of a block of documents, and of one vectorised pass.
BLOCK, CHARS = 24_000_000, 250_000
#: Characters of a pass that counts, which holds a table as well.
COUNTED = 60_000
#: Slots of a task's tables, as powers of two: of counts and answers, and of each table of strings asked for.
SLOTS, ASKED = 19, 20
#: Level at which the texts of a pass are compressed.
LEVEL = 6
#: Stands before a text's first character (above all code points).
PAD = 0x110000
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def keys_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes of the strings of 1 to ORDER characters that end at each place, places of the texts' characters, lengths).

    Texts are laid out one after the other, ORDER - 1 pads before each: the string before a place is the one that ends a place earlier."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    code = np.full(int(n.sum()) + (ORDER - 1) * len(texts), PAD, dtype=U64)
    at = np.arange(int(n.sum())) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), n)
    code[at] = np.frombuffer(raw, dtype=np.uint32)
    code += U64(1)
    out, total, power = [], np.zeros(len(code), U64), U64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            total = total.copy()
            total[k:] += code[: len(code) - k] * power
            power = power * _P
            out.append(mix(total + U64(k + 1) * _Q))
    return out, at, n


def _passes(texts: list[str], limit: int = CHARS) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


COUNT_FIELDS = ", ".join([*(f"g{k} long" for k in range(ORDER, 0, -1)), *(f"c{k} long" for k in range(ORDER - 1, 0, -1)), "n long"])


@streamed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams with their shorter ends (g), the strings before their last characters (c) and counts."""
    width = 2 * ORDER - 1
    held = np.zeros((1 << SLOTS, width), dtype=U64)
    counts = np.zeros(1 << SLOTS, dtype=np.int64)
    names = [*(f"g{k}" for k in range(ORDER, 0, -1)), *(f"c{k}" for k in range(ORDER - 1, 0, -1)), "n"]

    def told(rows: np.ndarray, n: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(places), 50_000):
            at = places[lo: lo + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[at, k].view(np.int64)) for k in range(width)), pa.array(n[at])], names)

    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for lo, hi in _passes(texts, COUNTED):
            keys, at, _ = keys_of(texts[lo:hi])
            found, first, n = np.unique(keys[-1][at], return_index=True, return_counts=True)
            place = at[first]
            rows = np.stack([*(keys[k][place] for k in range(ORDER - 1, -1, -1)), *(keys[k][place - 1] for k in range(ORDER - 2, -1, -1))], axis=1)
            slot = (found >> U64(64 - SLOTS)).astype(np.int64)
            # of new strings that fall on one free slot the last stays; the others are handed on
            free = counts[slot] == 0
            held[slot[free]] = rows[free]
            own = held[slot, 0] == found
            counts[slot[own]] += n[own]
            yield from told(rows, n, np.flatnonzero(~own))
    # the table is told bit by bit: a copy would double it
    yield from told(held, counts, np.flatnonzero(counts))


def train(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, p, back) of every string of the model: probability of its last character given the others, and its weight as a context."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, COUNT_FIELDS)
    others = [c for c in rows.columns if c not in (f"g{ORDER}", "n")]
    shard = cut(rows.groupBy(f"g{ORDER}").agg(*[F.min(c).alias(c) for c in others], F.sum("n").alias("n")))
    shards = [shard]
    for k in range(ORDER - 1, 0, -1):                                      # continuation counts: distinct characters before
        keep = [c for c in shards[-1].columns if c not in ("n", f"g{k + 1}", f"c{k}", f"g{k}")]
        shards.append(cut(shards[-1].groupBy(f"g{k}").agg(*[F.min(c).alias(c) for c in keep], F.count("*").alias("n"))))
    symbols = shards[-1].count()
    below, parts = None, []
    for k, shard in zip(range(1, ORDER + 1), reversed(shards)):
        c = shard.agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).first()          # four numbers
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.0
        cuts = [max(0.0, min(j, j - (j + 1) * y * c[j] / c[j - 1])) if c[j - 1] else 0.0 for j in (1, 2, 3)]
        cuts = [x if x > 0 else 0.5 for x in cuts]
        n = F.col("n")
        off = F.least(F.when(n == 1, cuts[0]).when(n == 2, cuts[1]).otherwise(cuts[2]), n.cast("double"))
        context = F.col(f"c{k - 1}") if k > 1 else F.lit(0).cast("long")
        totals = shard.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        own = shard.withColumn("context", context).join(totals, "context")
        back = F.col("off") / F.col("total")
        if below is None:
            # what is left goes to all characters alike, and one for those never seen
            p = (n - off) / F.col("total") + back / (symbols + 1)
            unseen = totals.select(F.lit(0).cast("long").alias("key"), (back / (symbols + 1)).alias("p"), F.lit(None).cast("double").alias("back"))
            parts.append(unseen)
        else:
            own = own.join(below.select(F.col("key").alias(f"g{k - 1}"), F.col("p").alias("lower")), f"g{k - 1}")
            p = (n - off) / F.col("total") + back * F.col("lower")
            parts.append(totals.select(F.col("context").alias("key"), F.lit(None).cast("double").alias("p"), back.alias("back")))
        below = cut(own.select(F.col(f"g{k}").alias("key"), p.alias("p")))
        parts.append(below.withColumn("back", F.lit(None).cast("double")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return cut(model.groupBy("key").agg(F.max("p").alias("p"), F.max("back").alias("back")))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(64 - ASKED)).astype(np.int64), (h >> U64(20) & U64((1 << ASKED) - 1)).astype(np.int64)


@streamed
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, z) of the documents: those of one pass are compressed together, with all their columns.

    A block is known by a hash of its task, its number in the task and all it holds."""
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    task, blocks, size, held = TaskContext.get().partitionId(), 0, 0, []

    def closed() -> pa.RecordBatch:
        h = xxhash.xxh3_64(f"{task}:{blocks}")
        for z in held:
            h.update(z)
        name = h.intdigest() >> 1
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.int64()), pa.array(held, pa.binary())], ["block", "z"])

    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for lo, hi in _passes(texts):
            packed = pa.BufferOutputStream()
            with pa.ipc.new_stream(packed, batch.schema) as out:
                out.write_batch(batch.slice(lo, hi - lo))
            held.append(press(packed.getvalue()))
            size += sum(map(len, texts[lo:hi]))
            if size > BLOCK:
                yield closed()
                blocks, size, held = blocks + 1, 0, []
    if held:
        yield closed()


def _unpacked(z: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(z))


@streamed
def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key) of the distinct strings of every block, and key 0; rows (block, z) come block by block."""
    block = None
    # a string is in its place of the first table, or, if another has that, of the second
    seen = np.zeros((2, 1 << ASKED), dtype=U64)

    def told(keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array(keys.view(np.int64))], ["block", "key"])

    for batch in batches:
        for name, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != block:
                block = name
                seen[:] = 0
                yield told(np.zeros(1, U64))
            for docs in _unpacked(z):
                keys, at, n = keys_of([t or "" for t in docs.column(0).to_pylist()])
                for k, h in enumerate(keys):
                    h = h[at] if k == ORDER - 1 else h
                    one, two = _places(h)
                    new = np.unique(h[(seen[0, one] != h) & (seen[1, two] != h)])
                    one, two = _places(new)
                    free = seen[0, one] == 0
                    # a string that others push out of both is asked for again: repeated requests change nothing
                    seen[0, one[free]] = new[free]
                    seen[1, two[~free]] = new[~free]
                    if len(new):
                        yield told(new)


class Answers:
    """A block's strings: a table by hash, and a sorted list for those that share a slot."""

    def __init__(self, keys: np.ndarray, p: np.ndarray, back: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.p, self.back = keys[order], p[order], back[order]
        self.slots = np.full(1 << SLOTS, -1, dtype=np.int32)
        self.slots[(self.keys >> U64(64 - SLOTS)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the strings, -1 for those without an answer."""
        if not len(self.keys):
            return np.full(len(h), -1, dtype=np.int64)
        at = self.slots[(h >> U64(64 - SLOTS)).astype(np.int64)].astype(np.int64)
        odd = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        if len(odd):
            there = np.searchsorted(self.keys, h[odd])
            there[there == len(self.keys)] = 0
            at[odd] = np.where(self.keys[there] == h[odd], there, -1)
        return at


def logs(keys: list[np.ndarray], at: np.ndarray, answers: Answers, unseen: float) -> np.ndarray:
    """Log-probability of the character at each of the places ``at``."""
    out = np.zeros(len(at))
    left = np.arange(len(at))
    for k in range(ORDER - 1, -1, -1):
        found = answers.find(keys[k][at[left]])
        p = np.where(found >= 0, answers.p[found] if len(answers.p) else np.nan, np.nan)
        hit = ~np.isnan(p)
        out[left[hit]] += np.log(p[hit])
        left = left[~hit]
        if not len(left):
            return out
        if k:
            # back off: the string before the place tells with what weight; one never followed, with all of it
            found = answers.find(keys[k - 1][at[left] - 1])
            w = np.where(found >= 0, answers.back[found] if len(answers.back) else np.nan, np.nan)
            out[left] += np.log(np.where(np.isnan(w), 1.0, w))
    out[left] += np.log(unseen)
    return out


def _measured(docs: pa.RecordBatch, answers: Answers, unseen: float, names: list[str]) -> pa.RecordBatch:
    """(mean, spread, size, columns beside the text) of the documents of one pass."""
    texts = [t or "" for t in docs.column(0).to_pylist()]
    keys, at, n = keys_of(texts)
    x = logs(keys, at, answers, unseen)
    end = np.cumsum(n)
    one, two = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (one[end] - one[end - n]) / n
        spread = np.sqrt(np.maximum((two[end] - two[end - n]) / n - mean ** 2, 0.0))
    rest = [docs.column(i) for i in range(1, docs.num_columns)]
    return pa.RecordBatch.from_arrays([pa.array(mean, mask=np.isnan(mean)), pa.array(spread, mask=np.isnan(spread)), pa.array(n, pa.int64()), *rest], names)


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(mean, spread, size, and the columns ``keep``) of every row: mean and standard deviation of its characters' log-probabilities."""
    kept = docs.select(F.col(text_col).cast("string").alias("__text"), *(keep or []))
    extra = kept.schema.fields[1:]
    names = ["mean", "spread", "size", *(f.name for f in extra)]
    told = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    unseen = model.where("key = 0").select("p").first()
    # the one shuffle of the texts: requests are read off it, and answers come to it
    texts = kept.mapInArrow(_pack, "block long, z binary").repartition("block")
    asked = texts.sortWithinPartitions("block").mapInArrow(_ask, "block long, key long")
    answers = asked.join(model, "key").select("block", "key", "p", "back")

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if unseen and not (texts.num_rows and answers.num_rows):
            raise RuntimeError("the input gave other rows when it was read again: write it first")
        key, p, back = (answers.column(c).to_numpy() for c in ("key", "p", "back"))
        found = Answers(key[key != 0].view(U64), p[key != 0].astype(float), back[key != 0].astype(float))
        done = [_measured(docs, found, unseen.p if unseen else 1.0, names) for z in texts.column("z").to_pylist() for docs in _unpacked(z)]
        give_back()
        return pa.Table.from_batches(done)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"mean double, spread double, size long{told}")


def _judged(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, low: float, high: float) -> DataFrame:
    """(id, lang, a, b: the text's and language's hashes, perplexity, ok) of every row."""
    prepare(docs.sparkSession)
    ids = bounded(trusted.select(F.col(id_col).alias("__id")).distinct())
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    marks = [F.xxhash64(text, lang).alias("__a"), F.xxhash64(F.lit(1), lang, text).alias("__b")]
    rows = docs.select(F.col(id_col).alias("__id"), lang.alias("__lang"), text.alias("__text"), *marks)
    model = train(rows.join(ids, "__id", "left_semi"), "__text")
    told = cut(score(rows, model, "__text", [F.col(c) for c in ("__id", "__lang", "__a", "__b")]))
    # a character's spread, over the root of the length, is what the mean may be off
    surprise, slack = -F.col("mean"), F.lit(SLACK) * F.col("spread") / F.sqrt("size")
    told = told.withColumns({"__high": surprise - slack, "__low": surprise + slack})
    calm = told.where("mean is not null").join(ids, "__id", "left_semi")
    quantiles = [F.percentile_approx("__low", low, 10_000).alias("q_low"), F.percentile_approx("__high", high, 10_000).alias("q_high")]
    by = F.broadcast(calm.groupBy(F.col("__lang").alias("__l")).agg(*quantiles))                            # a row per language
    whole = calm.agg(*quantiles).first()
    rows = told.join(by, F.col("__lang").eqNullSafe(F.col("__l")), "left")
    top = F.coalesce("q_high", F.lit(whole.q_high).cast("double"), F.lit(float("inf")))
    bottom = F.coalesce("q_low", F.lit(whole.q_low).cast("double"), F.lit(0.0))
    fine = F.col("mean").isNull() | ((F.col("__high") <= top) & (F.col("__low") >= bottom))
    return rows.select("__id", "__lang", "__a", "__b", F.exp(surprise).alias("__p"), fine.alias("__ok"))


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, lang, perplexity, accepted) of every row; ``trusted`` has the ids of the trusted rows."""
    rows = _judged(docs, trusted, id_col, text_col, lang_col, low, high)
    return rows.select(F.col("__id").alias("doc_id"), F.col("__lang").alias("lang"), F.col("__p").alias("perplexity"), F.col("__ok").alias("accepted"))


def accept(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           low: float = LOW, high: float = HIGH) -> DataFrame:
    """The accepted rows of ``docs``, with the columns they came with.  A text and language is judged once, whatever its rows."""
    gone = cut(_judged(docs, trusted, id_col, text_col, lang_col, low, high).where("not __ok").select("__a", "__b").distinct())
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    on = (F.xxhash64(text, lang) == F.col("__a")) & (F.xxhash64(F.lit(1), lang, text) == F.col("__b"))
    return docs.join(bounded(gone), on, "left_anti")
