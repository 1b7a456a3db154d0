"""Toxicity by a subsequence string-kernel machine with Nystrom landmarks.

A word is its letters after a start mark, whatever is inserted between them that is no letter;
letters set apart by blanks are one word; digits read as the letters they look like.  The kernel
of two words sums, over all subsequences of three letters within ``SPAN`` places, the product of
their weights, DECAY to the power of the places spanned: gaps and inserted letters weigh less but
match.  Landmarks are words and beginnings of words that labelled toxic texts have
and clean ones lack, from a bounded sample (``SAMPLE`` labelled rows of either class, by hash).  A word's
similarity to a landmark is the kernel over the landmark's with itself, at most 1, to the power of
``SHARP``; a document's kernel with a landmark is the damped sum over its words.  The Nystrom map makes
these kernel values the coordinates of a linear support vector machine (squared hinge), and a
logistic curve fitted to its margins gives the score.

Results.  One row per input row.  Null, empty and letterless texts get the score of no evidence.
Labels repeated for an id count as toxic if any says so; null labels and labels without a document are ignored.  Without
labels of both classes every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import U64, _inverse_powers, _powers, bounded, cut, mix, prepare, streamed

SAMPLE, LANDMARKS, LEAST_Z = 4000, 128, 5.0
SPAN, DECAY, SHARP, FAINT = 5, 0.7, 4, 0.5
#: What a missed toxic text counts in the logistic curve, a clean one counting 1.
MISS = 2.0
MARK, LETTERS = 27, 64
#: Places at which one word is looked at in a row; longer words are several overlapping pieces.
PIECE = 32
CHARS, REMEMBERED = 250_000, 300_000
#: Digits as the letters they look like (fixed).
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


def _letters() -> np.ndarray:
    """Code of every code point up to U+FFFF: 1-26 a-z, 28-63 other letters, 0 what is skipped, 255 blank."""
    table = np.zeros(1 << 16, dtype=np.uint8)
    for c in range(128, 1 << 16):
        ch = chr(c)
        table[c] = 255 if ch.isspace() else 28 + c % 36 if ch.isalpha() else 0
    for c in range(128):
        ch = LOOKALIKE.get(chr(c), chr(c))
        table[c] = 255 if ch.isspace() else ord(ch) - 96 if "a" <= ch <= "z" else 0
    return table


_TABLE = _letters()


class Words:
    """Words of some texts: letters in one array, each word's place, length, text and hash."""

    def __init__(self, texts: list[str]):
        code = _TABLE[np.minimum(np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)]
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])
        token = np.cumsum(code == 255)
        at = np.flatnonzero((code != 0) & (code != 255))
        self.letters, token = code[at], token[at]
        new = np.flatnonzero(np.diff(token, prepend=-1))
        size = np.diff(np.append(new, len(at)))
        doc = np.searchsorted(ends, at[new], side="right")
        # letters set apart: a word of one letter goes on with the next one, within a text
        joined = np.zeros(len(new), dtype=bool)
        joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (doc[1:] == doc[:-1])
        self.first = new[~joined]
        self.size = np.diff(np.append(self.first, len(at)))
        self.doc = doc[~joined]
        with np.errstate(over="ignore"):
            total = np.concatenate([[U64(0)], np.cumsum(self.letters.astype(U64) * _powers(len(at)), dtype=U64)])
            h = (total[self.first + self.size] - total[self.first]) * _inverse_powers(max(len(at), 1))[self.first] if len(new) else np.zeros(0, U64)
            self.hash = mix(h + self.size.astype(U64))

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, word) of pieces of the words ``which``: a start mark, then letters, 0 after the end."""
        step = PIECE - SPAN
        n = np.maximum(1, -(-(self.size[which] + 1 - SPAN) // step))
        word = np.repeat(np.arange(len(which)), n)
        part = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        place = part[:, None] * step + np.arange(PIECE)[None, :] - 1
        size = self.size[which][word][:, None]
        inside = (place >= 0) & (place < size)
        codes = np.where(inside, self.letters[np.minimum(self.first[which][word][:, None] + np.maximum(place, 0), len(self.letters) - 1)], 0)
        codes[place == -1] = MARK
        return codes, word


_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(row, number of the three letters, weight) of all subsequences that begin where a piece owns them."""
    c = codes.astype(np.int32)
    own = PIECE - SPAN
    for a, b in _GAPS:
        x, y, z = c[:, :own], c[:, a: own + a], c[:, b: own + b]
        r, k = np.nonzero((x > 0) & (z > 0))
        yield r, (x[r, k] * LETTERS + y[r, k]) * LETTERS + z[r, k], DECAY ** (b + 1)


class Landmarks:
    """Kernel of words with the landmarks, over the subsequences that landmarks have."""

    def __init__(self, strings: list[str]):
        # a beginning of a word and a whole word look alike here: the kernel is over what the landmark has
        w = Words([s.replace(" ", "") for s in strings])
        codes, word = w.rows(np.arange(len(w.first)))
        weight: dict[int, np.ndarray] = {}
        for r, key, x in subsequences(codes):
            for i, k in zip(word[r].tolist(), key.tolist()):
                weight.setdefault(k, np.zeros(len(strings), np.float32))[i] += x
        self.number = np.full(LETTERS ** 3, -1, dtype=np.int32)
        self.number[list(weight)] = np.arange(len(weight))
        self.weight = np.stack(list(weight.values())) if weight else np.zeros((0, len(strings)), np.float32)
        self.own = np.maximum((self.weight ** 2).sum(axis=0), 1e-9)
        self.m = len(strings)
        self.known: dict[int, tuple] = {}

    def similar(self, w: Words, which: np.ndarray) -> np.ndarray:
        codes, word = w.rows(which)
        rows, keys, xs = [], [], []
        for r, key, x in subsequences(codes):
            n = self.number[key]
            hit = n >= 0
            rows.append(word[r[hit]])
            keys.append(n[hit])
            xs.append(np.full(int(hit.sum()), x, np.float32))
        rows, keys, xs = np.concatenate(rows), np.concatenate(keys), np.concatenate(xs)
        out = np.zeros((len(which), self.m), np.float32)
        order = np.argsort(rows, kind="stable")
        for lo in range(0, len(order), 100_000):
            part = order[lo: lo + 100_000]
            at = np.flatnonzero(np.diff(rows[part], prepend=-1))
            out[rows[part][at]] += np.add.reduceat(self.weight[keys[part]] * xs[part][:, None], at, axis=0) if len(at) else 0
        r = np.minimum(out / self.own, 1.0)
        return np.where(r >= FAINT, r, 0) ** SHARP

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.m), np.float32)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHARS):
                size += len(texts[hi])
                hi += 1
            w = Words(texts[lo:hi])
            if len(w.first):
                h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                known = self.known
                new = np.array([k for k, x in enumerate(h.tolist()) if x not in known], dtype=np.int64)
                for a in range(0, len(new), 20_000):
                    part = new[a: a + 20_000]
                    s = self.similar(w, first[part])
                    some = s.any(axis=1)
                    for k, x in zip(part.tolist(), some.tolist()):
                        known[int(h[k])] = None
                    for k, v in zip(part[some].tolist(), s[some]):
                        j = np.flatnonzero(v)
                        known[int(h[k])] = (j, v[j])
                told = [known[x] for x in h.tolist()]
                match = np.array([t is not None for t in told])
                for i in np.flatnonzero(match[back]).tolist():
                    j, v = told[back[i]]
                    out[lo + w.doc[i], j] += v
            lo = hi
        return np.log1p(out)


@streamed
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, toxic texts, clean texts) that have the word or the beginning of a word."""
    count: Counter = Counter()

    def rows():
        keys = list({s for s, _ in count})
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([count[s, 1] for s in keys], pa.int64()), pa.array([count[s, 0] for s in keys], pa.int64())], ["s", "toxic", "clean"])
        count.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set()
            for raw in set((text or "").lower().split()):
                word = "".join(c for c in raw if c.isalpha())
                found.update(word[:k] for k in range(3, min(len(word), 9) + 1))
                if len(word) > 9:
                    found.add(word)
            count.update((s, toxic) for s in found)
        if len(count) > 300_000:
            yield rows()
    if count:
        yield rows()


def _cholesky(k: np.ndarray) -> np.ndarray:
    low = np.zeros_like(k)
    for j in range(len(k)):
        low[j, j] = np.sqrt(max(k[j, j] - (low[j, :j] ** 2).sum(), 1e-6))
        low[j + 1:, j] = (k[j + 1:, j] - (low[j + 1:, :j] * low[j, :j]).sum(axis=1)) / low[j, j]
    return low


def _whiten(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Nystrom coordinates: x times the inverse transposed factor of the landmarks' kernel."""
    out = np.zeros_like(x, dtype=float)
    for j in range(low.shape[0]):
        out[:, j] = (x[:, j] - (out[:, :j] * low[j, :j]).sum(axis=1)) / low[j, j]
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float, float, float]:
    """(w, b, slope, shift): squared-hinge support vector machine by accelerated gradient, then a logistic curve."""
    scale = 1.0 / max((x ** 2).sum(axis=1).max(initial=0.0) + 1, 1.0)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    pw, pb = w, b
    for t in range(1, rounds + 1):
        k = (t - 1) / (t + 2)
        vw, vb = w + k * (w - pw), b + k * (b - pb)
        slack = np.maximum(1 - y * (np.einsum("ij,j->i", x, vw) + vb), 0) * y * weight
        pw, pb = w, b
        w, b = vw + scale * (2 * np.einsum("ij,i->j", x, slack) - ridge * vw), vb + scale * 2 * slack.sum()
    f = np.einsum("ij,j->i", x, w) + b
    slope, shift, target = 1.0, 0.0, (y > 0).astype(float)
    cost = np.where(y > 0, MISS, 1.0)
    for _ in range(100):                                                  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * f + shift, -30, 30)))
        g1, g0, v = (cost * (p - target) * f).sum() + 1e-3 * slope, (cost * (p - target)).sum(), cost * p * (1 - p) + 1e-6
        h11, h10, h00 = (v * f * f).sum() + 1e-3, (v * f).sum(), v.sum()
        det = h11 * h00 - h10 * h10
        if det <= 1e-12:
            break
        slope, shift = slope - (h00 * g1 - h10 * g0) / det, shift - (h11 * g0 - h10 * g1) / det
    return w, float(b), float(slope), float(shift)


def choose(strings: DataFrame, n_toxic: int, n_clean: int, landmarks: int = LANDMARKS, least: float = LEAST_Z) -> list[str]:
    """The most telling strings; of strings that begin alike the most telling one."""
    a, b = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    p = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    z = (a - b) / F.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    best = strings.groupBy("s").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("z", z).where(F.col("z") >= least)
    best = best.orderBy(F.desc(F.round("z", 1)), F.desc(F.length("s")), "s").limit(20 * landmarks).collect()
    out: list[str] = []
    for r in best:
        if len(r.s) >= 3 and not any(r.s.startswith(o) or o.startswith(r.s) for o in out):
            out.append(r.s)
    return out[:landmarks]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple | None:
    """(landmarks, factor, w, b, slope, shift) from at most ``sample`` labelled documents of either class."""
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    picked = [told.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample) for y in (1, 0)]
    # at most twice the sample: small enough to broadcast
    rows = docs.join(F.broadcast(picked[0].union(picked[1])), docs[id_col] == F.col("__id")).select(F.col(text_col).cast("string").alias("text"), F.col("__y").cast("int").alias("y"))
    rows = cut(rows)
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    chosen = choose(rows.mapInArrow(_strings, "s string, toxic long, clean long"), n[1], n[0])
    if not chosen:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(chosen)
        for batch in batches:
            x = marks.features([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])

    # repeated labelled rows may exceed the sample: what is fitted is bounded as well
    got = rows.mapInArrow(features, "y int, x array<float>").limit(4 * sample).toArrow()
    y = np.where(got["y"].to_numpy() == 1, 1.0, -1.0)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), len(chosen))
    k = Landmarks(chosen).features(chosen).astype(float)
    low = _cholesky((k + k.T) / 2 + 0.1 * np.eye(len(chosen)))
    return (chosen, low, *fit(_whiten(x, low), y))


@streamed
def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    if model.value is not None:
        chosen, low, w, b, slope, shift = model.value
        marks = Landmarks(chosen)
        u = _whiten(np.eye(len(chosen)), low)                             # x -> x @ u
    for batch in batches:
        n = len(batch.column(0))
        score = np.zeros(n)
        if model.value is not None:
            x = marks.features([t or "" for t in batch.column(1).to_pylist()]).astype(float)
            f = np.einsum("ij,j->i", x, np.einsum("ij,j->i", u, w)) + b
            score = 1 / (1 + np.exp(-np.clip(slope * f + shift, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, score) of every row, learnt from ``labels``: pass only those to learn from."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, score double")
