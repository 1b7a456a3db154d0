"""Byte-pair encoding by a segment tree over pair ranks, and decoding.

The file is a BPE of the ``tokenizers`` library with a word-end suffix and byte letters.  A text is cut
at the file's added tokens, normalised (NFC, white space runs to one blank, lower case letter by letter)
and split into words.  Each word begins as its bytes' tokens, the last with the suffix.  The leaves of a
segment tree hold, for every adjacent pair, its merge rank and place; an inner node holds the least of its
two children, so the root is the leftmost pair of the lowest rank.  Merging it changes three leaves, each
with its path to the root, until the root holds no pair: O(n log n) for a word of n bytes, of any length.

Texts of Latin letters and plain ASCII are normalised and split with the standard library; all others by the
file's own normaliser and splitter, so that both follow one Unicode version.  A task remembers words and
their ids up to ``REMEMBERED`` bytes.

Results.  One row per input row, in any order.  Null and empty texts have no ids and decode to an empty text.
Repeated rows are encoded each.  Other columns of the input are ignored.  Decoding joins the ids' tokens with one blank,
as the library does for a file without a decoder; special tokens stay.  A null id list decodes to null; an
id that the file doesn't have has no token and is left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import prepare, streamed

#: Bytes of words, their ids and the table of them that a task remembers.
REMEMBERED = 48 << 20
#: The file's word split (a fixed pattern of that vocabulary), for texts that PLAIN allows.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
NO_PAIR = 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a file's contents."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE file")
        odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd:
            raise ValueError(f"added tokens that take in or look at what is beside them: {odd}")
        if spec.get("decoder") is not None:
            raise ValueError("a file with a decoder of its own")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        # rank of a pair of ids (below 2^20), and the id that each rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # the leftmost match, of those the longest
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        own = Tokenizer.from_str(content.decode())
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, by the segment tree."""
        n = len(word)
        first = self.first
        ids = [first[b] for b in word]
        if n:
            ids[-1] = self.last[word[-1]]
        if n < 2:
            return ids
        # leaves m..2m-1: rank * n + place of the pair that begins there; node k is the lesser of 2k and 2k+1
        ranks, made, m = self.ranks, self.made, n - 1
        tree = [NO_PAIR] * m
        for i in range(m):
            r = ranks.get(ids[i] << 20 | ids[i + 1])
            tree.append(NO_PAIR if r is None else r * n + i)
        for k in range(m - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, m))
        while tree[1] != NO_PAIR:
            r, i = divmod(tree[1], n)
            j = after[i]
            ids[i] = made[r]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            # three leaves change: that of j, which is gone, of i, and of the token before i
            for leaf in (j, i, before[i]):
                if leaf < 0 or leaf == m:
                    continue
                value = NO_PAIR
                if leaf != j and after[leaf] < n:
                    r = ranks.get(ids[leaf] << 20 | ids[after[leaf]])
                    if r is not None:
                        value = r * n + leaf
                k = leaf + m
                while tree[k] != value:
                    tree[k] = value
                    if k == 1:
                        break
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def words(self, text: str) -> list[bytes]:
        """The words of a text without added tokens, as bytes."""
        if not NOT_PLAIN.search(text):
            return [w.encode() for w in WORDS.findall(text.lower())]
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in split]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut else [text]
        known, out = self.known, []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
                continue
            words = self.words(part)
            for w in set(words).difference(known):
                ids = self.merge(w)
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
                self.held += len(w) + 4 * len(ids) + 150
            out += [known[w] for w in words]
            if self.held > REMEMBERED:
                known.clear()
                self.held = 0
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in tokens])


_HELD: dict[str, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary per worker: that of the last file used."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Vocabulary(content)
    return _HELD[key]


@streamed
def _encode(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(content.value)
    for batch in batches:
        ids = [voc.encode(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])


@streamed
def _decode(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(content.value)
    for batch in batches:
        texts = [None if b is None else voc.decode(b) for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])


def _content(df: DataFrame, path: str | None):
    """The file's contents for the executors, which need not see the driver's files."""
    prepare(df.sparkSession)
    with open(path or default_tokenizer(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, content=_content(docs, path)), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the text of its ids."""
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(partial(_decode, content=_content(encoded, path)), "doc_id long, n_tokens long, ids binary, text string")
