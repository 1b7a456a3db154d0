"""Spelling variants, whitening and segment-tree BPE against brute force or the library."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm import queries, segment_bpe, spelling, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"langerword{'x' * (i % 40)}" for i in range(20_000))
    run = "ab" * 3000
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \n\t ", "en", "s", 4), (-4, long, "en", "s", len(long)), (-5, f"{run} {run}z {run}", None, None, 1),
           (-6, f"{run} {run}z {run}z", None, None, 1), (-7, "weather weather weather weather weather weather wether wether wether weathers weathers weathers Weather", "en", "s", 9),
           (-7, "weather weather weather weather weather weather wether wether wether weathers weathers weathers Weather", "en", "s", 9),
           (None, "Ärgernis ärgernis ärgernis argernis argernis argernis hello's <|endoftext|>x <|startoftext|> 12½ ﬁ", None, None, 3),
           (-8, "ΣΑΣ ÉÀé é İstanbul ß ａｂｃ 日本語   tab\tx 👩‍👩‍👧 I'll they'RE don't ___ !?!... ǅ ͅ ẞ", "el", "s", 3), (-9, "aaaaab aaaaab aaaaab aaaab aaaab aaaab aaab aaab aaab baaaa baaaa baaaa", "en", "s", 0)]
    return base.union(spark.createDataFrame(odd, DOCS)).withColumns({"word": F.lit("mine"), "n": F.lit(1), "ids": F.lit("i"), "near": F.lit(2), "kind": F.lit(3)}).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- spelling variants

def plain_variants(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}
    masks = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[len(w), i, hashlib.md5((w[:i] + "\0" + w[i + 1:]).encode()).digest()].add(w)
    near = defaultdict(set)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in words:
                near[w].add(v)
                near[v].add(w)
    forms = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        forms[w] = top if top is not None and words[top] >= 2 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    return {(w, forms[w], root(w), n, len(near[w]), words.get(forms[w])) for w, n in words.items()}


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, docs, small):
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    # many rounds of small shards, or one round
    got = spelling.variants(docs, **({"round_bytes": 64 * 64, "per_shard": 16} if small else {}))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(r[1] for r in rows) and any(len(r[0]) > 5000 for r in rows)
    assert ("wether", "weather") in {r[:2] for r in rows} and any(r[2] not in (r[0], r[1]) for r in rows)


def test_variants_ties_and_empty(spark, empty):
    rows = [(None, " ".join(["caren"] * 3 + ["cater"] * 6 + ["cares"] * 6 + ["carex"] * 6))]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), one_in=1 << 40).collect()}
    assert got["caren"].form == "cares" and got["caren"].form_n == 6 and got["caren"].n_near == 2
    assert got["cater"].form is None and got["cater"].root == "cater" and got["cater"].n_near == 0
    assert spelling.variants(empty).collect() == []


def test_bloom_loses_no_word():
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdé") for _ in range(7)) for _ in range(5000)})
    blocks = {7: -(-len(words) * spelling.BITS // 512)}
    h = spelling.hashes(spelling.codes(words))
    bits = np.zeros(blocks[7] * 8, np.uint64)
    mixed = spelling.mix(h)
    for k in range(spelling.PROBES):
        b = spelling.bit_of(mixed, k)
        np.bitwise_or.at(bits, spelling.blocks_of(mixed, blocks[7]) * 8 + (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    bloom = spelling.Bloom(blocks, {7: (0, bits)})
    assert len(bloom.probe(7, h)) == len(words)
    other = list({"".join(rng.choice("vwxyz") for _ in range(7)) for _ in range(5000)})
    assert len(bloom.probe(7, spelling.hashes(spelling.codes(other)))) < 0.01 * len(other)


# ---- whitening

def plain_whitening(rows):
    keep = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(x) for _, x in keep)
    keep = [(i, x + [0] * (d - len(x))) for i, x in keep]
    fit = [list(x) for x in {tuple(x) for _, x in keep}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n ** 3) for j in range(d)] for i in range(d)]
    return keep, n, s, np.array([[float(c) for c in r] for r in cov])


@pytest.mark.parametrize("scale", [1, 2.0 ** 40])
def test_whitening_equals_plain(spark, scale):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * scale
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(100, None), (101, [1.0, None, 2.0, 3.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4),
                                                                         (104, [float(c) for c in base[0]]), (104, [float(c) for c in base[1]]), (None, [0.5 * scale, 0.25]), (106, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "x": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    keep, n, s, v = plain_whitening(rows)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(keep) and all(r.n == n for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.id, r.component].append(r)
    for i, x in keep:
        y = [n * c - t for c, t in zip(x, s)]
        for k in range(4):
            w = float(np.dot([c / n for c in y], u[:, k])) / np.sqrt(e[k])
            assert any(int(r.deviation) == sum(c * c for c in y) and abs(abs(r.whitened) - abs(w)) < 1e-8 * (1 + abs(w)) and abs(r.explained - e[k] / np.trace(v)) < 1e-9 for r in by[i, k + 1])
    assert all(r.identity_error < 1e-8 for r in got)


def test_covariance_is_that_of_differences_of_variances(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    keep, n, s, v = plain_whitening([(r.vec_id, list(r.embedding)) for r in df.collect()])
    one = whitening.whiten(df)
    w = np.array([[r.whitened for r in sorted(rs, key=lambda r: r.component)] for rs in _per_id(one.collect()).values()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9
    assert abs(one.first().explained - np.linalg.eigvalsh(v)[-1] / np.trace(v)) < 1e-12


def _per_id(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.id].append(r)
    return by


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert len(got) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.75, 0.25])], schema)).collect()
    assert [r.whitened is None for r in sorted(got, key=lambda r: (r.component, r.id))] == [False, False, True, True]
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []


# ---- BPE

def test_bpe_equals_library(spark, docs):
    own = Tokenizer.from_file(segment_bpe.default_tokenizer())
    got = sorted((tuple(r) for r in segment_bpe.decode(segment_bpe.encode(docs)).collect()), key=repr)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), bytearray(np.array(ids, "<u4").tobytes()), own.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)


def test_bpe_equals_library_on_random_text():
    own = Tokenizer.from_file(segment_bpe.default_tokenizer())
    with open(segment_bpe.default_tokenizer(), "rb") as f:
        voc = segment_bpe.Vocabulary(f.read())
    rng = random.Random(7)
    letters = ["a", "e", "t", "th", "Q", " ", "  ", "\n", "'s", "'LL", "9", "é", "́", "ß", "Σ", "İ", "中", "👍", "<|endoftext|>", "<|", "\x1c", "͸", "²", "×", "_", "-", "‍"]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert np.frombuffer(voc.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_of_one_very_long_word():
    with open(segment_bpe.default_tokenizer(), "rb") as f:
        voc = segment_bpe.Vocabulary(f.read())
    rng = random.Random(1)
    word = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    # the plain way: the leftmost of the lowest ranks, again and again
    ids = [voc.first[b] for b in word[:-1]] + [voc.last[word[-1]]]
    while True:
        ranks = [(voc.ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in voc.ranks]
        if not ranks:
            break
        r, i = min(ranks)
        ids[i: i + 2] = [voc.made[r]]
    assert voc.merge(word) == ids
    assert len(voc.merge(word * 30)) > 1000 and not voc.merge(b"")


def test_bpe_edges(spark, empty):
    assert segment_bpe.encode(empty).collect() == [] and segment_bpe.decode(segment_bpe.encode(empty)).collect() == []
    odd = spark.createDataFrame([(1, 1, None), (2, 1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id long, n_tokens long, ids binary")
    assert [r.text for r in segment_bpe.decode(odd).orderBy("doc_id").collect()] == [None, ""]


def test_queries_of_the_round(spark):
    wanted = {"op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"], "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
              "op13_segment_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]}
    for name, columns in wanted.items():
        assert queries.QUERIES[name](spark, SF).columns == columns
    one = queries.QUERIES["op13_segment_bpe"](spark, SF).where("doc_id = 1").first()
    own = Tokenizer.from_file(segment_bpe.default_tokenizer())
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 1").first().text
    ids = own.encode(text, add_special_tokens=False).ids
    assert one.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert one.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_top_k_of_ids_with_many_vectors(spark):
    from lakeloom.llm import mtree
    rng = np.random.default_rng(9)
    # the best vectors are one id's, many times over, and the query's own
    rows = [(1, [2.0, 0.01 * i]) for i in range(300)] + [(0, [1.0, 0.01 * i]) for i in range(40)] + [(i, [float(x) for x in rng.normal(size=2) * 0.3]) for i in range(2, 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in mtree.top_k(df, F.col("vec_id") == 0).collect())
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    best = {}
    for _, q in [x for x in ints if x[0] == 0]:
        for i, v in ints:
            if i:
                best[i] = max(best.get(i, -10 ** 18), int(q @ v))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert got == [(k + 1, i, s) for k, (i, s) in enumerate(want)]
