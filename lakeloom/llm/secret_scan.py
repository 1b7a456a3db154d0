"""Secret scan with DataFrame functions only: fixed patterns plus a randomness test battery.

Fixed patterns give the base spans (``KINDS``).  Besides, every run of at least ``MIN_LENGTH``
key characters is a candidate.  Its encoding is inferred from its characters (hex, base32, base
62, base 64), and three statistics are taken over its code indexes: chi-squared against a
uniform alphabet, the number of runs above and below the middle, and lag-1 serial correlation.
A candidate counts as random only if runs and correlation do not contradict it.  The null
hypothesis of the scan is *text of words*, whose letters repeat: under it chi-squared is
non-central, the non-centrality growing with the length, so short candidates need to look more uniform.
The lower-tail p-values of all candidates of the corpus go through Benjamini-Hochberg at level
``FDR``, over a histogram of p-values of bounded size (the only thing that leaves a row).

Results.  One row per input row, null and empty texts without spans.  Spans are in code points,
end exclusive.  Random spans that overlap a base span are left out: the base span stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, prepare

#: kind: (pattern, group whose length counts, least length).  Fixed patterns, in the order of kinds.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: A pattern that any row with a span of the kind matches, cheaper where short matches abound.
NEEDED = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
MIN_LENGTH, FDR, BATTERY_Z = 20, 0.01, 3.3
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Chance that two letters of a word-like text are the same (fixed), by alphabet size.
REPEAT = {16: 0.12, 32: 0.075, 62: 0.065, 64: 0.065}
#: Bins of -ln(p): the histogram that leaves the rows.
BINS, BIN = 2000, 0.02


def _located(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group is long enough: what lies between
    the matches (a split) and the matches themselves give the offsets."""
    p = F.lit(pattern)
    lengths = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    groups = F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.arrays_zip(lengths.alias("m"), groups.alias("g")), gaps, lambda m, gap: F.struct(gap.alias("gap"), m["m"].alias("m"), m["g"].alias("g")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,kind:int,end:int,name:string>>").alias("spans"))

    def add(acc, s):
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["m"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.lit(kind).alias("name"))
        return F.struct(end.alias("at"), F.when(s["g"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(steps, zero, add, lambda acc: acc["spans"])


_EMPTY = "array<struct<start:int,kind:int,end:int,name:string>>"


def _spans(text: Column, kind: str, order: int) -> Column:
    pattern, group, least = KINDS[kind]
    return F.when(text.rlike(NEEDED[kind]), _located(text, pattern, group, least, kind, order)).otherwise(F.expr("array()").cast(_EMPTY))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by a polynomial with error below 1e-7."""
    t = F.lit(1.0) / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, upper).otherwise(1 - upper)


def battery(token: Column) -> Column:
    """Struct of the encoding's alphabet size ``k``, the p-value under word-like text ``p``, and the
    z-values of the runs test and of serial correlation."""
    body = F.rtrim(token, F.lit("="))
    k = (F.when(body.rlike("^[0-9a-f]+$") | body.rlike("^[0-9A-F]+$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32)
         .when(body.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64))
    code = F.transform(F.split(body, ""), F.ascii)
    code = F.filter(code, lambda c: c > 0)

    def index(c, size):
        digit, upper, lower = c - 48, c - 65, c - 97
        six = F.when(c >= 97, lower + 10).when(c >= 65, upper + 10).otherwise(digit)
        return (F.when(size == 16, six).when(size == 32, F.when(c >= 65, upper).otherwise(c - 50 + 26))
                .otherwise(F.when(c >= 97, lower + 26).when((c >= 65) & (c <= 90), upper).when((c >= 48) & (c <= 57), digit + 52).when(c.isin(43, 45), 62).otherwise(63)))

    def stats(s):
        idx, size, n = s["idx"], s["k"], F.size(s["idx"]).cast("double")
        same = F.aggregate(F.array_distinct(idx), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(idx, lambda y: y == x)).cast("double"), F.lit(2.0)))
        chi = same * size / n - n
        repeat = F.element_at(F.create_map(*[F.lit(x) for kv in REPEAT.items() for x in kv]), size)
        shift = (n - 1) * (size * repeat - 1)
        p = normal_cdf((chi - (size - 1) - shift) / F.sqrt(2.0 * (size - 1) + 4 * shift))
        pairs = F.arrays_zip(F.slice(idx, 1, F.size(idx) - 1).alias("a"), F.slice(idx, 2, F.size(idx) - 1).alias("b"))
        half = size / 2
        high = F.size(F.filter(idx, lambda x: x >= half)).cast("double")
        changes = F.size(F.filter(pairs, lambda q: (q["a"] >= half) != (q["b"] >= half))).cast("double")
        mean = 2 * high * (n - high) / n
        spread = F.sqrt(F.greatest(mean * (2 * high * (n - high) - n) / (n * (n - 1)), F.lit(1e-6)))
        mid = F.aggregate(idx, F.lit(0.0), lambda a, x: a + x) / n
        var = F.aggregate(idx, F.lit(0.0), lambda a, x: a + (x - mid) * (x - mid))
        cov = F.aggregate(pairs, F.lit(0.0), lambda a, q: a + (q["a"] - mid) * (q["b"] - mid))
        return F.struct(size.alias("k"), p.alias("p"), ((changes - mean) / spread).alias("runs"), (cov / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)).alias("serial"))

    one = F.array(F.struct(k.alias("k"), F.transform(code, lambda c: index(c, k)).alias("idx")))
    return F.element_at(F.transform(one, stats), 1)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, base, random): arrays of (start, kind, end, name) spans of every row."""
    prepare(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[_spans(text, k, i).alias(k) for i, k in enumerate(KINDS)],
                       F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE, 0, MIN_LENGTH, "random", len(KINDS))).otherwise(F.expr("array()").cast(_EMPTY)).alias("runs"))
    base = F.array_sort(F.concat(*[F.col(k) for k in KINDS]))
    # words alone have no upper case inside, digits or signs: most candidates are plain long words, which the battery sees too
    rows = rows.select("doc_id", base.alias("base"), F.transform("runs", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name"),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token"))).alias("runs"))
    rows = rows.withColumn("runs", F.transform("runs", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name"), battery(s["token"]).alias("t"))))
    rows = cut(rows)

    # Benjamini-Hochberg on the histogram: the largest p whose rank allows it
    bin_ = F.least(F.lit(BINS), F.floor(-F.log(F.greatest(F.col("s.t.p"), F.lit(1e-300))) / BIN)).cast("int")
    bins = rows.select(F.explode("runs").alias("s")).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("rank", F.sum("n").over(total)).withColumn("m", F.sum("n").over(Window.partitionBy()))
    least = bins.where(F.exp(-F.col("bin") * BIN) <= fdr * F.col("rank") / F.col("m")).agg(F.min("bin")).first()[0]
    limit = math.exp(-least * BIN) if least is not None else -1.0

    def found(s):
        t = s["t"]
        alone = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (t["p"] <= limit) & (F.abs(t["runs"]) <= BATTERY_Z) & (F.abs(t["serial"]) <= BATTERY_Z) & alone
    random = F.transform(F.filter("runs", found), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name")))
    return rows.select("doc_id", "base", random.alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """The columns that sum a scan up: counts, a hash of the base spans and all spans as text."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["name"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
