"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text becomes a sequence of template words: numbers, units after a number and names (a capitalised word
inside a sentence) become typed placeholders, the rest is lower-cased, and everything
else separates.  Windows of ``WIDTH`` template words are hashed at every place of a benchmark item and of a
document, so any common run of ``WIDTH`` template words has a window on both sides, wherever it stands;
items shorter than that are windows of their own length.  A hash join finds them.  Matches of a document and
an item at one alignment cover the words under their windows and between two of them, if those are ``2 * WIDTH``
words at most (rewritten words).  They are a leak if they cover half of the item or ``LONG`` words, and if
the slots there are consistent: wherever the item repeats a value, the document repeats one too, and the other
way round, as in a re-parameterised question.

Results.  (doc_id, item_id, item_words, covered_words, n_slots, n_changed) per leaked pair, once however often it
occurs, with its longest run.  Null, empty or wordless texts on either side match nothing.  Windows of
fewer than ``LITERAL`` words that are no placeholders (all of them, in windows of fewer words) would match any
table of numbers; they are matched by their values, so that such items are found word for word.  Null ids are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded, cut, prepare

WIDTH, SHARE, LONG, LITERAL = 8, 0.5, 20, 3
#: Unit words after a number (fixed).
UNITS = ("kg|g|mg|km|m|cm|mm|mi|miles?|feet|ft|inch(?:es)?|l|ml|lit(?:re|er)s?|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|"
         "dollars?|cents?|euros?|pounds?|percent|degrees?|kmh|mph|watts?|kw|kwh|volts?|grams?|met(?:re|er)s?")
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
NAME = r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+"


def marked(text: Column, keep: bool) -> Column:
    """The text with placeholders 0 (number), 2 (unit) and 1 (name); ``keep``: with their values, between two control characters."""
    def slot(code: str, group: str) -> str:
        return f" {code}\u0001{group}\u0002 " if keep else f" {code} "
    t = F.translate(text, "\u0001\u0002", "  ")
    t = F.regexp_replace(t, f"({NUMBER})", slot("0", "$1"))
    after = "\u0002" if keep else "0"
    t = F.regexp_replace(t, f"{after} +((?i:{UNITS}))(?!\\p{{L}})", f"{after} " + slot("2", "$1"))
    return F.regexp_replace(t, f"({NAME})", slot("1", "$1"))


def template_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(marked(text, False)), r"[^\p{L}0-2]+"), "")


def slotted_words(text: Column) -> Column:
    """The same words, placeholders with their values: as many, at the same places."""
    return F.regexp_extract_all(F.lower(marked(text, True)), F.lit("[012]\u0001[^\u0002]*\u0002|\\p{L}+"), F.lit(0))


def _windows(words: str, width: int) -> Column:
    """Hashes of the windows at every place."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (width - 1), F.lit(1)), lambda i: F.xxhash64(F.slice(F.col(words), i, width)))
    return F.when(n >= width, hashes).otherwise(F.expr("array()").cast("array<bigint>"))


def _poor(words: str, width: int, literal: int) -> Column:
    """Places (from 1) of the windows with fewer than ``literal`` words that are no placeholders."""
    need = width - min(literal, width) + 1                                  # placeholders in such a window
    slots = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin("0", "1", "2"))

    def around(x: Column) -> Column:
        """Of each run of ``need`` placeholders that one window holds, the windows that hold it."""
        runs = F.transform(F.sequence(F.lit(1), F.size(x) - (need - 1), F.lit(1)), lambda j: F.struct(
            F.element_at(x, j + (need - 1)).alias("last"), F.element_at(x, j).alias("first")))
        runs = F.filter(runs, lambda r: (r["last"] - r["first"] < width))
        return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(
            F.greatest(r["last"] - (width - 1), F.lit(1)), F.least(r["first"], F.size(words) - (width - 1)), F.lit(1)))))
    found = F.get(F.transform(F.array(slots), lambda x: F.when(F.size(x) >= need, around(x))), 0)
    return F.when(F.size(words) >= width, F.coalesce(found, F.expr("array()").cast("array<int>"))).otherwise(F.expr("array()").cast("array<int>"))


def _hashes(texts: DataFrame, width: int, literal: int, *columns: str) -> DataFrame:
    """The ``columns`` with (at, hash, poor) for each window at every place, and ``by_value`` for those of values."""
    rows = texts.select(*columns, "text", "tokens", _poor("tokens", width, literal).alias("poor"))
    rows = rows.withColumn("values", F.when(F.size("poor") > 0, F.transform(F.array(slotted_words(F.col("text"))), lambda v: F.transform(
        "poor", lambda i: F.xxhash64(F.slice(v, i, width))))[0]).otherwise(F.expr("array()").cast("array<bigint>")))
    rows = rows.withColumn("n", F.greatest(F.size("tokens") - (width - 1), F.lit(0)))
    rows = rows.select(*columns, "n", "poor", F.posexplode(F.concat(_windows("tokens", width), "values")).alias("pos", "hash"))
    by_value = F.col("pos") >= F.col("n")
    return rows.select(*columns, "hash", "poor", by_value.alias("by_value"),
                       F.when(by_value, F.get("poor", F.col("pos") - F.col("n")) - 1).otherwise(F.col("pos")).alias("at"))


def _join(docs: DataFrame, items: DataFrame, width: int, literal: int) -> DataFrame:
    """Windows in common: (key, item, words, at, shift), shift being the place in the document less that in the item."""
    own = _hashes(items, width, literal, "item", "words")
    own = own.where(F.col("by_value") | ~F.array_contains("poor", F.col("at") + 1)).select("item", "words", "at", "hash")
    theirs = _hashes(docs, width, literal, "key").select("key", F.col("at").alias("place"), "hash")
    return theirs.join(bounded(own), "hash").select("key", "item", "words", "at", (F.col("place") - F.col("at")).alias("shift"), F.lit(width).alias("width"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          width: int = WIDTH, share: float = SHARE, long: int = LONG, literal: int = LITERAL) -> DataFrame:
    """Leaked pairs, with ``text_hash`` to tell rows of one id apart."""
    prepare(docs.sparkSession)
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    texts = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.struct(F.col(item_col).cast("long").alias("item_id"), F.xxhash64(F.col(item_text).cast("string")).alias("text_hash")).alias("item"),
                             F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    items = cut(items.withColumn("tokens", template_words(F.col("text"))).withColumn("words", F.size("tokens")).where("words > 0"))
    tokens = texts.select("key", "text", template_words(F.col("text")).alias("tokens"))
    hits = _join(tokens, items.where(F.col("words") >= width), width, literal)
    # at most width - 1 lengths
    for r in items.where(F.col("words") < width).select("words").distinct().collect():
        hits = hits.union(_join(tokens, items.where(F.col("words") == r.words), r.words, literal))
    runs = hits.groupBy("key", "item", "words", "shift", "width").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # the item's places (from 1) from each window to the next, or to its own end if the next is far
    after = lambda k: F.get("at", k + 1)
    runs = runs.withColumn("places", F.flatten(F.transform("at", lambda a, k: F.sequence(
        a + 1, F.when(after(k) - a <= 3 * F.col("width"), after(k)).otherwise(a + F.col("width"))))))
    runs = runs.withColumn("covered", F.size("places")).drop("at", "width")
    runs = runs.where((F.col("covered") >= F.col("words") * share) | (F.col("covered") >= long))
    runs = cut(runs)

    said = items.select("item", slotted_words(F.col("text")).alias("item_words"))
    rows = texts.join(bounded(runs.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).select("key", slotted_words(F.col("text")).alias("doc_words"))
    both = runs.join(rows, "key").join(bounded(said), "item")
    pairs = F.transform("places", lambda i: F.struct(
        F.element_at("item_words", i.cast("int")).alias("a"), F.element_at("doc_words", (i + F.col("shift")).cast("int")).alias("b")))
    slots = F.array_distinct(F.filter(pairs, lambda p: p["a"].rlike("^[012]")))
    both = both.select("key", "item", "words", "covered", slots.alias("slots"))
    left, right = F.array_distinct(F.col("slots.a")), F.array_distinct(F.col("slots.b"))
    both = both.where((F.size(left) == F.size("slots")) & (F.size(right) == F.size("slots")))
    both = both.withColumn("changed", F.size(F.filter("slots", lambda p: p["a"] != p["b"])))
    best = both.groupBy("key", "item").agg(F.max(F.struct("covered", "words", F.size("slots").alias("slots"), "changed")).alias("x"))
    return best.select("key.doc_id", "key.text_hash", "item.item_id", F.col("x.words").cast("long").alias("item_words"), F.col("x.covered").cast("long").alias("covered_words"),
                       F.col("x.slots").cast("long").alias("n_slots"), F.col("x.changed").cast("long").alias("n_changed")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that leak no item of ``benchmark``."""
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **params)
    bad = cut(bad.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct())
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__h"))
    return docs.join(bounded(bad), on, "left_anti")
