"""Substring search with an index (P7): pieces of one to three characters and the rows that hold them.

Rows get a number when the index is built; 32,768 successive numbers are a block.  A posting says which rows of a block
hold a piece, as one bitmap.  A pattern's literal runs (between ``%``, ``_`` and escapes) give the pieces that a match must
hold: its 3-character pieces, or the run itself if it is shorter, or, without any literal, the empty piece that every row
holds.  So all patterns, however short, take the same plan: postings of the pattern's pieces, an AND over the bitmaps of a
block that has them all, the rows whose bits are left, and ``ILIKE`` on these rows alone.

Texts and patterns are compared in lower case, as ``ILIKE`` does.  NULL texts match nothing, NULL patterns find nothing,
and the empty pattern finds every text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a piece.
WIDTH = 3


def _pieces(text: Column, width: int) -> Column:
    """The pieces of ``width`` characters of a text, none if it is shorter."""
    starts = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, width))


def text_pieces(text: Column) -> Column:
    """Distinct pieces of 1 to WIDTH characters of a text, and the empty one."""
    low = F.lower(text)
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(low, w) for w in range(1, WIDTH + 1)]))


def pattern_pieces(pattern: Column) -> Column:
    """Distinct pieces that every text must hold that contains ``pattern``."""
    runs = F.filter(F.split(F.lower(pattern), r"[%_\\]+", -1), lambda r: r != "")
    pieces = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < WIDTH, F.array(r)).otherwise(_pieces(r, WIDTH))))
    return F.when(F.size(pieces) > 0, F.array_distinct(pieces)).otherwise(F.array(F.lit("")))


def _held(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` (from 0) of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1


@dataclass
class TextIndex:
    """An index under ``path``: the rows with their numbers, and the postings in the order of pieces."""

    spark: SparkSession
    path: str
    text: str

    @classmethod
    def build(cls, df: DataFrame, text: str, path: str) -> TextIndex:
        """Write the rows, numbered once and for all, and their postings; files of postings hold ranges of pieces."""
        df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__block", F.bitmap_bucket_number("__row")).write.parquet(f"{path}/rows")
        index = cls(df.sparkSession, path, text)
        index._post(index.rows())
        return index

    def append(self, df: DataFrame) -> None:
        """Add rows: they get numbers above all others and postings of their own; nothing there is written again.

        Postings come first, so that a row which readers see can be found; those of a killed run are refused by ``ILIKE``.
        One writer at a time."""
        top = self.rows().agg(F.max("__row")).first()[0]
        start = 0 if top is None else ((top >> 15) + 1) << 15
        stage = f"{self.path}/staged/{uuid.uuid4().hex}"
        numbered = df.withColumn("__row", F.monotonically_increasing_id() + F.lit(start)).withColumn("__block", F.bitmap_bucket_number("__row"))
        numbered.write.mode("overwrite").parquet(stage)
        numbered = self.spark.read.schema(numbered.schema).parquet(stage)
        self._post(numbered, "append")
        numbered.write.mode("append").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _post(self, rows: DataFrame, mode: str = "errorifexists") -> None:
        pieces = rows.where(F.col(self.text).isNotNull()).select("__block", "__row", F.explode(text_pieces(F.col(self.text))).alias("piece"))
        posts = pieces.groupBy("piece", "__block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("__row")).alias("bits"))
        posts.repartitionByRange("piece", "__block").sortWithinPartitions("piece", "__block").write.mode(mode).parquet(f"{self.path}/postings")

    def candidates(self, patterns: DataFrame, pattern_id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
        """(pattern_id, pattern, __block, bits): the rows of every block that hold all pieces of a pattern."""
        p = patterns.where(F.col(pattern).isNotNull()).select(pattern_id, pattern, pattern_pieces(F.col(pattern)).alias("pieces"))
        wanted = p.select(pattern_id, pattern, F.size("pieces").alias("n"), F.explode("pieces").alias("piece"))
        # a block may have several postings of a piece if an append was run again; bitmaps of one piece add up first
        posts = wanted.join(self.postings(), "piece").groupBy(pattern_id, pattern, "n", "__block", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        found = posts.groupBy(pattern_id, pattern, "n", "__block").agg(F.count("*").alias("pieces"), F.bitmap_and_agg("bits").alias("bits"))
        return found.where((F.col("pieces") == F.col("n")) & (F.bitmap_count("bits") > 0)).select(pattern_id, pattern, "__block", "bits")

    def search(self, patterns: DataFrame, pattern_id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
        """(pattern_id, the rows' columns) of every row whose text contains a pattern, wildcards and escapes as in ``ILIKE``."""
        rows = self.rows()
        left = self.candidates(patterns, pattern_id, pattern).withColumnsRenamed({pattern_id: "__pid", pattern: "__pattern", "__block": "__b"})
        at = F.bitmap_bit_position("__row")
        hits = rows.join(left, (F.col("__block") == F.col("__b")) & _held(F.col("bits"), at))
        hits = hits.where(F.expr(f"`{self.text}` ilike concat('%', __pattern, '%')"))
        return hits.select(F.col("__pid").alias(pattern_id), *[c for c in rows.columns if c not in ("__row", "__block")])
