"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import (chat, decontam, html_crf, kneser_ney, line_dedup, mtree, ngram_join, packing, secret_scan, segment_bpe,
                          spelling, string_kernel, whitening)
from lakeloom.llm.common import prepare
from lakeloom.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the operators that SQL can express; tests hold the others against brute force.
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf, "documents"), min_words=line_dedup.EVERY)


ORACLES["op2_exact_topk"] = """
with fine as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::bigint as score
  from fine q join fine v on q.vec_id <> v.vec_id
  where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""


@query
def op2_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return mtree.top_k(load(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_quality_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return kneser_ney.judge(load(spark, sf, "documents"), load(spark, sf, "labels").where("quality = 1"))


@query
def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_documents(load(spark, sf, "documents"))


@query
def op5_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_crf.extract(load(spark, sf, "pages"))


@query
def op6_template_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.leaks(load(spark, sf, "documents"), load(spark, sf, "benchmark")).drop("text_hash").distinct()


@query
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    # conversation -1: two turns that hold the template's own control strings
    said = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_chats(chat.format_chats(turns.union(said)))


@query
def op8_secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(load(spark, sf, "documents")))


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    def held(column: str):
        return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))
    labels = load(spark, sf, "labels").where(~held("doc_id"))
    scored = string_kernel.score(load(spark, sf, "documents"), labels)
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return packing.pack(load(spark, sf, "documents"))


ORACLES["op11_spelling_variants"] = """
with recursive bits as (                                                   -- the table of crc32
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
                          lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) as r(i)
), runs as (
  select doc_id, run, count(*) as n, hex(coalesce(doc_id::varchar, '') || ':' || run) as hx
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents)
  group by doc_id, run
), hashed as (
  select run, n, xor(4294967295, list_reduce([4294967295]::bigint[] || list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint),
                                             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as h
  from runs, bits
), cut as (
  select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed
), words as materialized (
  select word, sum(n)::bigint as n from cut where length(word) >= 5 group by word having sum(n) >= 3
), places as materialized (
  select word, n, left(word, i) as head, substr(word, i + 2) as tail from (select word, n, unnest(range(0, length(word))) as i from words)
), shorter as (
  select distinct p.word as a, w.word as b from places p join words w on w.word = p.head || p.tail
), near as (
  select a, b from shorter union all select b, a from shorter
  union all select x.word, y.word from places x join places y on x.head = y.head and x.tail = y.tail and x.word <> y.word
), best as (
  select a as word, count(*) as n_near, first(b order by w.n desc, b) as top, max(w.n) as top_n
  from near join words w on w.word = near.b group by a
), forms as (
  select w.word, case when top_n >= 2 * w.n then top end as form, w.n, coalesce(n_near, 0) as n_near, case when top_n >= 2 * w.n then top_n end as form_n
  from words w left join best on best.word = w.word
), chain as (
  select word, word as at, form as up from forms
  union all select c.word, f.word, f.form from chain c join forms f on f.word = c.up
)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word where c.up is null
"""


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(load(spark, sf, "documents"))


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(load(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_segment_bpe(spark: SparkSession, sf: str) -> DataFrame:
    found = segment_bpe.decode(segment_bpe.encode(load(spark, sf, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
