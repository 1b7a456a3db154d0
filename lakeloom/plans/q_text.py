"""Registered document and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalar import round6
from lakeloom.functions.text import line_break_pattern, whitespace_chars, ws_class
from lakeloom.operators import text as X
from lakeloom.operators.vectors import label_centroids, topk_cosine
from lakeloom.plans.registry import register
from lakeloom.session import spread
from lakeloom.sources.tables import load


@register("page_text_rows")
def q_page_text_rows(s, d):
    return X.page_text(spread(load(s, d, "pages")))


@register("page_raw_text")
def q_page_raw_text(s, d):
    return X.page_text(spread(load(s, d, "pages")), raw=True)


def _md_sql(col: str) -> str:
    nl, ws = line_break_pattern("re2"), ws_class("re2")
    chars = "".join(f"chr({ord(c)})" if i == 0 else f" || chr({ord(c)})" for i, c in enumerate(whitespace_chars()))
    lines = (f"list_filter(list_transform(regexp_split_to_array({col}, '{nl}'), "
             f"lambda x: trim(x, {chars})), lambda x: x <> '')")
    fmt = (f"list_transform({lines}, lambda x: case "
           f"when x = upper(x) and x <> lower(x) and len(regexp_split_to_array(x, '{ws}+')) < 10 then '## ' || x "
           f"when suffix(x, ':') then '**' || x || '**' else x end)")
    nn = "chr(10) || chr(10)"
    return (f"case when {col} is null then null when len({fmt}) > 0 then "
            f"array_to_string({fmt}, {nn}) || {nn} || chr(10) || '---' else '---' end")


@register("text_to_markdown", oracle=f"""
select doc_id, {_md_sql('text')} as markdown from documents""")
def q_text_to_markdown(s, d):
    docs = spread(load(s, d, "documents"))
    return docs.select("doc_id", X.text_to_markdown(F.col("text")).alias("markdown"))


@register("markdown_roundtrip", oracle=f"""
select doc_id, {X.markdown_rules_sql(_md_sql('text'))} as plain from documents""")
def q_markdown_roundtrip(s, d):
    docs = spread(load(s, d, "documents"))
    return docs.select("doc_id", X.markdown_to_text(X.text_to_markdown(F.col("text"))).alias("plain"))


_SYS = X.DEFAULT_SYSTEM_PROMPT.replace("'", "''")


@register("conversation_messages", oracle=f"""
select conv_id, cast(0 as bigint) as pos, 'system' as role, '{_SYS}' as content
from (select distinct conv_id from conversations) c
union all
select conv_id, cast(turn + 1 as bigint) as pos, role, text as content from conversations""")
def q_conversation_messages(s, d):
    return X.conversation_messages(load(s, d, "conversations"))


@register("conversation_transcript", oracle=f"""
with m as (
  select conv_id, cast(0 as bigint) as pos, 'system' as role, '{_SYS}' as content
  from (select distinct conv_id from conversations) c
  union all
  select conv_id, cast(turn + 1 as bigint) as pos, role, text as content from conversations)
select conv_id, string_agg(role || ': ' || content, chr(10) || chr(10) order by pos) as full_text,
  count(*) as pages
from m group by conv_id""")
def q_conversation_transcript(s, d):
    m = X.conversation_messages(load(s, d, "conversations"))
    m = m.withColumn("line", F.concat_ws(": ", "role", "content"))
    return X.assemble_pages(m, "conv_id", "pos", "line")


@register("semantic_topk", oracle="""
with d as (
  select label, i, avg(v) as c from (
    select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) x
  group by label, i),
c as (select label, list(c order by i) as centroid from d group by label),
s as (select cast(c.label as bigint) as query_id, e.vec_id,
        list_cosine_similarity(e.embedding::double[], c.centroid) as score
      from embeddings e cross join c)
select query_id, vec_id, round(score, 6) as score, rank from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) x
where rank <= 5""")
def q_semantic_topk(s, d):
    emb = load(s, d, "embeddings")
    r = topk_cosine(emb, label_centroids(emb), k=5)
    return r.select("query_id", "vec_id", round6("score").alias("score"), "rank")
