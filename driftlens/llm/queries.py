"""The ten operators applied to their whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import decontamination, html_text, jaccard_join, language_id, packing, pii, secrets, token_counts, top_k, url_filter
from driftlens.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_url_filter,
        op3_pii_surrogates,
        op4_benchmark_decontamination,
        op5_html_extraction,
        op6_secret_scan,
        op7_token_counts,
        op8_packing,
        op9_exact_top_k,
        op10_language_id,
    )
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) end as sh
  from w),
e as (select doc_id, unnest(sh) as g from s),
n as (select doc_id, len(sh) as n from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b, c, x.n as na, y.n as nb from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edges as (select a as u, b as v from links union all select b, a from links),
reach as (select doc_id as u, doc_id as v from n union select reach.u, edges.v from reach join edges on reach.v = edges.u),
least as (select u, min(v) as component_id from reach group by u),
equal as (select u, count(*) as k from (select a as u from links where c = na and c = nb union all select b from links where c = na and c = nb) group by u)
select n.doc_id, n.n::bigint as n_shingles, least.component_id, (1 + coalesce(equal.k, 0))::bigint as n_equal
from n join least on least.u = n.doc_id left join equal on equal.u = n.doc_id""",
    "op9_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
}
