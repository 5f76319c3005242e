"""Queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, htmltext, licenses, neardup, packing, quality, rnnlm, substring, tokenfile, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select("doc_id", "text"), model).drop("text")


def op3_html(spark, sf_dir):
    return htmltext.extract_main_text(table(spark, sf_dir, "pages"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_vectors(spark, sf_dir):
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_tokens(spark, sf_dir):
    return tokenfile.token_table(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_language_model(spark, sf_dir):
    return rnnlm.score_documents(table(spark, sf_dir, "documents"))


def op8_substrings(spark, sf_dir):
    return substring.passage_digest(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_html, op4_decontamination, op5_vectors, op6_tokens, op7_language_model, op8_substrings, op9_near_duplicates, op10_licenses)}

#: Windows of 13 words, compared whole; words as in the operator.
SUBSTRING_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
w as (select doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') as win from d, unnest(range(1, len(words) - 11)) as u(i)),
f as (select win, min(doc_id) as first from w group by win),
r as (select distinct w.doc_id, w.i + k as pos from w join f using (win), range(13) as t(k) where f.first < w.doc_id),
g as (select doc_id, list(pos) as gone, count(*) as n from r group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256
from d left join g on d.doc_id = g.doc_id
"""

#: Every pair that shares a shingle, counted; components as all that can be reached.
NEAR_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
s as (select distinct doc_id, array_to_string(list_slice(words, i, i + 2), ' ') as shingle from d, unnest(range(1, greatest(2, len(words) - 1))) as u(i) where len(words) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
reach(doc_id, r) as (select doc_id, doc_id from d union select reach.doc_id, e.b from reach join e on reach.r = e.a)
select reach.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(r) as component_id, reach.doc_id = min(r) as kept from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
"""
#: All pairs of a label, by cosine in double precision.
VECTOR_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
u as (select * from v where label is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
n as (select a, count(*) as n from e group by a),
reach(vec_id, r) as (select vec_id, vec_id from v union select reach.vec_id, e.b from reach join e on reach.r = e.a)
select reach.vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(r) as component_id, reach.vec_id = min(r) as kept from reach left join n on n.a = reach.vec_id group by reach.vec_id
"""

ORACLE_SQL = {"op5_vectors": VECTOR_SQL, "op9_near_duplicates": NEAR_SQL, "op8_substrings": SUBSTRING_SQL, "op10_licenses": licenses.oracle_sql()}
