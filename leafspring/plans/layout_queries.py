"""Queries over figures, equations, lists, page ranges and letter repair. A line
item of an order stands for a layout item of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import document as D, layout as L, ranges as R, translation as X


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# (order, line number) can repeat, an item's place can't
ORD = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)"
# figures have 0 to 3 labelled captions
KIND = "element_at(array('image', 'image', 'image', 'table', 'equation', 'list', 'code', 'text'), cast(l_partkey % 8 + 1 as int))"
CAPTIONS = "transform(filter(array(0, 1, 2), j -> j < l_suppkey % 4), j -> concat('Fig. ', ord * 10 + j, ': Part one. Part two.'))"


def items(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").selectExpr("*", f"{ORD} as ord").selectExpr(
        "l_orderkey as doc_id", "ord", f"{KIND} as type", "cast(ord div 5 as int) as page_idx",
        "case l_partkey % 8 when 4 then if(l_quantity > 25, concat('$$a \\\\tag{', ord, '}$$'), '$$b$$') when 6 then concat('code ', ord) when 7 then 'Plain text.' end as text",
        "cast(null as int) as text_level", "concat('i', ord, '.png') as img_path",
        f"case when l_partkey % 8 < 4 then {CAPTIONS} end as image_caption",
        "case when l_partkey % 8 = 5 then array(concat('A. ', ord), ' ', 'B. C.') end as list_items",
    )


def layout(spark, sf_dir):
    return L.image_names(L.elements(items(spark, sf_dir))).select(
        "doc_id", "ord", "page", "element", "kind", "number", "labeled", "file_name", "text", F.array_join("sentences", "|").alias("sentences"), F.col("unknown_number").cast("long").alias("unknown_number")
    )


def _toc(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.selectExpr("o_custkey as doc_id", "o_orderkey as toc_ord", "cast(1 as int) as level", "o_orderkey * 7 % 97 + 1 as page", "cast(100 as bigint) as page_count")


def _labels(spark, sf_dir):
    return _table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "o_orderkey * 7 % 97 + 1 as page", "if(o_custkey % 2 = 0 and o_orderkey % 3 = 0, 'cover', if(o_custkey % 5 = 0, 'iv', cast(o_orderkey as string))) as label")


def body(spark, sf_dir):
    return R.body_entries(_toc(spark, sf_dir), _labels(spark, sf_dir)).select("doc_id", "toc_ord", "page")


def chapter_hull(spark, sf_dir):
    """From chapter 2 to the end of chapter 4, of documents that have four."""
    docs = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).count().where("count >= 4")
    return R.resolve_ranges(docs, chapters="4, 2-3", toc=_toc(spark, sf_dir))


def specs(spark, sf_dir):
    """Chapter specs as numbers."""
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(o_orderkey % 7 + 1, ', ', o_orderkey % 3 + 2, '-', o_orderkey % 3 + 2 + o_custkey % 4, if(o_custkey % 2 = 0, ',', '')) as spec")
    return d.select("o_orderkey", "spec", F.array_join(D.chapter_numbers(F.col("spec")), "|").alias("chapters"))


def label_range(spark, sf_dir):
    """The first page with the label 'iv', and the first cover."""
    labels = _labels(spark, sf_dir)
    iv, cover = D.label_pages(labels, " IV "), D.label_pages(labels, "cov").withColumnRenamed("page", "cover")
    return iv.join(cover, "doc_id", "full")


def known(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("pos < 50")
    lexicon = words.groupBy(F.lower("word").alias("word")).count().where("count >= 10").select("word")
    return D.known_words(words, lexicon)


def letters(spark, sf_dir):
    d = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('Let z be $z$ and x (w) of ', l_linenumber, ' or zz.') as en_text", "concat('値z は$z$で、x）と(w)と', l_linenumber, 'のv。') as ja_text"
    )
    return X.repair_math(d).select("l_orderkey", "l_linenumber", "en_text", "ja_text")


QUERIES = {
    "layout_elements": layout, "body_entries": body, "chapter_hull": chapter_hull, "letter_repair": letters, "chapter_specs": specs, "label_pages": label_range, "known_words": known,
}

_LAYOUT = f"""
with p as (select *, {ORD} as ord from lineitem),
i as (select l_orderkey as doc_id, ord::int as ord, ord // 5 + 1 as page, l_partkey % 8 as m, l_partkey % 8 < 4 as fig, l_suppkey % 4 as k, l_quantity > 25 as tagged,
  row_number() over (partition by l_orderkey, ord // 5 order by ord) as rn from p),
b as (select *, fig and k = 0 as bare from i),
r as (select *, rn - 1 - coalesce(max(case when not bare then rn end) over (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding), 0) as run from b),
g as (select *, case when fig and k > 1 then least(k - 1, run) else 0 end as given from r),
n as (select a.*, c.rn - a.rn as away, c.given as g2, c.ord as o2 from g a left join g c on a.bare and c.doc_id = a.doc_id and c.page = a.page and c.rn =
  (select min(x.rn) from g x where x.doc_id = a.doc_id and x.page = a.page and x.rn > a.rn and not x.bare)),
l as (select *, case when bare and away <= g2 then o2 * 10 + g2 - away when fig and k > 0 then ord * 10 + given end as lab,
  sum(case when bare or (m = 4 and not tagged) then 1 else 0 end) over (partition by doc_id, page order by ord) as seq,
  row_number() over (partition by doc_id, page, m order by ord) as un from n),
o as (select *, case when fig then 'figure' when m = 4 then 'equation' when m = 5 then 'list' else 'unknown' end as element,
  case when fig then case when lab is not null then 'figure' when m = 3 then 'table' else 'figure' end end as kind,
  case when fig then coalesce(lab, seq) when m = 4 then case when tagged then ord else seq end end::int as number,
  case when fig then lab is not null when m = 4 then tagged end as labeled from l where m <> 7)
select doc_id, ord, page::int as page, element, kind, number, labeled,
  case when element in ('figure', 'equation') then (case when m = 4 then 'eq' when kind = 'table' then 'table' else 'fig' end) || '_p' || page || (case when labeled then '_' else '_unlabeled' end) || number || '.png' end as file_name,
  case when m = 4 then case when tagged then 'a \\tag{{' || ord || '}}' else 'b' end when m = 6 then 'code ' || ord end as text,
  case when lab is not null then 'Fig. ' || lab || ': Part one.|Part two.' when m = 5 then 'A. ' || ord || '|B. C.' end as sentences,
  case when m = 6 then un end as unknown_number from o
"""
_BODY = """
with t as (select o_custkey as doc_id, o_orderkey as toc_ord, o_orderkey * 7 % 97 + 1 as page,
  case when o_custkey % 2 = 0 and o_orderkey % 3 = 0 then 'cover' when o_custkey % 5 = 0 then 'iv' else 'number' end as label from orders),
d as (select doc_id, page, max((label = 'number')::int) as body from t group by all),
j as (select t.*, body, max(body) over (partition by doc_id) as numbered from t join d using (doc_id, page))
select doc_id, toc_ord, page from j where body = 1 or numbered = 0
"""
_HULL = """
with t as (select o_custkey as doc_id, o_orderkey * 7 % 97 + 1 as page, row_number() over (partition by o_custkey order by o_orderkey) as chapter from orders),
e as (select a.*, coalesce((select min(page) from t b where b.doc_id = a.doc_id and b.page > a.page) - 1, 100) as last from t a)
select doc_id, min(page) as first_page, max(last)::bigint as last_page from e where chapter in (2, 3, 4) group by doc_id having count(*) = 3
"""
_SPECS = """
with s as (select o_orderkey, o_orderkey % 7 + 1 as a, o_orderkey % 3 + 2 as b, o_orderkey % 3 + 2 + o_custkey % 4 as c, o_custkey from orders)
select o_orderkey, a || ', ' || b || '-' || c || case when o_custkey % 2 = 0 then ',' else '' end as spec, array_to_string(list_sort(list_distinct(list_append(range(b, c + 1), a))), '|') as chapters from s
"""
_LABELS = """
with t as (select o_custkey as doc_id, o_orderkey * 7 % 97 + 1 as page, case when o_custkey % 2 = 0 and o_orderkey % 3 = 0 then 'cover' when o_custkey % 5 = 0 then 'iv' end as label from orders)
select doc_id, min(page) filter (label = 'iv') as page, min(page) filter (label = 'cover') as cover from t where label is not null group by doc_id
"""
_KNOWN = """
with w as (select doc_id, ws[i] as word, (i - 1)::int as pos from (select doc_id, string_split(text, ' ') as ws from documents), unnest(range(1, len(ws) + 1)) as r(i) where i <= 50),
lex as (select lower(word) as word from w group by 1 having count(*) >= 10)
select *, word <> '' and (lower(word) in (select word from lex) or length(word) = 1) as known from w
"""
_LETTERS = """
select l_orderkey, l_linenumber, 'Let $z$ be $z$ and $x$ (w) of ' || l_linenumber || ' or zz.' as en_text, '値$z$ は$z$で、$x$）と(w)と' || l_linenumber || 'のv。' as ja_text from lineitem
"""
ORACLE_SQL = {"layout_elements": _LAYOUT, "body_entries": _BODY, "chapter_hull": _HULL, "letter_repair": _LETTERS, "chapter_specs": _SPECS, "label_pages": _LABELS, "known_words": _KNOWN}
