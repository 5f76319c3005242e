"""Registered queries of the document engine and their SQL. Layout items, tags
and tables of contents are derived from the standard tables, whole; the rules
that SQL restates are in rules.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import document as D, layout as L, render as R, translation as X
from . import layout_queries, rules as S


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items(spark, sf_dir):
    """A document's lines as layout items of all kinds, five to a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    d = d.selectExpr("*", f"{S.M} as m", f"{S.LEVEL} as lvl", f"{S.V} as v", f"{S.H} as h")
    return d.selectExpr(
        "doc_id", "ord", f"{S.TYPE} as type", "cast(ord div 5 as int) as page_idx", f"{S.TEXT} as text", "lvl as text_level",
        "if(m in (2, 3, 4), concat('i', ord, '.png'), null) as img_path", f"if(m = 2, array({S.CAPTION}, 'note'), null) as image_caption", f"if(m = 6, array(line, ' ', {S.ENTRY}), null) as list_items",
    )


def units(spark, sf_dir):
    return L.units(items(spark, sf_dir))


def prepared(spark, sf_dir):
    return X.prepare(units(spark, sf_dir)).select("doc_id", "ord", "pos", "tag", "en_text", "translatable", "protected", F.to_json("math_spans").alias("spans"), "context")


def repaired(spark, sf_dir):
    return X.merge_math(X.translate(units(spark, sf_dir)))


def last_pages(d):
    return d.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("last"))


def all_pages(spark, sf_dir):
    """Every document's pages, from the first to its own last."""
    d = items(spark, sf_dir)
    return R.page_markdown(L.units(d), 1, last_pages(d))


def bilingual_pages(spark, sf_dir):
    return R.bilingual_pages(repaired(spark, sf_dir))


def parsed(spark, sf_dir):
    d = R.parse_tagged(R.page_lines(all_pages(spark, sf_dir)))
    return d.select("doc_id", F.row_number().over(R.Window.partitionBy("doc_id").orderBy("ord")).alias("n"), "page", "tag", "kind", "en_text", "image_path")


def blocks(spark, sf_dir):
    return R.blocks(repaired(spark, sf_dir))


def block_list(spark, sf_dir):
    tags = F.array_join(F.transform("sentences", lambda s: s["tag"]), "|")
    return blocks(spark, sf_dir).select("doc_id", "block_id", "block_kind", F.col("level").cast("long").alias("level"), "role", tags.alias("tags"))


# Lines with every kind of maths, by line number; both engines read this.
LINE = (
    "case l_linenumber % 7 "
    "when 0 then concat('We set t = ', l_partkey, ' or xy = 3 with scale γβ and Ω, inside $a = ', l_suppkey, ' α$.') "
    "when 1 then concat('For $K$ >= ', cast(l_quantity as int), ' and P($A$, $B', l_suppkey, '$) we pay 5$ or $$x', chr(10), '$$ each.') "
    "when 2 then concat('値z と prob($A$|q, ', l_partkey, ') は b=', l_suppkey, 'である（x(t)）。') "
    f"when 3 then concat('With $u', l_partkey, '${S.IDEO}≤{S.IDEO}$v$ and longer($A$), _f($A$), g(x) stay; α', l_suppkey, '.') "
    "when 4 then concat('$p ', chr(92), 'textless ', l_partkey, ' ', chr(92), 'textgreater q$ and ', chr(92), 'textless stays, (ODE) and w', l_suppkey, '.') "
    "when 5 then concat('Plain line ', l_partkey, ' without any of it') "
    "else concat('β', l_suppkey, 'βΑγ and $c$ > $d', l_partkey, '$, $e$ > word; h ($A$).') end"
)


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(LINE).alias("t"))


def per_line(column):
    return lambda spark, sf_dir: lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "t", column(F.col("t")).alias("out"))


HEAD = (
    f"case l_linenumber % 7 when 0 then concat('Fig. ', l_partkey, ': A plot') when 1 then concat('figure', l_partkey, '.') when 2 then concat('TABLE.{S.NBSP}', l_partkey, ' : Rows') when 3 then concat('Fig.{S.IDEO}', l_partkey, ' shows') "
    f"when 4 then concat('A.', l_suppkey, '.{S.NBSP}Proofs of it') when 5 then concat(l_suppkey, '. intro', l_partkey) else concat('Figures ', l_partkey, ': no') end"
)


def heads(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(HEAD).alias("t"))
    t = F.col("t")
    return d.select("l_orderkey", "l_linenumber", "t", T.caption_kind(t).alias("kind"), T.caption_number(t).cast("long").alias("number"), T.heading_number(t).alias("num"), T.slugify(T.heading_name(t)).alias("slug"))


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


def toc(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("toc_ord"), F.expr("int(o_orderkey % 2 + 1)").alias("level"), F.expr("o_orderkey * 7 % 97 + 1").alias("page"), F.lit(100).cast("long").alias("page_count"))


TAG = "case l_linenumber % 7 when 0 then concat('P', l_orderkey, '-TITLE') when 1 then concat('P', l_orderkey, '-HEADING-', l_linenumber, '.2.references') when 2 then concat('P', l_orderkey, '-S3-1.intro-S', l_linenumber) when 3 then concat('P', l_orderkey, '-FIG2-CAPTION-S', l_linenumber) when 4 then concat('P', l_orderkey, '-EQ1-LATEX') when 5 then concat('P', l_orderkey, '-UNKNOWN-code-1') else concat('X', l_orderkey) end"


def tags(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(TAG).alias("tag"))
    tag = F.col("tag")
    return d.select("l_orderkey", "l_linenumber", "tag", T.classify_tag(tag).alias("kind"), T.section_slug(tag).alias("slug"), T.in_references(T.section_slug(tag)).alias("in_references"), T.paragraph_key(tag).alias("para"), T.heading_level(T.section_slug(tag)).cast("long").alias("level"))


def word_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").count()


def lexicon(spark, sf_dir):
    return word_counts(spark, sf_dir).where("count >= 20").select("word")


def compounds(spark, sf_dir):
    return D.restore_compounds(word_counts(spark, sf_dir).select("word"), lexicon(spark, sf_dir))


def hyphens(spark, sf_dir):
    """Documents' texts, normalised, with the hyphens of merged compounds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ord"), F.lit("text").alias("type"), "text")
    return L.normalise_items(d, lexicon(spark, sf_dir)).select("doc_id", "text")


def headings(spark, sf_dir):
    return D.label_items(L.normalise_items(items(spark, sf_dir))).select("doc_id", "ord", "page", "label", "is_heading", "heading_id", "section")


def counts(spark, sf_dir):
    return X.repair_counts(repaired(spark, sf_dir).withColumn("letters", F.lit(0)), "doc_id").drop("letters")


def leaks(spark, sf_dir):
    known = lexicon(spark, sf_dir).select(F.upper("word").alias("token"))
    return X.unknown_leaks(lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("tag"), F.col("t").alias("ja_text")), known.unionByName(known.sparkSession.createDataFrame([("(ODE)",)], "token string")))


QUERIES = {
    "sentence_split_counts": lambda s, d: sentences(s, d).groupBy("doc_id").agg(F.count("*").alias("n")),
    "sentence_explode": sentences,
    "front_matter_and_sections": headings,
    "sentence_units": lambda s, d: units(s, d).drop("reason"),
    "noise_filter": lambda s, d: D.drop_noise(items(s, d)).groupBy("type").agg(F.count("*").alias("n")),
    "document_context": lambda s, d: X.document_context(X.prepare(units(s, d))),
    "prepare_translation": prepared,
    "translation_context": lambda s, d: X.translation_context(units(s, d)).select("doc_id", "ord", "pos", "tag", "context"),
    "translate": lambda s, d: repaired(s, d).select("doc_id", "ord", "pos", "tag", "en_text", "ja_text"),
    "repair_counts": counts,
    "unknown_leaks": leaks,
    "paragraph_blocks": block_list,
    "block_html": lambda s, d: R.block_html(blocks(s, d)),
    "bilingual_html": lambda s, d: R.bilingual_html(blocks(s, d)),
    "document_html": lambda s, d: R.document_html(R.block_html(blocks(s, d), "ja"), "ja", "t"),
    "page_markdown": all_pages,
    "bilingual_pages": bilingual_pages,
    "parse_tagged": parsed,
    "wrap_letter_equals": per_line(T.wrap_letter_equals),
    "wrap_greek": per_line(T.wrap_greek),
    "protect_math": per_line(T.protect),
    "math_span_count": per_line(lambda t: F.size(T.math_spans(t)).cast("long")),
    "normalize_math": per_line(T.normalize_math),
    "leak_candidates": per_line(lambda t: F.array_join(T.leak_candidates(t), "|")),
    "function_calls": per_line(lambda t: T.replace_first(t, T.function_calls(t))),
    "comparisons": per_line(lambda t: T.replace_first(t, T.comparisons(t))),
    "caption_labels": heads,
    "tag_functions": tags,
    "html_escape": lambda s, d: table(s, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped")),
    "chapter_ranges": lambda s, d: D.chapter_ranges(toc(s, d)),
    "compound_restore": compounds,
    "hyphen_restore": hyphens,
    "content_fingerprint": lambda s, d: D.content_fingerprint(table(s, d, "documents")),
}

_SPLIT = f"with p as (select doc_id, {S.sentences('text')} as parts from documents)\n"


def _lines_sql(expr: str) -> str:
    return f"with l as (select l_orderkey, l_linenumber, {LINE} as t from lineitem) select l_orderkey, l_linenumber, t, {expr} as out from l"


_WORDS = "w as (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents), c as (select word, count(*) as n from w where word <> '' group by word), lex as (select word from c where n >= 20)"
_FIXED = "s as (select word, i, word[1:i] as a, word[i+1:] as b from o, unnest(range(3, length(word) - 2)) as u(i)), fix as (select word, min_by(a || '-' || b, i) as fixed from s where a in (select word from lex) and b in (select word from lex) group by word)"
_TAKEN = r"[\p{L}\p{M}\p{N}_]"
_HTML = "case block_kind when 'figure' then '<figure><img src=\"' || {img} || '\" alt=\"' || {tag} || '\"></figure>' when 'meta' then '<div class=\"byline\">' || {en} || '</div>' when 'equation' then '<div class=\"formula\">' || {en} || '</div>' "
_FIRST = {k: f"first({S.escaped(c)} order by ord, pos)" for k, c in (("img", "image_path"), ("tag", "tag"), ("en", "en_text"))}
_LEVEL = f"first({S.level(S.slug('tag'))} order by ord, pos)"


def _blocks_sql(inner: str) -> str:
    return f"with {S.REPAIRED}, {S.blocks('repaired')}, html as (select doc_id, block_id, {_HTML.format(**_FIRST)} {inner} end as html from block group by doc_id, block_id, block_kind)"


_MONO = f"when 'title' then '<h1>' || {_FIRST['en']} || '</h1>' when 'heading' then '<h' || {_LEVEL} || '>' || {_FIRST['en']} || '</h' || {_LEVEL} || '>' else string_agg('<p>' || {S.escaped('en_text')} || '</p>', '' order by ord, pos)"
_STRONG = [f"case when block_kind = 'title' then '<{x}strong>' else '' end" for x in ("", "/")]
_CELL = f"{_STRONG[0]} || {S.escaped('en_text')} || {_STRONG[1]}"
_PAIR = f"""else '<table class="pair' || case block_kind when 'title' then ' level-1' when 'heading' then ' level-' || {_LEVEL} else '' end || '">' || string_agg('<tr><td lang="en">' || {_CELL} || '</td><td lang="ja">' || {_CELL} || '</td></tr>', '' order by ord, pos) || '</table>'"""
_PAGES = f"pg as (select doc_id, page, string_agg({S.LINE}, chr(10) order by ord, pos) || chr(10) as body from units group by doc_id, page)"

ORACLE_SQL = {
    "sentence_split_counts": _SPLIT + "select doc_id, len(parts)::bigint as n from p where len(parts) > 0",
    "sentence_explode": _SPLIT + "select doc_id, (i - 1)::int as pos, parts[i] as sentence from p, unnest(range(1, len(parts) + 1)) as u(i)",
    "front_matter_and_sections": f"with {S.LABELLED} select doc_id, ord, page::int as page, label, is_heading, heading_id, section from se",
    "sentence_units": f"with {S.UNITS} select * from units",
    "noise_filter": f"with {S.ITEMS} select type, count(*) as n from it where type <> 'header' group by type",
    "document_context": f"with {S.CONTEXTS} select doc_id, doc as context from dc",
    "prepare_translation": f"with {S.PREPARED} select doc_id, ord, pos, tag, en_text, translatable, protected, case when translatable then to_json({S.spans('en_text')})::varchar end as spans, case when translatable then context end as context from prepared",
    "translation_context": f"with {S.PREPARED} select doc_id, ord, pos, tag, context from prepared where translatable",
    "translate": f"with {S.REPAIRED} select doc_id, ord, pos, tag, en_text, en_text as ja_text from repaired",
    "repair_counts": f"with {S.CONTEXTS}, r as (select doc_id, translatable, {S.call('en_text')} as c, en_text from pt) select doc_id, count(*) filter (translatable and c <> en_text)::bigint as calls, count(*) filter (translatable and {S.comparison('c')} <> c)::bigint as comparisons from r group by doc_id",
    "unknown_leaks": f"with l as (select l_orderkey as doc_id, l_linenumber::varchar as tag, {LINE} as t from lineitem), {_WORDS}, k as (select doc_id, tag, unnest(list_distinct({S.leaks('t')})) as token from l) select * from k where token <> '(ODE)' and token not in (select upper(word) from lex)",
    "paragraph_blocks": f"with {S.REPAIRED}, {S.blocks('repaired')} select doc_id, block_id, block_kind, case when block_kind = 'heading' then {_LEVEL} end::bigint as level, case when block_kind = 'meta' then first(kind order by ord, pos) end as role, string_agg(tag, '|' order by ord, pos) as tags from block group by doc_id, block_id, block_kind",
    "block_html": _blocks_sql(_MONO) + " select * from html",
    "bilingual_html": _blocks_sql(_PAIR) + " select * from html",
    "document_html": _blocks_sql(_MONO) + f" select doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang=\"ja\">' || chr(10) || '<head><meta charset=\"utf-8\"><title>t</title><style>{R.STYLE}</style></head>' || chr(10) || '<body>' || chr(10) || string_agg(html, chr(10) order by block_id) || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) as html from html group by doc_id",
    "page_markdown": f"with {S.UNITS}, {_PAGES}, lp as (select doc_id, max(page) as last from it group by doc_id), al2 as (select doc_id, unnest(range(1, last + 1))::int as page from lp) select doc_id, page, coalesce(body, chr(10)) as body from al2 left join pg using (doc_id, page)",
    "bilingual_pages": f"with {S.REPAIRED}, {_PAGES.replace('from units', 'from repaired')} select doc_id, page, body as en, body as ja from pg",
    "parse_tagged": f"with {S.UNITS} select doc_id, row_number() over (partition by doc_id order by ord, pos)::int as n, page, tag, kind, en_text, image_path from units",
    "wrap_letter_equals": _lines_sql(S.letters("t")),
    "wrap_greek": _lines_sql(S.greek("t")),
    "protect_math": _lines_sql(S.protected("t")),
    "math_span_count": _lines_sql(f"len({S.spans('t')})::bigint"),
    "normalize_math": _lines_sql(S.escapes("t")),
    "function_calls": _lines_sql(S.call("t")),
    "comparisons": _lines_sql(S.comparison("t")),
    "leak_candidates": _lines_sql(f"array_to_string({S.leaks('t')}, '|')"),
    "caption_labels": rf"""with l as (select l_orderkey, l_linenumber, {HEAD} as t from lineitem),
k as (select *, lower(regexp_extract(t, '(?i)^(figure|fig|table)[.]?[{S.B}]*[0-9]+[{S.B}]*[.:]', 1)) as name, regexp_extract(t, '^([A-Z0-9]+(?:[.][0-9]+)*)[.][{S.B}]+[^{S.B}]', 1) as num from l)
select l_orderkey, l_linenumber, t, case when name = 'table' then 'table' when name <> '' then 'figure' end as kind, case when name <> '' then regexp_extract(t, '[0-9]+')::bigint end as number, num,
  case when num = '' then 'section' else coalesce(nullif(lower(regexp_extract(regexp_replace(t, '^[A-Z0-9.]+[{S.B}]+', ''), '^[A-Za-z]+')), ''), 'section') end as slug from k""",
    "tag_functions": f"""with t as (select l_orderkey, l_linenumber, {TAG} as tag from lineitem),
s as (select *, {S.slug('tag')} as slug from t)
select l_orderkey, l_linenumber, tag, slug, case l_linenumber % 7 when 0 then 'title' when 1 then 'heading' when 2 then 'body_sentence' when 3 then 'caption_sentence' when 4 then 'equation_latex' else 'unknown' end as kind,
slug like '%references' as in_references, case l_linenumber % 7 when 2 then concat('P', l_orderkey, '-1.intro') when 3 then concat('P', l_orderkey, '-FIG2-CAPTION') else tag end as para,
case l_linenumber % 7 when 1 then 3 else 2 end::bigint as level from s""",
    "html_escape": f"select page_id, {S.escaped('html')} as escaped from pages",
    "chapter_ranges": "with t as (select o_custkey as doc_id, o_orderkey as toc_ord, o_orderkey % 2 + 1 as level, o_orderkey * 7 % 97 + 1 as page from orders), m as (select *, min(level) over (partition by doc_id) as top from t) select doc_id, row_number() over (partition by doc_id order by toc_ord) as chapter, page as first, coalesce(min(page) over (partition by doc_id order by page range between 1 following and unbounded following) - 1, 100)::bigint as last from m where level = top",
    "compound_restore": f"with {_WORDS}, o as (select word from c where length(word) >= 6 and n < 20), {_FIXED} select * from fix",
    "hyphen_restore": f"""with {_WORDS}, n as (select doc_id, {S.normal(S.strip('text'))} as t from documents),
o as (select distinct word from (select unnest(regexp_extract_all(t, '{_TAKEN}+')) as word from n) where regexp_full_match(word, '[a-z]{{6,}}') and word not in (select word from lex)), {_FIXED},
m as (select map(list(word), list(fixed)) as fixes from fix)
select doc_id, {S.outside('t', lambda s: f"array_to_string(list_transform(regexp_extract_all({s}, '{_TAKEN}+|[^{_TAKEN[1:]}+'), lambda w: coalesce(fixes[w], w)), '')")} as text from n, m""",
    "content_fingerprint": "select doc_id, sha256(text) as sha256 from documents",
}

QUERIES |= layout_queries.QUERIES
ORACLE_SQL |= layout_queries.ORACLE_SQL
