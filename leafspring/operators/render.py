"""Units as tagged pages, read back from them, and as HTML. Pages and blocks are
put together by document, where a chain of document windows leaves its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .document import so_far

IMAGES = ("figure_image", "equation_image")
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def line(column: str = "en_text") -> Column:
    """A unit's line on its page; images and LaTeX have an empty one after them."""
    tagged = F.concat(F.lit("["), F.col("tag"), F.lit("] "), F.coalesce(column, F.lit("")))
    image = F.concat(F.lit("!["), F.col("tag"), F.lit("]("), F.coalesce("image_path", F.lit("")), F.lit(") ["), F.col("tag"), F.lit("]\n"))
    return F.when(F.col("kind").isin(*IMAGES), image).when(F.col("kind") == "equation_latex", F.concat(tagged, F.lit("\n"))).otherwise(tagged)


def _in_order(value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", value.alias("x")))), lambda s: s["x"]), sep)


def page_texts(units: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, page, ...): the text of every page that has units, in a column for
    each of columns, name=column of units."""
    texts = [F.concat(_in_order(line(c), "\n"), F.lit("\n")).alias(name) for name, c in columns.items()]
    return units.groupBy("doc_id", "page").agg(*texts)


def bilingual_pages(units: DataFrame) -> DataFrame:
    """(doc_id, page, en, ja) of every page that has units."""
    return page_texts(units, en="en_text", ja="ja_text")


def page_markdown(units: DataFrame, first: int, last: int | DataFrame) -> DataFrame:
    """(doc_id, page, body): a page's tagged lines; pages of the range without units
    hold an empty line. last is a page, or (doc_id, last) with the last page of
    each document."""
    docs = last if isinstance(last, DataFrame) else units.select("doc_id", F.lit(last).alias("last")).distinct()
    # by document alone, so that texts dealt by document stay where they are
    bodies = page_texts(units, body="en_text").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "body"))).alias("bodies"))
    page = lambda p: F.struct(p.alias("page"), F.coalesce(F.try_element_at("bodies", p), F.lit("\n")).alias("body"))
    return docs.where(F.col("last") >= first).join(bodies, "doc_id", "left").select("doc_id", F.inline(F.transform(F.sequence(F.lit(first), F.col("last")), page)))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ord, line) of pages(doc_id, page, body)."""
    return pages.select("doc_id", "page", F.posexplode(F.split("body", LINE_END)).alias("ord", "line"))


def parse_tagged(lines: DataFrame) -> DataFrame:
    """Units of the tagged lines (doc_id, page, ord, line) of page files. An image
    line or a line '[P1-...] text' begins a unit; a blank line is skipped; one in
    brackets without a page is lost; any other goes on with the unit before it on
    its page, if there is one."""
    image, tagged = r"(?U)^!\[([^\]]+)\]\(([^)]+)\)\s\[[^\]]+\]\z", r"^\[([^\]]+)\]"
    d = lines.where(T.strip(F.col("line")) != "")
    is_image, is_tagged = F.col("line").rlike(image), F.col("line").rlike(tagged)
    d = d.withColumn("_image", is_image).withColumn("_any", F.when(is_image, F.regexp_extract("line", image, 1)).when(is_tagged, F.regexp_extract("line", tagged, 1)))
    d = d.withColumn("_new", F.coalesce(F.col("_any").rlike(r"^P\d+-"), F.lit(False))).where("_new or _any is null")
    order = Window.partitionBy("doc_id", "page").orderBy("ord")
    d = d.withColumn("_unit", F.count(F.when(F.col("_new"), 1)).over(so_far(order))).where("_unit > 0")
    head = F.when(F.col("_new"), F.struct("ord", F.col("_any").alias("tag"), "_image", F.regexp_extract("line", image, 2).alias("path"), F.regexp_replace("line", r"(?U)^\[[^\]]+\]\s?", "").alias("body")))
    more = F.collect_list(F.when(~F.col("_new"), F.struct("ord", T.strip(F.col("line")).alias("x"))))
    got = d.groupBy("doc_id", "page", "_unit").agg(F.max(head).alias("h"), F.transform(F.array_sort(more), lambda s: s["x"]).alias("more"))
    body = F.when(F.col("h._image"), "").otherwise(F.col("h.body"))
    text = F.when(F.size("more") > 0, T.strip(F.concat(F.regexp_replace(body, r"(?U)\s+\z", ""), F.lit(" "), F.array_join("more", " ")))).otherwise(body)
    kind = F.when(~F.col("h._image"), T.classify_tag(F.col("h.tag"))).when(F.col("h.tag").contains("-EQ"), "equation_image").otherwise("figure_image")
    place = F.shiftleft(F.coalesce("page", F.lit(0)).cast("long"), 32) + F.col("h.ord")
    return got.select(
        "doc_id", place.alias("ord"), F.lit(0).alias("pos"), F.regexp_extract("h.tag", r"^P(\d+)-", 1).cast("int").alias("page"), F.col("h.tag").alias("tag"),
        kind.alias("kind"), text.alias("en_text"), F.when(F.col("h._image"), F.col("h.path")).alias("image_path"),
    )


def paragraph_blocks(units: DataFrame) -> DataFrame:
    """Units with block_id and block_kind (title, meta, heading, paragraph, figure,
    equation): neighbouring sentences of one paragraph share a block; any other unit
    is its own; equation images are no unit."""
    d = units.where("kind <> 'equation_image'")
    order = Window.partitionBy("doc_id").orderBy("ord", "pos")
    kind = F.col("kind")
    key = F.when(kind.isin("body_sentence", "caption_sentence"), T.paragraph_key(F.col("tag"))).otherwise(F.concat_ws("#", "tag", "ord", "pos"))
    d = d.withColumn("_key", key).withColumn("_new", (~F.col("_key").eqNullSafe(F.lag("_key").over(order))).cast("int"))
    block_kind = (
        F.when(kind.isin("title", "heading"), kind).when(kind.isin("authors", "affil"), "meta").when(kind == "figure_image", "figure")
        .when(kind == "equation_latex", "equation").otherwise("paragraph")
    )
    return d.withColumn("block_id", F.sum("_new").over(so_far(order))).withColumn("block_kind", block_kind).drop("_key", "_new")


def blocks(units: DataFrame) -> DataFrame:
    """(doc_id, block_id, block_kind, level, role, sentences): level of headings, role
    of meta blocks, and the units of a block in order."""
    for c in ("ja_text", "image_path", "image_uri"):
        if c not in units.columns:
            units = units.withColumn(c, F.col("en_text") if c == "ja_text" else F.lit(None).cast("string"))
    cols = ["ord", "pos", "tag", "kind", "en_text", "ja_text", "image_path", "image_uri"]
    got = paragraph_blocks(units).groupBy("doc_id", "block_id").agg(F.min("block_kind").alias("block_kind"), F.array_sort(F.collect_list(F.struct(*cols))).alias("sentences"))
    first = F.col("sentences")[0]
    level = F.when(F.col("block_kind") == "heading", T.heading_level(T.section_slug(first["tag"])))
    return got.select("doc_id", "block_id", "block_kind", level.alias("level"), F.when(F.col("block_kind") == "meta", first["kind"]).alias("role"), "sentences")


def _element(name: Column | str, inner: Column, attributes: str = "") -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit("<"), name, F.lit(attributes + ">"), inner, F.lit("</"), name, F.lit(">"))


def _common(d: Column) -> Column:
    """What looks alike in all versions: figures; authors and affiliations, in
    English, and formulas."""
    kind, first = F.col("block_kind"), F.col("sentences")[0]
    src = F.coalesce(first["image_uri"], first["image_path"], F.lit(""))
    image = F.concat(F.lit('<img src="'), T.html_escape(src), F.lit('" alt="'), T.html_escape(first["tag"]), F.lit('">'))
    text = T.html_escape(first["en_text"])
    return F.when(kind == "figure", _element("figure", image)).when(kind == "meta", _element("div", text, ' class="byline"')).when(kind == "equation", _element("div", text, ' class="formula"')).otherwise(d)


def block_html(blocks: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, block_id, html) of blocks() in one language, 'en' or 'ja': a
    paragraph element for each sentence."""
    own = lambda s: T.html_escape(s[f"{language}_text"])
    first, kind = own(F.col("sentences")[0]), F.col("block_kind")
    sentences = F.array_join(F.transform("sentences", lambda s: _element("p", own(s))), "")
    heading = _element(F.concat(F.lit("h"), F.col("level").cast("string")), first)
    html = F.when(kind == "title", _element("h1", first)).when(kind == "heading", heading).otherwise(sentences)
    return blocks.select("doc_id", "block_id", _common(html).alias("html"))


def bilingual_html(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, html) with both languages side by side, a table row for
    each sentence."""
    kind = F.col("block_kind")

    def row(s):
        strong = lambda c: F.when(kind == "title", _element("strong", c)).otherwise(c)
        return _element("tr", F.concat(*[_element("td", strong(T.html_escape(s[f"{x}_text"])), f' lang="{x}"') for x in ("en", "ja")]))

    rows = F.array_join(F.transform("sentences", row), "")
    level = F.when(kind == "title", " level-1").when(kind == "heading", F.concat(F.lit(" level-"), F.col("level").cast("string"))).otherwise("")
    html = F.concat(F.lit('<table class="pair'), level, F.lit('">'), rows, F.lit("</table>"))
    return blocks.select("doc_id", "block_id", _common(html).alias("html"))


STYLE = """
body { font: 10.5pt/1.6 "Noto Sans JP", sans-serif; margin: 2em auto; max-width: 50em; }
.byline, .formula, figure { text-align: center; break-inside: avoid; }
figure img { max-width: 85%; }
table.pair { width: 100%; table-layout: fixed; } table.pair td { width: 50%; vertical-align: top; padding: 4pt; }
table.pair tr { break-inside: avoid; } .level-1 td { text-align: center; font-size: 15pt; } .level-2 td, .level-3 td, .level-4 td { font-weight: bold; }
"""


def document_html(pieces: DataFrame, language: str, title: str = "") -> DataFrame:
    """(doc_id, html): each document's block HTML in order, as a whole page. Formulas
    stay TeX between dollars, for a renderer in the reader."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "html"))), lambda s: s["html"]), "\n")
    head = f'<!DOCTYPE html>\n<html lang="{language}">\n<head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head>\n<body>\n'
    return pieces.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit("\n</body>\n</html>\n")).alias("html"))


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def embed_images(units: DataFrame, images: DataFrame) -> DataFrame:
    """units with image_uri, from images(doc_id, image_path, content)."""
    found = images.select("doc_id", "image_path", data_uri(F.col("content")).alias("image_uri")).dropDuplicates(["doc_id", "image_path"])
    return units.join(found, ["doc_id", "image_path"], "left")
