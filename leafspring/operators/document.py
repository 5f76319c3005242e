"""Operators on ordered document rows: front matter, headings, sections, words,
chapters. Windows are partitioned by doc_id (or begin with it), so that one shuffle
by document serves a chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

NOISE = ("aside_text", "header", "footer", "page_number")
LABELS = ("TITLE", "AUTHORS", "AFFIL")


def reading_order():
    """A document's items by page, then in list order."""
    return Window.partitionBy("doc_id").orderBy("page", "ord")


def so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def drop_noise(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce("type", F.lit("")).isin(*NOISE))


def absolute_page(page_offset: int = 0) -> Column:
    return F.coalesce("page_idx", F.lit(0)) + 1 + page_offset


def add_labels(items: DataFrame, page_offset: int = 0) -> DataFrame:
    """Items (doc_id, ord, type, page_idx, text, text_level, ...), noise dropped, with
    page, txt, label (TITLE, AUTHORS, AFFIL), is_heading, heading_id (numbered or
    u1, u2, ... in list order) and section. Texts are taken as they are: see
    layout.normalise_items()."""
    d = drop_noise(items).withColumn("page", absolute_page(page_offset)).withColumn("txt", T.strip(F.col("text")))
    textish = F.coalesce("type", F.lit("")).isin("text", "page_footnote") & (F.coalesce("txt", F.lit("")) != "")
    abstract = F.upper("txt") == "ABSTRACT"
    level = F.col("text_level")
    d = d.withColumn("_free", textish & (F.col("page") == 1) & ~level.eqNullSafe(2))
    # page 1 stands first, so a count over the document is one over its front page
    h2 = F.sum((textish & (F.col("page") == 1) & level.eqNullSafe(2) & ~abstract).cast("int")).over(so_far(reading_order()))
    d = d.withColumn("_free", F.coalesce("_free", F.lit(False)) & (h2 == 0))
    d = d.withColumn("_rank", F.sum(F.col("_free").cast("int")).over(so_far(reading_order())))
    d = d.withColumn("label", F.when(F.col("_free") & (F.col("_rank") <= 3), F.element_at(F.array(*map(F.lit, LABELS)), F.col("_rank").cast("int"))))
    heading = F.coalesce(textish & F.col("label").isNull() & level.isin(1, 2) & ~abstract, F.lit(False))
    d = d.withColumn("is_heading", heading).withColumn("_num", F.when(F.col("is_heading"), F.nullif(T.heading_number(F.col("txt")), F.lit(""))))
    unnumbered = (F.col("is_heading") & F.col("_num").isNull()).cast("int")
    d = d.withColumn("_own", F.sum(unnumbered).over(so_far(Window.partitionBy("doc_id").orderBy("ord"))))
    name = T.slugify(F.when(F.col("_num").isNotNull(), T.heading_name(F.col("txt"))).otherwise(F.col("txt")))
    d = d.withColumn("heading_id", F.when(F.col("is_heading"), F.concat_ws(".", F.coalesce("_num", F.concat(F.lit("u"), F.col("_own").cast("string"))), name)))
    d = d.withColumn("section", F.coalesce(F.last("heading_id", True).over(so_far(reading_order())), F.lit("abstract")))
    return d.drop("_free", "_rank", "_num", "_own")


def label_items(items: DataFrame, page_offset: int = 0) -> DataFrame:
    return add_labels(items, page_offset).select("doc_id", "ord", "type", "page", "txt", "label", "is_heading", "heading_id", "section")


def known_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words(word) with known: in the lexicon, lower-cased, or one letter; never
    the empty word. The lexicon side is distinct, so rows stay as they are."""
    have = lexicon.select(F.lower("word").alias("_w")).distinct().withColumn("_in", F.lit(True))
    d = words.join(have, F.lower("word") == F.col("_w"), "left")
    return d.withColumn("known", (F.length("word") > 0) & (F.col("_in").isNotNull() | (F.length("word") == 1))).drop("_w", "_in")


def restore_compounds(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """left-right of each unknown word that is two known ones of three letters
    at least, split as far left as possible; by joins on distinct words."""
    known = lexicon.select(F.lower("word").alias("w")).distinct()
    odd = words.select("word").distinct().where(F.length("word") >= 6).join(known.withColumnRenamed("w", "word"), "word", "left_anti")
    cuts = odd.select("word", F.explode(F.expr("sequence(3, length(word) - 3)")).alias("k"))
    cuts = cuts.select("word", "k", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    both = cuts.join(known.withColumnRenamed("w", "a"), "a", "left_semi").join(known.withColumnRenamed("w", "b"), "b", "left_semi")
    return both.groupBy("word").agg(F.min_by(F.concat_ws("-", "a", "b"), "k").alias("fixed"))


def chapter_ranges(toc: DataFrame) -> DataFrame:
    """(doc_id, chapter, first, last) of toc(doc_id, toc_ord, level, title, page,
    page_count): top-level entries, numbered in list order; a chapter ends before
    the next larger start, or with the document."""
    top = toc.withColumn("top", F.min("level").over(Window.partitionBy("doc_id"))).where("level = top")
    nxt = Window.partitionBy("doc_id").orderBy("page").rangeBetween(1, Window.unboundedFollowing)
    return top.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("toc_ord")).cast("long").alias("chapter"), F.col("page").alias("first"),
        F.coalesce(F.min("page").over(nxt) - 1, F.col("page_count")).alias("last"),
    )


def chapter_numbers(spec: Column) -> Column:
    """Chapters of specs that chapter_spec() takes, as a sorted array."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    edge = lambda p, k: F.element_at(F.split(p, "-"), k).cast("int")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(edge(p, 1), edge(p, -1))))))


def chapter_spec(spec: str) -> list[int]:
    """'1,3-4' -> [1, 3, 4]."""
    out: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        a, dash, b = part.partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            raise ValueError(f"bad chapter: {part}")
        lo, hi = int(a), int(b) if dash else int(a)
        if lo < 1 or hi < lo:
            raise ValueError(f"bad chapter range: {part}")
        out |= set(range(lo, hi + 1))
    if not out:
        raise ValueError("no chapter given")
    return sorted(out)


def label_pages(labels: DataFrame, wanted: str) -> DataFrame:
    """The first page of each document with that label ('cov': any that begins so)."""
    own, want = F.lower(F.trim("label")), wanted.strip().lower()
    hit = own.startswith("cov") if want == "cov" else own == want
    return labels.where(hit).groupBy("doc_id").agg(F.min("page").alias("page"))


def content_fingerprint(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
