"""Page ranges by page number, printed label or chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .document import chapter_ranges, chapter_spec, label_pages


def body_entries(toc: DataFrame, page_labels: DataFrame) -> DataFrame:
    """Top-level entries on pages with a number for a label; all top-level ones
    of a document where none is."""
    own = Window.partitionBy("doc_id")
    top = toc.withColumn("_top", F.min("level").over(own)).where("level = _top").drop("_top")
    digits = page_labels.groupBy("doc_id", "page").agg(F.max(F.col("label").rlike(r"(?U)^\d+\z").cast("int")).alias("_body"))
    d = top.join(digits, ["doc_id", "page"], "left").withColumn("_body", F.coalesce("_body", F.lit(0)))
    return d.withColumn("_any", F.max("_body").over(own)).where("_body = 1 or _any = 0").drop("_body", "_any")


def _needed(c, message: str):
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.concat(F.lit(message + ", document "), F.col("doc_id").cast("string"))).cast("long"))


def resolve_ranges(
    docs: DataFrame, *, first: int | None = None, last: int | None = None, first_label: str | None = None, last_label: str | None = None,
    chapters: str | None = None, page_labels: DataFrame | None = None, toc: DataFrame | None = None,
) -> DataFrame:
    """docs(doc_id) with first_page and last_page. A page number or label on an
    edge goes before chapters, and the other edge is then open (null) unless
    given; both on one edge are an error, as is a label or a chapter that a
    document lacks. Nothing given: both are null."""
    if first is not None and first_label is not None or last is not None and last_label is not None:
        raise ValueError("an edge has both a page and a label")
    d, by_page = docs.select("doc_id"), {"first_page": first, "last_page": last}
    wanted = {"first_page": first_label, "last_page": last_label}
    if any(v is not None for v in (*by_page.values(), *wanted.values())):
        for name in by_page:
            if wanted[name] is None:
                d = d.withColumn(name, F.lit(by_page[name]).cast("long"))
            else:
                hit = label_pages(page_labels, wanted[name]).select("doc_id", F.col("page").cast("long").alias(name))
                d = d.join(hit, "doc_id", "left").withColumn(name, _needed(F.col(name), f"no page is labelled {wanted[name]}"))
        return d
    if chapters is None:
        return d.select("doc_id", *[F.lit(None).cast("long").alias(n) for n in by_page])
    spec = chapter_spec(chapters)
    entries = body_entries(toc, page_labels) if page_labels is not None else toc
    hull = chapter_ranges(entries).where(F.col("chapter").isin(spec)).groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("first").cast("long").alias("first_page"), F.max("last").cast("long").alias("last_page"))
    d = d.join(hull, "doc_id", "left")
    ok = F.when(F.col("_n") == len(spec), F.col("first_page"))
    return d.select("doc_id", _needed(ok, f"not all chapters of {chapters}").alias("first_page"), "last_page")


def check_range(first: int, last: int, pages: int) -> None:
    if not 1 <= first <= last <= pages:
        raise ValueError(f"pages {first} to {last} of {pages}")


def range_name(first=None, last=None, first_label=None, last_label=None, chapters: str | None = None) -> str:
    """Of labels, else pages, else chapters, else 'full'."""
    edges = lambda name, *ends: name + "-".join(str(e) for e in ends if e is not None) if any(e is not None for e in ends) else ""
    return edges("label", first_label, last_label) or edges("p", first, last) or (f"chapter{chapters.replace(',', '_')}" if chapters else "full")
