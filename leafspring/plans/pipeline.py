"""The whole way of a document: layout items to translated pages and HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import layout as L, render as R, translation as X
from ..operators.ranges import check_range
from ..sources.files import log, write_pages


def pages_between(items: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Items (page_idx from 0) of a range of pages, before anything is numbered."""
    page = F.coalesce("page_idx", F.lit(0)) + 1
    items = items if first is None else items.where(page >= first)
    return items if last is None else items.where(page <= last)


def run(
    items: DataFrame, *, first: int | None = None, last: int | None = None, page_offset: int = 0, lexicon: DataFrame | None = None, images: DataFrame | None = None,
    translator: X.Translator | None = None, snapshots: str | None = None, say: Callable[[str], None] = log.info,
) -> dict[str, DataFrame]:
    """Stages by name, each lazy: units, pages (English as read), prepared,
    translated, repaired, repairs (counts), bilingual_pages, blocks, and the HTML
    documents html_en, html_ja and html_pair. With a folder snapshots, structured,
    translated and repaired units are written there and read back, so that a later
    stage doesn't repeat an earlier one's work and a translator is asked once."""
    if first is not None and last is not None:
        check_range(first, last, last)

    def kept(d: DataFrame, name: str) -> DataFrame:
        if snapshots is None:
            return d
        path = f"{snapshots.rstrip('/')}/{name}"
        d.write.mode("overwrite").parquet(path)
        say(f"{name} written to {path}")
        return d.sparkSession.read.parquet(path)

    chosen = pages_between(items, first, last)
    units = kept(L.units(chosen, page_offset, lexicon), "structured")
    # every page with an item, noise too, up to each document's last
    ends = chosen.groupBy("doc_id").agg((F.max(F.coalesce("page_idx", F.lit(0))) + 1 + page_offset).alias("last"))
    translated = kept(X.translate(units, translator), "translated")
    repaired = kept(X.repair_math(translated), "repaired")
    blocks = R.blocks(R.embed_images(repaired, images) if images is not None else repaired)
    out = {
        "units": units, "pages": R.page_markdown(units, (first or 1) + page_offset, ends), "prepared": X.prepare(units), "translated": translated, "repaired": repaired,
        "repairs": X.repair_counts(repaired, "doc_id"), "bilingual_pages": R.bilingual_pages(repaired), "blocks": blocks,
        "html_en": R.document_html(R.block_html(blocks, "en"), "en"), "html_ja": R.document_html(R.block_html(blocks, "ja"), "ja"), "html_pair": R.document_html(R.bilingual_html(blocks), "ja"),
    }
    if snapshots is not None:
        write_pages(out["bilingual_pages"], f"{snapshots.rstrip('/')}/pages")
        say(f"pages written to {snapshots}")
    return out


__all__ = ["pages_between", "run"]
