"""Readers and writers at the engine's edge."""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.render import LINE_END, page_lines, parse_tagged

log = logging.getLogger("leafspring")

ITEM = (
    "type string, page_idx int, text string, text_level int, img_path string, image_caption array<string>, table_caption array<string>, "
    "chart_caption array<string>, code_caption array<string>, list_items array<string>, table_body string, code_body string, text_format string"
)


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """leafspring.<name> of the session, else LEAFSPRING_<NAME> of the environment."""
    return spark.conf.get(f"leafspring.{name}", None) or os.environ.get("LEAFSPRING_" + name.upper().replace(".", "_")) or default


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Layout items of JSON files that hold one array each: doc_id is the part of the
    file's name before _content_list.json, or its whole path. Of several files of one
    document the first by path counts. A file that is no such array gives one item
    of type 'unreadable' with the file's text, so that no document vanishes; error
    says why (null for all others)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    stem = F.regexp_extract("path", r"([^/]+)_content_list\.json$", 1)
    whole = whole.withColumn("doc_id", F.when(stem != "", stem).otherwise(F.col("path")))
    first = whole.groupBy("doc_id").agg(F.min("path").alias("path"))
    whole = whole.join(first, ["doc_id", "path"], "left_semi")
    items = F.from_json("value", f"array<struct<{ITEM}>>")
    bad = items.isNull() | F.exists(items, lambda i: i.isNull())
    lost = F.from_json(F.to_json(F.struct(F.lit("unreadable").alias("type"), F.col("value").alias("text"))), f"struct<{ITEM}>")
    rows = whole.select("doc_id", F.when(bad, F.lit("not an array of items")).alias("error"), F.posexplode(F.when(bad, F.array(lost)).otherwise(items)).alias("ord", "i"))
    return rows.select("doc_id", "ord", "i.*", "error")


def write_items(items: DataFrame, path: str) -> None:
    """One row a document, its items as one JSON array (column value)."""
    cols = [c.split()[0] for c in ITEM.split(", ") if c.split()[0] in items.columns]
    got = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *cols))).alias("i"))
    got.select("doc_id", F.to_json(F.transform("i", lambda i: F.struct(*[i[c].alias(c) for c in cols]))).alias("value")).write.mode("overwrite").parquet(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Lines of tagged files page_<n>_en.md (doc_id, page, ord, line): doc_id is the
    folder, page the number in the name, so a document's pages stand together and in
    numeric order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    doc, page = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"page_(\d+)_en[^/]*$", 1).try_cast("int")
    return whole.select(doc.alias("doc_id"), F.coalesce(page, F.lit(0)).alias("page"), F.posexplode(F.split("value", LINE_END)).alias("ord", "line"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of tagged files; an error if there are none."""
    units = parse_tagged(read_tagged(spark, path))
    if units.isEmpty():
        raise FileNotFoundError(f"no units in page_*_en.md of {path}")
    return units


def file_name(page, language: str):
    return F.format_string(f"page_%02d_{language}.md", page)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as one table, in as many files as there are tasks."""
    pages.write.mode("overwrite").parquet(path)


def write_markdown(pages: DataFrame, folder: str, language: str = "en", column: str = "body") -> DataFrame:
    """A file for every page, folder/<doc_id>/page_<nn>_<language>.md, written by the
    tasks; (file, bytes) of each. A file appears under its name when it is whole,
    so a task that is lost or run twice does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for doc, name, text in zip(b["doc_id"], b["name"], b["text"], strict=True):
                where.create_dir(f"{base}/{doc}", recursive=True)
                part = f"{base}/{doc}/.{name}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(text.encode())
                where.move(part, f"{base}/{doc}/{name}")
                done.append((f"{doc}/{name}", len(text.encode())))
            yield pd.DataFrame(done, columns=["file", "bytes"])

    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), file_name(F.col("page"), language).alias("name"), F.col(column).alias("text"))
    return rows.mapInPandas(run, "file string, bytes long")


__all__ = ["ITEM", "log", "page_lines", "read_items", "read_tagged", "read_units", "setting", "write_items", "write_markdown", "write_pages"]
