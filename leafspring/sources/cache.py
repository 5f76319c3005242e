"""Stored results, found again by the fingerprint of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import log, setting

# Fixed values.
BACKENDS = ("pipeline", "vlm-engine")
SCHEMA_VERSION = 1
FIELDS = ("doc_sha256", "extractor_version", "start_page", "end_page", "backend", "schema_version")


def check_backend(backend: str | None) -> str:
    """The backend, 'pipeline' if there is none; an error if it isn't known."""
    if backend is not None and backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}; known: {', '.join(BACKENDS)}")
    return backend or BACKENDS[0]


def valid_entries(entries: DataFrame, **wanted) -> DataFrame:
    """Entries (of the columns FIELDS) that were made from what is wanted: all of
    FIELDS agree, null with null; an entry without a backend is of 'pipeline'."""
    wanted = {"schema_version": SCHEMA_VERSION, **wanted, "backend": check_backend(wanted.get("backend"))}
    for name in FIELDS:
        own = F.coalesce(name, F.lit(BACKENDS[0])) if name == "backend" else F.col(name)
        entries = entries.where(own.eqNullSafe(F.lit(wanted.get(name))))
    return entries


def fingerprint(**parts) -> str:
    """Of content hash, extractor version, pages, backend, schema version, ..."""
    parts["backend"] = check_backend(parts.get("backend"))
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under key in root (a shared folder), or make()'s, stored.
    A write that did not end, or a table that can't be read, is made again. The
    setting cache.disable (see files.setting) passes everything to make()."""
    if setting(spark, "cache.disable"):
        return make()
    path = f"{root.rstrip('/')}/{key}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            log.warning("stored table %s can't be read; it is made again", path)
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
