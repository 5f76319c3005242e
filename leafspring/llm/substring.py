"""Repeated passages across documents, found with a log-structured index of
window fingerprints.

A window is `window` consecutive words. Each window is filed under its anchor,
the smallest of the hashes of its inner word runs, so equal windows have equal
anchors and a document has about one anchor for five windows. The index is a set
of immutable runs sorted by anchor, each with the smallest and largest document
of every anchor in one batch; a new batch makes a run, which is merge-joined with
the runs before it as it comes, without a shuffle of history; runs are compacted
as they gather. Anchors met in two documents name the windows that can repeat;
those, and only those, are verified by 96 bits of hashes over all their words, and
inside a document by the words. A window or anchor that very
many documents share is pre-aggregated where it is counted, and where it is looked
up the join's hot partition is split as it runs (adaptive skew joins)."""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Words, delete, discard, fresh_path, free_name, release_shuffles, run_hashes, stored, text_batches

GRAM = 5
_EMPTY = hashlib.sha256(b"").hexdigest()


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Windows:
    """All windows of a column of texts. at(i) is the places of text i's windows;
    the arrays hold an entry for every place of the column, also those where a
    window would run into the next text."""

    def __init__(self, column, window: int):
        words = Words(column)
        gram = min(GRAM, window)
        self.bounds, self.window = words.bounds, window
        self.anchors = _window_min(run_hashes(words.hashes, gram), window - gram + 1).view(np.int64) if len(words.hashes) >= window else np.zeros(0, np.int64)
        self.words = words.hashes

    def at(self, i: int) -> slice:
        a, z = int(self.bounds[i]), int(self.bounds[i + 1])
        return slice(a, max(a, z - self.window + 1))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a further 32-bit hash of each window's words."""
        return run_hashes(self.words, self.window).view(np.int64), (run_hashes(self.words, self.window, 0xD1342543DE82EF95) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _split(text: str | None) -> list[bytes]:
    """The words (bytes.split() parts at the six ASCII blanks)."""
    return (text or "").encode().split()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def postings(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id): each document's distinct anchors, of rows(doc_id, text)."""

    def run(batches):
        for b in batches:
            for part in text_batches(b, 1):
                w = Windows(part.column(1), window)
                found = [np.unique(w.anchors[w.at(i)]) for i in range(part.num_rows)]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(ids, pa.int64())], ["anchor", "doc_id"])

    return rows.mapInArrow(run, "anchor long, doc_id long")


def _among(x: np.ndarray, some: pa.Array) -> np.ndarray:
    some = np.sort(some.to_numpy(zero_copy_only=False))
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


class FingerprintIndex:
    """A log of runs (anchor, lo, hi), one for each batch so far: bucketed, sorted
    tables in the shared folder that are never changed. add() merge-joins a batch
    with all of them, without a shuffle of history, and says which of its anchors
    are known; where most_runs runs have gathered they are first compacted into
    one. An index outlives a call (and, by manifest() and reopen(), a session), so
    later batches are held against everything filed before."""

    def __init__(self, spark: SparkSession, window: int = 13, buckets: int | None = None, most_runs: int = 2):
        self.spark, self.window, self.most_runs = spark, window, most_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, str] = {}  # table -> folder
        self.compactions = 0

    def manifest(self) -> dict:
        return {"window": self.window, "buckets": self.buckets, "paths": list(self.runs.values())}

    @classmethod
    def reopen(cls, spark: SparkSession, manifest: dict, **options) -> FingerprintIndex:
        out = cls(spark, manifest["window"], manifest["buckets"], **options)
        for path in manifest["paths"]:
            name = f"leafspring_run_{uuid.uuid4().hex}"
            spark.sql(f"create table {name} (anchor bigint, lo bigint, hi bigint) using parquet clustered by (anchor) sorted by (anchor) into {out.buckets} buckets location '{path}'")
            out.runs[name] = path
        return out

    def _write(self, run: DataFrame) -> str:
        name = f"leafspring_run_{uuid.uuid4().hex}"
        path = fresh_path(self.spark, name)
        run.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).saveAsTable(name)
        self.runs[name] = path
        return name

    def add(self, rows: DataFrame) -> DataFrame:
        """File a batch of (doc_id, text); returns the anchors, a stored table,
        that the batch shares with the history or has in two documents."""
        if len(self.runs) >= self.most_runs:
            self.compact()
        history = list(self.runs)
        new = self._write(postings(rows, self.window).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
        known, seen = self.spark.table(new), F.col("lo") < F.col("hi")
        for i, name in enumerate(history):
            known = known.join(self.spark.table(name).select("anchor", F.lit(True).alias(f"in{i}")).hint("merge"), "anchor", "left")
            seen = seen | F.col(f"in{i}").isNotNull()
        return stored(known.where(seen).select("anchor"), "known")

    def merged(self) -> DataFrame:
        """(anchor, lo, hi) over all runs."""
        first, *rest = self.runs
        out = self.spark.table(first)
        for name in rest:
            more = self.spark.table(name).withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
            out = out.join(more.hint("merge"), "anchor", "full_outer").select("anchor", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
        return out

    def compact(self) -> None:
        """All runs as one; the old ones are deleted."""
        old = list(self.runs)
        if len(old) > 1:
            self._write(self.merged())
            self._drop(old)
            self.compactions += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            delete(self.spark, self.runs.pop(name))

    def close(self) -> None:
        """Delete the index."""
        self._drop(list(self.runs))


def repeated_passages(
    docs: DataFrame, *, window: int = 13, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", texts: bool = False,
    index: FingerprintIndex | None = None, history: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(base, changed). base: doc_id, sha (of all words), n_words of every row of
    docs. changed: doc_id, sha, n_removed and kept_sha256 (with texts: kept,
    the words left, joined by a space) of each row that loses words.

    A word goes if a window that covers it also starts in a document with a
    smaller id; windows are judged on the input. Rows of one text are one
    document as far as windows go: all but the smallest id lose every word, if
    there are `window` of them. docs are filed in batches, ranges of ids, each
    merge-joined with the runs before it; their number changes nothing in the
    result.

    With an index, docs are added to it and it stays open; history is then the
    documents (of the same two columns) that it holds already. They stand before
    all of docs, whatever their ids, and are read for the windows of known anchors
    alone. Without one an index is made for the call."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    rows = docs.select(*cols)
    spark = docs.sparkSession

    def to_base(batches):
        for b in batches:
            words = (_split(t.as_py()) for t in b.column(1))
            made = [(_digest(w), len(w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["doc_id", "sha", "n_words"])

    base = stored(rows.mapInArrow(to_base, "doc_id long, sha string, n_words long"), "base")
    long_enough = base.where(f"n_words >= {window} and doc_id is not null")
    firsts = stored(long_enough.groupBy("sha").agg(F.min("doc_id").alias("first")), "firsts")
    named = rows.where("doc_id is not null and text is not null")
    own_index = index is None
    index = index or FingerprintIndex(spark, window)
    if index.window != window:
        raise ValueError("the index is of another window")
    known = []
    try:
        cuts = (named.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []) if batches > 1 else []
        cuts = sorted(set(cuts))
        for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
            part = named if lo is None else named.where(F.col("doc_id") > lo)
            known.append(index.add(part if hi is None else part.where(F.col("doc_id") <= hi)))
            release_shuffles(spark)
    finally:
        if own_index:
            index.close()
    shared = known[0]
    for more in known[1:]:
        shared = shared.unionByName(more)
    shared = stored(shared.distinct(), "shared")
    discard(*known)
    # the documents of shared anchors, less the later copies of whole texts
    again = postings(named, window).join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    flagged = stored(again.join(firsts.withColumnRenamed("first", "doc_id"), "doc_id"), "flagged")

    def own(batches):  # rows that share an id with another text go to their own text's entry
        for b in batches:
            mine = [_digest(_split(t.as_py())) == s for t, s in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            yield b.filter(pa.array(mine, pa.bool_()))

    kinds = "doc_id long, text string, sha string, anchors array<bigint>"
    suspects = stored(named.join(flagged, "doc_id").select("doc_id", "text", "sha", "anchors").mapInArrow(own, kinds), "suspects")
    discard(flagged)

    def to_windows(batches):
        for b in batches:
            for part in text_batches(b, 1):
                w = Windows(part.column(1), window)
                h1, h2 = w.hashes()
                ids, places, starts = [], [], []
                for i, (doc, anchors) in enumerate(zip(part.column(0).to_pylist(), part.column(3), strict=True)):
                    own = w.at(i)
                    live = own.start + np.flatnonzero(_among(w.anchors[own], anchors.values))
                    _, first = np.unique(h1[live], return_index=True)
                    places.append(live[first]), starts.append(live[first] - own.start), ids.append(np.full(len(first), doc, np.int64))
                at = np.concatenate(places)
                both = (h2[at].astype(np.int64) << 32) | np.concatenate(starts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[at], both, np.concatenate(ids))], ["h1", "both", "doc_id"])

    def windows_of(d):
        """(h1, both, doc_id): each document's distinct windows of shared anchors by 96
        bits of hashes of all their words; both is 32 of them and the place."""
        return d.mapInArrow(to_windows, "h1 long, both long, doc_id long")

    h2 = F.shiftright("both", 32).alias("h2")
    windows = windows_of(suspects)
    first = windows.groupBy("h1", h2).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    if history is not None:
        old = history.select(*cols).where("doc_id is not null and text is not null")
        mine = postings(old, window).join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        before = windows_of(old.join(mine, "doc_id").select("doc_id", "text", F.lit("").alias("sha"), "anchors")).select("h1", h2).distinct()
        first = first.join(before.withColumn("old", F.lit(True)), ["h1", "h2"], "left").withColumn("lo", F.when(F.col("old").isNull(), F.col("lo")).otherwise(-(1 << 63)))
        first = first.withColumn("hi", F.when(F.col("old").isNull(), F.col("hi")).otherwise((1 << 63) - 1))
    repeated = stored(first.where("lo < hi").select("h1", "h2", "lo"), "repeated")
    discard(shared)
    release_shuffles(spark)
    found = windows.join(repeated.withColumnRenamed("h1", "h"), (F.col("h1") == F.col("h")) & (F.shiftright("both", 32) == F.col("h2"))).where("doc_id > lo")
    hits = stored(found.groupBy("doc_id").agg(F.collect_set(F.col("both").bitwiseAND((1 << 32) - 1).cast("int")).alias("places")), "hits")
    discard(repeated)

    def to_kept(batches):
        for b in batches:
            for part in text_batches(b, 1):
                w = Windows(part.column(1), window)
                h = run_hashes(w.words, window)
                removed, kept = [], []
                for i, (text, found) in enumerate(zip(part.column(1), part.column(3), strict=True)):
                    words, own = _split(text.as_py()), h[w.at(i)]
                    places = found.values.to_numpy(zero_copy_only=False)
                    at_hit = _same_windows(words, own, places, window)
                    edge = np.bincount(at_hit, minlength=len(words) + 1) - np.bincount(at_hit + window, minlength=len(words) + 1)
                    stay = edge[:-1].cumsum() == 0
                    removed.append(int(len(words) - stay.sum()))
                    left = list(compress(words, stay.tolist()))
                    kept.append(b" ".join(left).decode() if texts else _digest(left))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "sha", "n_removed", last])

    last = "kept" if texts else "kept_sha256"
    partly = suspects.join(hits, "doc_id").select("doc_id", "text", "sha", "places").mapInArrow(to_kept, f"doc_id long, sha string, n_removed long, {last} string")
    copies = long_enough.join(firsts, "sha").where("doc_id > first").select("doc_id", "sha", F.col("n_words").alias("n_removed"), F.lit("" if texts else _EMPTY).alias(last))
    changed = stored(partly.unionByName(copies).dropDuplicates(["doc_id", "sha"]), "changed")
    discard(suspects, hits)
    return base, changed


def _same_windows(words: list[bytes], hashes: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """All places of a document's windows whose words are those at one of places
    (the first of each kind); hashes find them, words decide."""
    places = np.sort(places)
    order = np.argsort(hashes[places], kind="stable")
    of = hashes[places][order]
    at = np.flatnonzero(_among(hashes, pa.array(of)))
    source = places[order][np.searchsorted(of, hashes[at])]
    wrong = [k for k in np.flatnonzero(at != source).tolist() if words[at[k] : at[k] + window] != words[source[k] : source[k] + window]]
    return np.delete(at, wrong)


def passage_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs. A null
    text has no words; a row with a null id neither loses words nor makes others
    lose them; repeated rows repeat; an empty table gives an empty result; other
    columns are not read."""
    base, changed = repeated_passages(docs, **options)
    both = base.join(changed, ["doc_id", "sha"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def remove_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each text that loses words replaced by the words left, joined
    by a space (an empty text where none is left); all other rows and columns as
    they are."""
    _, changed = repeated_passages(docs, id_col=id_col, text_col=text_col, texts=True, **options)
    names = docs.columns
    # rows that share an id but not a text: the word digest tells them apart
    key, by = free_name(docs, "id"), free_name(docs, "by")
    several = changed.groupBy(F.col("doc_id").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("sha", "kept"))).alias(by))
    joined = docs.join(several, F.col(f"`{id_col}`").cast("long") == F.col(key), "left")
    text = F.col(f"`{text_col}`")
    blank = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    mine = F.sha2(F.encode(F.trim(blank), "UTF-8"), 256)
    new = F.when(F.col(by).isNotNull(), F.coalesce(F.try_element_at(by, mine), text)).otherwise(text)
    return joined.select(*[(new if n == text_col else F.col(f"`{n}`")).alias(n) for n in names])
