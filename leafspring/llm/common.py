"""Helpers that the training-data operators share: tables in the cluster's
shared folder, connected components, and word tokens."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir (or set on the context), which
    all executors share. Where it is unset one is made, in local mode alone: on a
    cluster no folder of the driver's would do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafspring-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafspring/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here
    and survives the loss of any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafspring_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again, and let
    Spark drop the shuffle files of plans that are no longer referenced."""
    for t in tables:
        delete(t.sparkSession, t._leafspring_path)
    if tables:
        release_shuffles(tables[0].sparkSession)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df has not, in any case of letters."""
    have, name = {c.lower() for c in df.columns}, f"leafspring_{stem}"
    while name in have:
        name += "_"
    return name


def release_shuffles(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = {i: i + 32 for i in range(65, 91)}


def lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


_BLANKS = {i: " " for i in range(9, 14)}


def words_of(text: str) -> list[str]:
    """The words of WORD, in order; str.split() agrees with it on ASCII texts
    without the four separators U+001C-U+001F."""
    if text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
        return text.split()
    return [w for w in text.translate(_BLANKS).split(" ") if w]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges(a, b): component is the
    smallest node reachable. Smallest-label propagation with pointer jumping;
    each round's labels are a stored table, and a round's cost is linear in the
    edges, whatever the degree of a node (labels are pre-aggregated before they
    are shuffled)."""
    both = stored(
        edges.select("a", "b").where("a <> b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges"
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "low").alias("low"))
        # a root takes the smallest label any of its members has seen
        best = hooked.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("best"))
        jumped = hooked.join(best.withColumnRenamed("root", "component"), "component").select(
            "node", F.col("component").alias("was"), F.least("low", "best").alias("component")
        )
        new = stored(jumped, "labels")
        changed = new.where("component <> was").limit(1).count()
        discard(labels)
        labels = new.select("node", "component")
        labels._leafspring_path = new._leafspring_path
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels


def mix64(x):
    """A bijective scramble of an array of 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULT = 0x5851F42D4C957F2D
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict = {}


def _powers_of(base: int, n: int):
    """base**0 .. base**n modulo 2**64; kept, and grown in doublings."""
    import numpy as np

    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << n.bit_length()) + 1
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[: n + 1]


def _byte_values(lower: bool):
    import numpy as np

    t = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        t[65:91] = t[97:123]
    return t


class Words:
    """The words of a column of texts, hashed in place: hashes (64 bit, of a
    word's bytes; with lower, A-Z as a-z) of all texts in a row, and bounds, where
    each text's begin (one more at the end). Nulls have no words. Works on the
    column's UTF-8 bytes with a few array operations a batch."""

    def __init__(self, column, lower: bool = False):
        import numpy as np
        import pyarrow as pa

        column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
        column = column.fill_null("")
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        buf = column.buffers()[2] if n else None
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = np.zeros(len(data) + 1, bool)
        first[off] = True  # a text's end is an edge
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        values = _byte_values(lower)[data] * _powers_of(_MULT, len(data))[: len(data)]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _powers_of(_INVERSE, len(data))[self.starts]
        self.hashes = mix64(h + (self.ends - self.starts).astype(np.uint64))
        self.bounds = np.searchsorted(self.starts, off)


def run_hashes(words, k: int, base: int = 0x9E3779B97F4A7C15):
    """The hash of the k words that start at each place (len - k + 1 of them)."""
    import numpy as np

    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers_of(base, n)[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * _powers_of(pow(base, -1, 1 << 64), n)[: n - k + 1])


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def text_batches(batch, at: int, most: int = 1 << 20):
    """Slices of a record batch whose texts (column at) hold about most bytes."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
