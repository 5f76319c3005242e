"""Document quality by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BITS = 18
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case alphanumeric runs and symbol runs of the whole text,
    and marks of its shape: the shares, in steps, of upper-case words, of words
    that repeat the one before, and of symbol runs among all runs."""
    runs = TOKEN.findall(text.lower())
    out = set(runs)
    words = text.split()
    n = len(words)
    if n:
        upper = sum(map(str.isupper, words))
        again = sum(map(str.__eq__, words, islice(words, 1, None)))
        symbols = len(runs) - sum(map(str.isalnum, runs))
        for name, part, whole in (("upper", upper, n), ("again", again, n), ("symbols", symbols, len(runs) or 1)):
            share = part / whole
            out.update(f"\0{name}>{cut}" for cut in SHARES if share > cut)
    return out


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - theta[k]) with one weight vector for all
    grades and ordered thresholds; x marks the hash buckets that occur."""

    buckets: np.ndarray
    weights: np.ndarray
    thetas: np.ndarray

    def scorer(self):
        """text -> (expected grade, P(top grade)); keeps each token's weight."""
        table = dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))
        known: dict[str, float] = {}

        def score(text: str) -> tuple[float, float]:
            total = 0.0
            found = tokens_of(text)
            new = [t for t in found if t not in known]
            if len(known) + len(new) > 500_000:
                known.clear()
                new = found
            for t in new:
                known[t] = table.get(bucket(t), 0.0)
            total = sum(sorted(filter(None, map(known.__getitem__, found))))
            tails = 1 / (1 + np.exp(np.clip(self.thetas - total, -500, 500)))
            return float(tails.sum()), float(tails[-1])

        return score


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, shares: np.ndarray | None = None, least_docs: int = 3,
    l1: float = 2e-4, steps: int = 800, rate: float = 1.0,
) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty (FISTA). rows: each document's
    distinct buckets. Thresholds stay ordered. Grades count as shares says (their
    shares of all labelled documents, where rows are a sample by grade)."""
    grades = np.asarray(grades)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, col = np.unique(flat, return_inverse=True)
    keep = np.bincount(col, minlength=len(used)) >= least_docs
    renamed = np.cumsum(keep) - 1
    used, doc, col = used[keep], doc[keep[col]], renamed[col[keep[col]]]
    n, k = len(rows), n_grades - 1
    size = np.bincount(grades, minlength=n_grades)
    weight = ((size if shares is None else shares) / np.maximum(size, 1))[grades] if n else np.zeros(0)
    weight = weight / max(weight.sum(), 1e-9)
    w = v = np.zeros(len(used))
    theta = np.arange(k) - (k - 1) / 2
    # the step is set by the largest curvature seen on a power iteration
    x = np.ones(len(used))
    top = 1.0
    for _ in range(8):
        x = np.bincount(col, weight[doc] * np.bincount(doc, x[col], minlength=n)[doc], minlength=len(used))
        top = max(np.linalg.norm(x), 1e-12)
        x = x / top
    step, t = rate * 4 / max(top * k, 1e-6), 1.0
    for _ in range(steps):
        z = np.bincount(doc, v[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(theta[None] - z[:, None], -60, 60)))  # P(grade > j)
        upper = np.hstack([np.ones((n, 1)), p])
        lower = np.hstack([p, np.zeros((n, 1))])
        rows_at = np.arange(n)
        hi, lo = upper[rows_at, grades], lower[rows_at, grades]
        mass = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        slope = weight * (d_hi - d_lo)
        push = np.zeros(k)
        for j in range(k):
            push[j] = -(weight * d_hi)[grades == j + 1].sum() + (weight * d_lo)[grades == j].sum()
        new = v + step * np.bincount(col, slope[doc], minlength=len(used))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        theta = theta + 0.5 * push
        theta = np.maximum.accumulate(theta + np.arange(k) * 1e-6) if k else theta
    live = w != 0
    return OrdinalModel(used[live], w[live], theta)


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """0: toxic, 1: poor, 2: good; null where a label is missing."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def train(docs: DataFrame, labels: DataFrame, *, per_grade: int = 3000, id_col: str = "doc_id", text_col: str = "text", **options) -> OrdinalModel:
    """Fit on at most about per_grade labelled documents of each grade (all of
    them where there are fewer), chosen by a hash of the id. That bound is for
    the fit alone; it keeps what reaches the driver (distinct bucket numbers)
    under a fixed size. Rows with null id, text or grade don't take part; an id
    labelled twice counts with its lowest grade, documents that share an id each with
    it; texts are read whole, however long. Without labelled documents the model has
    no weights, and every text the same grade."""
    graded = (
        labels.select(F.col(id_col).alias("doc_id"), grade_of().alias("grade"))
        .where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    )
    sizes = {r.grade: r["count"] for r in graded.groupBy("grade").count().collect()}
    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col("grade") == g, min(1.0, per_grade / n)).otherwise(share)
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def hashed(batches):
        for b in batches:
            rows = [np.array(sorted({bucket(t) for t in tokens_of(x)}), "<i4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "grade", "buckets"])

    # chosen has about 3 * per_grade ids at most, whatever the size of the tables
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text").mapInArrow(hashed, "doc_id long, grade int, buckets binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.buckets)))
    rows = [np.frombuffer(bytes(r.buckets), "<i4") for r in found]
    shares = np.array([sizes.get(g, 0) for g in range(3)], float)
    return fit_ordinal(rows, np.array([r.grade for r in found], int), 3, shares=shares, **options)


def score_documents(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs with expected_grade, p_good = P(top grade) and kept = p_good >= cut
    added (columns of those names are replaced; good_documents() leaves all as they
    are). One pass, no shuffle. A null or empty text has no token and scores as the
    thresholds alone say; a row's result depends on its text alone, so repeated rows
    repeat; texts are read whole; an empty table gives an empty result."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2^18 weights
    base = docs.drop("expected_grade", "p_good", "kept")
    at = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType())])
    names = schema.names

    def run(batches):
        score = shared.value.scorer()
        for b in batches:
            got = [score(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names)

    return base.mapInArrow(run, schema).withColumn("kept", F.col("p_good") >= cut)


def good_documents(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs that score_documents() keeps, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        score = shared.value.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t.as_py() or "")[1] >= cut for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
