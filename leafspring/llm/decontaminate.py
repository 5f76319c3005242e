"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"\w+")
#: Fixed masks: 1 compares the token at that place, 0 ignores it.
MASKS = ("110110111", "111010111", "1101100111", "11111111")
_MULT = np.random.default_rng(20).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCHEMA = "doc_id long, item_id long, hits int, matched int, span int, start long, ends long"


def _mask_hashes(ids: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts whose compared tokens are all known, their hashes)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places = [k for k, c in enumerate(mask) if c == "1"]
    known = ids > 0
    ok = known[places[0] : places[0] + n].copy()
    for p in places[1:]:
        ok &= known[p : p + n]
    at = np.nonzero(ok)[0]
    h = np.full(len(at), salt, np.uint64)
    for p in places:
        h = (h ^ ids[at + p].astype(np.uint64)) * _MULT[p]
        h ^= h >> np.uint64(29)
    return at, h


class SeedIndex:
    """Spaced-seed hashes of one block of benchmark items. An item shorter than
    the shortest mask, of `shortest` tokens at least, is one seed: all of it."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS, shortest: int = 2):
        self.vocab: dict[str, int] = {}
        self.items = []
        for item, text in items:
            toks = TOKEN.findall((text or "").lower())
            self.items.append((item, np.array([self.vocab.setdefault(t, len(self.vocab) + 1) for t in toks], np.int64)))
        least = min(map(len, masks))
        short = sorted({len(ids) for _, ids in self.items if shortest <= len(ids) < least})
        self.masks, self.common, self.seeds = [*masks, *("1" * n for n in short)], len(masks), []
        for m, mask in enumerate(self.masks):
            own = [(k, ids) for k, (_, ids) in enumerate(self.items) if (len(ids) == len(mask) if len(mask) < least else len(ids) >= least)]
            parts = [(k, *_mask_hashes(ids, mask, m + 1)) for k, ids in own]
            hashes = _cat([h for _, _, h in parts], np.uint64)
            before = _cat([_before(at, h) for _, at, h in parts], np.uint64)
            owner, place = _cat([np.full(len(h), k) for k, _, h in parts], np.int64), _cat([at for _, at, _ in parts], np.int64)
            order = np.lexsort((place, owner, before, hashes))
            self.seeds.append((hashes[order], before[order], owner[order], place[order]))

    def _runs(self, ids: np.ndarray) -> dict[int, set[tuple[int, int, int]]]:
        """Where runs of hits begin: {item: {(diagonal, window start, width)}}. A
        hit just behind another hit of its mask on the same diagonal adds nothing
        to it, and such pairs are never listed: seeds are sorted by the hash before
        them too, and those with the window's own are left out as a range. So
        where a phrase repeats in both texts, their repeats are not multiplied."""
        found = defaultdict(set)
        for m, mask in enumerate(self.masks):
            hashes, before, owner, place = self.seeds[m]
            if not len(hashes):
                continue
            at, h = _mask_hashes(ids, mask, m + 1)
            lo = np.searchsorted(hashes, h, "left")
            hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
            if not len(hit):
                continue
            own = _before(at, h)
            hi = np.searchsorted(hashes, h[hit], "right")
            for i, first, last in zip(hit.tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
                start = int(at[i])
                a = z = last
                if own[i]:
                    a, z = (first + np.searchsorted(before[first:last], own[i], side) for side in ("left", "right"))
                for j in (*range(first, a), *range(z, last)):
                    found[int(owner[j])].add((start - int(place[j]), start, len(mask)))
        return found

    def matches(self, text: str, least: int, drop: int) -> list[tuple]:
        """(item_id, hits, matched, span, start, end) of each item that text
        holds. A hit fixes a diagonal; from the hit the overlap is extended both
        ways (match +1, substitution -1, given up at drop below the best). It counts
        if at least min(least, the item's length) tokens match and at least four
        fifths of its span do. Of an item's overlaps the one with most matches
        stands, then the shorter, then the first in text, then in the item."""
        get = self.vocab.get
        toks = TOKEN.findall(text.lower())
        ids = np.fromiter((get(t, 0) for t in toks), np.int64, len(toks))
        out = []
        for k, runs in self._runs(ids).items():
            item, own = self.items[k]
            room = lambda d: min(len(ids), d + len(own)) - max(0, d)
            best, done = None, {}
            for d, start, width in sorted(runs, key=lambda r: (-room(r[0]), r)):
                if best and room(d) < best[0]:
                    break  # no overlap on a shorter diagonal can be better
                if start + width <= done.get(d, 0):
                    continue
                a, z = max(0, d), min(len(ids), d + len(own))
                lo = start - _reach(lambda n: (ids[max(a, start - n) : start] == own[max(a, start - n) - d : start - d])[::-1], start - a, drop)  # noqa: B023
                end = start + width
                hi = end + _reach(lambda n: ids[end : min(z, end + n)] == own[end - d : min(z, end + n) - d], z - end, drop)  # noqa: B023
                done[d] = hi
                same = ids[lo:hi] == own[lo - d : hi - d]
                matched, span = int(same.sum()), hi - lo
                if matched >= min(least, len(own)) and 5 * matched >= 4 * span and (best is None or (matched, -span, -lo, d) > best):
                    best = (matched, -span, -lo, d)
            if best:
                matched, span, lo, d = best[0], -best[1], -best[2], best[3]
                a, z = max(0, d), min(len(ids), d + len(own))
                out.append((item, self._hits(ids[a:z] == own[a - d : z - d], len(own)), matched, span, lo, lo + span))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0))

    def _hits(self, same: np.ndarray, size: int) -> int:
        """Seed windows, of an item of that size, that match on a diagonal."""
        n = 0
        for mask in self.masks:
            places = [k for k, c in enumerate(mask) if c == "1"]
            if mask in self.masks[: self.common] or size == len(mask):
                count = len(same) - len(mask) + 1
                if count > 0:
                    n += int(np.logical_and.reduce([same[p : p + count] for p in places]).sum())
        return n


def _cat(x: list, kind) -> np.ndarray:
    return np.concatenate(x).astype(kind) if x else np.zeros(0, kind)


def _before(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of the window one place before each; 0 where there is none."""
    out = np.zeros(len(h), np.uint64)
    next_to = np.flatnonzero(np.diff(at) == 1) + 1
    out[next_to] = h[next_to - 1]
    return out


def _reach(same, most: int, drop: int) -> int:
    """How far to extend: to the best prefix score before it falls drop below the
    best. same(n) says which of the next n tokens match; only as many are looked
    at as the extension needs."""
    n = 64
    while most > 0:
        score = np.cumsum(np.where(same(min(n, most)), 1, -1))
        fell = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
        if len(fell) or n >= most:
            end = int(fell[0]) if len(fell) else len(score)
            return int(score[:end].argmax()) + 1 if end and score[:end].max() > 0 else 0
        n *= 4
    return 0


def _blocks(benchmark: DataFrame, block_chars: int, item_col: str, item_text: str):
    """Broadcast seed indexes of the distinct items, in their order, cut where a
    block would hold more than block_chars characters (an item that is longer is a
    block of its own). Items are read through one partition at a time."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    held, chars = [], 0
    for r in own.distinct().orderBy("item_id", "text").toLocalIterator():
        if held and chars + len(r.text) > block_chars:
            yield spark.sparkContext.broadcast(SeedIndex(held))
            held, chars = [], 0
        held.append((r.item_id, r.text))
        chars += len(r.text)
    yield spark.sparkContext.broadcast(SeedIndex(held))


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, least: int = 13, drop: int = 4, block_chars: int = 16 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per (document, benchmark item) with an overlap: hits (seed
    windows on its diagonal), matched and span (tokens), start and ends (token
    offsets in the document; tokens are word-character runs, lower-cased).

    The benchmark goes out in blocks of at most block_chars characters, so what is
    broadcast never grows with it: a larger benchmark takes more passes over the
    documents. No shuffle of documents, whole texts, every row. Items of two tokens
    at least but fewer than the shortest mask are found where all of their tokens
    stand in a row; one token is no passage. Null or empty texts, and items without
    a token, hold nothing; null ids stay null; repeated documents give repeated
    results, repeated items one (items of one id but unlike texts one each); an
    empty table on either side gives an empty result. Other columns are not
    read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    found = None
    for index in _blocks(benchmark, block_chars, item_col, item_text):

        def run(batches, index=index):
            for b in batches:
                out = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    out += [(doc, *m) for m in index.value.matches(text.as_py(), least, drop)]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        part = rows.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, *, least: int = 13, drop: int = 4, block_chars: int = 16 << 20,
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of docs without an overlap with the benchmark (as
    contamination() finds them), all columns kept, one filtering pass for each
    block of the benchmark and no shuffle. Rows with a null text are kept."""
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, block_chars, item_col, item_text):

        def run(batches, index=index):
            for b in batches:
                clean = [t.as_py() is None or not index.value.matches(t.as_py(), least, drop) for t in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
