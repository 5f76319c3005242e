"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_alphabet

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, padded_length int, step_group long"
)
TIERS = (128, 256, 512, 1024)


@lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """texts -> lists of ids for a byte-level BPE file of the tokenizers
    library, without special tokens. Where the file's ids are its merge order
    and it neither normalises nor uses another split pattern, the same merges
    run in tiktoken, which is about five times faster (the tests hold the two
    equal); any other file is run by the tokenizers library itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    pre = spec["pre_tokenizer"] or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    order = [vocab.get(m.replace(" ", ""), -1) for m in merges]
    plain = (
        spec["normalizer"] is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and order == sorted(order)
        and -1 not in order
    )
    if plain:
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_ordinary(t) for t in texts]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


class Packer:
    """Packs the pieces of one task. Whole windows of a long document are
    sequences at once. What is left of each document is routed to the tier of its
    length, the shortest context that holds it. flush() packs each tier to
    sequences of its own context size, the longest tier first: a window opens with
    the longest piece of its tier, and its gap takes the longest piece that fits
    from the tier of the gap or, if that has none, from ever shorter ones. A gap
    that no piece fits takes the head of a longer one; the tail is routed anew by
    its own length. So long windows use up short pieces only in gaps, and short
    documents left over make full short sequences. What at last fills no window
    is cut into sequences of powers of two.

    Sequences of a tier are then dealt to step groups of about step * the longest
    context tokens, so that attention costs (sum of squared piece lengths)
    balance between the groups of a tier; a group has one context size."""

    def __init__(self, task: int, tiers=TIERS, step: int = 8):
        self.tiers, self.window, self.step = sorted(tiers), max(tiers), step
        self.next_seq = self.next_group = task << 32
        self.full: list[list] = []
        self.waiting: list[tuple[int, int]] = []  # (length, slot)
        self.pools: dict[int, list[tuple[int, int]]] = {}  # the same by tier, sorted; filled on flush
        self.slots: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for at in range(0, n - n % w, w):
            self.full.append([(doc_id, at, w, zlib.crc32(ids[at : at + w].tobytes()), n)])
        if n % w:
            self.waiting.append((n % w, len(self.slots)))
            self.slots.append((doc_id, n - n % w, ids[n - n % w :].copy(), n))
            self.held += n % w

    def tier_of(self, n: int) -> int:
        return self.tiers[bisect_left(self.tiers, n)]

    def _take(self, tier: int, i: int, most: int) -> tuple:
        n, slot = self.pools[tier].pop(i)
        doc, at, ids, total = self.slots[slot]
        if n > most:
            self.slots.append((doc, at + most, ids[most:], total))
            insort(self.pools[self.tier_of(n - most)], (n - most, len(self.slots) - 1))
        return doc, at, ids[:most], total

    def _fill(self, gap: int) -> tuple | None:
        """A piece for a gap: whole, of the longest tier that has one, else cut."""
        for tier in reversed(self.tiers[: bisect_left(self.tiers, gap) + 1]):
            i = bisect_right(self.pools[tier], (gap, len(self.slots))) - 1
            if i >= 0:
                return self._take(tier, i, gap)
        for tier in self.tiers:
            if self.pools[tier]:
                return self._take(tier, 0, gap)
        return None

    def _rest(self, pieces: list) -> list[list]:
        """pieces, too few for a window, as sequences of powers of two."""
        out, left = [], sum(len(p[2]) for p in pieces)
        queue = list(reversed(pieces))
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            out.append([])
            while want:
                doc, at, ids, total = queue.pop()
                if len(ids) > want:
                    queue.append((doc, at + want, ids[want:], total))
                out[-1].append((doc, at, ids[:want], total))
                want -= min(want, len(ids))
        return out

    def _pack(self) -> dict[int, list[list]]:
        """Sequences of each tier, of all pieces that wait."""
        self.pools = {t: [] for t in self.tiers}
        for n, slot in sorted(self.waiting):
            self.pools[self.tier_of(n)].append((n, slot))
        made: dict[int, list[list]] = {t: [] for t in self.tiers}
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                seq, gap = [], tier
                while gap:
                    piece = self._fill(gap) if seq else self._take(tier, len(self.pools[tier]) - 1, tier)
                    if piece is None:
                        break
                    seq.append(piece)
                    gap -= len(piece[2])
                if gap:  # nothing is left in any tier
                    for part in self._rest(seq):
                        made[self.tier_of(sum(len(p[2]) for p in part))].append(part)
                else:
                    made[tier].append(seq)
        return made

    def flush(self):
        """Rows of SCHEMA for everything added since the last flush."""
        sequences = {t: [[(d, at, len(x), zlib.crc32(x.tobytes()), n) for d, at, x, n in s] for s in made] for t, made in self._pack().items()}
        sequences[self.window] += self.full
        self.full, self.waiting, self.pools, self.slots, self.held = [], [], {}, [], 0
        for tier, own in sequences.items():
            own.sort(key=lambda s: -sum(p[2] ** 2 for p in s))
            groups = -(-len(own) * tier // (self.step * self.window))
            for k, seq in enumerate(own):
                lap, i = divmod(k, groups)
                group = self.next_group + (i if lap % 2 == 0 else groups - 1 - i)
                used, at = sum(p[2] for p in seq), 0
                for doc, start, n, crc, total in seq:
                    yield doc, start, n, crc, total, self.next_seq, at, tier, used, group
                    at += n
                self.next_seq += 1
            self.next_group += groups


def pack_documents(
    docs: DataFrame, tokenizer: str, *, tiers=TIERS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    step: int = 8, pool_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece of each document's ids (its text's, then end_id).

    Documents are packed where they are read: no shuffle, and a task holds at
    most pool_tokens ids (pieces shorter than a window) plus one batch of texts,
    so a source with a third of all rows is as cheap as any other. sequence_id is
    unique over the result; its high bits are the task's number. Every id lies
    in exactly one piece. A sequence's offset runs without gaps from 0. tier is the
    context size it was packed for, padded_length what it fills: the tier, or, for
    the rest of a pool, a power of two. There is no padding.

    Null text is an empty text (one piece: the end id alone); a null id stays
    null and is packed as any other; repeated rows are packed as often as they
    occur; an empty table gives an empty result; other columns are not read."""
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def run(batches):
        packer, encode = Packer(TaskContext.get().partitionId(), tiers, step), byte_level_encoder(tokenizer)
        end = np.array([end_id], "<u4")

        def rows():
            cols = list(zip(*packer.flush(), strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    packer.add(doc, np.concatenate([np.array(ids, "<u4"), end]))
                if packer.held >= pool_tokens or len(packer.full) > 20_000:
                    yield rows()
        yield rows()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
