"""Token ids of documents as sorted-string-table shards.

A shard holds entries in key order. Layout, integers little-endian:

    block*   entries: varint shared, varint rest, key suffix, varint n, ids
    index    per block: varint key length, first key, varint offset, varint size
    bloom    bit array, 10 bits a document, 7 probes by double hashing
    footer   56 bytes: index offset, index size, bloom offset, bloom size,
             documents, ids, id width, magic (each 8 bytes but the last two of 4)

A key is one byte (0 for a null id, which sorts first, else 1) and the id as
eight big-endian bytes with the sign bit flipped, so byte order is id order;
neighbours share prefixes, which a block stores once. Blocks close at 64 KB.
lookup() asks the Bloom filter, finds the block by binary search in the sparse
index, and reads that block alone."""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_alphabet, fresh_path, stored, text_batches

FOOTER = struct.Struct("<QQQQQQII")
MAGIC = 0x31545353
BLOCK, PROBES, BITS = 64 << 10, 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes entries, given in key order, to an open stream."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index, self.keys, self.ids = bytearray(), [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids))
        self.block += ids.astype(f"<u{self.width}", copy=False).tobytes()
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            self.index += _varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(self.block))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def finish(self) -> None:
        self._close_block()
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_probes(k, bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(bytes(self.index) + packed)
        self.out.write(FOOTER.pack(self.at, len(self.index), self.at + len(self.index), bits, len(self.keys), self.ids, self.width, MAGIC))


class ShardReader:
    """Random and sequential access to one shard; file: seekable, binary."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        at, n, bloom_at, self.bits, self.documents, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at, size - FOOTER.size - bloom_at), np.uint8))[: self.bits].astype(bool)
        self.firsts, self.places, buf, i = [], [], self._read(at, n), 0
        while i < n:
            k, i = _read_varint(buf, i)
            self.firsts.append(bytes(buf[i : i + k]))
            offset, i = _read_varint(buf, i + k)
            length, i = _read_varint(buf, i)
            self.places.append((offset, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int):
        buf, at, key = self._read(*self.places[block]), 0, b""
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            rest, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            n, at = _read_varint(buf, at + rest)
            yield key, np.frombuffer(buf, f"<u{self.width}", n, at).astype("<u4")
            at += n * self.width

    def scan(self):
        """(doc_id, ids) of all entries, in key order."""
        for block in range(len(self.places)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def lookup(self, doc_id) -> list[np.ndarray]:
        """The ids of every entry with this id (several if rows repeated)."""
        key = key_of(doc_id)
        if not self.firsts or not self.bloom[_probes(key, self.bits)].all():
            return []
        lo, hi = max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)
        return [ids for b in range(lo, hi) for k, ids in self._entries(b) if k == key]


#: Characters outside these long-settled ranges may be classed differently by
#: two versions of Unicode; stretches that hold any go to the library whole.
_UNSETTLED = re.compile("[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bd\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


class CachedEncoder:
    """Ids of texts under a BPE file of the tokenizers library that drops white
    space and whose normaliser works character by character. Such a file encodes
    what stands between blanks on its own, and in it each piece of its split
    pattern, so the library's model is asked once for a piece, and a batch of
    texts is a gather: Arrow numbers the stretches between blanks, each has its
    place in one flat array of ids. That array, the stretches and the pieces kept
    are bounded in number and in length (longer ones are looked up afresh). Files
    of any other make-up are passed to the library text by text; the tests hold
    the two ways equal on long texts of mixed scripts."""

    LONGEST = 48  # characters of a stretch or piece that is kept

    def __init__(self, path: str, most: int = 600_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.most, self.known, self.pieces = most, {}, {}
        # ids of all stretches end to end; stretch k's are flat[at[k] : at[k] + size[k]]
        self.flat, self.at, self.size, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        spec = json.loads(open(path, encoding="utf-8").read())
        self.width = 2 if max(spec["model"]["vocab"].values()) < 65536 else 4
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.apart = (
            steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"]
        )
        if self.apart:
            import regex

            self.cut = regex.compile(pre[0]["pattern"]["Regex"]).findall
            self.model, self.alphabet = self.tok.model, {b: c for c, b in byte_alphabet().items()}

    def _of_piece(self, piece: str) -> bytes:
        """A normalised piece, written in the file's alphabet of bytes, by the
        library's model."""
        found = self.pieces.get(piece)
        if found is None:
            written = piece.encode().decode("latin-1").translate(self.alphabet)
            found = np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()
            if len(self.pieces) < self.most and len(piece) <= self.LONGEST:
                self.pieces[piece] = found
        return found

    def _of_stretch(self, text: str) -> bytes:
        if text.isascii():
            cut = self.cut(text.lower())
        elif _UNSETTLED.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:  # the library lower-cases character by character: no final sigma
            cut = self.cut(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return self._of_piece(cut[0]) if len(cut) == 1 else b"".join(map(self._of_piece, cut))

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        """The place of each (distinct) stretch in at and size. Those that aren't
        kept stand behind the kept ones, until the next call."""
        known = self.known
        codes = np.fromiter(map(known.get, stretches, repeat(-1)), np.int64, len(stretches))
        new = np.flatnonzero(codes < 0)
        made = [self._of_stretch(stretches[i]) for i in new.tolist()]
        fits = [len(stretches[i]) <= self.LONGEST for i in new.tolist()]
        order = np.argsort(~np.array(fits, bool), kind="stable")  # those to keep first
        room = max(0, self.most - len(known))
        keep = min(room, sum(fits))
        first = len(known)
        codes[new[order]] = np.arange(first, first + len(new))
        known.update(zip([stretches[i] for i in new[order[:keep]].tolist()], range(first, first + keep), strict=True))
        sizes = np.array([len(made[i]) >> 2 for i in order.tolist()], np.int64)
        ids = np.frombuffer(b"".join([made[i] for i in order.tolist()]), "<u4")
        self.at, self.size = _room(self.at, first, len(new)), _room(self.size, first, len(new))
        self.flat = _room(self.flat, self.used, len(ids))
        self.size[first : first + len(new)] = sizes
        self.at[first : first + len(new)] = self.used + sizes.cumsum() - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += int(sizes[:keep].sum())
        return codes

    def column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of an Arrow column, end to end; n + 1 bounds). Null
        texts are empty."""
        texts = texts.fill_null("")
        if not self.apart:
            parts = [np.array(e.ids, "<u4") for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *parts]), np.cumsum([0, *map(len, parts)])
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        codes = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        sizes = self.size[codes]
        ends = np.concatenate([[0], sizes.cumsum()])
        place = np.repeat(self.at[codes] - ends[:-1], sizes)
        place += np.arange(len(place))
        return self.flat[place], ends[offsets - offsets[0]]

    def __call__(self, text: str) -> np.ndarray:
        return self.column(pa.array([text], pa.string()))[0]


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(x):
        return x
    out = np.zeros(max(2 * len(x), used + more), x.dtype)
    out[:used] = x[:used]
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


MANIFEST = "part int, seq int, path string, documents long, ids long"


def write_shards(docs: DataFrame, tokenizer: str, out_dir: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode every document and write its ids plus end_id to shards under
    out_dir, in ascending id order over all shards; returns the manifest, a
    stored table of MANIFEST with one row per shard ((part, seq) is key order).

    One range shuffle of the texts. A task writes under names of its own and
    only the manifest of the attempt that counts names them, so a lost or
    repeated task leaves no wrong shard in the table. Null texts are empty; rows
    with a null id come first; repeated ids are entries of their own (ordered by a
    hash of the text); an empty table gives no shard; very long texts are whole
    entries (a block holds at least one); other columns are not read."""
    from pyarrow import fs

    def run(batches):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        where, base = fs.FileSystem.from_uri(out_dir)
        where.create_dir(base, recursive=True)
        writer = stream = path = None
        done = []

        def close():
            writer.finish()
            stream.close()
            done.append((part, len(done), path, len(writer.keys), writer.ids))

        for b in batches:
            for part_rows in text_batches(b, 1, 4 << 20):
                ids, bounds = enc.column(part_rows.column(1))
                ids = np.insert(ids, bounds[1:], end_id).astype(f"<u{enc.width}")
                bounds = (bounds + np.arange(len(bounds))).tolist()
                for i, doc in enumerate(part_rows.column(0).to_pylist()):
                    if writer is None:
                        path = f"{base}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.sst"
                        stream = where.open_output_stream(path)
                        writer = ShardWriter(stream, enc.width)
                    writer.add(doc, ids[bounds[i] : bounds[i + 1]])
                    if writer.at >= shard_bytes:
                        close()
                        writer = None
        if writer is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "seq", "path", "documents", "ids"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    # a null or repeated id with many texts spreads over tasks
    own = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", own).sortWithinPartitions("doc_id", own, "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, out_dir: str) -> DataFrame:
    """One row per document from the files of a manifest: doc_id, start,
    n_tokens, ids_crc32, shard. Work is one task's per shard; only shard totals
    (a few numbers each) are summed in order."""
    from pyarrow import fs

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def run(batches):
        where, _ = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with where.open_input_file(path) as f:
                    rows, at = [], base
                    for doc, ids in ShardReader(f).scan():
                        rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), path.rpartition("/")[2]))
                        at += len(ids)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_table(docs: DataFrame, tokenizer: str, out_dir: str | None = None, **options) -> DataFrame:
    """write_shards() then read_shards(): what the files hold of each document."""
    out_dir = out_dir or fresh_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer, out_dir, **options), out_dir)
