import io
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leafspring.llm import packing, tokenfile
from leafspring.llm.common import fresh_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def library(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_fast_encoders_agree_with_the_library(text):
    assert packing.byte_level_encoder(BYTE)([text])[0] == library(BYTE)(text)
    assert tokenfile.encoder(WORD)(text).tolist() == library(WORD)(text)


SCRIPTS = ("abcXYZ", "éèÜßñÇ", "абвГДЖ", "αβσςΣΩ", "漢字仮名", "かなカナ", "한국어글", "עברית", "ไทยคำ", "0123٤५½", "'s't\u2019re.,;:!?", "\U0001f600\u200d\ufe0f", "ﬁǅİıſ", "e\u0301a\u0308\u0323", " \t\n\u00a0\u3000\u2028\x1c\x85")


def test_encoders_agree_on_long_texts_of_mixed_scripts():
    rng = np.random.default_rng(12)
    texts = ["", None, " ", "word " * 3000, "x" * 5000, "<|endoftext|>"]
    for n in (300, 4000, 20_000):
        for share in (0.1, 0.5, 0.95):  # of runs that stay in the script before them
            out, script = [], SCRIPTS[0]
            while len(out) < n:
                script = script if rng.random() < share else SCRIPTS[rng.integers(len(SCRIPTS))]
                out += [script[k] for k in rng.integers(0, len(script), rng.integers(1, 9))]
                out += [" "] if rng.random() < 0.5 else []
            texts.append("".join(out))
    for most in (600_000, 50):  # also where nearly nothing is kept
        ids, bounds = tokenfile.CachedEncoder(WORD, most).column(pa.array(texts * 2))
        for i, t in enumerate(texts * 2):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library(WORD)(t or "")
    assert packing.byte_level_encoder(BYTE)([t or "" for t in texts]) == [library(BYTE)(t or "") for t in texts]


def check_packing(rows, want):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        ids, at = want[doc], 0
        copies = sum(p.start == 0 for p in pieces)
        assert sum(p.length for p in pieces) == len(ids) * copies
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    padding = used = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= pieces[0].padded_length <= 1024
        padding, used = padding + pieces[0].padded_length - at, used + at
    assert padding == 0
    return used


def test_packing_keeps_every_id_once(docs, texts, odd, none):
    enc = library(BYTE)
    ids = lambda t: np.array([*enc(t or ""), 0], "<u4")
    check_packing(packing.pack_documents(docs, BYTE).collect(), {i: ids(t) for i, t in texts.items()})
    rows = packing.pack_documents(odd, BYTE).collect()
    check_packing(rows, {r.doc_id: ids(r.text) for r in odd.collect()})
    assert packing.pack_documents(none, BYTE).count() == 0


def packed(lengths, **options):
    p = packing.Packer(0, **options)
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u4"))
    names = [c.split()[0] for c in packing.SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in p.flush()]


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["length"], r["tier"]))
    return sorted(out.values())


def test_step_groups_balance():
    rows = packed(np.random.default_rng(0).integers(1, 900, 400), step=4)
    cost, tier = {}, {}
    for r in rows:
        cost[r["step_group"]] = cost.get(r["step_group"], 0) + r["length"] ** 2
        assert tier.setdefault(r["step_group"], r["tier"]) == r["tier"]
    longest = [c for g, c in cost.items() if tier[g] == 1024]
    assert max(longest) < 1.25 * np.mean(longest)


def test_tiers_are_packed_apart():
    """Short documents fill windows of their own tier, and long windows' gaps."""
    short, every = (128, 256, 512, 1024), (1024,)
    assert sequences(packed([128] * 8, tiers=short)) == [[(i, 0, 128, 128)] for i in range(8)]
    assert sequences(packed([128] * 8, tiers=every)) == [[(i, 0, 128, 1024) for i in range(7, -1, -1)]]
    # a gap of 224 takes 200 of the tier 256, then the head of a piece of the tier 128
    got = sequences(packed([800, 200, 300, 100, 100, 60], tiers=short))
    assert [(0, 0, 800, 1024), (1, 0, 200, 1024), (5, 0, 24, 1024)] in got
    # 300 opens a window of the tier 512, which the rest of the shorter tiers goes to
    assert [(2, 0, 300, 512), (4, 0, 100, 512), (3, 0, 100, 512), (5, 24, 12, 512)] in got
    lengths = np.random.default_rng(3).integers(1, 3000, 500)
    a, b = packed(lengths, tiers=short), packed(lengths, tiers=every)
    assert sequences(a) != sequences(b) and sum(r["length"] for r in a) == sum(r["length"] for r in b) == lengths.sum()
    lengths = np.concatenate([np.full(300, 40), np.full(20, 900)])
    sizes = {r["sequence_id"]: r["padded_length"] for r in packed(lengths)}
    full = [n for n in sizes.values() if n in short]
    assert set(full) >= {128, 1024} and len(sizes) - len(full) <= 9


def test_token_table(docs, texts, odd, none):
    enc = library(WORD)
    got = {r.doc_id: r for r in tokenfile.token_table(docs, WORD).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array([*enc(texts[i]), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = sorted(tokenfile.token_table(odd, WORD).collect(), key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys) and len(rows) == odd.count()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(enc(r.text or "")) + 1) for r in odd.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in rows) == want
    assert tokenfile.token_table(none, WORD).count() == 0


def test_shard_lookup_is_by_block_and_filter():
    out = io.BytesIO()
    w = tokenfile.ShardWriter(out, 2)
    rng = np.random.default_rng(1)
    want = {}
    for i in sorted(rng.choice(10**6, 3000, replace=False).tolist()):
        want[i] = rng.integers(0, 49_000, rng.integers(0, 200))
        w.add(i, want[i])
    w.add(10**6, np.array([5])), w.add(10**6, np.array([6]))
    w.finish()
    r = tokenfile.ShardReader(io.BytesIO(out.getvalue()))
    assert len(r.places) > 5 and r.documents == 3002
    for i in list(want)[::17]:
        assert r.lookup(i)[0].tolist() == want[i].tolist()
    assert [x.tolist() for x in r.lookup(10**6)] == [[5], [6]]
    absent = [i for i in range(2000) if i not in want]
    assert not any(r.lookup(i) for i in absent) and r.lookup(None) == []
    assert [k for k, _ in r.scan()][:-2] == sorted(want)
    passed = sum(r.bloom[tokenfile._probes(tokenfile.key_of(i), r.bits)].all() for i in absent)
    assert passed < 0.05 * len(absent)
    with pytest.raises(ValueError):
        tokenfile.ShardReader(io.BytesIO(b"x" * 100))


def test_large_shards_roll_over(docs, texts):
    out = fresh_path(docs.sparkSession, "roll")
    manifest = tokenfile.write_shards(docs, WORD, out, shard_bytes=20_000)
    assert manifest.count() > 4
    assert tokenfile.read_shards(manifest, out).count() == len(texts)
