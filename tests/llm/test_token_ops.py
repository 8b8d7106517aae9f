"""Token store, packing, and the two encoders."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailgrain.llm import packing, pieces, token_store
from mailgrain.llm.bpe import Encoder
from mailgrain.llm.common import shared_dir

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*" \n\t▁ab cdefg'.,;01\xa0éß²日本🙂\x1c", "  ", "\n\n", " the", "ing", "'s", " 12", "don't", "\r\n"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with the operators' own names."""
    rows = [(3, "same text", 1, "x"), (3, "same text", 2, "y"), (1, "", 3, "z"), (2, None, 4, None), (None, "no id", 5, "v"), (5, "word " * 60_000, 6, "w"), (3, "other text", 7, "u"), (9, "same  text", 8, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, local int, kept string")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    return t


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_bpe_equals_library(library):
    added = [f"{a}<|endoftext|>{b}" for a in ("", "a", "a ", "a. ", "\n", "<|endoftext|>") for b in ("", " b", "b", "\nb", "<|", "|>")]
    enc, sample = Encoder(BPE, max_bytes=20_000), texts(4000) + added + ["<|endoftext", "a" * 3000, "word " * 500, "one, two; naïve don't x2 y\nz"]
    for start in range(0, len(sample), 100):
        part = sample[start : start + 100]
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(part)]
        assert got == [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), min_size=1, max_size=5))
def test_shard_round_trip(docs):
    shard = token_store.Shard.build(list(range(len(docs))), [np.array(d, "<u4").tobytes() for d in docs])
    back = token_store.Shard.from_bytes(shard.to_bytes())
    flat = [x for d in docs for x in d]
    assert back.ids().tolist() == flat
    for i in random.Random(0).sample(range(len(flat)), min(20, len(flat))):
        assert back.token(i) == flat[i]
    assert back.document(len(docs) - 1).tolist() == docs[-1]


def test_damaged_shard():
    image = bytearray(token_store.Shard.build([1], [np.arange(9, dtype="<u4").tobytes()]).to_bytes())
    image[-1] ^= 1
    with pytest.raises(ValueError):
        token_store.Shard.from_bytes(bytes(image))


def test_token_store(spark, library):
    docs, path = edge_docs(spark), shared_dir(spark)
    token_store.write_token_store(docs, path, BPE, shard_tokens=50)
    got = token_store.read_token_store(spark, path).orderBy("start").collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for row, doc in zip(got, order, strict=True):
        ids = ids_of(library, doc.text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    asked = spark.createDataFrame([(5, 100), (5, 10**9), (9, 0), (77, 0)], "doc_id long, pos long")
    found = {(r.doc_id, r.pos): r.token for r in token_store.token_at(spark, path, asked).collect()}
    assert found == {(5, 100): ids_of(library, "word " * 60_000, 2)[100], (5, 10**9): None, (9, 0): ids_of(library, "same  text", 2)[0], (77, 0): None}
    empty = shared_dir(spark)
    token_store.write_token_store(docs.limit(0), empty, BPE)
    assert token_store.read_token_store(spark, empty).count() == 0


def check_packed(rows, documents):
    """Every id in one piece, sequences gapless and full."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == [sum(x.length for x in seq[:k]) for k in range(len(seq))]
        total = sum(r.length for r in seq)
        assert total == seq[0].context_length <= 2048 and total & (total - 1) == 0
    assert sum(r.length for r in rows) == sum(map(len, documents))


def test_packing(spark, library):
    docs = edge_docs(spark)
    rows = packing.pack_documents(docs, BPE, pool_tokens=5000).collect()
    want = [ids_of(library, r.text, 1) for r in docs.collect()]
    check_packed(rows, want)
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start)
    ids, at = np.array(ids_of(library, "word " * 60_000, 1), "<u4"), 0
    for r in long:
        assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
        at += r.length
    assert at == len(ids)
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), min_size=1, max_size=60))
def test_pack_pool(lengths):
    windows, rest = packing.pack_pool([(n, i, 0) for i, n in enumerate(lengths)])
    for tier, window in windows:
        assert tier in packing.TIERS and sum(p[0] for p in window) == tier
    dealt = packing.deal_rest(rest)
    spans = sorted((d, s, n) for _, w in windows + dealt for n, d, s in w)
    for i, n in enumerate(lengths):
        at = 0
        for d, s, k in (x for x in spans if x[0] == i):
            assert s == at
            at += k
        assert at == n
    groups = packing.step_groups([t for t, _ in windows], 4096)
    assert len(groups) == len(windows)


def test_pieces_equal_library():
    coder, sample = pieces.Pieces(SP, max_bytes=60_000), texts(4000, 2) + ["▁", "a▁", " ", "\n", "word " * 500]
    for start in range(0, len(sample), 100):
        part = sample[start : start + 100]
        assert coder.encode_batch(part) == coder.library.encode(part, num_threads=1)
    for t in sample[:500]:  # the agenda alone, over whole texts
        assert coder.merge(coder.library.normalize(t)) == coder.library.encode(t) or not t
    coder.merge = lambda u: [1]
    with pytest.raises(ValueError, match="differ"):
        coder.encode_batch(["neverseenbefore"])


def test_pieces_documents(spark):
    docs = edge_docs(spark)
    rows = pieces.encode_documents(docs, SP, keep_ids=True)
    library = pieces.pieces(SP).library
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in rows.collect())
    import hashlib

    want = sorted((r.doc_id or 0, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r in docs.collect() for i in [library.encode(r.text or "")])
    assert got == want
    texts_ = {r.text for r in pieces.decode_documents(rows, SP).collect()}
    assert texts_ == {r.text or "" for r in docs.collect()}
    assert pieces.encode_documents(docs.limit(0), SP).count() == 0
