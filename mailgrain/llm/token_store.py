"""Token ids in directly addressable codes (DAC): random access to any token without decoding a block.

An id is cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest chunk of every id; a bitmap tells which
ids go on, and level k+1 holds the next chunk of just those. A rank directory counts the set bits before each
512-bit block, so token i is reached with one chunk and one rank per level.

A store is a folder of Parquet rows, each a shard: first the position columns, then one binary file image
(``Shard.to_bytes``). Spark's committers write them, so a lost executor leaves no half-written shard.

Defined results: a null or empty text holds the end id only; repeated doc_ids stay repeated rows, next to each other,
ordered by a hash of the text and the text, which also parts a hot doc_id among tasks; null doc_ids come first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import doc_texts, shared_dir, table

CHUNK_BITS = 8
BLOCK = 512
MAGIC = b"MGDAC001"
STORE = "part long, shard long, part_start long, n_docs long, n_tokens long, image binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Shard:
    """A run of documents: levels of chunks, continuation bitmaps, rank directories, and where each document begins."""

    def __init__(self, doc_ids, known, offsets, levels, bitmaps, ranks):
        self.doc_ids, self.known, self.offsets = doc_ids, known, offsets
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def build(cls, doc_ids: list, parts: list[bytes]) -> Shard:
        ids = np.frombuffer(b"".join(parts), "<u4")
        offsets = np.zeros(len(parts) + 1, "<u8")
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        levels, bitmaps, ranks, rest = [], [], [], ids
        while True:
            levels.append((rest & (2**CHUNK_BITS - 1)).astype(np.uint8))
            more = rest >> CHUNK_BITS
            go_on = more > 0
            bits = np.packbits(go_on, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            counts = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(1)
            bitmaps.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))
            rest = more[go_on]
            if not len(rest):
                break
        known = np.array([d is not None for d in doc_ids], np.uint8)
        return cls(np.array([d or 0 for d in doc_ids], "<i8"), known, offsets, levels, bitmaps, ranks)

    def to_bytes(self) -> bytes:
        arrays = [self.doc_ids, self.known, self.offsets]
        for k in range(len(self.levels)):
            arrays += [self.levels[k], self.bitmaps[k], self.ranks[k]]
        raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
        body = struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + b"".join(raw)
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, image: bytes) -> Shard:
        if image[:8] != MAGIC or struct.unpack_from("<I", image, 8)[0] != zlib.crc32(memoryview(image)[12:]):
            raise ValueError("not a whole token shard")
        (n,) = struct.unpack_from("<I", image, 12)
        at, raw = 16 + 8 * n, []
        for size in struct.unpack_from(f"<{n}Q", image, 16):
            raw.append(memoryview(image)[at : at + size])
            at += size
        kinds = ["<i8", "u1", "<u8"] + ["u1", "u1", "<u4"] * ((n - 3) // 3)
        a = [np.frombuffer(r, k) for r, k in zip(raw, kinds, strict=True)]
        return cls(a[0], a[1], a[2], a[3::3], a[4::3], a[5::3])

    def __len__(self) -> int:
        return len(self.levels[0])

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap: one directory entry and at most one block."""
        block = i // BLOCK
        first, last = block * BLOCK // 8, i // 8
        bits = self.bitmaps[level]
        n = int(self.ranks[level][block]) + int(np.bitwise_count(bits[first:last]).sum())
        return n + int(bits[last] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else n

    def token(self, i: int) -> int:
        """Token i, by one chunk and one rank a level."""
        value = 0
        for level in range(len(self.levels)):
            value |= int(self.levels[level][i]) << (CHUNK_BITS * level)
            if not self.bitmaps[level][i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        value = self.levels[-1].astype("<u4")
        for level in range(len(self.levels) - 2, -1, -1):
            low = self.levels[level].astype("<u4")
            low[np.unpackbits(self.bitmaps[level], count=len(low), bitorder="little").astype(bool)] |= value << CHUNK_BITS
            value = low
        return value

    def document(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.array([self.token(i) for i in range(a, b)], "<u4")


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write shards in ascending doc_id order.

    Range partitions by doc_id and text hash, sorted inside: one shuffle of the texts. A task holds one shard at a time;
    a shard is closed at ``shard_tokens``, after a whole document.
    """
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches):
        encode, part = encoder(tokenizer_path).encode_batch, TaskContext.get().partitionId()
        ids, parts, size, shard, start = [], [], 0, 0, 0

        def image():
            n = size // 4
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "part_start": [start], "n_docs": [len(ids)], "n_tokens": [n], "image": pa.array([Shard.build(ids, parts).to_bytes()], pa.binary())})

        for batch in batches:
            texts = encode(batch.column("text").to_pylist())
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids.append(doc_id)
                parts.append(got + end)
                size += len(got) + 4
                if size >= 4 * shard_tokens:
                    yield image()
                    ids, parts, shard, start, size = [], [], shard + 1, start + size // 4, 0
        if ids:
            yield image()

    order = (F.col("doc_id"), F.xxhash64("text"))
    ordered = doc_texts(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(shards, STORE).write.option("compression", "zstd").parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the shards alone: its start over the whole store, its length and the checksum of its ids.

    To the driver comes one count per written partition (8 bytes each), never more.
    """
    store = spark.read.schema(STORE).parquet(path)
    sizes = {r.part: r.n for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part], total = total, total + sizes[part]

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.from_bytes(row["image"])
                raw, at = memoryview(shard.ids().tobytes()), shard.offsets.astype("i8")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.known == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at[:-1] + (bases[row["part"]] + row["part_start"])), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.select("part", "part_start", "image").mapInArrow(documents, DOCS)


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(doc_id, pos) → token id, by random access into the shards that hold the documents; null where there is none.

    ``positions`` is matched to shards by doc_id through the documents' directory; a shard is decoded nowhere.
    """
    store = spark.read.schema(STORE).parquet(path)

    def directory(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.from_bytes(row["image"])
                n = len(shard.doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=shard.known == 0), pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["shard"])), pa.array(np.arange(n)), pa.array(np.diff(shard.offsets.astype("i8")))], names=["doc_id", "part", "shard", "slot", "length"])

    where = store.mapInArrow(directory, "doc_id long, part long, shard long, slot long, length long")
    asked = positions.select("doc_id", "pos").join(where, "doc_id").filter("pos >= 0 AND pos < length")

    def lookup(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "pos": pd.Series(dtype="int64"), "token": pd.Series(dtype="int64")})
        shard = Shard.from_bytes(right["image"].iloc[0])
        at = shard.offsets.astype("i8")[left["slot"].to_numpy()] + left["pos"].to_numpy()
        return left[["doc_id", "pos"]].assign(token=[shard.token(int(i)) for i in at])

    found = asked.groupBy("part", "shard").cogroup(store.select("part", "shard", "image").groupBy("part", "shard")).applyInPandas(lookup, "doc_id long, pos long, token long")
    return positions.select("doc_id", "pos").distinct().join(found, ["doc_id", "pos"], "left")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_token_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_store(spark, path)
