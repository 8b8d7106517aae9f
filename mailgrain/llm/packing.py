"""Hierarchical multi-length packing of tokenised documents.

A document is cut into full windows of the longest context; what is left is routed to the shortest context tier that
holds it. Tiers are packed from the longest down: the piece that opens a window leaves a gap, filled with the largest
shorter pieces that fit, and the last gap with the head of one piece, whose rest goes back to its tier. So every
window is full, but the rest of a task: that is dealt to windows of falling powers of two, which need no padding.
Windows of one pool are then dealt to step groups, the longest first, each to the group with the fewest tokens.

Each task packs the documents it reads, pool by pool, with no shuffle; a pool holds ``pool_tokens`` ids.

Defined results: a null or empty text is the end id alone; repeated rows are packed like others; null doc_ids stay null;
an empty table gives no rows; ties go by reading order; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoder
from .common import doc_texts, table

TIERS = (2048, 1024, 512, 256)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_length long, step_group long"


def route(length: int, tiers=TIERS) -> int:
    """The shortest tier that holds ``length`` tokens."""
    return min(t for t in tiers if t >= length)


def pack_pool(pieces: list[tuple[int, int, int]], tiers=TIERS) -> tuple[list[tuple[int, list]], list]:
    """(length, document, start) pieces of at most the longest tier → full windows (tier, pieces), and the pieces of at most one that is not full."""
    pool, windows = sorted(pieces), []
    while pool:
        length, doc, start = pool.pop()
        tier = route(length, tiers)
        window, gap = [(length, doc, start)], tier - length
        while gap and pool:
            k = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if k >= 0:
                piece = pool.pop(k)
            else:  # all are longer: cut the shortest
                n, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (n - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            return windows, window
        windows.append((tier, window))
    return windows, []


def deal_rest(rest: list[tuple[int, int, int]]) -> list[tuple[int, list]]:
    """The last pieces of a task in windows of falling powers of two, all of them full."""
    total, out, rest = sum(p[0] for p in rest), [], rest[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        window, gap = [], size
        while gap:
            n, doc, start = rest.pop()
            take = min(n, gap)
            window.append((take, doc, start))
            if take < n:
                rest.append((n - take, doc, start + take))
            gap -= take
        out.append((size, window))
        total -= size
    return out


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens."""
    n = max(1, sum(sizes) // group_tokens)
    loads, out = [(0, g) for g in range(n)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(loads)
        out[i] = g
        heapq.heappush(loads, (load + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers=TIERS, pool_tokens: int = 2_000_000, group_tokens: int = 32 * 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence."""
    tiers, end = tuple(sorted(tiers, reverse=True)), np.array([end_id], "<u4").tobytes()
    if any(t & (t - 1) for t in tiers):
        raise ValueError("context lengths must be powers of two")
    longest = tiers[0]

    def pack(batches):
        encode, base = encoder(tokenizer_path).encode_batch, TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # documents with pieces not yet placed
        pieces, size, n_docs, n_seq, n_groups = [], 0, 0, 0, 0

        def rows(windows):
            nonlocal n_seq, n_groups
            groups = step_groups([t for t, _ in windows], group_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for (tier, window), group in zip(windows, groups, strict=True):
                offset = 0
                for n, doc, start in window:
                    doc_id, raw = held[doc]
                    for c, v in zip(cols, (doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(raw) // 4, base + n_seq, offset, tier, base + n_groups + group), strict=True):
                        c.append(v)
                    offset += n
                n_seq += 1
            n_groups += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            texts = encode(batch.column("text").to_pylist())
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                raw = got + end
                n = len(raw) // 4
                held[n_docs] = (doc_id, raw)
                pieces += [(min(longest, n - s), n_docs, s) for s in range(0, n, longest)]
                n_docs, size = n_docs + 1, size + n
                if size >= pool_tokens:
                    windows, pieces = pack_pool(pieces, tiers)
                    yield rows(windows)
                    held = {d: held[d] for _, d, _ in pieces}
                    size = sum(p[0] for p in pieces)
        windows, rest = pack_pool(pieces, tiers)
        if windows or rest:
            yield rows(windows + deal_rest(rest))

    return doc_texts(docs, id_col, text_col).mapInArrow(pack, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
