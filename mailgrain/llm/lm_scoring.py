"""Cross-entropy difference: two matched bigram models over one vocabulary score every document.

Words are what stands between blanks, in lower case and with its punctuation, which tells prose from junk. The vocabulary is every
word of all documents, with <s> and <unk>; ``size`` bounds it to the ``size - 2`` most frequent words, the others being <unk>. The
background model counts the bigrams of all documents, the target model those of the documents labelled good, outside the held-out
fold. Both smooth alike: p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu), p(w) = (c(w) + 1) / (N + V), V the vocabulary with <s> and
<unk>. A document's score is the mean over its words of target loss minus background loss: below zero is closer to the target.

The models are tables that grow with the documents. Tasks cut their documents into chunks of about ``chunk_words`` words and send each
chunk's distinct words and bigrams with their counts, packed by range of their 64-bit hashes; every range is summed by itself and
answers each chunk with the sums of just the keys it sent. A chunk then meets its answers and scores its documents. A key is sent once
a chunk, so that neither a word nor a bigram is a hot key; there are more ranges where there is more text, so that a range stays small.
The driver gets three totals.

The counts that score a document hold its own words, in the background model always and in the target model if it is one of the target: such a
document looks closer to the target than an equal one outside. Compare scores among held-out documents, or among those that are not target.

Defined results: null and empty texts, and texts without words, have 0 tokens, losses and score 0; rows labelled null or
with null doc_id are not target; a doc_id labelled twice counts by its highest label; repeated rows count as often as they
occur; without target rows the target model is uniform; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, doc_texts, keep_only, release, table, written

FOLDS = 5
START, UNK = 0, 1  # in place of a word's hash
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def word_hash(word: str) -> int:
    """64 bits, the upper 32 of them the CRC; 0 and 1 are taken."""
    data = word.encode()
    return max(2, zlib.crc32(data) << 32 | xxhash.xxh32_intdigest(data))


_words = Words(word_hash, 400_000)


def keep_words() -> None:
    """For the start of a task that hashes words."""
    keep_only(_words)


def word_hashes(text: str) -> np.ndarray:
    """The hash of each word; a worker keeps those it has met."""
    return np.array([_words[w] for w in text.lower().split()], np.uint64)


def word_counts(docs: DataFrame, flush_words: int = 2_000_000) -> DataFrame:
    """(hash, n) of every word of every text."""

    def run(batches):
        keep_words()
        held, size = [], 0

        def rows():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                held.append(word_hashes(t))
                size += len(held[-1])
            if size > flush_words:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return doc_texts(docs).select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the ``size - 2`` most frequent words, equally frequent ones by their CRC."""
    # Written first: collecting a sorted limit would send every partition's top rows to the driver.
    top = written(word_counts(docs).orderBy(F.desc("n"), F.shiftrightunsigned("hash", 32), "hash").limit(size - 2))
    return np.sort(np.array([r.hash for r in top.collect()], np.int64).view(np.uint64))


def pair_keys(tokens: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words (as places in ``hashes``, whose first is <s>): the word before each, the distinct bigrams, and each word's bigram."""
    before = np.zeros(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    ends = np.cumsum(lengths)
    before[(ends - lengths)[lengths > 0]] = 0
    x = hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[tokens]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    keys, pair = np.unique(x ^ (x >> np.uint64(31)), return_inverse=True)
    return before, keys, pair


def squeezed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, column by column; the first byte is the type's width."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << 8 * w - (w == 8))
    return bytes([width]) + zlib.compress(counts.T.astype(f"<u{width}").tobytes(), 1)


def expanded(column, columns: int) -> np.ndarray:
    parts = [np.frombuffer(zlib.decompress(memoryview(x)[1:]), f"<u{x[0]}").reshape(columns, -1).T.astype(np.int64) for x in column.to_pylist()]
    return np.concatenate([np.zeros((0, columns), np.int64), *parts])


def cut_chunks(marked: DataFrame, vocab: np.ndarray | None, chunk_words: int) -> DataFrame:
    """A row for each chunk: its documents' ids and lengths, and its words as places among its distinct words' hashes."""
    shared = marked.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        number, known = TaskContext.get().partitionId() << 32, shared.value
        keep_words()
        held: list[tuple] = []

        def row():
            h = np.concatenate([h for _, _, h in held])
            if known is not None:
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                h = np.where(known[at] == h, h, np.uint64(UNK)) if len(known) else np.full(len(h), UNK, np.uint64)
            hashes, tokens = np.unique(np.concatenate([[np.uint64(START)], h]), return_inverse=True)
            planes = np.ascontiguousarray(tokens[1:].astype("<u4").view(np.uint8).reshape(-1, 4).T)
            docs = np.array([(i is not None, i or 0, bool(g), len(h)) for i, g, h in held], np.int64)
            return pa.RecordBatch.from_pydict({"chunk": [number], "docs": [docs.tobytes()], "tokens": [pa.compress(planes.tobytes(), codec="zstd", asbytes=True)], "hashes": [hashes.tobytes()]})

        size = 0
        for b in batches:
            for i, t, g in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("good").to_pylist(), strict=True):
                held.append((i, g, word_hashes(t)))
                size += len(held[-1][2]) + 8
                if size > chunk_words:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return marked.mapInArrow(run, "chunk long, docs binary, tokens binary, hashes binary")


def read_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's documents (known id, id, good, words), its words, and the hashes that they are places of."""
    docs = np.frombuffer(row["docs"], np.int64).reshape(-1, 4)
    n = int(docs[:, 3].sum())
    planes = np.frombuffer(pa.decompress(row["tokens"], 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return docs, np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64), np.frombuffer(row["hashes"], np.uint64)


def send_keys(chunks: DataFrame, bits: int) -> DataFrame:
    """Of each chunk, for each range of hashes that it has any of, its distinct words and bigrams with their counts."""

    def run(batches):
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for b in batches:
            for row in b.to_pylist():
                docs, tokens, hashes = read_chunk(row)
                if not len(tokens):
                    continue
                before, keys, pair = pair_keys(tokens, hashes, docs[:, 3])
                good = np.repeat(docs[:, 2] > 0, docs[:, 3])
                count = lambda x, n: np.stack([np.bincount(x, minlength=n), np.bincount(x[good], minlength=n)], 1)
                word_n, pair_n = np.concatenate([count(tokens, len(hashes)), count(before, len(hashes))], 1), count(pair, len(keys))
                out: list[tuple] = []
                at = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for k in (hashes, keys)]
                for r in np.flatnonzero(np.diff(at[0]) + np.diff(at[1])).tolist():
                    w, p = (slice(x[r], x[r + 1]) for x in at)
                    out.append((row["chunk"], r, hashes[w].tobytes(), squeezed(word_n[w]), keys[p].tobytes(), squeezed(pair_n[p])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["chunk", "range", "words", "word_n", "pairs", "pair_n"])

    return chunks.mapInArrow(run, "chunk long, range long, words binary, word_n binary, pairs binary, pair_n binary")


def answer_keys(sent: DataFrame) -> DataFrame:
    """For each chunk and range, the sums over all chunks of the keys that the chunk sent, in their order; and the range's own totals."""

    def add(group: pa.Table) -> pa.Table:
        out, totals = {"chunk": group.column("chunk"), "range": group.column("range")}, (0, 0, 0)
        for k, n, width in (("words", "word_n", 4), ("pairs", "pair_n", 2)):
            ends = np.cumsum([len(x) // 8 for x in group.column(k).to_pylist()])
            keys, at = np.unique(np.frombuffer(b"".join(group.column(k).to_pylist()), np.uint64), return_inverse=True)
            counts = expanded(group.column(n), width)
            sums = np.stack([np.bincount(at, counts[:, c], len(keys)) for c in range(width)], 1).astype(np.int64)
            out[n] = pa.array([squeezed(x) for x in np.split(sums[at], ends[:-1])], pa.binary())
            if k == "words":
                totals = (int((keys > UNK).sum()), int(sums[:, 0].sum()), int(sums[:, 1].sum()))
        first = np.arange(group.num_rows) == 0
        return pa.Table.from_pydict(out | {c: pa.array(np.where(first, t, 0)) for c, t in zip(("n_words", "total", "good"), totals, strict=True)})

    return sent.groupBy("range").applyInArrow(add, "chunk long, range long, word_n binary, pair_n binary, n_words long, total long, good long")


def good_documents(labels: DataFrame, folds: int = FOLDS, label: str = "quality") -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    return known.filter((F.col("y") == 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != 0)).select("doc_id")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, size: int | None = None, mu: float = 1000.0, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 1_500_000) -> DataFrame:
    """One row per document: tokens, mean losses under both models, and their difference."""
    texts = doc_texts(docs, id_col, text_col)
    vocab = None if size is None else vocabulary(texts, size)
    # About 32 MB of text a range, and at least 1024 ranges, which deal evenly: a chunk sends a row to each, so more ranges than needed cost rows.
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(10, (chars >> 25).bit_length())
    # Sorted and written, the ids take about a byte each: Spark broadcasts them if their files are under its threshold, else it shuffles.
    target = written(target.select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    marked = texts.join(target.select("doc_id", F.lit(True).alias("good")), "doc_id", "left").select("doc_id", "text", "good")
    chunks = written(cut_chunks(marked, vocab, chunk_words))
    answers = written(answer_keys(send_keys(chunks, bits)))
    n_words, *n = (x or 0 for x in answers.agg(F.sum("n_words"), F.sum("good"), F.sum("total")).first())
    width = size if size is not None else n_words + 2
    release(docs.sparkSession)  # the keys' shuffle files are as large as the input

    def score(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        docs, tokens, hashes = read_chunk(chunk.to_pylist()[0])
        lengths = docs[:, 3]
        before, keys, pair = pair_keys(tokens, hashes, lengths)
        answered = answered.sort_by("range")
        word_n, pair_n = expanded(answered.column("word_n"), 4), expanded(answered.column("pair_n"), 2)
        first = np.zeros(len(keys), np.int64)
        first[pair] = np.arange(len(pair))  # one place of each bigram
        v, w = before[first], tokens[first]
        doc, means = np.repeat(np.arange(len(lengths)), lengths), []
        for k, total in ((1, n[0]), (0, n[1])):  # target, background
            p = mu * (word_n[w, k] + 1.0) / (total + width)
            loss = -np.log((pair_n[:, k] + p) / (word_n[v, 2 + k] + mu))
            means.append(np.bincount(doc, loss[pair], len(lengths)) / np.maximum(lengths, 1))
        g, e = means
        return pa.Table.from_arrays([pa.array(docs[:, 1], mask=docs[:, 0] == 0), pa.array(lengths), pa.array(g), pa.array(e), pa.array(g - e)], names=[f.split()[0] for f in SCORED.split(", ")])

    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "range", "word_n", "pair_n").groupBy("chunk")).applyInArrow(score, SCORED)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good_documents(table(spark, sf_dir, "labels")))
