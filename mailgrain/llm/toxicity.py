"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, of neighbouring pairs and of pairs with one or two words between,
hashed to 32 bits, so that a long clean text hardly ever meets a weight by accident. FTRL-proximal keeps a learning rate per
coordinate and an L1 penalty, which leaves few weights; these alone go to the executors (12 bytes for each coordinate of the
bounded sample that keeps a weight). Scoring is one pass over the texts with no shuffle.

Training takes at most ``max_rows`` labelled rows, those with the smallest hashes, and ``max_features`` coordinates; that
bound is the only place where rows are left out, and holds however often a doc_id is repeated.

Defined results: null and empty texts have no features and score as the bias alone; rows whose label or doc_id is null
don't train; a doc_id labelled twice counts by its highest label; rows of equal doc_id and text train once; with no
training rows every score is 0; repeated rows score alike; an empty table gives no rows; other columns are never inputs, and
``drop_toxic`` returns them as they are.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, doc_texts, keep_only, table, written

FOLDS = 5
ALPHA, L1, EPOCHS = 1.0, 10.0, 5
_EDGES = string.punctuation + "¡¿«»“”„‘’…–—"


def word_hash(word: str) -> int:
    bare = word.strip(_EDGES)
    return zlib.crc32(bare.encode()) if bare else -1


_words = Words(word_hash)


def keep_words() -> None:
    """For the start of a task that hashes words."""
    keep_only(_words)


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each word, lower case and without punctuation at its ends; words of punctuation alone are skipped."""
    h = np.array([_words[w] for w in text.lower().split()], np.int64)
    return h[h >= 0].astype(np.uint64)


def feature_hashes(text: str) -> np.ndarray:
    """32-bit coordinates of words, pairs and skip pairs, repeated as they occur."""
    h = word_hashes(text)
    mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            mixed.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] * np.uint64(0x165667B19E3779F9)) * np.uint64(2 * min(gap, 2) + 1))
    return (np.concatenate(mixed) >> np.uint64(32)).astype(np.uint32)


def ftrl_fit(rows: list[np.ndarray], labels: list[int], alpha: float = ALPHA, beta: float = 1.0, l1: float = L1, l2: float = 0.5, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights (coordinates, values) and bias of presence features, by FTRL-proximal; the bias has no penalty.

    A coordinate's sum of gradients is at most one a row and epoch, so one that is in no more than l1 / epochs rows never
    passes the penalty, and is left out before with the same result.
    """
    known, n_rows = np.unique(np.concatenate(rows), return_counts=True)
    known = known[n_rows > l1 / epochs]
    rows = [np.searchsorted(known, x[np.isin(x, known, assume_unique=True)]).astype(np.int32) for x in rows]
    n, z, bias_n, bias_z = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k], labels[k]
            w = weights(z[x], n[x])
            bias = -bias_z * alpha / (beta + np.sqrt(bias_n))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            for_n = n[x] + g * g
            z[x] += g - (np.sqrt(for_n) - np.sqrt(n[x])) / alpha * w
            n[x] = for_n
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return known[at], w[at], float(-bias_z * alpha / (beta + np.sqrt(bias_n)))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_features: int, target: str = "toxic") -> DataFrame:
    """(doc_id, fp, y, x) of the sample that trains: a row for each different text of a labelled doc_id outside the held-out fold.

    Labelled ids, then their rows, are taken in the order of their hashes, up to ``max_rows`` of either, and up to ``max_features``
    coordinates in all. The last choice needs only the rows' sizes, at most ``max_rows`` of them.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("y"))
    chosen = known.filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def features(batches):
        keep_words()
        for b in batches:
            x = [np.unique(feature_hashes(t)).view(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), b.column("y"), pa.array([len(v) for v in x], pa.int64()), pa.array(x, pa.list_(pa.int32()))], names=["doc_id", "fp", "y", "size", "x"])

    # A doc_id may have very many rows: equal ones are one, and of different ones the first by hash are taken.
    different = doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("fp"), "y", "text").dropDuplicates(["doc_id", "fp"])
    rows = written(different.mapInArrow(features, "doc_id long, fp long, y int, size long, x array<int>"))
    place = (F.xxhash64("doc_id", "fp"), F.col("doc_id"), F.col("fp"))
    first = rows.select("doc_id", "fp", "size").orderBy(*place).limit(max_rows)
    upto = F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    fits = first.withColumn("upto", upto).filter(F.col("upto") <= max_features).select("doc_id", "fp")
    return rows.join(F.broadcast(fits), ["doc_id", "fp"], "left_semi").select("doc_id", "fp", "y", "x")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_features: int = 12_000_000, target: str = "toxic"):
    """Sparse weights from the labelled rows outside the held-out fold; None without any.

    One task fits the bounded sample (4 bytes a coordinate, 48 MB at most); to the driver come the weights that are not zero.
    """

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("fp", "ascending")])
        x = group["x"].combine_chunks()
        flat, at = x.values.to_numpy().view(np.uint32), x.offsets.to_numpy()
        known, values, bias = ftrl_fit([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], group["y"].to_pylist())
        return pa.table({"at": pa.array([None, *known.tolist()], pa.int64()), "value": pa.array([bias, *values.tolist()], pa.float64())})

    rows = training_rows(docs, labels, max_rows, max_features, target)
    got = rows.groupBy(F.lit("sample")).applyInArrow(fit, "at long, value double").toArrow()
    if not got.num_rows:
        return None
    weights = got.filter(pc.is_valid(got["at"])).sort_by("at")
    return weights["at"].to_numpy().astype(np.uint32), weights["value"].to_numpy(), got.filter(pc.is_null(got["at"]))["value"][0].as_py()


def scorer(model):
    """texts → scores, on a worker."""
    keep_words()
    if model is None:
        return lambda texts: np.zeros(len(texts))
    at, values, bias = model
    near = np.zeros(2**16, bool)  # a first look at the upper half of a coordinate spares most searches
    near[at >> 16] = True

    def score(texts):
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = feature_hashes(t)
            x = np.unique(x[near[x >> 16]])
            k = np.searchsorted(at, x)
            k = k[(k < len(at)) & (at[np.minimum(k, len(at) - 1)] == x)] if len(at) else k[:0]
            out[i] = bias + values[k].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return score


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            s = score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return doc_texts(docs, id_col, text_col).select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            s = score([t or "" for t in b.column(text_col).to_pylist()])
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
