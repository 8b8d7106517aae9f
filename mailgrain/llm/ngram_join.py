"""Jaccard similarity self-join of texts on word shingles: MinHash LSH forest, then exact verification.

1. Each text becomes a set of 64-bit shingle fingerprints (five words each) and, for each tree, a label of ``max_depth`` MinHash values.
   A tree is the sorted labels, that is a prefix trie; two texts meet in it at the length of their common prefix. No pair needs a
   shorter prefix than the floor, at which one at the threshold meets in some tree with probability ``recall``.
2. Texts with equal sets are copies, by a 128-bit digest of fingerprints of 128 bits: one stands for all, with their number.
3. Spark groups what meets at the floor: texts of one floor prefix are linked to the smallest of them, and the connected
   components of these links are the candidate groups, so each set travels once, however many subtries it lies in.
4. A group's labels are sorted, and its pairs compared exactly by falling length of their common prefix, only those that share
   one. The prefix is shortened until the links still missing, estimated from the similarities of those found (a link of
   similarity s is met at depth d with probability 1 - (1 - s^d)^trees), are below ``missed`` of them, or the floor is reached.
5. A group over ``block`` texts or ``block_bytes`` is compared in blocks. Before, the sets near its centre (the shingles that most of
   one block hold) are taken out: sets within half the allowed distance of one centre are linked by the triangle inequality,
   so near copies of one text, however many, travel twice and are never compared with each other. Only the other texts
   of the group, n of them, meet each block: n x (group / block) rows, which for a group that is no such ball is quadratic.
6. Classes are the connected components of the verified links. Only link counts and forests leave a task, never pairs.

What decides a link: sets of fewer than ``threshold / (1 - threshold)`` shingles (four, at 0.8) can only be linked by being equal, which is
decided on 128 bits; others by their 64-bit fingerprints, where a false link takes a pair that truly shares most of its shingles and
also a collision among the few others. The MinHash values have 32 bits; they only choose what is compared.

Words are split at blanks, in lower case, without punctuation at their ends. Defined results: a text with one to four
words is one shingle; a text without words (null, empty, punctuation only) is compared as a whole, so null and empty
texts form one class; repeated rows count as links of each other; class_id is the smallest doc_id of the class, null only if
all are; an empty table gives no rows; other columns are not read, and ``drop_near_copies`` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Words, free_names, keep_only, table, written
from .toxicity import _EDGES

SHINGLE = 5
TREES = 32
THRESHOLD = 0.8
MAX_DEPTH = 8
ROWS = "doc_id long, fp long, local long, head boolean, size int, same binary, keys array<long>, deeper binary, shingles binary"


def meeting(similarity, depth: int, trees: int = TREES):
    """Chance that a pair shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = 0.9999) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with the target recall."""
    for depth in range(max_depth, 0, -1):
        if meeting(threshold, depth, trees) >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def word_digest(word: str) -> bytes:
    """128 bits of a word without punctuation at its ends; nothing for punctuation alone."""
    bare = word.strip(_EDGES)
    return xxhash.xxh3_128_digest(bare.encode()) if bare else b""


_words = Words(word_digest, 200_000)


def shingles(text: str) -> tuple[np.ndarray, bytes]:
    """(sorted distinct 64-bit fingerprints of the text's shingles, 128-bit digest of the set by its 128-bit fingerprints)."""
    h = np.frombuffer(b"".join([_words[w] for w in text.lower().split()]), "<u8").reshape(-1, 2)
    if not len(h):
        return np.array([xxhash.xxh3_64_intdigest(text.encode())], np.uint64), xxhash.xxh3_128_digest(text.encode(), 1)
    size = min(SHINGLE, len(h))
    mixed = np.zeros((len(h) - size + 1, 2), np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : len(h) - size + 1 + k]) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed[np.lexsort((mixed[:, 1], mixed[:, 0]))]
    mixed = mixed[np.concatenate([[True], (mixed[1:] != mixed[:-1]).any(1)])]
    first = mixed[:, 0]
    return np.ascontiguousarray(first[np.concatenate([[True], first[1:] != first[:-1]])]), xxhash.xxh3_128_digest(np.ascontiguousarray(mixed).tobytes())


def least_size(threshold: float) -> float:
    """Smaller sets are linked only if they are equal."""
    return threshold / (1 - threshold) - 1e-9 if threshold < 1 else float("inf")


class Forest:
    """Labels of a set in each tree: a hash of the floor prefix, and the values after it."""

    def __init__(self, trees: int, floor: int, depth: int):
        rng = np.random.default_rng(11)
        self.trees, self.floor, self.depth = trees, floor, depth
        self.mul = rng.integers(1, 2**31, (trees * depth, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 2**32, (trees * depth, 1), np.uint32)

    def labels(self, sets: np.ndarray) -> tuple[list[int], bytes]:
        low = np.full(self.trees * self.depth, 2**32 - 1, np.uint32)
        for a in range(0, len(sets), 1024):
            low = np.minimum(low, (sets[None, a : a + 1024] * self.mul + self.add).min(1))
        slices = low.astype("<u4").reshape(self.trees, self.depth)
        keys = [xxhash.xxh64_intdigest(slices[t, : self.floor].tobytes(), t) - 2**63 for t in range(self.trees)]
        return keys, slices[:, self.floor :].astype("<u2").tobytes()


def slices(batches, rows: int = 64):
    """Arrow batches in slices of a few rows: Spark's hold up to 10,000, and what is made of them is larger than their texts."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def sketch(batches, forest: Forest, base: int):
    """ROWS of (doc_id, fp, text) batches, in small batches: a worker keeps neither the texts nor the sets of a whole one."""
    keep_only(_words)  # here, not in a function that Spark pickles, which would bring a cache of its own
    made, seen = 0, {}
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    for b in slices(batches):
        cols: list[list] = [[] for _ in kinds]
        for doc_id, fp, text in zip(b.column("doc_id").to_pylist(), b.column("fp").to_pylist(), b.column("text").to_pylist(), strict=True):
            s, same = shingles(text)
            local = seen.get(same)
            head = (None,) * 3
            if local is None:
                local = seen[same] = base + made
                made += 1
                head = (*forest.labels((s >> np.uint64(32)).astype(np.uint32)), s.astype("<u8").tobytes())
            for c, v in zip(cols, (doc_id, fp, local, head[0] is not None, len(s), same, *head), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in ROWS.split(", ")])


def common_prefixes(keys: np.ndarray, deeper: np.ndarray, floor: int) -> np.ndarray:
    """Longest common prefix of each pair over all trees, 0 below the floor: from the sorted labels, (text x tree) and (text x tree x level)."""
    n, trees = keys.shape
    tree, row = np.repeat(np.arange(trees), n), np.tile(np.arange(n), trees)
    levels = [deeper[:, :, k].T.ravel() for k in range(deeper.shape[2])]
    order = np.lexsort((*levels[::-1], keys.T.ravel(), tree))
    row, same = row[order], np.ones(n * trees - 1, bool)
    out = np.zeros((n, n), np.int8)
    for depth, label in enumerate((tree, keys.T.ravel(), *levels), floor - 1):
        label = label[order]
        same = same & (label[1:] == label[:-1])
        if depth < floor:
            continue
        subtrie = np.concatenate([[0], np.cumsum(~same)])
        for k in range(1, n):
            hit = subtrie[k:] == subtrie[:-k]
            if not hit.any():
                break
            a, b = row[:-k][hit], row[k:][hit]
            out[a, b] = out[b, a] = depth
    return out


def numbered(sets: list[np.ndarray]) -> np.ndarray:
    """The sets' values, one after another, as numbers from 0 in their order: np.unique's inverse at half its memory."""
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    flat = flat[order]
    new = flat[1:] != flat[:-1]
    del flat
    at = np.zeros(len(order), np.int32)
    at[order[1:]] = np.cumsum(new, dtype=np.int32)
    return at


def link_block(frame: pd.DataFrame, threshold: float, floor: int, missed: float = 1e-5) -> pd.DataFrame:
    """Counts and forest of the links within one block, or between two: rows (rep, links, parent)."""
    own, first = frame["own"].to_numpy(), frame["first"].to_numpy()
    sets = [np.frombuffer(b, "<u8") for b in frame["shingles"]]
    sizes = np.array([len(s) for s in sets])
    keys = np.stack([np.asarray(k) for k in frame["keys"]])
    n, trees = keys.shape
    deeper = np.stack([np.frombuffer(b, "<u2").reshape(trees, -1) for b in frame["deeper"]])
    depths = common_prefixes(keys, deeper, floor)
    wanted = np.triu(own[:, None] & own, 1) | (first[:, None] & ~first & ~own)
    wanted &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-9
    wanted &= np.minimum(sizes[:, None], sizes) >= least_size(threshold)  # the sets of different texts here are not equal
    depths[~wanted] = 0
    at = numbered(sets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mask, reps, copies = np.zeros(int(at.max()) + 1, bool), frame["rep"].to_numpy(), frame["copies"].to_numpy()
    links, parent, expected, found = np.zeros(n, np.int64), np.arange(n), 0.0, []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for depth in range(floor + deeper.shape[2], floor - 1, -1):
        for i in np.flatnonzero((depths == depth).any(1)).tolist():
            others = np.flatnonzero(depths[i] == depth)
            mask[at[starts[i] : starts[i + 1]]] = True
            both = np.array([np.count_nonzero(mask[at[starts[j] : starts[j + 1]]]) for j in others.tolist()])
            mask[at[starts[i] : starts[i + 1]]] = False
            union = sizes[others] + sizes[i] - both
            good = both >= threshold * union - 1e-9
            near = others[good]
            found.append(both[good] / union[good])
            links[i] += copies[near].sum()
            links[near] += copies[i]
            for j in near.tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        met = meeting(np.concatenate([*found, [threshold]]), depth, trees)  # one more at the threshold, for what none was found of
        expected = float(((1 - met) / met).sum())
        if expected <= missed * (len(met) - 1):
            break
    out = pd.DataFrame({"rep": reps, "links": links, "parent": reps[[find(i) for i in range(n)]]})
    return out[out["links"] > 0]


def centre(frame: pd.DataFrame) -> pd.DataFrame:
    """The shingles that more than half of a block's sets hold."""
    values, n = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in frame["shingles"]]), return_counts=True)
    return pd.DataFrame({"root": [frame["root"].iloc[0]], "middle": [values[n > len(frame) / 2].astype("<u8").tobytes()]})


def is_near(sets: bytes, middle: bytes, threshold: float) -> bool:
    """Within half the distance that a link may have."""
    a, b = np.frombuffer(sets, "<u8"), np.frombuffer(middle, "<u8")
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) >= least_size(threshold) and both >= (1 + threshold) / 2 * (len(a) + len(b) - both) - 1e-9


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``local`` is in ``wanted``, without shuffling them.

    A number is its task's part and a count, so the wanted ones are a bit each, in one array of words per part. These arrays (an
    eighth of a byte a document) are written and joined by part: Spark broadcasts them if their files are under its threshold, else it shuffles.
    """

    def words(frame: pd.DataFrame) -> pd.DataFrame:
        keep_only(None)
        at = frame["local"].to_numpy() & (2**40 - 1)
        bits = np.zeros(int(at.max()) // 64 + 1, np.uint64)
        np.bitwise_or.at(bits, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "words": [bits.view(np.int64)]})

    part = F.shiftright("local", 40)
    bits = written(wanted.select("local", part.alias("part")).groupBy("part").applyInPandas(words, "part long, words array<long>"))
    k = F.col("local").bitwiseAND(F.lit(2**40 - 1))
    word = F.get("words", F.floor(k / 64).cast("int"))
    hit = F.coalesce(F.expr("shiftright(word, cast(k % 64 as int)) & 1"), F.lit(0)) == 1
    marked = rows.withColumn("part", part).join(bits, "part").withColumns({"word": word, "k": k})
    return marked.filter(hit).drop("part", "words", "word", "k")


def deal_blocks(groups: DataFrame, rows: DataFrame, reps: DataFrame, threshold: float, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(root, rep, near, mine, others, whole): the block of each text of a group and those it meets; and the links inside balls."""
    size = only(rows.select("local", "size"), groups.select(F.col("node").alias("local")))
    of_root = groups.join(size, F.col("node") == F.col("local")).groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("words") * 8 / block_bytes)).cast("int")
    sizes = written(of_root.select("root", blocks.alias("blocks")))
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    members = groups.select("root", F.col("node").alias("rep"))
    zero = F.lit(0)
    whole = members.join(sizes.filter("blocks = 1"), "root").select("root", "rep", F.lit(False).alias("near"), zero.alias("mine"), F.array(zero).alias("others"), F.lit(True).alias("whole"))
    large = sizes.filter("blocks > 1")
    none = whole.select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("parent"), "whole").limit(0)
    if large.isEmpty():
        return whole, none

    def nearness(batches):
        keep_only(None)
        for b in slices(batches):
            near = [is_near(s, m, threshold) for s, m in zip(b.column("shingles").to_pylist(), b.column("middle").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("rep"), pa.array(near)], names=["root", "rep", "near"])

    dealt = written(members.join(large, "root").withColumn("mine", part(F.col("blocks"))))
    sets = only(rows.select("local", "shingles"), dealt.select(F.col("rep").alias("local"))).withColumnRenamed("local", "rep")
    placed = dealt.select("root", "rep", "mine").join(sets, "rep")
    middles = placed.filter("mine = 0").groupBy("root").applyInPandas(centre, "root long, middle binary")
    # A row for each block: the group's number alone would be a hot key.
    middles = middles.join(large, "root").select("root", "middle", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("mine"))
    near = written(placed.join(middles, ["root", "mine"]).select("root", "rep", "shingles", "middle").mapInArrow(nearness, "root long, rep long, near boolean"))
    ball = near.filter("near").join(reps.select("rep", "copies"), "rep")
    # One row a group, written: Spark broadcasts such tables under its own threshold, and the groups' numbers are no hot keys.
    inside = written(ball.groupBy("root").agg(F.sum("copies").alias("all"), F.min("rep").alias("parent")))
    links = ball.join(inside, "root").select("rep", (F.col("all") - F.col("copies")).alias("links"), "parent", F.lit(False).alias("whole"))
    count = near.groupBy("root").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far")).join(large, "root").join(of_root.select("root", "n"), "root")
    share = lambda c: F.ceil(F.col("blocks") * F.col(c) / F.col("n")).cast("int")
    count = written(count.select("root", share("n_far").alias("far_blocks"), share("n_near").alias("near_blocks")).filter("far_blocks > 0"))
    placed = near.join(count, "root").withColumn("mine", F.when(F.col("near"), F.col("far_blocks") + part(F.greatest("near_blocks", F.lit(1)))).otherwise(part(F.col("far_blocks"))))
    last = F.col("far_blocks") + F.when(F.col("near"), 0).otherwise(F.col("near_blocks")) - 1
    split = placed.select("root", "rep", "near", "mine", F.sequence(zero, last).alias("others"), F.lit(False).alias("whole"))
    return whole.unionByName(split), links


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = 0.9999, block: int = 512, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, kept (the first row of its class), fp (xxhash64 of its text)."""
    floor = floor_depth(threshold, trees, recall=recall)

    def sketches(batches):
        yield from sketch(batches, Forest(trees, floor, MAX_DEPTH), TaskContext.get().partitionId() << 40)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(src.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(sketches, ROWS))

    # Copies: the smallest number of a task's gathering stands for all equal sets.
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp"))
    local = rows.groupBy("local", "same").agg(F.count("*").alias("n"), first_row.alias("first"))
    reps = local.groupBy("same").agg(F.min("local").alias("rep"), F.sum("n").alias("copies"), F.min("first").alias("first"))
    of_local = written(local.select("local", "same").join(reps, "same").select("local", "rep", "copies", "first"))
    reps = of_local.filter("local = rep").select("rep", "copies", "first")

    # Candidate groups: texts that share a floor prefix in a tree are linked to the smallest of them.
    heads = rows.filter("head")
    own = reps.select(F.col("rep").alias("local"))
    prefixes = only(heads.select("local", "keys"), own).select(F.col("local").alias("rep"), F.explode("keys").alias("key"))
    buckets = prefixes.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).filter("n > 1").select("key", "low")
    edges = prefixes.join(buckets, "key").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    groups = written(components(edges, cut=written))

    # Verification: in a group, or blocks of it against each other.
    dealt, ball = deal_blocks(groups, heads, reps, threshold, block, block_bytes)
    pairs = dealt.select("root", "rep", "mine", F.explode("others").alias("other"), "whole")
    pairs = pairs.select("root", "rep", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") == F.col("other")).alias("own"), (F.col("mine") < F.col("other")).alias("first"), "whole")
    sets = only(heads.select("local", "keys", "deeper", "shingles"), groups.select(F.col("node").alias("local")))
    payload = pairs.join(sets.withColumnRenamed("local", "rep"), "rep").join(reps.select("rep", "copies"), "rep")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        keep_only(None)
        return link_block(frame.sort_values("rep", ignore_index=True), threshold, floor).assign(whole=bool(frame["whole"].iloc[0]))

    linked = written(payload.groupBy("root", "i", "j").applyInPandas(verify, "rep long, links long, parent long, whole boolean").unionByName(ball))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))

    # Classes: a group of one block has its forest already; others join theirs.
    whole = linked.filter("whole").select(F.col("rep").alias("node"), F.col("parent").alias("root"))
    joined = components(linked.filter("NOT whole").select(F.col("rep").alias("a"), F.col("parent").alias("b")), cut=written)
    roots = whole.unionByName(joined)
    classed = reps.join(roots, F.col("rep") == F.col("node"), "left").join(counts, "rep", "left").select("rep", "first", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    lead = classed.groupBy("root").agg(F.min(F.struct("first", "rep")).alias("lead"))
    per_rep = classed.join(lead, "root").select("rep", "lead", "links")
    per_local = of_local.join(per_rep, "rep").select("local", "lead", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    out = rows.select("doc_id", "fp", "local").join(per_local, "local")
    return out.select("doc_id", F.col("lead.first.doc_id").alias("class_id"), "n_links", (mine == F.col("lead.first")).alias("kept"), "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id, then the smallest hash of its text; of rows equal in both, any one."""
    (key,) = free_names(docs, "key")

    def joined(doc_id, fp):
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), fp)

    stay = similar_documents(docs, id_col=id_col, text_col=text_col).filter("kept").select(joined(F.col("doc_id"), F.col("fp")).alias(key))
    marked = docs.withColumn(key, joined(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    return marked.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: The same by an exact self-join of shingles: classes by recursion, for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, [y FOR y IN [regexp_replace(x, '^[!-/:-@\[-`{-~¡¿«»“”„‘’…–—]+|[!-/:-@\[-`{-~¡¿«»“”„‘’…–—]+$', '', 'g') FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\s+')] IF y <> ''] AS l
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN ['=' || text] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
  ELSE [array_to_string(l[i : i + 4], ' ') FOR i IN range(1, len(l) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hit FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE hit >= 0.8 * (a.c + b.c - hit) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, (SELECT min(c) FROM r WHERE r.x = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links FROM documents d
"""
