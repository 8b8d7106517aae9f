"""Phrase collocations of each language: word suffixes in subtrees of bounded size, in the manner of ERA's vertical partitioning.

A phrase of two to ``longest`` words is a candidate if it occurs ``least`` times or more within pieces; it is scored by its weakest cut. All
counts are exact and cover all documents.

1. Chunks. Tasks cut their texts into chunks of about ``chunk_words`` words of one language: the distinct words with their counts, and the
   text as places among them. Words are summed over all chunks, and each chunk gets back the numbers of its frequent words. A phrase with a
   rarer word can't be frequent, so rarer words become breaks, and words alone between breaks go; nothing that could be counted is lost.
2. Vertical partitioning. A word is a prefix of as many suffixes as it has occurrences. Prefixes are grouped, in the order in which they lie, up to
   ``budget`` suffixes a group. A word with more is extended: its suffixes go to several groups by their next word, in the number that its count asks
   for. Where a pair alone has more than a quarter of the budget (only pairs of words that are as frequent can, and only these are counted), it is
   extended in the same way, and so on to the longest phrases. So a group keeps near its budget, however frequent a word, a pair or a passage is.
3. Subtrees. Chunks send each group its suffixes, cut after ``longest`` words, each different one once with its count. A group sorts them, which is
   its depth-truncated suffix subtree: leaves are the different suffixes, and a node's count is the sum of the leaves below it.
   Groups know nothing of each other.
4. Scores. Both parts of every cut of a candidate are frequent phrases or words, so their counts are joined from the nodes; a candidate inside
   a longer one with nearly its count goes; the best of each language are ranked in two steps, first within hashed shares.

A chunk sends one row to each group it has suffixes for, so rows are at most as many as different suffixes of chunks. What a chunk is told of pairs
and longer prefixes is of those that it holds. Joins by word or phrase are of written tables with one row a key on one side, where Spark splits a hot
key of the other.

Defined results: null and empty texts have no words; a null language is "und"; repeated rows count as often as they occur; doc_ids aren't
read, null or not; fewer candidates than ``top`` are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LONGEST, LEAST, TOP = 4, 30, 2000
HELD = 80  # of a hundred: a phrase goes if a longer one has this share of its count
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_FOLD = str.maketrans(string.ascii_uppercase + SEPARATORS + "\t", string.ascii_lowercase + "\n" * len(SEPARATORS) + " ")
CHUNK = "chunk long, lang string, n_words long, words array<string>, counts array<int>, tokens binary"
CODED = "chunk long, lang string, words binary, tokens binary"


class Places(dict):
    """Words → 1, 2, ... in order of appearance; 0 is a break, -1 nothing."""

    def __init__(self):
        super().__init__({"": -1, "\n": 0})

    def __missing__(self, word: str) -> int:
        self[word] = len(self) - 1
        return self[word]


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes, column by column."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x.T).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return len(raw.ravel()).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype, columns: int = 1) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    out = np.ascontiguousarray(planes.T).view(dtype).reshape(columns, -1)
    return out[0] if columns == 1 else out.T


def cut_chunks(docs: DataFrame, chunk_words: int, text_col: str, lang_col: str) -> DataFrame:
    """A row for each chunk: its words, their counts, and its texts as places among them."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[Places, list]] = {}
        size = 0

        def rows():
            nonlocal number
            out: list[tuple] = []
            for lang, (places, parts) in held.items():
                tokens = np.concatenate(parts)
                counts = np.bincount(tokens, minlength=len(places) - 1)[1:].astype(np.int32)
                if len(counts):
                    out.append((number, lang, int(counts.sum()), list(places)[2:], counts, packed(tokens)))
                    number += 1
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in CHUNK.split(", ")])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                places, parts = held.setdefault(lang, (Places(), []))
                words = text.translate(_FOLD).replace("\n", " \n ").split(" ")
                x = np.array([places[w] for w in words] + [0], np.int32)
                parts.append(x[x >= 0])
                size += len(parts[-1])
                if size > chunk_words:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, CHUNK)


def grouped(prefixes: DataFrame, budget: int, size: int = 1) -> DataFrame:
    """Prefixes of ``size`` words with a count f, and where their suffixes go: group ``grp``, or one of ``subs`` groups from there by the next word.

    Neighbours go together up to ``budget`` suffixes; a word with more, and every longer prefix, gets groups for about a quarter of it each. A task groups
    what it holds, so this shuffles nothing. Words also get an id above zero.
    """
    added = ["grp", "subs"] + ["id"] * (size == 1)

    def run(batches):
        base = (TaskContext.get().partitionId() + 1) << 36
        group, held, number = base | size << 33, 0, base
        for b in batches:
            groups, subs = [], []
            for f in b.column("f").to_pylist():
                if size > 1 or f > budget:
                    n = -(-4 * f // budget)
                    groups.append(group + 1)
                    group, held = group + n, budget
                else:
                    if held + f > budget:
                        group, held = group + 1, 0
                    n, held = 1, held + f
                    groups.append(group)
                subs.append(n)
            columns = [pa.array(groups, pa.int64()), pa.array(subs, pa.int64()), pa.array(np.arange(number, number + len(groups)))][: len(added)]
            number += len(groups)
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *added])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema) + "".join(f", {n} long" for n in added)
    return prefixes.mapInArrow(run, schema)


def code_chunk(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk's text as places among its frequent words, others being breaks; ``known`` has (place, id, grp, subs, f) of the frequent ones."""
    rows = chunk.select(["chunk", "lang", "tokens"]).to_pylist()
    known = known.sort_by("place")
    place = known.column("place").to_numpy()
    to = np.zeros(int(place.max()) + 1 if len(place) else 1, np.int32)
    to[place] = np.arange(1, len(place) + 1)
    out: list[dict] = []
    for row in rows:
        tokens = unpacked(row["tokens"], np.int32)
        tokens = np.where(tokens < len(to), to[np.minimum(tokens, len(to) - 1)], 0)
        # Words alone between breaks begin no phrase, and one break is as good as many.
        before, after = np.concatenate([[0], tokens[:-1]]), np.concatenate([tokens[1:], [0]])
        tokens = np.where((before == 0) & (after == 0), 0, tokens)
        tokens = tokens[(tokens > 0) | (np.concatenate([[0], tokens[:-1]]) > 0)].astype(np.int32)
        words = np.stack([known.column(c).to_numpy() for c in ("id", "grp", "subs", "f")], 1).astype(np.int64)
        out.append({"chunk": row["chunk"], "lang": row["lang"], "words": packed(words), "tokens": packed(tokens)})
    return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("tokens", pa.binary())]))


def starts_of(head: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]).any(1)])) if len(head) else np.zeros(0, np.int64)


def mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


class Chunk:
    """A coded chunk on a worker: its different suffixes with their counts, and the group of each under the prefixes known so far."""

    def __init__(self, row: dict, longest: int, budget: int):
        self.number, self.lang = row["chunk"], row["lang"]
        words = np.concatenate([np.zeros((1, 4), np.int64), unpacked(row["words"], np.int64, 4)])
        self.ids, self.frequent = words[:, 0], words[:, 3] > budget // 4
        tokens = unpacked(row["tokens"], np.int32)
        padded = np.concatenate([tokens, np.zeros(longest, np.int32)])
        suffix = np.stack([padded[k : k + len(tokens)] for k in range(longest)], 1)
        for k in range(1, longest):
            suffix[:, k] *= suffix[:, k - 1] > 0
        suffix = suffix[suffix[:, 1] > 0]
        suffix = suffix[np.lexsort(suffix.T[::-1])]
        starts = starts_of(suffix)
        self.suffix, self.n = suffix[starts], np.diff(np.concatenate([starts, [len(suffix)]])).astype(np.int64)
        self.group, self.whole = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first = self.suffix[:, 0]
        self.deal(np.arange(len(starts)), 1, words[first, 1], words[first, 2])
        self.open = words[first, 2] > 1

    def deal(self, at: np.ndarray, size: int, grp: np.ndarray, subs: np.ndarray) -> None:
        """Send suffixes to the groups of their prefix of ``size`` words; where there are several, by the next word, and without one to none."""
        several = subs > 1
        following = self.ids[self.suffix[at, size]] if size < self.suffix.shape[1] else np.zeros(len(at), np.int64)
        to = grp + (mixed(following) % np.maximum(subs, 1).astype(np.uint64)).astype(np.int64) * several
        self.group[at] = np.where(several & (following == 0), -1, to)
        self.whole[at] = size + several  # the shortest prefix that the group has whole

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Different prefixes of ``size`` words of the suffixes whose shorter one is extended and whose last word is frequent enough, as ids, with their counts."""
        at = np.flatnonzero(self.open & (self.suffix[:, size - 1] > 0) & self.frequent[self.suffix[:, size - 1]])
        head = self.suffix[at, :size]
        starts = starts_of(head)
        return self.ids[head[starts]], np.add.reduceat(self.n[at], starts) if len(starts) else np.zeros(0, np.int64)

    def extend(self, size: int, plan: dict[tuple, tuple[int, int]]) -> None:
        """Deal the suffixes of the longer prefixes in the plan anew."""
        at = np.flatnonzero(self.open & (self.suffix[:, size - 1] > 0))
        self.open[:] = False
        head = self.suffix[at, :size]
        starts = starts_of(head)
        got = np.array([plan.get(tuple(x), (0, 0)) for x in self.ids[head[starts]].tolist()], np.int64).reshape(-1, 2)
        got = np.repeat(got, np.diff(np.concatenate([starts, [len(at)]])), axis=0)
        found = got[:, 1] > 0
        self.deal(at[found], size, got[found, 0], got[found, 1])
        self.open[at[found]] = True

    def messages(self):
        """(grp, suffixes) of each group: w1, ..., the count, and the size of the prefix that the group has whole."""
        at = np.flatnonzero(self.group >= 0)
        at = at[np.argsort(self.group[at], kind="stable")]
        edges = np.flatnonzero(np.diff(self.group[at])) + 1
        rows = np.concatenate([self.ids[self.suffix], self.n[:, None], self.whole[:, None]], 1)
        for part in np.split(at, edges) if len(at) else ():
            yield int(self.group[part[0]]), packed(rows[part])


def words(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def with_plan(coded: DataFrame, plan: DataFrame | None, upto: int, longest: int, budget: int, rows, schema: str) -> DataFrame:
    """rows(chunk) of every coded chunk, which has met its part of the plan for prefixes of 2 to ``upto`` words.

    Spark broadcasts the plan under its own threshold, and shuffles the chunks only beyond.
    """
    if plan is not None:
        told = plan.groupBy("chunk").agg(F.collect_list(F.struct("size", F.array(*words(longest)).alias("w"), "grp", "subs")).alias("plan"))
        coded = coded.join(told.withColumnRenamed("chunk", "of"), F.col("chunk") == F.col("of"), "left").drop("of")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                chunk = Chunk(row, longest, budget)
                told = row.get("plan") or []
                for size in range(2, upto + 1):
                    chunk.extend(size, {tuple(x["w"][:size]): (x["grp"], x["subs"]) for x in told if x["size"] == size})
                yield from rows(chunk).to_batches()

    return coded.mapInArrow(run, schema)


def open_prefixes(coded: DataFrame, plan: DataFrame | None, size: int, longest: int, budget: int) -> DataFrame:
    """(chunk, lang, w1, ..., n): of each chunk the prefixes of ``size`` words that may have to be extended."""
    names = words(longest)

    def rows(chunk: Chunk) -> pa.Table:
        ids, n = chunk.prefixes(size)
        ids = np.concatenate([ids, np.zeros((len(ids), longest - size), np.int64)], 1)
        return pa.table({"chunk": pa.array([chunk.number] * len(n), pa.int64()), "lang": pa.array([chunk.lang] * len(n), pa.string()), **{w: pa.array(ids[:, k]) for k, w in enumerate(names)}, "n": pa.array(n)})

    return with_plan(coded, plan, size - 1, longest, budget, rows, "chunk long, lang string, " + ", ".join(f"{w} long" for w in names) + ", n long")


def subtree(longest: int, least: int):
    """A group's frequent nodes: sorted suffixes are a tree, and a node's count is the sum of its leaves."""
    names = words(longest)

    def run(group: pa.Table) -> pa.Table:
        x = np.concatenate([unpacked(m, np.int64, longest + 2) for m in group.column("suffixes").to_pylist()])
        x = x[np.lexsort(x[:, :longest].T[::-1])]
        out, lang = [], group.column("lang")[0].as_py()
        for size in range(2, longest + 1):
            change = (x[1:, :size] != x[:-1, :size]).any(1)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])  # a group has a row at least
            n = np.add.reduceat(x[:, longest], starts)
            whole = (n >= least) & (x[starts, size - 1] > 0) & (x[starts, longest + 1] <= size)
            node = x[starts[whole], :longest].copy()
            node[:, size:] = 0
            out.append(np.concatenate([node, np.full((len(node), 1), size), n[whole, None]], 1))
        nodes = np.concatenate(out)
        return pa.table({"lang": pa.array([lang] * len(nodes), pa.string()), **{w: pa.array(nodes[:, k]) for k, w in enumerate(names)}, "size": pa.array(nodes[:, longest].astype(np.int32)), "a": pa.array(nodes[:, longest + 1])})

    return run, "lang string, " + ", ".join(f"{w} long" for w in names) + ", size int, a long"


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, budget: int = 1_000_000, chunk_words: int = 1_000_000, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, totals), all written: (lang, w1, ..., size, a) by word ids, 0 after the last; (lang, word, f, grp, id); (lang, n)."""
    names = words(longest)
    chunks = written(cut_chunks(docs, chunk_words, text_col, lang_col))
    totals = written(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    used = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "lang", (F.col("place") + 1).alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    vocabulary = written(grouped(used.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), budget))
    known = used.join(vocabulary.select("lang", "word", "id", "grp", "subs", "f"), ["lang", "word"]).select(F.col("chunk").alias("of_chunk"), "place", "id", "grp", "subs", "f")
    coded = written(chunks.select("chunk", "lang", "tokens").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(code_chunk, CODED))

    plan, whole, hot = None, [], vocabulary.filter("subs > 1")  # prefixes of two words and more that are extended; their own counts are known
    for size in range(2, longest):
        if hot.isEmpty():
            break
        met = written(open_prefixes(coded, plan, size, longest, budget))
        hot = written(grouped(met.groupBy("lang", *names).agg(F.sum("n").alias("f")).filter(F.col("f") > budget // 4), budget, size))
        whole.append(hot.filter(F.col("f") >= least).select("lang", *names, F.lit(size).alias("size"), F.col("f").alias("a")))
        told = met.join(hot.select(*names, "grp", "subs"), names).select("chunk", *names, F.lit(size).alias("size"), "grp", "subs")
        plan = written(told if plan is None else plan.unionByName(told))

    def messages(chunk: Chunk) -> pa.Table:
        sent = list(chunk.messages())
        return pa.table({"grp": pa.array([g for g, _ in sent], pa.int64()), "lang": pa.array([chunk.lang] * len(sent), pa.string()), "suffixes": pa.array([m for _, m in sent], pa.binary())})

    sent = with_plan(coded, plan, longest - 1, longest, budget, messages, "grp long, lang string, suffixes binary")
    nodes = sent.groupBy("grp", "lang").applyInArrow(*subtree(longest, least))
    for more in whole:
        nodes = nodes.unionByName(more)
    return written(nodes), vocabulary, totals


def part(names: list[str], start: int, end: int) -> list[Column]:
    """The words from ``start`` to ``end`` of a phrase, as a phrase."""
    return [F.col(names[start + k]) if start + k < end else F.lit(0).cast("long") for k in range(len(names))]


def scored_phrases(phrases: DataFrame, vocabulary: DataFrame, longest: int = LONGEST, held: int = HELD) -> DataFrame:
    """(lang, w1, ..., size, a, l, r, score) of the phrases that no longer one stands for, with the weakest cut of each."""
    names = words(longest)
    keys = [f"p{k + 1}" for k in range(longest)]

    def as_key(columns: list[Column]) -> list[Column]:
        return [c.alias(k) for c, k in zip(columns, keys, strict=True)]

    # The counts of both parts of every cut.
    counts = vocabulary.select(F.col("id").alias("p1"), *[F.lit(0).cast("long").alias(k) for k in keys[1:]], "f").unionByName(phrases.filter(F.col("size") < longest).select(*[F.col(w).alias(k) for w, k in zip(names, keys, strict=True)], F.col("a").alias("f")))
    cuts = []
    for size in range(2, longest + 1):
        for k in range(1, size):
            for side, (start, end) in enumerate(((0, k), (k, size))):
                cuts.append(F.when(F.col("size") == size, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *as_key(part(names, start, end)))))
    parts = phrases.select(*names, F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).select(*names, "c.*")
    found = parts.join(counts, keys).select(*names, "k", "side", "f")
    sums = found.groupBy(*names).agg(*[F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{'lr'[side]}{k}") for k in range(1, longest) for side in (0, 1)])
    scored = phrases.join(sums, names)

    def cut(k: int) -> Column:
        value = F.expr(f"cast(2000000 * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0))) as long)")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    scored = scored.withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, longest)])))
    # The largest count of the longer phrases that hold a phrase.
    inner = [F.when(F.col("size") == size, F.struct(*as_key(part(names, start, start + length)))) for size in range(3, longest + 1) for length in range(2, size) for start in range(size - length + 1)]
    longer = phrases.filter("size > 2").select("a", F.explode(F.filter(F.array(*inner), lambda c: c.isNotNull())).alias("c")).select("c.*", F.col("a").alias("above"))
    longer = longer.groupBy(*keys).agg(F.max("above").alias("above"))
    same = [F.col(w) == F.col(k) for w, k in zip(names, keys, strict=True)]
    kept = scored.join(longer, same, "left").filter(F.col("above").isNull() | (F.col("above").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * held))
    return kept.select("lang", *names, "size", "a", "cut.l", "cut.r", "cut.score")


def best_phrases(scored: DataFrame, vocabulary: DataFrame, totals: DataFrame, top: int = TOP, longest: int = LONGEST, shares: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` of each language."""
    names = words(longest)
    scored = written(scored.withColumn("share", F.pmod(F.xxhash64(*names), F.lit(shares))))
    # The score and count at the last rank don't depend on how ties are broken; only what reaches them is spelled out.
    order = [F.desc("score"), F.desc("a")]
    within = scored.select("lang", "share", "score", "a").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    last = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") == top).select("lang", F.struct("score", "a").alias("last"))
    reach = written(scored.join(last, "lang", "left").filter(F.col("last").isNull() | (F.struct("score", "a") >= F.col("last"))).drop("last"))
    spelled = reach.select(*names, F.posexplode(F.array(*names)).alias("at", "id")).filter("id > 0").join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy(*names).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    whole = reach.join(spelled, names)
    order.append(F.asc("phrase"))
    first = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, held: int = HELD, **options) -> DataFrame:
    """The best phrases of each language."""
    phrases, vocabulary, totals = frequent_phrases(docs, longest, least, **options)
    return best_phrases(scored_phrases(phrases, vocabulary, longest, held), vocabulary, totals, top, longest)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i : i + k - 1] AS ph, count(*) AS f FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY 1, 2),
c AS (SELECT * FROM g WHERE len(ph) > 1 AND f >= 30),
cuts AS (SELECT lang, ph, f, unnest(range(1, len(ph))) AS k FROM c),
v AS (SELECT cuts.lang, cuts.ph, cuts.f AS a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * cuts.f) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.ph = cuts.ph[: k] JOIN g y ON y.lang = cuts.lang AND y.ph = cuts.ph[k + 1 :]),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
u AS (SELECT lang, f, ph[i : i + k - 1] AS inner_ph FROM (SELECT lang, f, ph, k, unnest(range(1, len(ph) - k + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < len(ph))),
d AS (SELECT lang, inner_ph, max(f) AS above FROM u GROUP BY 1, 2),
o AS (SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM b LEFT JOIN d ON d.lang = b.lang AND d.inner_ph = b.ph WHERE above IS NULL OR 100 * above < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
