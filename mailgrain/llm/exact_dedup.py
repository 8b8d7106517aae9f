"""Exact deduplication with Patricia tries as owners of texts.

1. Each task gathers the equal texts it reads, so a text goes on once a task, however many copies there are.
2. These texts are dealt by length and content hash; each partition inserts the full byte strings into a compressed
   radix trie whose terminal nodes hold the owner, the row with the smallest doc_id. A trie over its memory limit
   spills its largest subtree to a temporary file and works it off later, recursively.
3. Rows find their owner by the number of their task's gathering, never by text, so a hot text is no hot key.

Defined results: null text counts as empty, and all empty texts are one group; null doc_ids come after all others as
owners; of rows with equal text and equal doc_id exactly one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, free_names, table, written

BLANKS = b" \t\n\r\x0b\x0c"
GATHERED = "doc_id long, local long, head boolean, copies long, n_bytes long, content_hash long, text binary"
OWNERS = "local long, keep_id long, owner_local long, group_size long, text_sha256 string"


def normalise(text: bytes) -> bytes:
    """Each run of blanks (space, tab, line ends) becomes one space."""
    words = text.split()  # of bytes: at just these blanks
    if not words:
        return b" " if text else b""
    return b" " * (text[:1] in BLANKS) + b" ".join(words) + b" " * (text[-1:] in BLANKS)


class Node:
    __slots__ = ("edge", "children", "value", "file")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.value, self.children, self.file = edge, value, {}, None


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by bisection on slices."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings to merged values. ``merge(old, new)`` combines the values of equal strings."""

    def __init__(self, merge, max_bytes: int = 256 << 20, depth: int = 0):
        self.merge, self.max_bytes, self.depth = merge, max_bytes, depth
        self.root, self.held, self.spilled = Node(b""), 0, 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], value), node.file)
                return
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.held += len(key) - at + 200
                break
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            n = common_prefix(child.edge, key, at)
            upper = Node(child.edge[:n])
            child.edge = child.edge[n:]
            upper.children[child.edge[0]] = child
            node.children[key[at]] = upper
            self.held += 200
            node, at = upper, at + n
        if self.held > self.max_bytes:
            self.spill()

    @staticmethod
    def weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.edge) + 200
            stack.extend(x.children.values())
        return total

    @staticmethod
    def records(file) -> Iterator:
        """What a subtree's file holds; it is closed at the end."""
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                break
        file.close()

    def spill(self) -> None:
        """Move the heaviest subtree below the first branching to a file; later strings of that subtree go there too."""
        node = self.root
        while len(node.children) == 1 and node.file is None:
            node = next(iter(node.children.values()))
        open_ = [c for c in node.children.values() if c.file is None]
        if not open_:
            self.held = 0  # all of it is in files already
            return
        top = max(open_, key=self.weight)
        before, file = self.weight(top), tempfile.TemporaryFile()
        stack = [(top, b"")]
        while stack:
            x, prefix = stack.pop()
            if x.file is not None:  # a part of it was spilled before
                for key, value in self.records(x.file):
                    pickle.dump((prefix + key, value), file)
                continue
            if x.value is not None:
                pickle.dump((prefix, x.value), file)
            stack += [(c, prefix + c.edge) for c in x.children.values()]
        top.value, top.children, top.file = None, {}, file
        self.held -= before - len(top.edge) - 200
        self.spilled += 1

    def values(self) -> Iterator:
        """The merged value of every string; spilled subtrees are built and walked one after the other."""
        stack = [self.root]
        while stack:
            x = stack.pop()
            if x.file is not None:
                below = PatriciaTrie(self.merge, self.max_bytes, self.depth + 1)
                for key, value in self.records(x.file):
                    below.insert(key, value)
                yield from below.values()
                continue
            if x.value is not None:
                yield x.value
            stack.extend(x.children.values())


def rank(doc_id, local) -> tuple:
    return doc_id is None, doc_id or 0, local


def exact_groups(docs: DataFrame, gather_bytes: int = 64 << 20, trie_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""

    def gather(batches):
        base, made = TaskContext.get().partitionId() << 40, 0
        seen: dict[bytes, list] = {}
        held = 0

        def rows():
            nonlocal made
            cols: list[list] = [[] for _ in range(7)]
            for text, ids in seen.items():
                local, made = base + made, made + 1
                ids.sort(key=lambda d: (d is None, d or 0))
                for k, d in enumerate(ids):
                    head = (len(ids), len(text), xxhash.xxh64_intdigest(text) - 2**63, text) if k == 0 else (None,) * 4
                    for c, v in zip(cols, (d, local, k == 0, *head), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [f.split()[0] for f in GATHERED.split(", ")]
            for a in range(0, len(cols[0]), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 1000], t) for c, t in zip(cols, kinds, strict=True)], names=names)
            seen.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                text = normalise(text)
                if text in seen:
                    seen[text].append(doc_id)
                else:
                    seen[text] = [doc_id]
                    held += len(text)
            if held > gather_bytes:
                yield from rows()
                held = 0
        yield from rows()

    def own(batches):
        def merge(old, new):
            old[2].extend(new[2])
            return min(old[0], new[0]), old[1] + new[1], old[2], old[3]

        trie = PatriciaTrie(merge, trie_bytes)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for text, doc_id, local, copies in zip(texts, batch.column("doc_id").to_pylist(), batch.column("local").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                trie.insert(text, (rank(doc_id, local), copies, [local], hashlib.sha256(text).hexdigest()))
        cols: list[list] = [[] for _ in range(5)]
        for (no_id, doc_id, owner), copies, locals_, sha in trie.values():
            for x in locals_:
                for c, v in zip(cols, (x, None if no_id else doc_id, owner, copies, sha), strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in OWNERS.split(", ")]
        for a in range(0, len(cols[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 10_000], t) for c, t in zip(cols, kinds, strict=True)], names=names)

    gathered = written(doc_texts(docs, id_col, text_col).mapInArrow(gather, GATHERED))
    heads = gathered.filter("head").select("doc_id", "local", "copies", "text", "n_bytes", "content_hash")
    owners = heads.repartition("n_bytes", "content_hash").mapInArrow(own, OWNERS)
    rows = gathered.select("doc_id", "local", "head").join(owners, "local")
    kept = F.col("head") & (F.col("local") == F.col("owner_local"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were: that with the smallest doc_id, then the smallest raw text.

    Of rows equal in both any one stays. Joined on doc_id and content hash; equal rows with equal doc_ids meet in the same partition,
    so choosing among them costs no further shuffle.
    """
    key, row = free_names(docs, "key", "row")

    def joined(doc_id, sha):
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), sha)

    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.regexp_replace(raw, r"[ \t-\r]+", " ")
    stay = exact_groups(docs, id_col=id_col, text_col=text_col).filter("kept").select(joined(F.col("doc_id"), F.col("text_sha256")).alias(key))
    marked = docs.withColumn(key, joined(F.col(id_col), F.sha2(text.cast("binary"), 256)))
    one = marked.join(stay, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), raw).alias(row))
    return one.select(f"{row}.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
