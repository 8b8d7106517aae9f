"""Merkle manifest of a dataset: a root that any row can be proved against, built with sibling-shift self-joins.

A row is a leaf: the digest of its columns, each with its length in front. Leaves of one group (a source) ascend by id and form a
tree of ``fanout`` children; the groups' roots, in the order of the groups, form the tree above. A node is (group number, place,
digest), and a group's number is its place in the upper tree.

1. Places. Rows are dealt by range of (group, id, digest) and written; a row's place is its position in its part less that of its
   group's first row there, and what earlier parts hold of the group: one row for each part and group, summed by group. So a group
   of any size is numbered without being in one task.
2. Levels. Every level equijoins its nodes with the nodes at their siblings' places: XOR 1 for two children, else one join for each
   slot offset. The rows in slot zero then emit the parents. A level is written, and is a third (for three children) of the one below.
3. Proofs. From the top down every node takes its parent's path and puts its own siblings in front: those left of it and those right of
   it, so that a path is an array of (left, right) digests, and its root is folded by one expression, without the tree.

Digests are sha256 of concatenated texts (inner digests as lowercase hex text); between tasks they travel as 32 bytes.

Defined results: null columns are "-", which no value is; a null group is a group, the first; rows of equal group and id are
ordered by their digests, and equal rows are leaves beside each other; null ids come first and are never tampered with; a lone leaf is its
group's root, and a lone group's root is the root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:binary,right:binary>"


def hexed(digests: Column) -> Column:
    """32 bytes a digest → their lowercase hex text."""
    return F.lower(F.hex(digests))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row: of each column its UTF-8 length, a colon and its text, or a hyphen for null."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]))


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with sid and idx, groups): the place of each row in its group by ``order``, and (sid, group, n) with the groups' own places.

    Both are written. Rows equal in group and order are dealt evenly too: the last sort key is random, and decides nothing else.
    """
    ranged = rows.withColumn("tie", F.rand(17)).repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    rows = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))
    parts = rows.groupBy(group, "part").agg(F.min("pos").alias("low"), F.count("*").alias("c"))
    before = Window.partitionBy(group).orderBy("part")  # a row for each part that the group is in
    offset = F.sum("c").over(before.rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select(group, "part", "low", F.coalesce(offset, F.lit(0)).alias("offset"), "c"))
    totals = parts.groupBy(group).agg(F.sum("c").alias("n"))
    ranked = written(totals.repartitionByRange(group).sortWithinPartitions(group).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))
    first = ranked.groupBy("part").agg(F.min("pos").alias("low"), F.count("*").alias("c"))  # a row for each part
    first = first.select("part", "low", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    groups = written(ranked.join(first, "part").select((F.col("pos") - F.col("low") + F.col("offset")).alias("sid"), group, "n"))
    known = parts.join(groups.select("sid", F.col(group).alias("g"), "n"), F.col(group).eqNullSafe(F.col("g"))).select("part", F.col(group).alias("g"), "sid", "n", "low", "offset")
    # One row for each part and group: below its threshold Spark broadcasts them, and beyond a key is no larger than a part.
    joined = rows.join(known.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return joined.withColumn("idx", F.col("pos") - F.col("low") + F.col("offset")).drop("part", "pos", "p", "g", "low", "offset", group), groups


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds slot, left and right: the digests of the siblings before and after each node, by self-joins on their computed places."""
    slot = (F.col("idx") % fanout).cast("int")
    out = nodes.withColumn("slot", slot)
    at = {k: F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - F.col("slot") + (F.col("slot") + k) % fanout for k in range(1, fanout)}
    out = out.select("*", *[c.alias(f"at_{k}") for k, c in at.items()])
    for k in at:
        sibling = nodes.select(F.col("sid").alias("s"), F.col("idx").alias("i"), F.col("digest").alias(f"d_{k}"))
        out = out.join(sibling, (F.col("sid") == F.col("s")) & (F.col(f"at_{k}") == F.col("i")), "left").drop("s", "i", f"at_{k}")
    in_slot = [F.coalesce(*[F.when((F.col("slot") + k) % fanout == t, F.col(f"d_{k}")) for k in at], F.lit(b"")) for t in range(fanout)]
    side = {"left": F.concat(*[F.when(F.col("slot") > t, d).otherwise(F.lit(b"")) for t, d in enumerate(in_slot)]), "right": F.concat(*[F.when(F.col("slot") < t, d).otherwise(F.lit(b"")) for t, d in enumerate(in_slot)])}
    return out.select(*nodes.columns, "slot", *[c.alias(n) for n, c in side.items()])


def raise_levels(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """Written levels from the leaves up: (sid, idx, n, digest, slot, left, right), n being the group's nodes of the level; the groups' roots have n = 1."""
    levels = []
    while True:
        several = nodes.filter("n > 1")
        alone = nodes.filter("n = 1").select("*", F.lit(0).alias("slot"), F.lit(b"").alias("left"), F.lit(b"").alias("right"))
        level = written(with_siblings(several, fanout).unionByName(alone) if most > 1 else alone)
        levels.append(level)
        if most <= 1:
            return levels
        up = level.filter("n > 1 AND slot = 0")
        nodes = up.select("sid", (F.col("idx") / fanout).cast("long").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), digest(F.concat(hexed(F.col("digest")), hexed(F.col("right")))).alias("digest"))
        most = -(-most // fanout)


def lower_paths(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The nodes of the lowest level, with subroot and path: each node's siblings in front of its parent's path; ``above`` has (sid, path) of the groups' roots."""
    own, paths = F.struct("left", "right").cast(STEP), None
    for level in reversed(levels):
        kept = [c for c in level.columns if c not in ("n", "slot", "left", "right")]
        ends = above.select(F.col("sid").alias("s"), "path")
        out = level.filter("n = 1").join(ends, F.col("sid") == F.col("s")).select(*kept, F.col("digest").alias("subroot"), "path")
        if paths is not None:
            parents = paths.select(F.col("sid").alias("s"), F.col("idx").alias("i"), "subroot", F.col("path").alias("up"))
            inner = level.filter("n > 1").join(parents, (F.col("sid") == F.col("s")) & (F.col("idx") - F.col("slot") == F.col("i") * fanout))
            out = out.unionByName(inner.select(*kept, "subroot", F.concat(F.array(own), "up").alias("path")))
        paths = out
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, step: digest(F.concat(hexed(step["left"]), hexed(acc), hexed(step["right"]))))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(hexed(step["left"]), hexed(step["right"]))), ""))


@dataclass
class Manifest:
    """``proofs``: the rows given, with sid and idx in place of their group, subroot and path; ``groups``: (sid, group, n); ``root``: 32 bytes, None without rows."""

    proofs: DataFrame
    groups: DataFrame
    root: bytes | None


def build(rows: DataFrame, group: str, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The manifest of rows that have a ``digest`` (32 bytes); the driver gets the largest group's size, the number of groups and the root."""
    if fanout < 2:
        raise ValueError("a tree needs at least two children a node")
    leaves, groups = placed(rows, group, order)
    most, count = (x or 0 for x in groups.agg(F.max("n"), F.count("*")).first())
    levels = raise_levels(written(leaves), most, fanout)
    roots = written(_union([x.filter("n = 1").select("sid", "digest") for x in levels]))
    upper = raise_levels(roots.select(F.lit(0).cast("long").alias("sid"), F.col("sid").alias("idx"), F.lit(count).cast("long").alias("n"), "digest"), count, fanout)
    top = upper[-1].select("digest").first()
    start = groups.sparkSession.range(1).select(F.col("id").alias("sid"), F.array().cast(f"array<{STEP}>").alias("path"))
    above = written(lower_paths(upper, start, fanout).select(F.col("idx").alias("sid"), "path"))
    return Manifest(lower_paths(levels, above, fanout), groups, bytes(top["digest"]) if top else None)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, tampered): leaves of documents, and what they would be without line ends where crc32(doc_id) is even (null where nothing changes)."""
    columns = {c: F.col(c) for c in COLUMNS}
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = even & F.contains(F.col("text").cast("string"), F.lit("\n"))
    other = leaf_digest(columns | {"text": F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(columns).alias("digest"), F.when(cut, other).alias("tampered"))


def verified_documents(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per document: its leaf, group root, root, proof, and the root that the tampered leaf and the original siblings lead to."""
    made = build(document_leaves(docs), "source", ["doc_id", "digest"], fanout)
    root = F.lit(made.root.hex() if made.root is not None else None).cast("string")
    folded = hexed(fold(F.coalesce("tampered", "digest"), F.col("path")))
    out = made.proofs.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"), hexed(proof_digest(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(table(spark, sf_dir, "documents"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(d.doc_id::VARCHAR, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR z IN range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(f"d.{c}") for c in COLUMNS[:-1])
#: The same by recursion over levels, and over each document's path. A tree's key is a source, or '=' for the tree of the sources' roots.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rid FROM documents),
l0 AS (SELECT rid, doc_id, source, coalesce('s' || source, 'n') AS tree, sha256({_LEAF} || {_FIELD.format('d.text')}) AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format("replace(d.text, chr(10), '')")}) END AS other FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l0),
lv AS (SELECT 0 AS level, tree, idx // 3 AS run, n, list(leaf ORDER BY idx) AS kids FROM leaves GROUP BY tree, idx // 3, n
  UNION ALL SELECT level + 1, tree, run // 3, (n + 2) // 3, list(sha256(array_to_string(kids, '')) ORDER BY run) FROM lv WHERE n > 1 GROUP BY level, tree, run // 3, n),
subs AS (SELECT tree, kids[1] AS subroot FROM lv WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM subs JOIN (SELECT DISTINCT tree, source FROM leaves) USING (tree)),
up AS (SELECT 0 AS level, '=' AS tree, idx // 3 AS run, n, list(subroot ORDER BY idx) AS kids FROM ranked GROUP BY idx // 3, n
  UNION ALL SELECT level + 1, tree, run // 3, (n + 2) // 3, list(sha256(array_to_string(kids, '')) ORDER BY run) FROM up WHERE n > 1 GROUP BY level, tree, run // 3, n),
low AS (SELECT rid, tree, 0 AS level, idx, n, coalesce(other, leaf) AS dig, '' AS proof FROM leaves
  UNION ALL SELECT rid, low.tree, low.level + 1, idx // 3, (low.n + 2) // 3, sha256(array_to_string([CASE WHEN i = idx % 3 + 1 THEN dig ELSE kids[i] END FOR i IN range(1, len(kids) + 1)], '')),
    proof || array_to_string([kids[i] FOR i IN range(1, len(kids) + 1) IF i <> idx % 3 + 1], '') FROM low JOIN lv ON lv.tree = low.tree AND lv.level = low.level AND lv.run = idx // 3 WHERE low.n > 1),
high AS (SELECT rid, 0 AS level, ranked.idx, ranked.n, dig, proof FROM low JOIN ranked USING (tree) WHERE low.n = 1
  UNION ALL SELECT rid, high.level + 1, idx // 3, (high.n + 2) // 3, sha256(array_to_string([CASE WHEN i = idx % 3 + 1 THEN dig ELSE kids[i] END FOR i IN range(1, len(kids) + 1)], '')),
    proof || array_to_string([kids[i] FOR i IN range(1, len(kids) + 1) IF i <> idx % 3 + 1], '') FROM high JOIN up ON up.level = high.level AND up.run = idx // 3 WHERE high.n > 1),
r AS (SELECT kids[1] AS root FROM up WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, dig AS folded_root, dig = root AS verified FROM leaves JOIN subs USING (tree) JOIN high USING (rid), r WHERE high.n = 1
"""
