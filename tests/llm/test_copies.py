"""Exact copies and the n-gram join against brute force."""

import random
import tracemalloc
import zlib
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from mailgrain.llm import exact_dedup, ngram_join, toxicity
from mailgrain.llm.common import written
from mailgrain.llm.registry import SQL
from mailgrain.operators import graph

from .test_token_ops import edge_docs


def test_trie_spills():
    r, words = random.Random(2), [b"", b"a", b"ab", b"abc", b"abd", b"xyz" * 50]
    keys = words + [bytes(r.choice(b"abc") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for limit in (1 << 30, 5000, 1000):
        trie, want = exact_dedup.PatriciaTrie(lambda a, b: [a[0], a[1] + b[1]], max_bytes=limit), {}
        for k in keys:
            trie.insert(k, [k, 1])
            want[k] = want.get(k, 0) + 1
        assert sorted((k, n) for k, n in trie.values()) == sorted(want.items())
        assert (trie.spilled > 0) == (limit < 1 << 30)


@pytest.mark.parametrize("text", ["", " ", " a\t\tb\n", "\x0b\x0cx", "a\xa0b  c", "é \r\n é"])
def test_normalise(text):
    assert exact_dedup.normalise(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_exact_edges(spark):
    docs = edge_docs(spark)
    got = exact_dedup.exact_groups(docs, gather_bytes=10, trie_bytes=500).collect()
    by = sorted((r.doc_id or -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.kept) for r in got)
    assert by == [(-1, -1, 1, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (3, 3, 3, False), (3, 3, 3, True), (5, 5, 1, True), (9, 3, 3, False)]
    stay = exact_dedup.drop_exact_copies(docs)
    assert stay.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in stay.collect()) == sorted([(-1, "no id"), (1, ""), (3, "other text"), (3, "same text"), (5, "word " * 60_000)])
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_ties(spark):
    docs = spark.createDataFrame([(1, "b  c", 1), (1, "b c", 2), (1, "b\tc", 3), (2, "b c", 4)], "doc_id long, text string, row int").repartition(3)
    assert [tuple(r) for r in exact_dedup.drop_exact_copies(docs).collect()] == [(1, "b\tc", 3)]


def test_exact_sql(spark, sf):
    got = exact_dedup.op3_exact_dedup(spark, sf).select("doc_id", "group_size", "keep_id", "kept", "text_sha256").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"select doc_id, group_size, keep_id, kept, text_sha256 from ({SQL['op3_exact_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def brute(rows):
    """(class by smallest id, links) of every row, from sets of word tuples."""
    sets = []
    for _, text in rows:
        w = [x.strip("".join(ngram_join_edges())) for x in (text or "").lower().split()]
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {text or ""})
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return sorted((d if d is not None else -1, min((x for x in low[find(i)] if x is not None), default=-1), links[i]) for i, (d, _) in enumerate(rows))


def ngram_join_edges():
    from mailgrain.llm.toxicity import _EDGES

    return _EDGES


def corpus(seed=4):
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for f in range(6):
        base = [word() for _ in range(r.randint(30, 80))]
        for _ in range(r.choice([1, 2, 12, 40])):
            text = list(base)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    shared = " ".join(word() for _ in range(60))
    rows += [(1000 + k, shared + " " + " ".join(word() for _ in range(40))) for k in range(30)]
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_join_equals_brute_force(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.similar_documents(docs, block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_join_edges(spark):
    docs = edge_docs(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in ngram_join.similar_documents(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    stay = ngram_join.drop_near_copies(docs)
    assert stay.columns == docs.columns and sorted((r.doc_id or -1, r.text or "")[:2] for r in stay.collect()) == sorted([(-1, "no id"), (1, ""), (3, "other text"), (3, "same text"), (5, "word " * 60_000)])
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_words_of_one_crc_are_not_copies(spark):
    """Two words with the same 32-bit CRC, alone and in longer texts, and a clean pair beside them."""
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    long = " ".join(f"w{k}" for k in range(12))
    rows = [(1, "plumless"), (2, "buckeroo"), (3, "one two three plumless five six"), (4, "one two three buckeroo five six"), (5, f"{long} plumless"), (6, f"{long} buckeroo"), (7, "Plumless!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(docs).collect())
    assert got == brute(rows) and {d: c for d, c, _ in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 1}  # 8 of 10 shingles are equal in 5 and 6
    assert sorted(r.doc_id for r in ngram_join.drop_near_copies(docs).collect()) == [1, 2, 3, 4, 5]


def test_many_short_texts_have_no_links(spark):
    """200,000 different texts of two words: 32 bits would link some of them."""
    docs = spark.range(200_000).selectExpr("id AS doc_id", "concat('a', id div 500, ' b', id % 500) AS text")
    assert ngram_join.similar_documents(docs).filter("n_links > 0 OR class_id <> doc_id").count() == 0


def test_floor_depth():
    assert ngram_join.meeting(0.8, ngram_join.floor_depth()) >= 0.9999 > ngram_join.meeting(0.8, ngram_join.floor_depth() + 1)
    with pytest.raises(ValueError):
        ngram_join.floor_depth(0.1, trees=2)


def test_common_prefixes():
    """The sorted labels against a comparison of every pair, tree by tree."""
    rng = np.random.default_rng(3)
    keys, deeper = rng.integers(0, 4, (30, 5)), rng.integers(0, 2, (30, 5, 2)).astype(np.uint16)
    keys += np.arange(5) * 100
    got = ngram_join.common_prefixes(keys, deeper, 6)
    for i in range(30):
        for j in range(30):
            want = max((0 if keys[i, t] != keys[j, t] else 6 if deeper[i, t, 0] != deeper[j, t, 0] else 7 + int(deeper[i, t, 1] == deeper[j, t, 1])) for t in range(5))
            assert i == j or got[i, j] == want


def test_forest_meets_as_often_as_it_should():
    """Pairs of known similarity against the formula, so that the recall at 0.8 is what the floor promises."""
    rng, floor, met = np.random.default_rng(5), ngram_join.floor_depth(), 0
    forest = ngram_join.Forest(ngram_join.TREES, floor, ngram_join.MAX_DEPTH)
    shares = []
    for _ in range(300):
        x = rng.integers(0, 2**32, 100, np.uint32)
        a, b = x[:90], np.concatenate([x[:80], x[90:]])  # similarity 0.8
        (ka, da), (kb, db) = forest.labels(a), forest.labels(b)
        equal = [i for i in range(forest.trees) if ka[i] == kb[i]]
        shares.append(len(equal) / forest.trees)
        met += bool(equal)
    assert met == 300 and np.mean(shares) == pytest.approx(0.8**floor, abs=0.02)


def test_large_group_is_taken_by_its_centre(spark):
    """Near copies of one text need no comparison with each other; strays of the group meet every block."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(120)], []
    for k in range(90):
        text = list(base)
        for _ in range(1 if k < 70 else r.randint(2, 6)):
            text[r.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.similar_documents(docs, block=16).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)
    got = ngram_join.similar_documents(docs, block_bytes=5_000).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def peak_of(f):
    """(result, MB that Python and numpy held at most meanwhile)."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_sketch_holds_few_texts_at_once():
    """Of one Arrow batch with 10 MB of texts and sets; all together were held before."""
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(1000)}" for _ in range(600)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "fp": pa.array(range(1000), pa.int64()), "text": pa.array(texts)})
    made = []

    def run():
        for b in ngram_join.sketch([batch], ngram_join.Forest(32, 6, 8), 5 << 40):
            assert b.nbytes < 1e6
            made.append(b)

    assert peak_of(run)[1] < 5
    rows = pa.Table.from_batches(made).to_pydict()
    assert rows["doc_id"] == list(range(1000)) and rows["local"] == [(5 << 40) + k for k in range(1000)] and all(rows["head"])
    assert rows["shingles"] == [ngram_join.shingles(t)[0].tobytes() for t in texts]


def test_block_numbers_its_shingles():
    """np.unique's inverse, at half its memory."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) % np.uint64(500_000)) for _ in range(20)] + [np.array([2**64 - 1], np.uint64)]
    want, before = peak_of(lambda: np.unique(np.concatenate(sets), return_inverse=True)[1])
    got, now = peak_of(lambda: ngram_join.numbered(sets))
    assert (got == want).all() and now < 0.7 * before
    assert ngram_join.numbered([np.array([7], np.uint64)]).tolist() == [0]


def test_words_are_let_go_by_the_next_operator(spark):
    """What a worker keeps for the join's words is gone once another operator runs there."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('x', id, ' y', id, ' z') AS text").repartition(8)
    ngram_join.similar_documents(docs).write.format("noop").mode("overwrite").save()

    def kept(batches):
        toxicity.keep_words()
        for b in batches:
            yield pd.DataFrame({"n": [len(ngram_join._words)] * len(b)})

    assert spark.range(64).repartition(16).mapInPandas(kept, "n long").filter("n > 0").count() == 0


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f", "y")], "doc_id long, text string, key string")
    for drop in (ngram_join.drop_near_copies, exact_dedup.drop_exact_copies):
        got = drop(docs.withColumnRenamed("key", "Key"))
        assert got.columns == ["doc_id", "text", "Key"] and sorted(map(tuple, got.collect())) == [(1, "a b c", "x"), (2, "d e f", "y")]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 300), (300, 400), (7, 7)], "a long, b long")
    got = dict(graph.components(chain, cut=written).collect())
    assert set(got.values()) == {0, 300} and len(got) == 104
    assert graph.components(chain.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        graph.components(chain, max_rounds=2, cut=written)


def test_schema(spark, sf):
    assert ngram_join.op9_ngram_join(spark, sf).schema == T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "class_id", "n_links")])
