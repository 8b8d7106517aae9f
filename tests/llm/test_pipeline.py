"""The pipeline stage by stage against brute force, and its whole run."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mailgrain.llm import secret_scan, toxicity
from mailgrain.llm.common import shared_dir

from .test_copies import brute
from .test_text_ops import plain_secrets
from .test_token_ops import check_packed, edge_docs


@pytest.fixture(scope="module")
def staged(spark, sf):
    """Each stage's input and output over the smallest tables, with clashing extra columns and repeated rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"kept": F.lit("x"), "rid": F.col("doc_id"), "local": F.lit(1)})
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in df.select("doc_id", "text").collect())


def test_order_and_columns(staged):
    assert [n for n, *_ in staged] == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    for _, before, after in staged[:-1]:
        assert after.dtypes == before.dtypes


def test_toxic_rows_go(spark, sf, staged):
    _, before, after = staged[0]
    model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    keep = {r.doc_id for r in toxicity.score_documents(before, model).filter("predicted = 0").collect()}
    assert pairs(after) == [p for p in pairs(before) if p[0] in keep or (p[0] == -1 and None in keep)]


def test_exact_copies_go(staged):
    _, before, after = staged[1]
    first: dict = {}
    for d, t in sorted(pairs(before), key=lambda p: (p[0] == -1, p[0])):
        first.setdefault(" ".join(t.replace("\n", " ").split(" ")) if "  " not in t else t, (d, t))
    assert len(pairs(after)) == len({x for x in first.values()}) and set(pairs(after)) <= set(pairs(before))
    assert len({t for _, t in pairs(after)}) == after.count()


def test_near_copies_go(staged):
    _, before, after = staged[2]
    rows = [(d if d != -1 else None, t) for d, t in pairs(before)]
    leaders = {c for _, c, _ in brute(rows)}
    assert {d for d, _ in pairs(after)} == leaders and after.count() == len(leaders)


def test_secrets_are_masked(staged):
    _, before, after = staged[3]
    was, now = dict(pairs(before)), dict(pairs(after))
    assert was.keys() == now.keys()
    for d, t in was.items():
        assert now[d] == t if not plain_secrets(t) and "[SECRET]" not in now[d] else "[SECRET]" in now[d]
    assert all(r.n == len(r.text) for r in after.filter("text IS NOT NULL").select(F.col("n_chars").alias("n"), "text").collect())
    found = secret_scan.find_secrets(after).filter("size(base) > 0").count()
    assert found == 0


def test_all_is_packed(staged):
    _, before, after = staged[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packed(after.collect(), [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in pairs(before)])


def test_edges(spark, sf):
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            path = shared_dir(spark)
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "local", "kept"]
        assert sorted(r.doc_id or -1 for r in docs.collect()) in ([-1, 1, 3, 3, 5], [])
