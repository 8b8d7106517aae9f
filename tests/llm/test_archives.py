"""WARC archives, the Merkle manifest and phrase mining against plain forms and SQL."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from mailgrain.llm import merkle, phrases, warc
from mailgrain.llm.common import scratch, shared_dir, written
from mailgrain.llm.registry import QUERIES, SQL


def compare(spark, sf, name, tables=("documents", "pages")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    want = con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want)) and want


@pytest.mark.parametrize("name", ["op11_warc", "op12_merkle", "op13_phrases"])
def test_sql(spark, sf, name):
    compare(spark, "/root/testdata/sf0.01" if name == "op13_phrases" else sf, name)


# -- WARC ------------------------------------------------------------------------------------------------------------------------


def page_rows():
    """Copies, equal rows, null and empty pages, null ids and urls, letters of several bytes, blank lines in payloads."""
    return [
        (5, "http://a/5", "same"), (3, "http://a/3", "same"), (3, "http://a/3", "same"), (3, "http://b/3", "same"), (9, None, "same"), (None, "http://a/n", "same"), (1, "http://a/1", None), (2, "http://a/2", ""),
        (7, "http://a/7", "héé\r\n\r\n<b>🙂</b>\n"), (8, "http://a/8 b", "x" * 300_000), (None, None, "lone"), (10, "http://a/10", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    ]


def plain_records(rows, least):
    out = []
    for body in {(h or "") for _, _, h in rows}:
        mine = sorted((i is None, i or 0, u is None, u or "") for i, u, h in rows if (h or "") == body)
        digest = warc.base32(hashlib.sha1(body.encode()).digest())
        for n, (no_id, i, _, _) in enumerate(mine):
            lead = None if mine[0][0] else mine[0][1]
            copy = n > 0 and len(body.encode()) >= least
            out.append((None if no_id else i, len(body.encode()), digest, "revisit" if copy else "response", lead if copy else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 1, 100_000])
@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, least, compression):
    pages = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id long, url string, html string, RECORD_TYPE string")
    path = shared_dir(spark)
    warc.write_warc(warc.page_records(pages, "2024-01-01T00:00:00Z", least), path, compression=compression, file_bytes=1000)
    rows = warc.read_warc(spark, path, partition_bytes=2000)
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers) for r in rows.withColumn("page", warc.page_of(F.col("record_id"))).withColumn("refers", F.when(F.col("refers_to").isNotNull(), warc.page_of(F.col("refers_to")))).collect()]
    assert sorted(map(repr, got)) == plain_records(page_rows(), least)
    ids = {r.record_id for r in rows.select("record_id").collect()}
    assert len(ids) == len(page_rows()) and {r.refers_to for r in rows.filter("refers_to IS NOT NULL").select("refers_to").collect()} <= ids
    by_id = {r.record_id: r.payload for r in rows.filter("record_type = 'response'").select("record_id", "payload").collect()}
    assert {bytes(p) for p in by_id.values()} == {(h or "").encode() for _, _, h in page_rows()}


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.archive_pages(pages, path, "2024-01-01T00:00:00Z")
    assert warc.read_warc(spark, path).count() == 0


def test_warc_pushdown(spark):
    """Filters on headers leave the plan, and the payload of what they leave out is never inflated."""
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"page {i // 2}") for i in range(40)], "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.archive_pages(pages, path, "2024-01-01T00:00:00Z")
    rows = warc.read_warc(spark, path, ("record_type", "target_uri", "payload_bytes"))
    kept = rows.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h1/") & (F.col("payload_bytes") > 0))
    assert kept.count() == sum(i % 2 == 1 and i % 3 == 1 for i in range(40))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[1].split("\n")[0] and "payload_bytes" in plan.split("Filter")[1].split("\n")[0]
    for condition in ("record_type IN ('revisit', 'x')", "record_type <> 'response'", "refers_to IS NOT NULL", "NOT record_type IN ('response')", "record_type <=> 'revisit'", "target_uri LIKE '%h1%'", "target_uri LIKE '%9' OR record_type = 'revisit'"):
        assert rows.select("record_type", "target_uri").limit(0).columns and sorted(map(tuple, warc.read_warc(spark, path).filter(condition).select("record_id").collect())) == sorted(map(tuple, written(warc.read_warc(spark, path)).filter(condition).select("record_id").collect())), condition


def test_warc_skips_payloads(monkeypatch):
    """Unwanted records are stepped over by their stated length; files of other writers are inflated to their end."""
    make = lambda n, kind: warc.record_bytes(dict(record_id=f"r{n}", record_type=kind, target_uri=None, date="d", refers_to="r0", payload_digest=warc.base32(hashlib.sha1(random.Random(n).randbytes(200_000)).digest()), payload_bytes=1, payload=random.Random(n).randbytes(200_000)))
    records = [make(n, "response" if n % 3 else "revisit") for n in range(9)]
    ours, foreign = b"".join(map(warc.gzip_member, records)), b"".join(gzip.compress(r) for r in records)
    wanted = warc.Wanted()
    assert wanted.take(ds.EqualTo(("record_type",), "revisit")) and not wanted.take(ds.GreaterThan(("date",), "d")) and not wanted.take(ds.EqualTo(("payload",), b""))
    inflated = Counter()
    whole = warc.Member.more

    def counted(self, n):
        out = whole(self, n)
        inflated["bytes"] += len(self.data)
        return out

    monkeypatch.setattr(warc.Member, "more", counted)
    for data in (ours, foreign, b"".join(records)):
        inflated.clear()
        got = list(warc.read_records(io.BytesIO(data), len(data), wanted, ["record_id"]))
        assert [r["record_id"] for r in got] == ["r0", "r3", "r6"] and inflated["bytes"] < 100_000
    for broken in (ours[:-9], foreign[: len(foreign) // 2], ours[5:], b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", records[1].replace(b"sha1:", b"sha1:A")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken), len(broken), warc.Wanted(), ["payload"]))
    chunked = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n"
    data = chunked % (len(block), block)
    assert next(warc.read_records(io.BytesIO(data), len(data), warc.Wanted(), ["payload"]))["payload"] == b"abcde"


# -- manifest --------------------------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """(root, path of each leaf as (left, right) lists)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[k].append((run[: p % fanout], run[p % fanout + 1 :]))
        level = [h("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], paths


def manifest_rows():
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "ü", None]), r.choice(["en", None]), i * 3, r.choice(["x", "two\nlines\n", "", None, "é"])) for i in range(120)]
    return rows + [(7, "a", "en", 1, "again\n"), (7, "a", "en", 1, "again\n"), (None, "a", None, None, None), (500, "z", "en", 1, "lone\n"), (None, None, None, None, "\n")]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_plain_tree(spark, fanout):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, Idx string").repartition(5)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner, tops = {}, []
    for g in order:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        inner[g] = (mine, *plain_tree([plain_leaf(r) for r in mine], fanout))
        tops.append(inner[g][1])
    root, top_paths = plain_tree(tops, fanout)
    want = []
    for k, g in enumerate(order):
        mine, sub, paths = inner[g]
        for r, path in zip(mine, paths, strict=True):
            whole = path + top_paths[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            leaf = folded = plain_leaf(r)
            if tampered:
                folded = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in whole:
                folded = h("".join([*left, folded, *right]))
            want.append((r[0], leaf, sub, root, h("".join("".join(a + b) for a, b in whole)), folded, folded == root))
    got = merkle.verified_documents(docs, fanout).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and {r.verified for r in got} == {True, False}


def test_manifest_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.verified_documents(spark.createDataFrame([], schema)).count() == 0
    one = merkle.verified_documents(spark.createDataFrame([(1, None, None, None, None)], schema)).first()
    leaf = plain_leaf((1, None, None, None, None))
    assert (one.leaf, one.subroot, one.root, one.proof_sha256, one.folded_root, one.verified) == (leaf, leaf, leaf, h(""), leaf, True)
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([], "g string, digest binary"), "g", ["digest"], 1)


# -- phrases ---------------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top, held=80):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, lower = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                q = (lang, p[i : i + k])
                if 100 * a >= held * f[q]:
                    gone.add(q)
    out = []
    for lang in n:
        mine = []
        for (other, p), a in found.items():
            if other == lang and (lang, p) not in gone:
                score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, m[2].decode(), m[3], m[4], m[5], n[lang], -m[0]) for rank, m in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(9)
    word = lambda: r.choice(["the", "The", "of", "a", "é", "É", "x-y", "new", "York", "z z", "(q)"])
    gap = lambda: r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "? !"])
    rows = [(r.choice(["en", "en", "fr", None]), "".join(word() + gap() for _ in range(r.randint(0, 60)))) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("und", "new york new york"), ("li\nne", "a a a a a"), ("en", "the new york " * 400), ("en", "the new york " * 400)]


@pytest.mark.parametrize("budget,chunk", [(1_000_000, 1_000_000), (40, 300), (7, 60)])
def test_phrases_equal_plain_counts(spark, budget, chunk):
    """One group and many: words, pairs and triples that are too large for a group are extended."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(l, t, i) for i, (l, t) in enumerate(rows)], "lang string, text string, Size int").repartition(4)
    got = phrases.collocations(docs, top=15, least=5, budget=budget, chunk_words=chunk).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 5, 15)


def test_phrases_groups_keep_the_budget(spark):
    """A word and a passage that very many texts share: no group has many more suffixes than the budget."""
    rows = [("en", " ".join(["the"] + [random.Random(k).choice("abcdefghijklmnop") + str(j % 5) for j in range(8)] + ["new york city hall"] * 3)) for k in range(600)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    sizes, whole = [], phrases.subtree

    def watched(longest, least):
        run, schema = whole(longest, least)

        def measured(group):
            n = sum(int(phrases.unpacked(m, "int64", longest + 2).shape[0]) for m in group.column("suffixes").to_pylist())
            out = run(group)
            return out.append_column("rows", [[n] * out.num_rows])

        return measured, schema + ", rows long"

    phrases.subtree = watched
    try:
        nodes, _, _ = phrases.frequent_phrases(docs.limit(0), budget=500)
        assert nodes.count() == 0
    finally:
        phrases.subtree = whole
    vocabulary = phrases.grouped(spark.createDataFrame([(f,) for f in (10, 700, 400, 90, 20_000, 499)], "f long").coalesce(1), 500).collect()
    used = [(r.grp, r.subs, r.f) for r in vocabulary]
    load = Counter()
    for grp, subs, f in used:
        for k in range(subs):
            load[grp + k] += -(-f // subs)
    assert max(load.values()) <= 500 and [s for _, s, _ in used] == [1, 6, 1, 1, 160, 1]
    assert sizes == []


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " \t. ")], "lang string, text string")).count() == 0


def test_scratch_deletes_its_own(spark, tmp_path):
    kept = written(spark.range(3), f"file://{tmp_path}/kept")
    with scratch(spark):
        written(spark.range(3), f"file://{tmp_path}/gone")
    assert kept.count() == 3 and [p.name for p in tmp_path.iterdir()] == ["kept"]
