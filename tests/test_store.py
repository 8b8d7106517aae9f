"""The store's buckets, commits and compaction; archives; vocabularies and rules of any size; searches of many questions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgrain.functions import dates, identity, text
from mailgrain.functions.rules import Rules
from mailgrain.operators import ingest, senders
from mailgrain.sources import mail, store, typed
from mailgrain.streaming import ingest as streaming

from .test_operators import AT, MAIL, eml, raw, state

STOP = "List-Unsubscribe: <https://x.example/u>\r\n"


def args():
    return dict(as_of=AT("2026-09-01T00:00:00Z"), since=AT("2025-09-01T00:00:00Z"), folders=("INBOX", "Other"))


def files(spark, root, name):
    return {(b, v) for b, v, _ in store.Store(spark, root).parts(name)}


def test_a_batch_touches_only_its_buckets(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/a"
    streaming.ingest_batch(raw(spark, [eml(n, STOP, f"s{n}") for n in range(1, 200)]), root, buckets=32, **args())
    before, read = {n: files(spark, root, n) for n in ("message", "sender")}, []
    whole = store.Store.read

    def watched(self, name, buckets=None):
        read.append((name, buckets))
        return whole(self, name, buckets)

    monkeypatch.setattr(store.Store, "read", watched)
    streaming.ingest_batch(raw(spark, [eml(n, STOP, f"s{n % 3}") for n in (300, 301)]), root, buckets=32, by_watermark=False, **args())
    met = {n: b for n, b in read if b is not None}
    assert set(met) == {"message", "sender_identity", "sender"} and all(0 < len(b) <= 8 for b in met.values()) and len({b for b, _ in before["message"]}) == 32
    # What is scanned is those buckets' files; the others' senders keep theirs.
    scanned = whole(store.Store(spark, root), "message", met["message"]).inputFiles()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in scanned} == set(met["message"])
    after = files(spark, root, "sender")
    assert {x for x in before["sender"] if x[0] not in met["sender"]} == {x for x in after if x[0] not in met["sender"]} and not {x for x in before["sender"] if x[0] in met["sender"]} & after
    assert len(state(spark, root)[0]) == 201


def test_a_crash_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    """Killed after three messages, at each step of the next batch in turn: nothing of it is seen, and the batch is ingested on the next run."""
    once, root = f"{tmp_path}/once", f"{tmp_path}/a"
    for part in (MAIL[:3], MAIL[3:]):
        streaming.ingest_batch(raw(spark, part), once, buckets=4, **args())
    streaming.ingest_batch(raw(spark, MAIL[:3]), root, buckets=4, **args())
    old = state(spark, root)
    for step in ("append", "replace", "commit"):
        whole = getattr(store.Change, step)

        def killed(self, *given, step=step, whole=whole):
            if step != "commit":
                whole(self, *given)
            raise KeyboardInterrupt

        with monkeypatch.context() as m:
            m.setattr(store.Change, step, killed)
            with pytest.raises(KeyboardInterrupt):
                streaming.ingest_batch(raw(spark, MAIL[3:]), root, buckets=4, **args())
        assert state(spark, root) == old
    streaming.ingest_batch(raw(spark, MAIL[3:]), root, buckets=4, **args())
    assert state(spark, root) == state(spark, once)


def test_compaction_bounds_the_files(spark, tmp_path):
    """Fifty batches: few files a bucket, all rows, a reader that began before still reads, and rows are rewritten a few times each at most."""
    tables, rewritten = store.Store(spark, str(tmp_path), buckets=2), 0
    for k in range(50):
        change = tables.change()
        change.append("decision", spark.createDataFrame([(k * 10 + i, f"s{i}", "keep") for i in range(4)], "id long, sender_id string, decision string"))
        change.commit()
        if k == 20:
            reader = tables.read("decision")
        rewritten += tables.compact("decision", 4)
        assert max(len(v) for v in tables.tables["decision"].values()) <= 4
    assert sorted(r.id for r in tables.read("decision").select("id").collect()) == sorted(k * 10 + i for k in range(50) for i in range(4))
    assert reader.count() == 84 and rewritten < 50
    tables.clean(keep=1)
    left = {p.parent.parent.name for p in tmp_path.glob("decision/*/bucket=*/*.parquet")}
    assert left == {v for _, v, _ in tables.parts("decision")} and store.Store(spark, str(tmp_path)).read("decision").count() == 200
    other, late = store.Store(spark, str(tmp_path)), tables.change()
    other.change().commit()
    with pytest.raises(RuntimeError):
        late.commit()


def test_an_archive_is_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(f"F{i % 2}", 1, i, f"2026-{1 + i % 6:02d}-15 00:00:00", "x") for i in range(60)] + [("F0", 1, 99, None, "x")], "folder string, uidvalidity long, uid long, internal_date string, raw string")
    mail.write_archive(rows.withColumn("internal_date", F.col("internal_date").cast("timestamp_ntz")), str(tmp_path))
    whole = mail.read_archive(spark, str(tmp_path))
    part = ingest.folder_filter(ingest.backfill_filter(whole, AT("2026-05-01T00:00:00Z")), ("F1",))
    assert sorted(r.uid for r in part.collect()) == [i for i in range(60) if i % 2 and 1 + i % 6 >= 5] and whole.count() == 61
    scanned = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in filters and "folder" in filters and all("folder=F1" in f for f in scanned) and len(scanned) < len(list(tmp_path.glob("*/*/*.parquet")))


def test_eml_files(spark, tmp_path):
    assert mail.write_eml(raw(spark, MAIL), f"file://{tmp_path}") == len(MAIL)
    got = mail.read_eml(spark, f"{tmp_path}/INBOX").select("uid", "raw").collect()
    assert sorted((r.uid, r.raw) for r in got) == sorted((m[2], m[4]) for m in MAIL if m[0] == "INBOX")


def test_eml_names_stay_out_of_the_driver(spark, tmp_path):
    """Spark's reader of binary files has every name, and a task for each few, in the driver."""
    for k in range(2):
        (tmp_path / f"box{k}").mkdir()
        for i in range(60):
            (tmp_path / f"box{k}" / f"{i}.eml").write_text(f"{k} {i}")
    got = mail.read_eml(spark, f"{tmp_path}/box[01]")
    (tmp_path / "box0" / "99.eml").write_text("came later")
    assert got.inputFiles() == [] and "Scan binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.raw for r in got.collect()) == sorted(f"{k} {i}" for k in range(2) for i in range(60))
    names = [tuple(x) for x in mail._files(spark, f"{tmp_path}/box0").select("path").collect()]
    assert len(names) == 61 and len(set(names)) == 61


def test_eml_files_are_those_of_sparks_reader(spark, tmp_path):
    """Names, hidden and empty files, links, patterns, folders key=value and single files."""
    odd = ["7-a.eml", "b.eml", "é ñ.eml", "x%20y.eml", "q?.eml", "h#.eml", "_h.eml", ".h.eml", "_a=b.eml", "_metadata1.eml", "X.EML", "t.txt", "[z]1.eml", "back\\s3.eml", "empty.eml"]
    top = tmp_path / "a b%20#x"
    for f in [*odd, "k=1/1.eml", "sub/2.eml"]:
        for at in (top / "plain", top / "parts"):
            if f.startswith("k=") == (at.name == "parts"):
                (at / f).parent.mkdir(parents=True, exist_ok=True)
                (at / f).write_bytes(b"" if f == "empty.eml" else b"a\xff" + f.encode())
    (top / "plain" / "dead.eml").symlink_to("/nowhere/x")
    (top / "plain" / "link.eml").symlink_to(top / "plain" / "b.eml")
    (top / "none").mkdir()

    def rows(frame):
        return sorted(map(tuple, frame.select("path", "modificationTime", "content").collect()))

    for path, n in (("plain", 10), ("parts", 1), ("none", 0), ("{plain,none}", 10), ("plain/", 10), ("plain/b.eml", 1), ("plain/[7b]*.eml", 3)):
        for scheme in ("", "file://"):
            expected = rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(f"{scheme}{top}/{path}"))
            assert rows(mail._files(spark, f"{scheme}{top}/{path}")) == expected and len(expected) == n, path
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        mail.read_eml(spark, f"{top}/nothing")
    (top / "parts" / "a:b3.eml").write_text("a colon, which Spark's reader can't open")
    assert [r.raw for r in mail.read_eml(spark, f"{top}/parts").filter("uid = 3").collect()] == ["a colon, which Spark's reader can't open"]


def test_messages_go_in_batches_of_bounded_size(tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.eml").write_bytes(b"x" * (mail.BATCH // 2))
    (names,) = mail._listed([str(tmp_path)])([pa.RecordBatch.from_pydict({"id": [0]})])
    read = list(mail._contents([("file:/r", str(tmp_path))])([names]))
    assert [b.num_rows for b in read] == [2, 2, 2] and sorted(p for b in read for p in b.column("path").to_pylist()) == [f"file:/r/{i}.eml" for i in range(6)]


def plain_domain(host, rules):
    labels = host.split(".")
    tails = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)]
    for k in range(len(tails), 0, -1):
        if "!" + tails[k - 1] in rules:
            return tails[k - 1]
    m = max([k for k in range(2, len(tails) + 1) if tails[k - 1] in rules] + [k + 1 for k in range(1, len(tails)) if "*." + tails[k - 1] in rules] + [1])
    return tails[m] if m < len(tails) else None


def test_a_full_list_of_suffixes(spark):
    """Ten thousand rules, wildcards and exceptions among them, against the rule itself; the plan is as large as for a few."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    rules = {f"{word(r.randint(1, 4))}.{word(r.randint(1, 2))}" for _ in range(200)} | {f"{word(3)}.{word(2)}.{word(1)}" for _ in range(60)} | {f"*.{word(2)}.{word(1)}" for _ in range(12)} | {f"!{word(1)}.{word(2)}.{word(1)}" for _ in range(30)}
    many = frozenset(rules | {f"s{i}.t{i % 90}" for i in range(10_000)})
    hosts = sorted({".".join(word(r.randint(1, 3)) for _ in range(r.randint(1, 5))) for _ in range(1500)} | {"x.s7.t7", "s7.t7", "a.b.x.s9999.t9"})
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    made = frame.select("h", identity.registrable_domain(F.col("h"), Rules(suffixes=many)).alias("d"))
    assert {x.h: x.d for x in made.collect()} == {h: plain_domain(h, many) for h in hosts}

    def nodes(suffixes):
        plan = frame.select(identity.registrable_domain(F.col("h"), Rules(suffixes=frozenset(suffixes))).alias("d"))._jdf.queryExecution().analyzed()
        return plan.expressions().mkString().count("lambda")

    assert nodes(["co.uk", "a.b.c"]) == nodes(many)


def test_the_first_token_of_any_vocabulary(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab ") for _ in range(n))
    tokens = list(dict.fromkeys(t for t in (word(r.randint(1, 5)) for _ in range(60)) if text.normalized_token(t)))
    texts = [word(r.randint(0, 12)) for _ in range(300)] + ["", "(a+b)*", "É-a_b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.match_token(F.col("t"), tokens[:12]).alias("m")).collect()
    for x in got:
        norm = text.normalized_token(x.t)
        assert x.m == next((t for t in tokens[:12] if norm and text.normalized_token(t) in norm), None), x.t
    odd = ["a.b", "c|d", "(", "x\\y", "désabonner", "désabonner ici"]
    got = spark.createDataFrame([("please c|d now",), ("(",), ("x\\y",), ("Désabonner ici",)], "t string").select(text.match_token(F.col("t"), odd).alias("m")).collect()
    assert [x.m for x in got] == ["c|d", "(", "x\\y", "désabonner"]


def test_rejects(spark):
    rows = [(1, "2026-01-31T10:00:00Z", "3m"), (2, "2026-02-30", ""), (3, " ", "soon"), (4, None, None), (5, "31/01/2026", "-2m"), (6, "2026-01-31T25:00:00Z", "0m"), (7, "2026-01-31", "3"), (8, "2026-01-31T10:00:00+02:00", "3 fortnights"), (9, "2026-01-31", "999999999y"), (10, "", "NEVER")]
    typed_rows, name = typed.read_typed(spark.createDataFrame(rows, "id long, at string, hold string"), {"at": "instant", "hold": "duration"})
    bad = {(r.id, r.column): r.reason for r in typed.rejected(typed_rows, "id", name).collect()}
    long = "not a duration (use 3m, 45d, 1y or forever)"
    assert bad == {(2, "at"): "no such date or time", (2, "hold"): "empty", (3, "at"): "empty", (3, "hold"): long, (5, "at"): "not an ISO-8601 instant", (5, "hold"): long, (6, "at"): "no such date or time", (6, "hold"): "not positive", (7, "hold"): long, (8, "hold"): long, (9, "hold"): "too long", (10, "at"): "empty"}
    assert sorted(r.id for r in typed.accepted(typed_rows, name).collect()) == [1, 4]
    taken = spark.createDataFrame([("x", "y")], "Rejects string, at string")
    assert typed.read_typed(taken, {"at": "instant"})[1] == "rejects_"
    assert dates.read_duration("3m") == (3, None, False)


def test_many_searches_equal_one_by_one(spark):
    people = spark.createDataFrame([("ab1", "Café Nord", "n@x.example"), ("ab2", None, "NORD@y.example"), ("zz9", "a", None)], "id string, display_name string, display_address string")
    known = spark.createDataFrame([("zz9", "list_id", "Nord")], "sender_id string, kind string, value string")
    merges = spark.createDataFrame([(1, "ab1", "zz9", True)], "id long, source_id string, target_id string, active boolean")
    asked = ["nord", " NORD ", "ab", "a", "é n", "", "nobody", "zz9", "x.example", "noré"]
    frame = spark.createDataFrame(list(enumerate(asked)), "question long, reference string")
    for m in (None, merges):
        got = {(r.question, r.sender_id) for r in senders.find_many(frame, people, known, senders.gram_index(people), m).collect()}
        everyone = people.select(F.col("id").alias("sender_id"))
        assert got == {(k, r.sender_id) for k, ref in enumerate(asked) for r in senders.find_senders(ref, people, known, everyone, m).collect()}


def test_sync_report(spark):
    found = spark.createDataFrame([("A", 1, 5, "x", True), ("A", 1, 6, None, False), ("B", 2, 9, "x", False)], "folder string, uidvalidity long, uid long, detection string, body_read boolean")
    marks = spark.createDataFrame([("A", 1), ("B", 1)], "folder string, uidvalidity long")
    got = {r.folder: tuple(r) for r in ingest.sync_report(found, found.filter("detection IS NOT NULL"), marks).select("folder", "examined", "detected", "recorded", "bodies_fetched", "last_uid", "uidvalidity_changed").collect()}
    assert got == {"A": ("A", 2, 1, 1, 1, 6, False), "B": ("B", 1, 1, 1, 0, 9, True), None: (None, 3, 2, 2, 1, None, True)}
    assert ingest.sync_report(found.limit(0), found.limit(0), marks).count() == 0
