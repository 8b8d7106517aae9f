"""Operators on small tables: decisions, review, merges, integrity, resolution, ingest and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from mailgrain.functions import dates
from mailgrain.operators import decisions as log
from mailgrain.operators import ingest, integrity, resolve, review, senders
from mailgrain.sources import tables
from mailgrain.streaming import ingest as streaming


def frame(spark, name, rows):
    columns = [f.split()[0] for f in tables.SCHEMAS[name].split(", ")]
    return tables.conform(spark.createDataFrame([tuple(str(r[c]) if r.get(c) is not None else None for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)), name)


AT = dates.instant


@pytest.mark.parametrize("as_of,state", [("2026-11-17T08:59:00Z", "suppressed"), ("2026-11-17T09:00:00Z", "returning"), ("2026-11-17T09:01:00Z", "returning")])
def test_keep_returns(spark, as_of, state):
    people = spark.createDataFrame([("s1",)], "sender_id string")
    kept = log.keep_decisions(people, AT("2026-08-17T09:00:00Z")).withColumn("id", F.lit(1))
    row = log.suppression_status(people, kept, AT(as_of)).withColumn("tag", log.returning_tag(F.col("state"), F.col("decided_at"), F.col("until"))).first()
    assert row.state == state
    assert row.tag == (None if state == "suppressed" else "Returning — you kept this on Aug 17, 2026; the 3-month hold has expired.")


def test_latest_and_order(spark):
    rows = [dict(id=1, sender_id="a", decision="keep", decided_at="2026-01-01 00:00:00"), dict(id=2, sender_id="a", decision="unsubscribe", decided_at="2026-01-01 00:00:00"), dict(id=3, sender_id="b", decision="keep", decided_at="2026-01-01 00:00:00")]
    dec = frame(spark, "decision", rows)
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "sender_id string")
    got = {r.sender_id: r.state for r in log.suppression_status(people, dec, AT("2026-02-01T00:00:00Z")).collect()}
    assert got == {"a": "unsubscribed", "b": "suppressed_forever", "c": "never_decided"}
    footer = spark.range(1).select(log.hidden_footer(F.lit(1), "x kept"), log.hidden_footer(F.lit(0), "x kept")).first()
    assert footer[0] == "1 sender hidden — kept within the last 3 months. Run 'x kept' to see them and their return dates." and footer[1].startswith("No senders hidden.")


@pytest.mark.parametrize("last,flag", [("2026-08-05", False), ("2026-08-11", False), ("2026-08-12", True)])
def test_still_sending(spark, last, flag):
    att = frame(spark, "unsubscribe_attempt", [dict(id=1, sender_id="s", method="mailto", attempted_at="2026-08-01 00:00:00", result="success")])
    agg = spark.createDataFrame([("s", last + " 00:00:00")], "sender_id string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
    assert (review.still_sending(agg, att).count() == 1) == flag


def test_merges(spark):
    rows = [("a", "b", True), ("b", "c", True), ("x", "y", True), ("y", "x", True), ("p", "q", True), ("p", "q", False)]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, source_id string, target_id string, active boolean")
    got = dict(senders.resolve_merge_target(m).select("source_id", "target_id").collect())
    assert got["a"] == "c" and got["b"] == "c" and "p" not in got and got["x"] in ("x", "y")
    mail = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "p")], "id string, sender_id string")
    assert sorted(r.sender_id for r in senders.effective_sender(mail, m).collect()) == ["c", "c", "p"]


def test_integrity(spark):
    ident = spark.createDataFrame([("a", "list_id", "l"), ("b", "list_id", "l"), ("a", "dkim_domain", "d"), ("b", "dkim_domain", "d"), ("b", "odd", "d")], "sender_id string, kind string, value string")
    assert [(r.kind, r.owners) for r in integrity.duplicate_identity_check(ident).collect()] == [("list_id", 2)]
    assert [r.value for r in integrity.enum_check({"sender_identity": ident}).collect()] == ["odd"]
    known = spark.createDataFrame([("a",)], "id string")
    assert [(r.table, r.sender_id, r.rows) for r in integrity.orphan_check(known, {"i": ident}).collect()] == [("i", "b", 3)]


def sequential(rows, stored):
    """The rule itself: one message after the other."""
    owner, out = {(k, v): s for s, k, v in stored}, {}
    for mid, _, lst, addr in sorted(rows, key=lambda r: r[1]):
        local, domain = addr.split("@")
        norm = f"list:{lst}" if lst else "addr:" + ("bounce-*" if local.startswith("bounce-") else local) + "@" + domain
        keys = ([("list_id", lst)] if lst else []) + [("from_address", addr), ("normalized_key", norm)]
        matched = [owner[k] for k in keys if k in owner]
        sender = matched[0] if matched else "new:" + "/".join(keys[0])
        for k in keys:
            owner.setdefault(k, sender)
        out[mid] = sender
    return out


def test_resolution_equals_sequence(spark):
    """Many random mailboxes at once: their keys don't meet, so one job settles them all."""
    r, rows, stored, expected = random.Random(5), [], [], {}
    for box in range(150):
        mine, known = [], []
        for i in range(r.randint(1, 9)):
            addr = r.choice([f"a@b{box}.example", f"c@b{box}.example", f"bounce-{r.randint(1, 4)}-x@b{box}.example", f"d{r.randint(1, 3)}@b{box}.example"])
            mine.append((f"{box}-{i}", box * 100 + i, r.choice([None, None, f"l{box}", f"k{box}"]), addr))
        for s in range(r.randint(0, 2)):
            known.append((f"S{box}-{s}", *r.choice([("list_id", f"l{box}"), ("from_address", f"a@b{box}.example"), ("normalized_key", f"addr:bounce-*@b{box}.example"), ("normalized_key", f"addr:c@b{box}.example")])))
        known = list({k[1:]: k for k in known}.values())
        rows, stored, expected = rows + mine, stored + known, expected | sequential(mine, known)
    mail = spark.createDataFrame(rows, "id string, ord long, list_id string, from_address string")
    ident = spark.createDataFrame(stored, "sender_id string, kind string, value string")
    got = {x.id: x.sender_id for x in resolve.resolve_senders(mail, ident).collect()}
    names: dict = {}
    for mid, sender in expected.items():
        assert (got[mid] == sender) if sender.startswith("S") else names.setdefault(sender, got[mid]) == got[mid], mid
    assert len(set(names.values())) == len(names)


def test_one_large_component_is_no_group(spark, monkeypatch):
    """Shared lists and platform addresses tie everything together; no task may be handed the whole of it."""
    from pyspark.sql.group import GroupedData

    def refuse(*_):
        raise AssertionError("a component in one Python group")

    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)
    r = random.Random(11)
    rows = [(str(i), i, r.choice([None, "l1", "l2", "l3"]), r.choice(["a@b.example", "c@b.example", f"bounce-{i % 9}@b.example", f"d{r.randint(1, 20)}@b.example"])) for i in range(200)]
    stored = [("S", "from_address", "d3@b.example"), ("T", "list_id", "l3")]
    mail = spark.createDataFrame(rows, "id string, ord long, list_id string, from_address string")
    got = {x.id: x.sender_id for x in resolve.resolve_senders(mail, spark.createDataFrame(stored, "sender_id string, kind string, value string")).collect()}
    names: dict = {}
    for mid, sender in sequential(rows, stored).items():
        assert (got[mid] == sender) if sender in "ST" else names.setdefault(sender, got[mid]) == got[mid], mid
    assert len(set(names.values())) == len(names)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """1,000 tuples that wait for each other, and as many that take a stored sender over: rounds grow with the logarithm."""
    rounds, whole = [], resolve.cut

    def counted(df):
        rounds.append(1)
        return whole(df)

    monkeypatch.setattr(resolve, "cut", counted)
    # A list's address is the next one's: each tuple has the list of the one before it, or its address.
    rows = [(str(i), i, f"l{(i + 1) // 2}", f"a{i // 2}@b.example") for i in range(1000)] + [(f"s{i}", 5000 + i, f"m{(i + 1) // 2}", f"c{i // 2}@b.example") for i in range(1000)]
    stored = [("S", "from_address", "c0@b.example")]
    mail = spark.createDataFrame(rows, "id string, ord long, list_id string, from_address string")
    got = {x.id: x.sender_id for x in resolve.resolve_senders(mail, spark.createDataFrame(stored, "sender_id string, kind string, value string")).collect()}
    want, names = sequential(rows, stored), {}
    for mid, sender in want.items():
        assert (got[mid] == sender) if sender == "S" else names.setdefault(sender, got[mid]) == got[mid], mid
    assert len(set(want.values())) == 2 and len(rounds) <= 5 + 15  # five cuts besides the rounds


def eml(uid, extra="", sender="n", folder="INBOX", body="hi", mid=None):
    head = f"From: {sender} <{sender}@x.example>\r\nMessage-ID: <{mid or uid}@x>\r\n{extra}\r\n"
    return (folder, 42, uid, f"2026-08-{uid % 28 + 1:02d} 00:00:00", head + body)


MAIL = [
    eml(1, "List-Unsubscribe: <https://x.example/u>\r\nList-Unsubscribe-Post: List-Unsubscribe=One-Click\r\n"), eml(2, "List-Unsubscribe: <https://x.example/u>\r\n"), eml(3, "List-Unsubscribe: <mailto:u@x.example>\r\n", "m"),
    eml(4, "Content-Type: text/html\r\n", "b", body='<a href="https://x.example/stop">Unsubscribe</a>'), eml(5, "", "friend"), eml(6, "List-Unsubscribe: <https://x.example/u>\r\n", folder="Other", mid=2),
]


def raw(spark, rows):
    return spark.createDataFrame(rows, "folder string, uidvalidity long, uid long, internal_date string, raw string").withColumn("internal_date", F.col("internal_date").cast("timestamp_ntz"))


def state(spark, root):
    m = tables.read_table(spark, root, "message").select("id", "sender_id", "method").orderBy("id").collect()
    s = tables.read_table(spark, root, "sender").select("id", "first_seen_at", "last_seen_at").orderBy("id").collect()
    w = tables.read_table(spark, root, "sync_state").select("folder", "last_uid").orderBy("folder").collect()
    i = tables.read_table(spark, root, "sender_identity").select("sender_id", "kind", "value").orderBy("sender_id", "kind", "value").collect()
    return m, s, w, i


def test_ingest_idempotent_and_split(spark, tmp_path):
    args = dict(as_of=AT("2026-09-01T00:00:00Z"), since=AT("2025-09-01T00:00:00Z"), folders=("INBOX", "Other"))
    streaming.ingest_batch(raw(spark, MAIL), f"{tmp_path}/a", **args)
    once = state(spark, f"{tmp_path}/a")
    assert [r.method for r in once[0]] == ["one_click", "http_link", "mailto", "body_link"] and len(once[1]) == 3
    assert [tuple(r) for r in once[2]] == [("INBOX", 5), ("Other", 6)]
    streaming.ingest_batch(raw(spark, MAIL), f"{tmp_path}/a", **args)
    assert state(spark, f"{tmp_path}/a") == once
    for part in (MAIL[:2], MAIL[2:5], MAIL[5:]):
        streaming.ingest_batch(raw(spark, part), f"{tmp_path}/b", **args)
    assert state(spark, f"{tmp_path}/b") == once


def test_stream(spark, tmp_path):
    args = dict(as_of=AT("2026-09-01T00:00:00Z"), since=AT("2025-09-01T00:00:00Z"))
    for part in (MAIL[:3], MAIL[3:5]):
        raw(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", max_files=1, **args).awaitTermination()
    assert [r.method for r in state(spark, f"{tmp_path}/out")[0]] == ["one_click", "http_link", "mailto", "body_link"]
    plan = streaming.stream_dedupe(spark.readStream.schema("id string, received_at timestamp_ntz").parquet(f"{tmp_path}/in"))
    assert plan.isStreaming


def test_incremental(spark):
    marks = frame(spark, "sync_state", [dict(folder="INBOX", uidvalidity=42, last_uid=3, backfill_since="2026-01-01 00:00:00")])
    left = lambda since: sorted(r.uid for r in ingest.incremental_filter(raw(spark, MAIL), marks, AT(since)).collect())
    assert left("2026-02-01T00:00:00Z") == [4, 5, 6] and left("2025-02-01T00:00:00Z") == [1, 2, 3, 4, 5, 6]
    other = marks.withColumn("uidvalidity", F.lit(99).cast("long"))
    assert len(ingest.incremental_filter(raw(spark, MAIL), other, AT("2026-02-01T00:00:00Z")).collect()) == 6


def test_two_uidvalidities_in_a_batch(spark):
    rows = [(*eml(1000)[:1], 42, 1000, *eml(1000)[3:]), (*eml(5)[:1], 99, 5, *eml(5)[3:])]
    got = ingest.advance_watermark(raw(spark, rows), None, AT("2025-01-01T00:00:00Z"), AT("2026-09-01T00:00:00Z")).first()
    assert (got.uidvalidity, got.last_uid) == (99, 5)
    marks = frame(spark, "sync_state", [dict(folder="INBOX", uidvalidity=99, last_uid=7, backfill_since="2025-01-01 00:00:00")])
    later = ingest.advance_watermark(raw(spark, rows), marks, AT("2025-02-01T00:00:00Z"), AT("2026-09-01T00:00:00Z")).withColumn("since", F.col("backfill_since").cast("string")).first()
    assert (later.uidvalidity, later.last_uid, later.since) == (99, 7, "2025-01-01 00:00:00")


def test_the_newest_name_stays(spark):
    def mail(rows):
        return spark.createDataFrame(rows, "sender_id string, received_at string, uid long, from_name string, from_address string").withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))

    new = ingest.sender_touch(mail([("s", "2024-05-01 00:00:00", 9, "New Name", "n@x"), ("s", "2024-06-01 00:00:00", 10, None, "o@x")]))
    both = ingest.sender_touch(mail([("s", "2023-01-01 00:00:00", 20, "Old Name", "q@x"), ("t", "2023-01-01 00:00:00", 21, None, "t@x")]), new)
    got = {r.id: r for r in both.withColumn("first", F.col("first_seen_at").cast("string")).collect()}
    assert (got["s"].display_name, got["s"].display_address, got["s"].first) == ("New Name", "o@x", "2023-01-01 00:00:00") and got["t"].display_name is None
    third = ingest.sender_touch(mail([("s", "2024-07-01 00:00:00", 1, "Newest", None)]), both).filter("id = 's'").first()
    assert (third.display_name, third.display_address) == ("Newest", "o@x")


def test_ingest_by_watermark(spark, tmp_path, monkeypatch):
    """A rerun examines nothing; a new uidvalidity or a wider window examines all again, and adds only what is new."""
    from mailgrain.operators import ingest as job

    seen, whole = [], job.incremental_filter

    def counted(*args):
        out = whole(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(streaming, "incremental_filter", counted)
    args = dict(as_of=AT("2026-09-01T00:00:00Z"), folders=("INBOX", "Other"))
    root = f"{tmp_path}/a"
    streaming.ingest_batch(raw(spark, MAIL), root, since=AT("2026-08-04T00:00:00Z"), **args)
    streaming.ingest_batch(raw(spark, MAIL), root, since=AT("2026-08-04T00:00:00Z"), **args)
    assert seen == [4, 0] and [r.id for r in state(spark, root)[0]] == ["<2@x>", "<3@x>", "<4@x>"]
    streaming.ingest_batch(raw(spark, MAIL), root, since=AT("2026-08-01T00:00:00Z"), **args)
    assert seen[2] == 6 and [r.id for r in state(spark, root)[0]] == ["<1@x>", "<2@x>", "<3@x>", "<4@x>"]
    renumbered = [(f, 99, u + 100, d, r) for f, _, u, d, r in MAIL] + [("INBOX", 99, 300, *eml(7, "List-Unsubscribe: <https://x.example/u>\r\n")[3:])]
    streaming.ingest_batch(raw(spark, renumbered), root, since=AT("2026-08-01T00:00:00Z"), **args)
    assert seen[3] == 7 and [r.id for r in state(spark, root)[0]][4:] == ["<7@x>"] and [tuple(r) for r in state(spark, root)[2]] == [("INBOX", 300), ("Other", 106)]


def test_half_written_snapshots_do_not_count(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    for n in range(1, 4):
        tables.write_snapshot(rows(*"abc"[:n]), str(tmp_path), "sender")
    (tmp_path / "sender" / "snapshot-000000004").mkdir()
    assert tables.read_table(spark, str(tmp_path), "sender").count() == 3
    assert sorted(p.name for p in (tmp_path / "sender").iterdir()) == [f"snapshot-00000000{n}" for n in (2, 3, 4)]


def test_plan(spark):
    rows = [("a", "one_click", "https://x", False), ("b", "mailto", "mailto:u@x.example", False), ("c", "mailto", "mailto:bad", False), ("d", "http_link", "https://x", True), ("e", None, None, False)]
    agg = spark.createDataFrame(rows, "sender_id string, method string, unsubscribe_uri string, suspicious boolean")
    got = {r.sender_id: r.result for r in review.unsubscribe_plan(agg, AT("2026-01-01T00:00:00Z")).collect()}
    assert got == {"a": "planned_post", "b": "planned_mail", "c": "failed", "d": "skipped_suspicious"}


def test_read_eml(spark, tmp_path):
    from mailgrain.sources import mail

    for name in ("7-a.eml", "b.eml"):
        (tmp_path / name).write_bytes(b"From: A <a@x.example>\r\nMessage-ID: <" + name.encode() + b">\r\n\r\nhi")
    rows = {r.id: r for r in mail.parsed_mail(mail.read_eml(spark, str(tmp_path))).collect()}
    assert rows["<7-a.eml>"].uid == 7 and rows["<b.eml>"].uid > 0 and rows["<b.eml>"].from_address == "a@x.example"


def test_renormalize_keeps_owners(spark):
    stored = spark.createDataFrame([("a", "normalized_key", "addr:x@e"), ("b", "normalized_key", "addr:y@e")], "sender_id string, kind string, value string")
    again = spark.createDataFrame([("a", "normalized_key", "addr:*@e", 1), ("b", "normalized_key", "addr:*@e", 2), ("b", "normalized_key", "addr:x@e", 3)], "sender_id string, kind string, value string, ord long")
    got = sorted(tuple(r) for r in senders.renormalize(stored, again).collect())
    assert got == [("a", "normalized_key", "addr:*@e"), ("a", "normalized_key", "addr:x@e"), ("b", "normalized_key", "addr:y@e")]
