"""More registered queries: single functions over the driver's tables, stored tables, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, detect, identity, mime, text
from ..operators import decisions as log
from ..operators import review
from ..sources import mail as mail_source
from ..sources import tables
from ..streaming import ingest as streaming
from . import driver_mail as dm
from .queries import _DATE, _DKIM, _TARGET, ISO, aggregates, as_of, iso, query, workspace


def events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumnRenamed("event_id", "uid")


@query("append_log", f"SELECT id, sender_id, decision, strftime(decided_at, '{ISO}') AS decided_at FROM dec")
def _(spark, d):
    root, dec = workspace(spark), dm.decisions(spark, d)
    for part in (dec.filter("id % 2 = 0"), dec.filter("id % 2 = 1")):
        tables.append_log(part, root, "decision")
    return tables.read_table(spark, root, "decision").select("id", "sender_id", "decision", *iso("decided_at"))


@query("read_write_tables", "SELECT sender_id, count(*) AS messages FROM m GROUP BY sender_id")
def _(spark, d):
    root = workspace(spark)
    tables.write_messages(dm.messages(spark, d), root)
    return tables.read_table(spark, root, "message").groupBy("sender_id").agg(F.count("*").alias("messages"))


@query("header_all", f"SELECT event_id AS uid, CAST(event_type IN ('click', 'view', 'purchase') AS INT) AS stop_headers, concat('v=1; a=b; d=', {_DKIM}, '; s=k') AS signature FROM events", views=False)
def _(spark, d):
    rows = mail_source.with_headers(dm.raw_mail(spark, d))
    h = F.col("headers")
    return rows.select("uid", F.size(mime.header_all(h, "list-unsubscribe")).alias("stop_headers"), mime.header(h, "dkim-signature").alias("signature"))


@query("decode_encoded_words", "SELECT event_id AS uid, CASE event_id % 3 WHEN 0 THEN concat('né ', user_id) WHEN 1 THEN 'né Straße' ELSE 'plain' END AS decoded FROM events", views=False)
def _(spark, d):
    words = F.expr("CASE uid % 3 WHEN 0 THEN concat('=?utf-8?q?n=C3=A9_', user_id, '?=') WHEN 1 THEN concat('né =?ISO-8859-1?B?', 'U3RyYd9l', '?=') ELSE 'plain' END")
    return events(spark, d).select("uid", mime.decode_encoded_words(words).alias("decoded"))


@query("html_part", "SELECT event_id AS uid, true AS html, false AS plain FROM events", views=False)
def _(spark, d):
    parts = dm.raw_mail(spark, d).select("uid", mime.decode_parts("raw").alias("p"))
    return parts.select("uid", mime.html_part(F.col("p")).isNotNull().alias("html"), mime.text_part(F.col("p")).isNotNull().alias("plain"))


@query("has_one_click_post", "SELECT event_id AS uid FROM events WHERE event_type = 'click'", views=False)
def _(spark, d):
    return mail_source.with_headers(dm.raw_mail(spark, d)).filter(detect.has_one_click_post(F.col("headers"))).select("uid")


@query("decode_entities", """SELECT event_id AS uid, concat('<', event_id, '> & "', user_id, '" it''s ') AS decoded FROM events""", views=False)
def _(spark, d):
    return events(spark, d).select("uid", text.decode_entities(F.expr("concat('&lt;', uid, '&GT; &amp; &quot;', user_id, '&quot; it&#39;s&nbsp;')")).alias("decoded"))


@query("target_domain", "SELECT event_id AS uid, CASE WHEN event_id % 4 = 0 THEN NULL WHEN value > 60 THEN 'elsewhere.co.uk' ELSE concat('s', user_id % 10, '.example') END AS target FROM events", views=False)
def _(spark, d):
    uri = F.expr(f"CASE uid % 4 WHEN 0 THEN 'not a uri' WHEN 1 THEN concat('mailto:x@', event_target, '?subject=y') ELSE concat('https://me@', event_target, ':8443/x') END")
    rows = events(spark, d).withColumn("event_id", F.col("uid")).withColumn("event_target", F.expr(_TARGET))
    return rows.select("uid", detect.target_domain(uri).alias("target"))


@query("is_resolving", "SELECT kind, kind <> 'dkim_domain' AS resolves, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'list_id' WHEN 1 THEN 'from_address' WHEN 2 THEN 'normalized_key' ELSE 'dkim_domain' END AS kind FROM events) GROUP BY kind", views=False)
def _(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in (*identity.RESOLVING, "dkim_domain")]), (F.col("uid") % 4 + 1).cast("int"))
    return events(spark, d).select(kind.alias("kind")).groupBy("kind", identity.is_resolving(F.col("kind")).alias("resolves")).agg(F.count("*").alias("n"))


@query("parse_instant", f"SELECT event_id AS uid, strftime(date_trunc('milliseconds', ts) - INTERVAL '2' HOUR, '{ISO}') AS instant FROM events", views=False)
def _(spark, d):
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    return events(spark, d).select("uid", dates.to_iso(dates.parse_instant(written)).alias("instant"))


@query("days_until", "SELECT event_id AS uid, date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') AS days, concat(CAST(CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') >= 16 THEN 1 ELSE date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') END AS VARCHAR), CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') >= 16 THEN '-month' ELSE '-day' END) AS hold FROM events", views=False)
def _(spark, d):
    return events(spark, d).select("uid", dates.days_until(F.col("ts"), as_of()).cast("long").alias("days"), dates.hold_length(F.col("ts"), as_of()).alias("hold"))


@query("format_date", f"SELECT event_id AS uid, {_DATE.format('ts')} AS on_, {_DATE.format(chr(40) + 'ts - INTERVAL 5 HOUR' + chr(41))} AS in_new_york FROM events", views=False)
def _(spark, d):
    return events(spark, d).select("uid", dates.format_date(F.col("ts")).alias("on_"), dates.format_date(F.col("ts"), "America/New_York").alias("in_new_york"))


@query("keep_confirmation", "SELECT sender_id, 'Keeping ' || sender_id || '. Won''t ask again until May 5, 2024.' AS kept, 'Keeping ' || sender_id || '. Won''t ask again.' AS for_good FROM agg")
def _(spark, d):
    rows = log.keep_decisions(aggregates(spark, d), as_of())
    return rows.select("sender_id", log.keep_confirmation(F.col("sender_id"), F.col("suppressed_until")).alias("kept"), log.keep_confirmation(F.col("sender_id"), F.lit(None).cast("timestamp_ntz")).alias("for_good"))


@query("hidden_footer", "SELECT CASE n WHEN 0 THEN 'No senders hidden. Run `mail kept` to see past decisions.' ELSE n || CASE n WHEN 1 THEN ' sender' ELSE ' senders' END || ' hidden — kept within the last 3 months. Run ''mail kept'' to see them and their return dates.' END AS footer FROM (SELECT count(*) AS n FROM st WHERE state IN ('suppressed', 'suppressed_forever'))")
def _(spark, d):
    return review.hidden_count(aggregates(spark, d), dm.decisions(spark, d), as_of()).select(log.hidden_footer(F.col("hidden"), "mail kept").alias("footer"))


@query("stream_ingest", "SELECT CASE event_type WHEN 'click' THEN 'one_click' WHEN 'view' THEN 'http_link' WHEN 'purchase' THEN 'mailto' ELSE 'body_link' END AS method, count(*) AS messages FROM events WHERE event_type <> 'error' GROUP BY 1", views=False)
def _(spark, d):
    """All mail arrives in several micro-batches, uids out of order, and one half arrives twice."""
    root, raw = workspace(spark), dm.raw_mail(spark, d)
    for part in (raw.filter("uid % 2 = 0"), raw.filter("uid % 2 = 1"), raw.filter("uid % 2 = 0")):
        part.write.mode("append").parquet(f"{root}/in")
    run = streaming.stream_ingest(spark, f"{root}/in", f"{root}/tables", f"{root}/checkpoint", as_of(), dates.instant("2023-01-01T00:00:00Z"), ("F0", "F1", "F2"), max_files=spark.sparkContext.defaultParallelism)
    run.awaitTermination()
    return tables.read_table(spark, f"{root}/tables", "message").groupBy("method").agg(F.count("*").alias("messages"))


@query("stream_dedupe", "SELECT count(DISTINCT id) AS ids, count(DISTINCT id) AS rows FROM m")
def _(spark, d):
    """The second row of each repeated id comes in a later micro-batch than the first."""
    root, m = workspace(spark), dm.messages(spark, d)
    for again in (False, True):
        m.filter((F.col("uid") % 50 == 7) == again).select("id", "received_at").repartition(2, "id").write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("id string, received_at timestamp_ntz").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run = streaming.stream_dedupe(stream, "60 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("rows"))
