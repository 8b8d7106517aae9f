"""Registered queries of the mail operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, detect, identity, mime, text
from ..operators import decisions as log
from ..operators import ingest, integrity, resolve, review, senders
from ..operators.graph import cut
from ..sources import mail as mail_source
from ..sources import tables
from . import driver_mail as dm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = dates.instant
ISO = "%Y-%m-%dT%H:%M:%S.%gZ"


def query(name: str, sql: str | None = None, views: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = dm.with_views(sql) if views else sql
        return f

    return keep


def as_of():
    return dates.instant(dm.AS_OF)


def aggregates(spark, d):
    return senders.aggregate_senders(dm.messages(spark, d).withColumn("id", F.concat_ws("|", "id", F.lpad(F.col("uid").cast("string"), 12, "0"))))


def workspace(spark) -> str:
    """A new folder where the cluster shares files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/mail-{uuid.uuid4().hex}"


def iso(*names: str):
    return [dates.to_iso(F.col(n)).alias(n) for n in names]


# -- sources ---------------------------------------------------------------------------------------------------------------------

_FROM = "concat('news-', user_id, '@s', user_id % 10, '.example')"
_DKIM = "concat('mail.s', user_id % 10, '.example')"
_LIST = "CASE WHEN event_id % 3 = 0 THEN concat('\"A list\" <L', user_id % 20, '.Lists.example>') END"


@query("read_raw_mail", "SELECT folder_, count(*) AS messages, min(event_id) AS low, max(event_id) AS high FROM (SELECT concat('F', event_id % 3) AS folder_, event_id FROM events) GROUP BY folder_", views=False)
def _(spark, d):
    """Through an archive that is written and read."""
    root = workspace(spark)
    dm.raw_mail(spark, d).write.parquet(root)
    return mail_source.read_raw_mail(spark, root).groupBy(F.col("folder").alias("folder_")).agg(F.count("*").alias("messages"), F.min("uid").alias("low"), F.max("uid").alias("high"))


@query("project_headers", f"""SELECT event_id AS uid, 4 + CAST(event_id % 3 = 0 AS INT) + CAST(event_type IN ('click', 'view', 'purchase') AS INT) + CAST(event_type = 'click' AS INT) AS fields, 'from' AS first_name FROM events""", views=False)
def _(spark, d):
    rows = mail_source.with_headers(dm.raw_mail(spark, d))
    return rows.select("uid", F.size("headers").alias("fields"), F.get("headers", F.lit(0))["name"].alias("first_name"))


@query("upsert_sync_state", "SELECT folder, max(uid) AS last_uid FROM m GROUP BY folder")
def _(spark, d):
    m = dm.messages(spark, d)
    old = m.filter("received_at < TIMESTAMP_NTZ '2024-01-08 00:00:00'").groupBy("folder").agg(F.max("uid").alias("last_uid"))
    return tables.upsert(old, m.groupBy("folder").agg(F.max("uid").alias("last_uid")), ["folder"])


# -- parsing ---------------------------------------------------------------------------------------------------------------------


@query("split_message", """SELECT event_id AS uid, CASE WHEN event_type = 'signup' THEN length(concat('<p>Hi</p><a href=3D"https://', CASE WHEN value > 60 THEN concat('track', event_id % 5, '.elsewhere.co.uk') ELSE concat('mail.s', user_id % 10, '.example') END, '/leave?c=3D', event_id, '">Se d=C3=A9sabonner</a>')) ELSE 26 END AS body_length FROM events""", views=False)
def _(spark, d):
    return dm.raw_mail(spark, d).select("uid", F.length(mime.split_message(F.col("raw"))["body"]).alias("body_length"))


@query("parse_headers", "SELECT event_id AS uid, concat('Hello again ', event_id) AS subject, 'y' AS other, concat('<m', event_id, '@x>') AS message_id FROM events", views=False)
def _(spark, d):
    rows = mail_source.with_headers(dm.raw_mail(spark, d), keep=None)
    h = F.col("headers")
    return rows.select("uid", mime.header(h, "subject").alias("subject"), F.get(mime.header_all(h, "x-other"), F.lit(0)).alias("other"), mime.header(h, "message-id").alias("message_id"))


@query("parse_address", f"SELECT event_id AS uid, concat('Café ', user_id) AS name, {_FROM} AS address FROM events", views=False)
def _(spark, d):
    return mail_source.parsed_mail(dm.raw_mail(spark, d)).select("uid", F.col("from_name").alias("name"), F.col("from_address").alias("address"))


@query("decode_parts", """SELECT event_id AS uid, CASE WHEN event_type = 'signup' THEN concat('<p>Hi</p><a href="https://', CASE WHEN value > 60 THEN concat('track', event_id % 5, '.elsewhere.co.uk') ELSE concat('mail.s', user_id % 10, '.example') END, '/leave?c=', event_id, '">Se désabonner</a>') ELSE '<a href="/home">Home</a>' END AS html FROM events""", views=False)
def _(spark, d):
    return dm.raw_mail(spark, d).select("uid", mime.html_part(mime.decode_parts("raw")).alias("html"))


_NESTED = """SELECT event_id AS uid, concat('Straße ', user_id) AS plain, concat('<b>né ', event_id, '</b>') AS html, 'text/plain utf-8,text/html iso-8859-1' AS kinds FROM events"""


@query("decode_multipart", _NESTED, views=False)
def _(spark, d):
    """A PDF, and in a nested multipart a base64 text and a quoted-printable page, in single and double quotes of their parameters."""
    e = spark.read.parquet(f"{d}/events.parquet")
    plain = F.base64(F.encode(F.concat(F.lit("Straße "), F.col("user_id")), "UTF-8"))
    raw = F.concat(
        F.lit('Subject: x\r\nContent-Type: multipart/mixed; boundary="out"\r\n\r\npreamble\r\n--out\r\nContent-Type: application/pdf\r\n\r\nJVBERi0=\r\n--out\r\nContent-Type: Multipart/Alternative;\r\n boundary=in\r\n\r\n--in\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\n'),
        plain, F.lit("\r\n--in\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<b>n=C3=\r\n=A9 "), F.col("event_id"), F.lit("</b>\r\n--in--\r\nafter\r\n--out--\r\nend"),
    )
    parts = e.select(F.col("event_id").alias("uid"), mime.decode_parts(raw).alias("p"))
    kinds = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["content_type"], p["charset"])), ",")
    return parts.select("uid", mime.text_part(F.col("p")).alias("plain"), mime.html_part(F.col("p")).alias("html"), kinds.alias("kinds"))


@query("parse_content_type", """SELECT event_id AS uid, CASE event_id % 4 WHEN 0 THEN 'text/html' ELSE 'text/plain' END AS kind, CASE event_id % 4 WHEN 0 THEN concat('utf-8;', user_id % 7) WHEN 1 THEN 'UTF-8' ELSE 'utf-8' END AS charset FROM events WHERE event_id % 4 <> 3""", views=False)
def _(spark, d):
    """Case, quotes, blanks and a missing field; an image is no text part. (A semicolon inside quotes ends a parameter.)"""
    e = spark.read.parquet(f"{d}/events.parquet")
    field = F.expr("CASE event_id % 4 WHEN 0 THEN concat('Content-Type: TEXT/Html ; Charset = \"utf-8\"; x=', user_id, '\\n') WHEN 1 THEN 'Content-Type: text/plain;charset=UTF-8\\n' WHEN 2 THEN '' ELSE 'Content-Type: image/png\\n' END")
    parts = e.select(F.col("event_id").alias("uid"), F.col("user_id"), F.explode(mime.decode_parts(F.concat(field, F.lit("X: y\n\nbody")))).alias("p"))
    return parts.select("uid", F.col("p.content_type").alias("kind"), F.when(F.col("uid") % 4 == 0, F.concat_ws(";", "p.charset", F.col("user_id") % 7)).otherwise(F.col("p.charset")).alias("charset"))


@query("dkim_domains", f"SELECT event_id AS uid, {_DKIM} AS domains FROM events", views=False)
def _(spark, d):
    return mail_source.parsed_mail(dm.raw_mail(spark, d)).select("uid", F.array_join("dkim", ",").alias("domains"))


@query("merge_headers", "SELECT event_id AS uid, concat('new ', event_id) AS subject, 2 AS fields FROM events", views=False)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    part = mime.parse_headers(F.concat(F.lit("Subject: old\nTo: a"), F.col("user_id")))
    full = mime.parse_headers(F.concat(F.lit("subject: new "), F.col("event_id")))
    merged = mime.merge_headers(part, full)
    return rows.select(F.col("event_id").alias("uid"), mime.header(merged, "subject").alias("subject"), F.size(merged).alias("fields"))


# -- detection -------------------------------------------------------------------------------------------------------------------

_TARGET = "CASE WHEN value > 60 THEN concat('track', event_id % 5, '.elsewhere.co.uk') ELSE concat('mail.s', user_id % 10, '.example') END"
_URI = f"CASE WHEN event_type IN ('click', 'view') THEN concat('https://', {_TARGET}, '/u?c=', event_id) WHEN event_type = 'purchase' THEN concat('mailto:leave-', event_id, '@', {_TARGET}, '?subject=stop') WHEN event_type = 'signup' THEN concat('https://', {_TARGET}, '/leave?c=', event_id) END"
_METHOD = "CASE event_type WHEN 'click' THEN 'one_click' WHEN 'view' THEN 'http_link' WHEN 'purchase' THEN 'mailto' WHEN 'signup' THEN 'body_link' END"
_CONF = "CAST(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.8 WHEN 'purchase' THEN 0.7 WHEN 'signup' THEN 0.4 END AS DOUBLE)"


@query("parse_list_unsubscribe", f"SELECT event_id AS uid, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'purchase' THEN 1 ELSE 0 END AS uris, event_type = 'click' AS one_click FROM events", views=False)
def _(spark, d):
    rows = mail_source.with_headers(dm.raw_mail(spark, d))
    return rows.select("uid", F.size(detect.parse_list_unsubscribe(F.array_join(mime.header_all(F.col("headers"), "list-unsubscribe"), ", "))).alias("uris"), detect.has_one_click_post(F.col("headers")).alias("one_click"))


@query("detect", f"SELECT event_id AS uid, {_METHOD} AS method, {_URI} AS uri, {_CONF} AS confidence, value > 60 AS suspicious FROM events WHERE event_type <> 'error'", views=False)
def _(spark, d):
    x = F.col("detection")
    return ingest.with_signal(ingest.detect_messages(dm.raw_mail(spark, d))).select("uid", x["method"].alias("method"), x["uri"].alias("uri"), x["confidence"].alias("confidence"), x["suspicious"].alias("suspicious"))


@query("headers_inconclusive", "SELECT event_id AS uid FROM events WHERE event_type IN ('signup', 'error')", views=False)
def _(spark, d):
    return mail_source.with_headers(dm.raw_mail(spark, d)).filter(detect.headers_inconclusive(F.col("headers"))).select("uid")


@query("extract_anchors", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b([^>]*)>(.*?)</a\s*>', 1)) AS attrs, unnest(regexp_extract_all(html, '(?is)<a\b([^>]*)>(.*?)</a\s*>', 2)) AS body FROM pages),
b AS (SELECT page_id, trim(regexp_extract(attrs, '(?i)\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href, trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM a)
SELECT page_id, count(*) AS anchors, sum(length(href)) AS href_chars, sum(length(replace(replace(replace(replace(replace(replace(txt, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '))) AS text_chars FROM b WHERE href <> '' GROUP BY page_id
""", views=False)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(detect.extract_anchors(F.col("html"))).alias("a"))
    return rows.groupBy("page_id").agg(F.count("*").alias("anchors"), F.sum(F.length("a.href")).alias("href_chars"), F.sum(F.length("a.text")).alias("text_chars"))


@query("detect_body_link", f"SELECT event_id AS uid, {_URI} AS uri, CAST(0.4 AS DOUBLE) AS confidence, 'body anchor link text matched \"désabonner\"' AS evidence FROM events WHERE event_type = 'signup'", views=False)
def _(spark, d):
    html = mime.html_part(mime.decode_parts("raw"))
    rows = dm.raw_mail(spark, d).select("uid", html.alias("html")).select("uid", detect.detect_body_link(F.col("html")).alias("b"))
    return rows.filter("b IS NOT NULL").select("uid", "b.uri", "b.confidence", "b.evidence")


_WORDS = "CASE event_id % 4 WHEN 0 THEN 'Please OPT_OUT  here' WHEN 1 THEN 'Gérer: Préférences' WHEN 2 THEN 'Me Désabonner' ELSE 'nothing' END"


@query("match_token", f"SELECT event_id AS uid, CASE event_id % 4 WHEN 0 THEN 'opt out' WHEN 2 THEN 'désabonner' END AS stop, CASE event_id % 4 WHEN 1 THEN 'préférences' END AS prefs, CASE event_id % 4 WHEN 0 THEN 'please opt out here' WHEN 1 THEN 'gerer: preferences' WHEN 2 THEN 'me desabonner' ELSE 'nothing' END AS norm FROM events", views=False)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_WORDS).alias("w"))
    return rows.select(F.col("event_id").alias("uid"), detect.match_unsubscribe_token(F.col("w")).alias("stop"), detect.match_preference_token(F.col("w")).alias("prefs"), text.normalize_for_match(F.col("w")).alias("norm"))


@query("match_url_token", "SELECT event_id AS uid, CASE event_id % 3 WHEN 0 THEN 'unsub' WHEN 1 THEN NULL ELSE 'remove' END AS token FROM events", views=False)
def _(spark, d):
    url = F.expr("CASE event_id % 3 WHEN 0 THEN concat('https://x.example/unsub?i=', event_id) WHEN 1 THEN concat('https://unsubscribe.example/x#unsubscribe', event_id) ELSE '/list/remove' END")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), detect.match_url_token(url).alias("token"))


@query("registrable_domain", r"""
WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '.') AS l FROM pages)
SELECT page_id, CASE WHEN len(l) < 2 THEN NULL ELSE concat(l[-2], '.', l[-1]) END AS domain FROM h
""", views=False)
def _(spark, d):
    """Computed once a distinct host."""
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    hosts = pages.select("host").distinct().withColumn("domain", identity.registrable_domain(F.col("host")))
    return pages.join(hosts, "host").select("page_id", "domain")


@query("is_suspicious", f"SELECT event_id AS uid, CASE WHEN value > 60 THEN 'elsewhere.co.uk' ELSE concat('s', user_id % 10, '.example') END AS target, value > 60 AS suspicious FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), F.expr(f"concat('https://', {_TARGET}, '/x')").alias("uri"), F.expr(_FROM).alias("sender"))
    return e.select("uid", detect.target_domain(F.col("uri")).alias("target"), detect.is_suspicious(F.col("uri"), F.col("sender"), F.array(F.lit("other.test"))).alias("suspicious"))


@query("parse_mailto", "SELECT event_id AS uid, concat('a b', event_id, '@x.example') AS to_, CASE WHEN event_id % 2 = 0 THEN concat('leave ', user_id) ELSE 'unsubscribe' END AS subject, 'unsubscribe' AS body FROM events WHERE event_id % 5 <> 0", views=False)
def _(spark, d):
    uri = F.expr("CASE WHEN event_id % 5 = 0 THEN 'mailto:nobody' ELSE concat('mailto:a%20b', event_id, '@x.example', CASE WHEN event_id % 2 = 0 THEN concat('?x=1&subject=leave%20', user_id) ELSE '' END) END")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), detect.parse_mailto(uri).alias("p"))
    return rows.filter("p IS NOT NULL").select("uid", F.col("p.to").alias("to_"), "p.subject", "p.body")


@query("unsubscribe_plan", """SELECT sender_id, CASE WHEN bad THEN 'skipped_suspicious' WHEN method = 'one_click' THEN 'planned_post' WHEN method IN ('http_link', 'body_link') THEN 'pending_manual' ELSE 'failed' END AS result, uri AS target_uri
FROM (SELECT sender_id, arg_max(method, k) AS method, arg_max(unsubscribe_uri, k) AS uri, arg_max(suspicious, k) AS bad FROM (SELECT *, (confidence, received_at, id, uid) AS k FROM m) GROUP BY sender_id)""")
def _(spark, d):
    return review.unsubscribe_plan(aggregates(spark, d), as_of()).select("sender_id", "result", "target_uri")


# -- identities ------------------------------------------------------------------------------------------------------------------


@query("split_address", r"""SELECT doc_id, count(*) AS addresses, sum(length(a)) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS a FROM documents) GROUP BY doc_id""", views=False)
def _(spark, d):
    found = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))).alias("a"))
    parts = found.select("doc_id", identity.split_address(F.col("a")).alias("s")).filter("s IS NOT NULL")
    return parts.groupBy("doc_id").agg(F.count("*").alias("addresses"), F.sum(F.length("s.local") + 1 + F.length("s.domain")).alias("chars"))


_SHAPES = "CASE event_id % 6 WHEN 0 THEN concat('bounce-', 100000 + event_id, '-abc') WHEN 1 THEN concat('you', user_id % 10, '+tag') WHEN 2 THEN concat('patagonia-', lower(hex(268435456 + event_id)), '-news') WHEN 3 THEN lower(hex(268435456 + event_id)) WHEN 4 THEN 'news2' ELSE concat('a.', 100 + event_id % 900) END"


@query("is_variable_segment", "SELECT event_id AS uid, event_id >= 100 AS by_digits, true AS by_hex, false AS by_name FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("uid"), identity.is_variable_segment(F.col("event_id").cast("string")).alias("by_digits"), identity.is_variable_segment(F.lower(F.hex(F.col("event_id") + 268435456))).alias("by_hex"), identity.is_variable_segment(F.lit("news2")).alias("by_name"))


@query("normalize_local_part", "SELECT event_id AS uid, CASE event_id % 6 WHEN 0 THEN 'bounce-*' WHEN 1 THEN concat('you', user_id % 10) WHEN 2 THEN 'patagonia-*-news' WHEN 3 THEN '*' WHEN 4 THEN 'news2' ELSE 'a.*' END AS normalized, event_id % 6 <> 4 AS collapsed FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), F.expr(_SHAPES).alias("l"))
    return e.select("uid", identity.normalize_local_part(F.col("l")).alias("n")).select("uid", "n.normalized", "n.collapsed")


@query("normalize_list_id", "SELECT event_id AS uid, concat('l', user_id % 20, '.lists.example') AS list_id FROM events WHERE event_id % 3 = 0", views=False)
def _(spark, d):
    rows = mail_source.parsed_mail(dm.raw_mail(spark, d)).select("uid", identity.normalize_list_id(F.col("list_id")).alias("list_id"))
    return rows.filter("list_id IS NOT NULL")


@query("normalized_key", "SELECT event_id AS uid, CASE WHEN event_id % 7 = 0 THEN concat('list:l', user_id % 20, '.example') WHEN event_id % 6 = 3 THEN 'domain:x.co.uk' ELSE concat('addr:', CASE event_id % 6 WHEN 0 THEN 'bounce-*' WHEN 1 THEN concat('you', user_id % 10) WHEN 2 THEN 'patagonia-*-news' WHEN 4 THEN 'news2' ELSE 'a.*' END, '@m.x.co.uk') END AS key, CASE WHEN event_id % 7 = 0 THEN 'list_id' WHEN event_id % 6 = 3 THEN 'domain' ELSE 'address' END AS tier FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), F.expr(f"concat({_SHAPES}, '@M.x.co.uk')").alias("a"), F.expr("CASE WHEN event_id % 7 = 0 THEN concat('List <L', user_id % 20, '.example>') END").alias("l"))
    return e.select("uid", identity.normalized_key(F.col("l"), F.col("a")).alias("k")).select("uid", "k.key", "k.tier")


@query("candidate_identities", f"""SELECT uid, ord, kind, value FROM (
SELECT event_id AS uid, 0 AS ord, 'list_id' AS kind, concat('l', user_id % 20, '.lists.example') AS value FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, 'from_address', {_FROM} FROM events
UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END, 'normalized_key', CASE WHEN event_id % 3 = 0 THEN concat('list:l', user_id % 20, '.lists.example') WHEN user_id >= 100 THEN concat('addr:news-*@s', user_id % 10, '.example') ELSE concat('addr:', {_FROM}) END FROM events
UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END, 'dkim_domain', concat('s', user_id % 10, '.example') FROM events)""", views=False)
def _(spark, d):
    rows = mail_source.parsed_mail(dm.raw_mail(spark, d))
    return rows.select("uid", F.posexplode(identity.candidate_identities(F.col("list_id"), F.col("from_address"), F.col("dkim"))).alias("ord", "c")).select("uid", "ord", "c.kind", "c.value")


def _known(spark, d):
    """A stored identity table: lists 0 to 9, and the addresses of two users of five."""
    e = spark.read.parquet(f"{d}/events.parquet")
    lists = e.filter("user_id % 20 < 10").select(F.concat(F.lit("L"), F.col("user_id") % 20).alias("sender_id"), F.lit("list_id").alias("kind"), F.concat(F.lit("l"), F.col("user_id") % 20, F.lit(".lists.example")).alias("value"))
    addresses = e.filter("user_id % 5 < 2").select(F.concat(F.lit("A"), F.col("user_id")).alias("sender_id"), F.lit("from_address").alias("kind"), F.expr(_FROM).alias("value"))
    return lists.union(addresses).distinct()


def _candidates(spark, d):
    rows = mail_source.parsed_mail(dm.raw_mail(spark, d))
    return rows.select("id", F.explode(identity.candidate_identities(F.col("list_id"), F.col("from_address"), F.col("dkim"))).alias("c")).select(F.col("id").alias("message_id"), "c.kind", "c.value")


_BY_LIST = "event_id % 3 = 0 AND user_id % 20 < 10"


@query("find_matches", f"SELECT concat('<m', event_id, '@x>') AS message_id, 'list_id' AS kind, concat('L', user_id % 20) AS sender_id FROM events WHERE {_BY_LIST} UNION ALL SELECT concat('<m', event_id, '@x>'), 'from_address', concat('A', user_id) FROM events WHERE user_id % 5 < 2", views=False)
def _(spark, d):
    return senders.find_matches(_candidates(spark, d), _known(spark, d)).select("message_id", "kind", "sender_id")


@query("resolve_sender", f"SELECT concat('<m', event_id, '@x>') AS message_id, CASE WHEN {_BY_LIST} AND user_id % 5 < 2 THEN 'ambiguous' WHEN {_BY_LIST} OR user_id % 5 < 2 THEN 'existing' ELSE 'new' END AS outcome, CASE WHEN {_BY_LIST} THEN concat('L', user_id % 20) WHEN user_id % 5 < 2 THEN concat('A', user_id) END AS sender_id, CASE WHEN {_BY_LIST} AND user_id % 5 < 2 THEN concat('A', user_id) ELSE '' END AS also FROM events", views=False)
def _(spark, d):
    return senders.resolve_known(_candidates(spark, d), _known(spark, d)).select("message_id", "outcome", "sender_id", F.coalesce(F.array_join("also_matched", ","), F.lit("")).alias("also"))


@query("resolve_senders_cold", f"""
WITH e AS (SELECT event_id, user_id AS u, user_id % 20 AS k, user_id % 10 AS j, event_id % 3 AS f, {_FROM} AS a FROM events),
own AS (SELECT k, CASE WHEN k < 10 THEN concat('L', k) WHEN arg_min(u, event_id) % 5 < 2 THEN concat('A', arg_min(u, event_id)) ELSE sha256(concat(chr(31), 'list_id', chr(31), 'l', k, '.lists.example')) END AS owner FROM e WHERE f = 0 GROUP BY k),
lists AS (SELECT DISTINCT u, owner AS by_list FROM e JOIN own USING (k) WHERE f = 0),
x AS (SELECT e.*, own.owner, by_list, sha256(concat(chr(31), 'from_address', chr(31), a)) AS fresh FROM e LEFT JOIN own USING (k) LEFT JOIN lists USING (u)),
stars AS (SELECT j, arg_min(CASE WHEN u % 5 < 2 THEN concat('A', u) ELSE coalesce(by_list, fresh) END, (f, event_id)) AS star FROM x WHERE f > 0 AND u >= 100 GROUP BY j)
SELECT concat('<m', event_id, '@x>') AS id, CASE WHEN f = 0 THEN owner WHEN u % 5 < 2 THEN concat('A', u) WHEN by_list IS NOT NULL THEN by_list WHEN u < 100 THEN fresh ELSE star END AS sender_id FROM x LEFT JOIN stars USING (j)
""", views=False)
def _(spark, d):
    """Order-dependent: lists come first (folder F0), then addresses, then what rotating addresses share; the tests hold random mail against a sequential pass."""
    rows = mail_source.parsed_mail(dm.raw_mail(spark, d)).withColumn("ord", F.struct("folder", "uid"))
    return resolve.resolve_senders(rows, _known(spark, d)).select("id", "sender_id")


@query("new_identities", f"SELECT DISTINCT concat('s', user_id) AS sender_id, 'from_address' AS kind, {_FROM} AS value FROM events WHERE user_id % 5 >= 2 UNION SELECT DISTINCT concat('s', user_id), 'dkim_domain', {_DKIM} FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    sender, order = F.concat(F.lit("s"), F.col("user_id")).alias("sender_id"), F.col("event_id").alias("ord")
    found = e.select(sender, F.lit("from_address").alias("kind"), F.expr(_FROM).alias("value"), order).union(e.select(sender, F.lit("dkim_domain").alias("kind"), F.expr(_DKIM).alias("value"), order))
    return senders.new_identities(found, _known(spark, d))


@query("renormalize", f"SELECT DISTINCT concat('u', user_id) AS sender_id, 'normalized_key' AS kind, concat('addr:', {_FROM}) AS value FROM events UNION ALL SELECT DISTINCT concat('u', min(user_id) OVER (PARTITION BY user_id % 10)), 'normalized_key', concat('addr:new-*@s', user_id % 10) FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    stored = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("sender_id"), F.lit("normalized_key").alias("kind"), F.expr(f"concat('addr:', {_FROM})").alias("value")).distinct()
    again = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("sender_id"), F.lit("normalized_key").alias("kind"), F.expr("concat('addr:new-*@s', user_id % 10)").alias("value"), F.col("user_id").alias("ord"))
    return senders.renormalize(stored, again)


_ENDS = """SELECT source_id, coalesce(c.target_id, b.target_id, a.target_id) AS target_id FROM (SELECT * FROM mrg WHERE active) a LEFT JOIN (SELECT source_id AS s2, target_id FROM mrg WHERE active) b ON a.target_id = s2 LEFT JOIN (SELECT source_id AS s3, target_id FROM mrg WHERE active) c ON b.target_id = s3"""


@query("resolve_merge_target", _ENDS)
def _(spark, d):
    return senders.resolve_merge_target(dm.merges(spark, d))


@query("merge_senders", f"SELECT coalesce(e.target_id, m.sender_id) AS sender_id, count(*) AS messages FROM m LEFT JOIN ({_ENDS}) e ON m.sender_id = e.source_id GROUP BY 1")
def _(spark, d):
    return senders.effective_sender(dm.messages(spark, d), dm.merges(spark, d)).groupBy("sender_id").agg(F.count("*").alias("messages"))


@query("split_sender", "SELECT sender_id, count(*) AS messages FROM m GROUP BY 1")
def _(spark, d):
    """All merges undone: the rows appended, then applied."""
    m = dm.merges(spark, d)
    undo = senders.split_rows(m.select("source_id"), m, as_of()).select((F.lit(10_000_000) + F.monotonically_increasing_id()).alias("id"), "source_id", "target_id", "active")
    return senders.effective_sender(dm.messages(spark, d), m.unionByName(undo)).groupBy("sender_id").agg(F.count("*").alias("messages"))


@query("find_senders", "SELECT concat('c', c_custkey) AS sender_id FROM customer WHERE lower(c_name) LIKE '%00012%' UNION SELECT concat('c', c_custkey) FROM customer WHERE c_custkey IN (5)", views=False)
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    people = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("display_name"), F.lit(None).cast("string").alias("display_address"))
    known = c.filter("c_custkey = 5").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("sender_id"), F.lit("list_id").alias("kind"), F.lit("00012").alias("value"))
    return senders.find_senders(" 00012 ", people, known, people.select(F.col("id").alias("sender_id")))


# -- ingest ----------------------------------------------------------------------------------------------------------------------


@query("folder_filter", "SELECT folder, CASE folder WHEN 'F2' THEN 1 ELSE 2 END AS folder_ord, count(*) AS n FROM m WHERE folder IN ('F2', 'F0') GROUP BY folder")
def _(spark, d):
    return ingest.folder_filter(dm.messages(spark, d), ("F2", "F0")).groupBy("folder", "folder_ord").agg(F.count("*").alias("n"))


@query("backfill_filter", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15'", views=False)
def _(spark, d):
    return ingest.backfill_filter(dm.raw_mail(spark, d), dates.instant("2024-01-15T00:00:00Z")).agg(F.count("*").alias("n"))


@query("parse_since", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-26') AS days, count(*) FILTER (ts >= TIMESTAMP '2024-01-05') AS months, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS dated FROM events", views=False)
def _(spark, d):
    mail, at = dm.raw_mail(spark, d), datetime.datetime(2024, 2, 5)
    since = {"days": "10d", "months": "1m", "dated": "2024-01-20"}
    kept = {k: ingest.backfill_filter(mail, F.lit(dates.parse_since(v, at).isoformat()).cast("timestamp_ntz")).agg(F.count("*").alias(k)) for k, v in since.items()}
    return kept["days"].crossJoin(kept["months"]).crossJoin(kept["dated"])  # one row each


_STATE = "SELECT * FROM VALUES ('F0', 1L, 4000L, TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('F1', 9L, 9000L, TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('F2', 1L, 5000L, TIMESTAMP_NTZ '2024-01-20 00:00:00') AS t(folder, uidvalidity, last_uid, backfill_since)"


@query("incremental_filter", "SELECT concat('F', event_id % 3) AS folder, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND (event_id % 3 > 0 OR event_id > 4000) GROUP BY 1", views=False)
def _(spark, d):
    rows = ingest.incremental_filter(dm.raw_mail(spark, d), spark.sql(_STATE), dates.instant("2024-01-05T00:00:00Z"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"))


@query("message_key", "SELECT event_id AS uid, CASE WHEN event_id % 4 = 0 THEN concat('F', event_id % 3, ':1:', event_id) ELSE concat('<m', event_id, '>') END AS id FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("uid"), detect.message_key(F.expr("CASE WHEN event_id % 8 = 0 THEN '' WHEN event_id % 4 = 0 THEN NULL ELSE concat(' <m', event_id, '> ') END"), F.expr("concat('F', event_id % 3)"), F.lit(1), F.col("event_id")).alias("id"))


@query("dedupe_messages", "SELECT id, folder, uid FROM m WHERE received_at >= TIMESTAMP '2024-01-08' AND id NOT IN (SELECT id FROM m WHERE received_at < TIMESTAMP '2024-01-08') QUALIFY row_number() OVER (PARTITION BY id ORDER BY folder, uid) = 1")
def _(spark, d):
    m = dm.messages(spark, d)
    new = F.col("received_at") >= F.lit("2024-01-08").cast("timestamp_ntz")
    return ingest.dedupe_messages(m.filter(new), m.filter(~new)).select("id", "folder", "uid")


@query("sender_touch", f"SELECT sender_id AS id, strftime(min(received_at), '{ISO}') AS first_seen_at, strftime(max(received_at), '{ISO}') AS last_seen_at, arg_max(from_name, received_at) FILTER (from_name IS NOT NULL) AS display_name FROM m GROUP BY sender_id")
def _(spark, d):
    """The older half of the mail comes last."""
    m = dm.messages(spark, d)
    new = F.col("received_at") >= F.lit("2024-01-15").cast("timestamp_ntz")
    return ingest.sender_touch(m.filter(~new), ingest.sender_touch(m.filter(new))).select("id", *iso("first_seen_at", "last_seen_at"), "display_name")


@query("advance_watermark", """SELECT concat('F', k) AS folder, CASE WHEN k = 1 THEN 9 WHEN k = 2 THEN 2 ELSE 1 END AS uidvalidity, CASE WHEN k = 1 THEN 5000 ELSE greatest(arg_max(event_id, (v, event_id)), CASE WHEN k = 0 THEN 5000 ELSE 0 END) END AS last_uid
FROM (SELECT event_id, event_id % 3 AS k, CASE WHEN event_id % 3 = 2 AND value > 60 THEN 2 ELSE 1 END AS v FROM events) GROUP BY k""", views=False)
def _(spark, d):
    """F2's mail has two uidvalidities in one batch; F1's stored one is higher than the batch's."""
    state = spark.sql(_STATE).withColumn("last_uid", F.lit(5000).cast("long"))
    e = spark.read.parquet(f"{d}/events.parquet")
    mail = e.select(F.expr("concat('F', event_id % 3)").alias("folder"), F.expr("CASE WHEN event_id % 3 = 2 AND value > 60 THEN 2L ELSE 1L END").alias("uidvalidity"), F.col("event_id").alias("uid"))
    return ingest.advance_watermark(mail, state, dates.instant("2024-01-01T00:00:00Z"), as_of()).select("folder", F.col("uidvalidity").cast("int").alias("uidvalidity"), "last_uid")


@query("sync_summary", "SELECT concat('F', event_id % 3) AS folder, count(*) AS examined, count(*) FILTER (event_type <> 'error') AS detected, count(*) FILTER (event_type <> 'error') AS recorded, count(*) FILTER (event_type IN ('signup', 'error')) AS bodies_fetched, max(event_id) AS last_uid FROM events GROUP BY 1", views=False)
def _(spark, d):
    """Detection is written once, as in an ingest, and then counted twice."""
    found = cut(ingest.detect_messages(dm.raw_mail(spark, d)))
    return ingest.sync_summary(found, ingest.dedupe_messages(ingest.as_messages(found))).select("folder", "examined", "detected", "recorded", "bodies_fetched", "last_uid")


# -- aggregates and decisions ----------------------------------------------------------------------------------------------------


@query("aggregate_senders", f"SELECT sender_id, message_count, strftime(first_seen, '{ISO}') AS first_seen, strftime(last_seen, '{ISO}') AS last_seen, method, confidence FROM agg")
def _(spark, d):
    return aggregates(spark, d).select("sender_id", "message_count", *iso("first_seen", "last_seen"), "method", "confidence")


@query("best_method_per_sender", "SELECT sender_id, method, confidence, unsubscribe_uri, suspicious FROM m QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY confidence DESC, received_at DESC, id DESC) = 1")
def _(spark, d):
    return senders.best_method_per_sender(dm.messages(spark, d))


@query("count_for_sender", "SELECT sender_id, count(*) AS message_count FROM m GROUP BY 1")
def _(spark, d):
    return senders.count_for_sender(dm.messages(spark, d))


@query("total_messages", "SELECT count(*) AS total FROM m")
def _(spark, d):
    return senders.total_messages(dm.messages(spark, d))


@query("method_distribution", "SELECT method, count(*) AS messages FROM m GROUP BY 1")
def _(spark, d):
    return senders.method_distribution(dm.messages(spark, d))


@query("latest_decision", f"SELECT sender_id, id, decision, strftime(decided_at, '{ISO}') AS decided_at, strftime(suppressed_until, '{ISO}') AS suppressed_until FROM last")
def _(spark, d):
    return log.latest_decision(dm.decisions(spark, d)).select("sender_id", "id", "decision", *iso("decided_at", "suppressed_until"))


@query("decision_history", "SELECT sender_id, string_agg(concat(id, ':', decision), ',' ORDER BY decided_at, id) AS history FROM dec GROUP BY sender_id")
def _(spark, d):
    rows = log.decision_history(dm.decisions(spark, d))
    return rows.select("sender_id", F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["id"], h["decision"])), ",").alias("history"))


@query("latest_attempt", "SELECT sender_id, id AS attempt_id, result FROM att QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY attempted_at DESC, id DESC) = 1")
def _(spark, d):
    return review.latest_attempt(dm.attempts(spark, d)).select("sender_id", "attempt_id", "result")


_LAST_ATT = "(SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY attempted_at DESC, id DESC) = 1)"


@query("still_sending", f"SELECT sender_id, message_count FROM agg JOIN {_LAST_ATT} a USING (sender_id) WHERE a.result = 'success' AND last_seen > attempted_at + INTERVAL '240' HOUR")
def _(spark, d):
    return review.still_sending(aggregates(spark, d), dm.attempts(spark, d)).select("sender_id", "message_count")


@query("mail_after_attempt", f"SELECT m.sender_id, count(*) AS messages_after, strftime(max(m.received_at), '{ISO}') AS latest FROM m JOIN {_LAST_ATT} a USING (sender_id) WHERE a.result = 'success' AND m.received_at > a.attempted_at + INTERVAL '240' HOUR GROUP BY 1")
def _(spark, d):
    return review.mail_after_attempt(dm.messages(spark, d), dm.attempts(spark, d)).select("sender_id", "messages_after", *iso("latest"))


@query("pending_follow_ups", f"SELECT sender_id, target_uri FROM agg JOIN {_LAST_ATT} a USING (sender_id) WHERE a.result = 'pending_manual'")
def _(spark, d):
    return review.pending_follow_ups(aggregates(spark, d), dm.attempts(spark, d)).select("sender_id", "target_uri")


@query("follow_ups", f"SELECT sender_id, CASE a.result WHEN 'success' THEN 'still_sending' ELSE 'pending_manual' END AS kind FROM agg JOIN {_LAST_ATT} a USING (sender_id) WHERE a.result = 'pending_manual' OR (a.result = 'success' AND last_seen > attempted_at + INTERVAL '240' HOUR)")
def _(spark, d):
    return review.follow_ups(aggregates(spark, d), dm.attempts(spark, d)).select("sender_id", "kind")


@query("orphan_check", "SELECT 'decision' AS \"table\", sender_id, count(*) AS rows FROM dec WHERE sender_id NOT IN (SELECT sender_id FROM m WHERE suspicious AND method = 'mailto' AND folder = 'F1') GROUP BY 2")
def _(spark, d):
    known = dm.messages(spark, d).filter("suspicious AND method = 'mailto' AND folder = 'F1'").select(F.col("sender_id").alias("id")).distinct()
    return integrity.orphan_check(known, {"decision": dm.decisions(spark, d)})


@query("duplicate_identity_check", "SELECT 'normalized_key' AS kind, concat('k', user_id % 40) AS value, count(DISTINCT user_id) AS owners FROM events GROUP BY 2 HAVING count(DISTINCT user_id) > 1", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return integrity.duplicate_identity_check(e.select(F.concat(F.lit("u"), F.col("user_id")).alias("sender_id"), F.lit("normalized_key").alias("kind"), F.concat(F.lit("k"), F.col("user_id") % 40).alias("value")))


@query("enum_check", "SELECT 'decision' AS \"table\", 'decision' AS \"column\", event_type AS value, count(*) AS rows FROM events GROUP BY event_type UNION ALL SELECT 'unsubscribe_attempt', 'result', result, count(*) FROM (SELECT concat(result, '!') AS result FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'pending_manual' ELSE 'failed' END AS result FROM events)) GROUP BY result", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    att = e.select(F.lit("mailto").alias("method"), F.expr("concat(CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'pending_manual' ELSE 'failed' END, '!')").alias("result"))
    return integrity.enum_check({"decision": e.select(F.col("event_type").alias("decision")), "unsubscribe_attempt": att})


# -- dates and sentences ---------------------------------------------------------------------------------------------------------

_NY = "America/New_York"


@query("add_months", f"SELECT o_orderkey, strftime(o_orderdate + to_months(CAST(1 + o_orderkey % 14 AS INT)), '{ISO}') AS later FROM orders", views=False)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return o.select("o_orderkey", dates.to_iso(dates.add_months(F.col("o_orderdate"), (1 + F.col("o_orderkey") % 14).cast("int"))).alias("later"))


@query("parse_duration", "SELECT event_id AS uid, CASE event_id % 4 WHEN 0 THEN 1 + event_id % 9 WHEN 1 THEN 12 * (1 + event_id % 9) END AS months, CASE WHEN event_id % 4 = 2 THEN 1 + event_id % 9 END AS days FROM events", views=False)
def _(spark, d):
    words = F.expr("concat(1 + event_id % 9, CASE event_id % 4 WHEN 0 THEN ' Months' WHEN 1 THEN 'y' WHEN 2 THEN 'd' ELSE ' fortnights' END)")
    p = dates.parse_duration(words)
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), p["months"].cast("long").alias("months"), p["days"].cast("long").alias("days"))


@query("apply_duration", f"SELECT event_id AS uid, strftime(CASE event_id % 3 WHEN 0 THEN ts + INTERVAL '6' MONTH WHEN 1 THEN ts + INTERVAL '1080' HOUR END, '{ISO}') AS until FROM events", views=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    duration = dates.parse_duration(F.expr("CASE event_id % 3 WHEN 0 THEN '6m' WHEN 1 THEN '45 days' ELSE 'forever' END"))
    return e.select(F.col("event_id").alias("uid"), dates.to_iso(dates.apply_duration(F.col("ts"), duration)).alias("until"))


@query("keep_decisions", "SELECT sender_id, 'keep' AS decision, '2024-05-05T00:00:00.000Z' AS suppressed_until FROM agg")
def _(spark, d):
    return log.keep_decisions(aggregates(spark, d), as_of()).select("sender_id", "decision", *iso("suppressed_until"))


@query("unsubscribe_decisions", "SELECT sender_id, 'unsubscribe' AS decision FROM att")
def _(spark, d):
    return log.unsubscribe_decisions(dm.attempts(spark, d), as_of()).select("sender_id", "decision")


@query("unsuppress_decisions", "SELECT sender_id, 'unsuppress' AS decision FROM st WHERE state IN ('suppressed', 'suppressed_forever')")
def _(spark, d):
    status = log.suppression_status(aggregates(spark, d), dm.decisions(spark, d), as_of())
    return log.unsuppress_decisions(status, as_of()).select("sender_id", "decision")


@query("suppression_status", "SELECT sender_id, state, CASE WHEN state = 'suppressed' THEN date_diff('day', DATE '2024-02-05', CAST(suppressed_until AS DATE)) END AS days_remaining, state IN ('never_decided', 'returning', 'unsuppressed') AS reviewable FROM st")
def _(spark, d):
    rows = log.suppression_status(aggregates(spark, d), dm.decisions(spark, d), as_of())
    return rows.select("sender_id", "state", F.col("days_remaining").cast("long").alias("days_remaining"), log.is_reviewable(F.col("state")).alias("reviewable"))


_DATE = "strftime({0}, '%b %-d, %Y')"


@query("status_sentences", f"""SELECT sender_id, CASE state WHEN 'never_decided' THEN 'never decided on' WHEN 'suppressed_forever' THEN 'kept forever on ' || {_DATE.format('decided_at')} WHEN 'returning' THEN 'kept on ' || {_DATE.format('decided_at')} || '; hold expired ' || {_DATE.format('suppressed_until')} WHEN 'unsubscribed' THEN 'unsubscribed on ' || {_DATE.format('decided_at')} WHEN 'unsuppressed' THEN 'hold ended early on ' || {_DATE.format('decided_at')}
 ELSE 'kept on ' || {_DATE.format('decided_at')} || '; ' || lower('Returns in ' || dr || CASE WHEN dr = 1 THEN ' day (' ELSE ' days (' END || {_DATE.format('suppressed_until')} || ')') END AS description,
 CASE WHEN state = 'returning' THEN 'Returning — you kept this on ' || {_DATE.format('decided_at')} || '; the 10-day hold has expired.' END AS tag
FROM (SELECT *, date_diff('day', DATE '2024-02-05', CAST(suppressed_until AS DATE)) AS dr FROM st)""")
def _(spark, d):
    rows = log.suppression_status(aggregates(spark, d), dm.decisions(spark, d), as_of())
    args = F.col("state"), F.col("decided_at"), F.col("until")
    return rows.select("sender_id", log.status_description(*args, F.col("days_remaining")).alias("description"), log.returning_tag(*args).alias("tag"))


# -- review ----------------------------------------------------------------------------------------------------------------------


@query("build_review", "SELECT sender_id, message_count, state, method FROM st WHERE state IN ('never_decided', 'returning', 'unsuppressed') ORDER BY message_count DESC, last_seen DESC, sender_id LIMIT 20")
def build_review(spark, d):
    return review.build_review(aggregates(spark, d), dm.decisions(spark, d), as_of(), limit=20).select("sender_id", "message_count", "state", "method")


@query("hidden_count", "SELECT count(*) AS hidden FROM st WHERE state IN ('suppressed', 'suppressed_forever')")
def _(spark, d):
    return review.hidden_count(aggregates(spark, d), dm.decisions(spark, d), as_of())


@query("build_kept", f"SELECT sender_id, state, CASE WHEN state = 'suppressed_forever' THEN 'Never returns (kept forever)' ELSE 'Returns in ' || date_diff('day', DATE '2024-02-05', CAST(suppressed_until AS DATE)) || CASE WHEN date_diff('day', DATE '2024-02-05', CAST(suppressed_until AS DATE)) = 1 THEN ' day (' ELSE ' days (' END || {_DATE.format('suppressed_until')} || ')' END AS returns FROM st WHERE state IN ('suppressed', 'suppressed_forever')")
def _(spark, d):
    return review.build_kept(aggregates(spark, d), dm.decisions(spark, d), as_of()).select("sender_id", "state", "returns")


@query("sender_label", "SELECT sender_id, coalesce(max(from_name), max(from_address)) AS label, CASE arg_max(method, (confidence, received_at, id, uid)) WHEN 'one_click' THEN 'one-click' WHEN 'http_link' THEN 'link' WHEN 'mailto' THEN 'mailto' ELSE 'body link' END AS method FROM m GROUP BY sender_id")
def _(spark, d):
    return aggregates(spark, d).select("sender_id", review.sender_label(F.col("display_name"), F.col("display_address"), F.col("sender_id")).alias("label"), review.method_label(F.col("method")).alias("method"))


@query("mailbox_status", "SELECT count(*) AS senders, CAST(sum(message_count) AS BIGINT) AS messages, count(*) FILTER (state IN ('never_decided', 'returning', 'unsuppressed')) AS awaiting, count(*) FILTER (state IN ('suppressed', 'suppressed_forever')) AS hidden, (SELECT string_agg(folder || ':1:' || last_uid, ',' ORDER BY folder) FROM (SELECT folder, max(uid) AS last_uid FROM m GROUP BY folder)) AS folders FROM st")
def _(spark, d):
    marks = ingest.advance_watermark(dm.messages(spark, d).withColumn("uidvalidity", F.lit(1).cast("long")), None, as_of(), as_of())
    rows = review.mailbox_status(aggregates(spark, d), dm.decisions(spark, d), as_of(), marks)
    return rows.withColumn("folders", F.array_join(F.transform("folders", lambda f: F.concat_ws(":", f["folder"], f["uidvalidity"], f["last_uid"])), ","))


@query("sender_detail", "SELECT sender_id, message_count, state, (SELECT count(*) FROM dec WHERE dec.sender_id = st.sender_id) AS decisions, (SELECT count(*) FROM att WHERE att.sender_id = st.sender_id) AS attempts FROM st")
def _(spark, d):
    m = dm.messages(spark, d)
    known = m.select("sender_id", F.lit("from_address").alias("kind"), F.col("from_address").alias("value")).distinct()
    rows = review.sender_detail(m, known, dm.decisions(spark, d), dm.attempts(spark, d), as_of())
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return rows.select("sender_id", "message_count", "state", n("history").alias("decisions"), n("attempts").alias("attempts"))
