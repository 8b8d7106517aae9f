"""The driver's tables as mail: expressions that both engines read alike, so that every operator can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-05T00:00:00Z"

# One text for both engines. ``events`` is the table; times are zone-less and taken as UTC.
EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM {events}"
MESSAGES = """
SELECT event_id AS uid, concat('F', event_id % 3) AS folder, concat('m', event_id - CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) AS id,
  concat('u', user_id) AS sender_id, ts AS received_at,
  CASE event_type WHEN 'click' THEN 'one_click' WHEN 'view' THEN 'http_link' WHEN 'purchase' THEN 'mailto' ELSE 'body_link' END AS method,
  CAST(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.8 WHEN 'purchase' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence,
  concat('https://t', event_id % 7, '.example/u?c=', event_id) AS unsubscribe_uri, value > 60 AS suspicious,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Name ', user_id) END AS from_name,
  concat('n', user_id, '@s', user_id % 10, '.example') AS from_address
FROM {events} WHERE event_type <> 'error'
"""
DECISIONS = """
SELECT event_id AS id, concat('u', user_id) AS sender_id,
  CASE WHEN event_id % 4 = 0 THEN 'unsubscribe' WHEN event_id % 7 = 0 THEN 'unsuppress' ELSE 'keep' END AS decision, ts AS decided_at,
  CASE WHEN event_id % 4 = 0 OR event_id % 7 = 0 OR event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ts + INTERVAL '10' DAY ELSE ts + INTERVAL '3' MONTH END AS suppressed_until,
  CAST(NULL AS VARCHAR(10)) AS note
FROM {events} WHERE event_id % 9 = 0 AND user_id % 5 <> 0
"""
ATTEMPTS = """
SELECT event_id AS id, concat('u', user_id) AS sender_id, 'http_link' AS method, ts AS attempted_at,
  CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'pending_manual' ELSE 'failed' END AS result, concat('https://a.example/', event_id) AS target_uri
FROM {events} WHERE event_id % 11 = 0 AND day(ts) < 18
"""
MERGES = """
SELECT DISTINCT user_id AS id, concat('u', user_id) AS source_id, concat('u', CASE WHEN user_id % 10 = 3 THEN user_id - 1 ELSE user_id - 3 END) AS target_id, user_id % 20 <> 13 AS active
FROM {events} WHERE user_id % 10 = 3 OR (user_id % 10 = 5 AND user_id > 10)
"""
#: Senders with a state, as SQL over the views above.
VIEWS = {"m": MESSAGES, "dec": DECISIONS, "att": ATTEMPTS, "mrg": MERGES}


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view as a DataFrame; its instants are zone-less."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dict(events.dtypes)["ts"] != "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return spark.sql(text, events=events)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, MESSAGES)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, DECISIONS)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, ATTEMPTS)


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, MERGES)


def with_views(sql: str) -> str:
    """DuckDB text: the views that ``sql`` may name, in front of it."""
    views = ", ".join(f"{k} AS ({v.format(events='events')})" for k, v in VIEWS.items())
    return f"WITH {views}, agg AS ({AGGREGATES}), last AS ({LATEST}), st AS ({STATUS}) {sql}"


AGGREGATES = """
SELECT sender_id, count(*) AS message_count, min(received_at) AS first_seen, max(received_at) AS last_seen,
  arg_max(method, (confidence, received_at, id, uid)) AS method, max(confidence) AS confidence
FROM m GROUP BY sender_id
"""
LATEST = "SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY decided_at DESC, id DESC) = 1"
STATUS = """
SELECT agg.*, last.decided_at, CASE WHEN last.decision IS NULL THEN 'never_decided' WHEN last.decision = 'unsubscribe' THEN 'unsubscribed' WHEN last.decision = 'unsuppress' THEN 'unsuppressed'
  WHEN suppressed_until IS NULL THEN 'suppressed_forever' WHEN suppressed_until > TIMESTAMP '2024-02-05' THEN 'suppressed' ELSE 'returning' END AS state, suppressed_until
FROM agg LEFT JOIN last USING (sender_id)
"""


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages whose headers and bodies are spelled out from the events, with folds, repeats and encoded words."""
    events, cores = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.sparkContext.defaultParallelism
    if len(events.inputFiles()) < cores:  # a few small files are a few scan tasks, and building and parsing mail is worth all cores; a large table has its own
        events = events.repartition(cores)
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    own = F.concat(F.lit("s"), u % 10, F.lit(".example"))
    target = F.when(F.col("value") > 60, F.concat(F.lit("track"), i % 5, F.lit(".elsewhere.co.uk"))).otherwise(F.concat(F.lit("mail."), own))
    https = F.concat(F.lit("<https://"), target, F.lit("/u?c="), i, F.lit(">"))
    mail = F.concat(F.lit("<mailto:leave-"), i, F.lit("@"), target, F.lit("?subject=stop>"))
    stop = F.when(kind == "click", F.concat(F.lit("List-Unsubscribe: "), https, F.lit(",\r\n "), mail, F.lit("\r\nList-Unsubscribe-Post: List-Unsubscribe=One-Click\r\n")))
    stop = stop.when(kind == "view", F.concat(F.lit("List-Unsubscribe: "), https, F.lit("\r\n"))).when(kind == "purchase", F.concat(F.lit("List-Unsubscribe: "), mail, F.lit("\r\n"))).otherwise("")
    link = F.concat(F.lit('<p>Hi</p><a href=3D"https://'), target, F.lit("/leave?c=3D"), i, F.lit('">Se d=C3=A9sabonner</a>'))
    body = F.when(kind == "signup", link).otherwise('<a href=3D"/home">Home</a>')
    raw = F.concat(
        F.lit('From: "=?UTF-8?Q?Caf=C3=A9_'), u, F.lit('?=" <news-'), u, F.lit("@"), own, F.lit(">\r\nSubject: Hello\r\n\tagain "), i, F.lit("\r\nMessage-ID: <m"), i, F.lit("@x>\r\nX-Other: y\r\n"),
        F.when(i % 3 == 0, F.concat(F.lit('List-ID: "A list" <L'), u % 20, F.lit(".Lists.example>\r\n"))).otherwise(""), F.lit("DKIM-Signature: v=1; a=b;\r\n d=mail."), own, F.lit("; s=k\r\n"), stop,
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n"), body,
    )
    return events.select(F.concat(F.lit("F"), i % 3).alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), i.alias("uid"), F.col("ts").cast("timestamp_ntz").alias("internal_date"), raw.alias("raw"))
